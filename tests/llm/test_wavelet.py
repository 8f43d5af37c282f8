import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from loomsight.llm import wavelet as w

PATH = P.path("byte_bpe_50k.json")


def test_matrix_answers():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 511, 512, 513, 3000):
        ids = rng.integers(0, 40, n).astype(np.uint32)
        m = w.WaveletMatrix(w.pack(ids, np.array([n]), 16))
        assert (m.ids() == ids).all()
        for i in rng.integers(0, n, 20):
            assert m.access(int(i)) == ids[i]
        for t in (0, 5, 39, 40, 65535):
            at = np.flatnonzero(ids == t)
            i, j = sorted(map(int, rng.integers(0, n + 1, 2)))
            assert m.count(t) == len(at) and m.count(t, i, j) == ((at >= i) & (at < j)).sum()
            assert [m.find(t, k) for k in range(len(at))][:30] == at.tolist()[:30]
            with pytest.raises(IndexError):
                m.find(t, len(at))


def test_words_encode_as_texts_do():
    lib, mine = Tokenizer.from_file(PATH), w.ByteTokens(PATH)
    texts = ["a b", "a  b", " a", "a ", "\n\na\nb", "it's  \t\nfun ", "x<|endoftext|>y", "\x1c a", "é ü", "", " ", "a\0 b", "don't 12 34!! ##"]
    for t in texts:
        assert mine.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_shards(spark):
    rows = [(5, "b c"), (1, None), (3, ""), (2, "long " * 3000), (5, "b c"), (None, "x"), (9, "z")]
    lib = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, file string")
    got = sorted(w.read_shards(w.write_shards(docs, PATH, shard=100)).collect(), key=lambda r: r.start)
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert w.read_shards(w.write_shards(docs, PATH)).count() == 0


def test_random_texts_against_the_library():
    lib, mine = Tokenizer.from_file(PATH), w.ByteTokens(PATH)
    rng = np.random.default_rng(11)
    parts = ["a", "Zq", "é", "ß", "×", "÷", "Ā", "ɐ", "1", "23", " ", "  ", "\n", "\t", "\r", "'", "'s", "'ll", "’", "—", " ", " ", "漢字", "。", "　", "🙂", "\x1c", "\x85", "\0", ".", ",", "###", "_", "<|endoftext|>", "٣", "ª", "²", "́", "the", "Ж"]
    for _ in range(4000):
        t = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 14)))
        assert mine.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_many_rows_at_once_and_forgetting(monkeypatch):
    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("abcdé ,\n'1"), rng.integers(0, 60))) for _ in range(400)] + ["x <|endoftext|> y", ""]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    want = [[*lib.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    monkeypatch.setattr(w, "PIECES", 4096)
    mine = w.ByteTokens(PATH)
    for k in range(3):
        for a in range(0, len(texts), 40):
            b = min(len(texts), a + 40)
            ids, many = mine.rows(np.frombuffer(b"".join(raw[a:b]), np.uint8), off[a : b + 1] - off[a])
            assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == want[a:b]
        monkeypatch.setattr(w, "PIECES", 4096)
        mine.seen.n = max(mine.seen.n, 4000 * (k == 1))  # nearly full: the next new piece makes it start afresh


def test_a_long_text_is_encoded_in_stretches(monkeypatch):
    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(13)
    monkeypatch.setattr(w, "TEXT_BYTES", 50)
    mine = w.ByteTokens(PATH)
    for alphabet in ("abcé ×\n1,'s", "漢字 。", "Ж"):
        t = "".join(rng.choice(list(alphabet), 3000))
        assert mine.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_reads_few_blocks():
    rng = np.random.default_rng(14)
    ids = rng.integers(0, 50000, 40 * w.BLOCK).astype(np.uint32)
    m = w.WaveletMatrix(w.pack(ids, np.array([len(ids)]), 16))
    assert not m.opened and m.access(7 * w.BLOCK + 5) == ids[7 * w.BLOCK + 5] and len(m.opened) <= 32
    token = int(ids[12345])
    at = np.flatnonzero(ids == token)
    m.opened.clear()
    assert m.count(token) == len(at) and m.find(token, len(at) - 1) == at[-1] and len(m.opened) <= 80


def test_a_hot_and_a_null_id_are_dealt_over_parts(spark):
    rows = [(7, f"hot {k}") for k in range(300)] + [(None, f"null {k}") for k in range(100)] + [(k, "cold") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = w.write_shards(docs, PATH)
    lib = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, t in rows)
    got = sorted(w.read_shards(shards).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((a, b) for a, b, _ in want)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    of = {r.part: set(r.doc_ids) for r in shards.collect()}
    assert sum(7 in x for x in of.values()) > 3 and sum(None in x for x in of.values()) > 3
