import hashlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomsight.llm import alignment
from loomsight.llm.bpe import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "Zq", "é", "ß", "Ā", "1", "23", " ", "  ", "\n", "\t", "'s", "’", "—", " ", "漢字", "。", "🙂", "\0", ".", "###", "<|endoftext|>", "<s>", "<0x41>", "٣", "́", "the", "Ж", "ﬁ", " international", "aaaaaa"]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


def plain(texts, libraries):
    """The contract, text by text."""
    t, s = libraries
    of = {c: b for b, c in byte_letters().items()}
    letters = {i: bytes(of[c] for c in w) for w, i in t.get_vocab().items() if all(c in of for c in w)}
    piece = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        left, right = [letters[i] for i in a], [piece(i) for i in b]
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            rows.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        groups, low = [], 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(([i for i, e in zip(a, ea) if low < e <= cut], [i for i, e in zip(b, eb) if low < e <= cut]))
            low = cut
        rows.append((len(a), len(b), groups))
        counts.update({p for x, y in groups for p in product(x, y)})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [p for x, y in r[2] for p in product(x, y)]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2])
        out.append((r[0], r[1], len(r[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def texts(n=400):
    rng = np.random.default_rng(3)
    made = ["".join(PARTS[k] for k in rng.integers(0, len(PARTS), rng.integers(0, 30))) for _ in range(n)]
    return [*made, None, "", " ", "   ", "a▁b", "▁", "same text twice", "same text twice", "word " * 3000]


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_against_the_libraries(spark, libraries, most, monkeypatch):
    monkeypatch.setattr("loomsight.llm.common.HOT_ROWS", 20)  # common pairs are dealt over parts
    given = texts()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(given)], "doc_id long, text string, row string, pair int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(docs, A, B, most).collect()}
    want = plain(given, libraries)
    assert [got[k] for k in range(len(given))] == want
    assert got[len(given) - 5] == (0, 0, 0, 0, 0, 0, "")


def test_words_alone_as_in_their_text(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 50)
    mine = alignment.PieceTokens(B)
    for t in texts(1500):
        raw = (t or "").encode()
        ids, many, good = mine.rows(raw, np.array([0, len(raw)]))
        if good[0]:
            assert ids.tolist() == (libraries[1].encode(t) if t else [])
        else:
            assert "▁" in t


def test_no_rows_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty, A, B).count() == 0
    docs = spark.createDataFrame([(None, "one"), (3, "one"), (3, "one"), (None, None)], "doc_id long, text string")
    got = sorted(alignment.aligned(docs, A, B).collect(), key=str)
    assert len(got) == 4 and [r.count_sum for r in got].count(0) == 1 and len({r.groups_sha256 for r in got}) == 2


def test_no_python_behind_the_tokens(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tokens = spark.createDataFrame(alignment.tokenised(docs, A, B).collect(), alignment.TOKENS)
    plan = alignment.grouped(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


def test_arrays_are_as_long_as_tokens(spark):
    """What Spark gets of a text grows with its tokens, not with its bytes."""
    docs = spark.createDataFrame([(1, " international" * 50)], "doc_id long, text string")
    row = alignment.tokenised(docs, A, B).collect()[0]
    arrays = [x for x in row if isinstance(x, list)]
    assert max(map(len, arrays)) <= 110 and sum(map(len, arrays)) <= 330


def test_words_are_asked_once(monkeypatch):
    mine, asked = alignment.PieceTokens(B), []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode(self, words, **more):
            asked.extend(words)
            return self.library.encode(words, **more)

        def __getattr__(self, name):
            return getattr(self.library, name)

    mine.library = Counted(mine.library)
    raw = ("word " + "long" * 30 + " word").encode()
    first, again = (mine.rows(raw, np.array([0, len(raw)])) for _ in range(2))
    assert first[0].tolist() == again[0].tolist() and sorted(asked) == ["long" * 30, "word"]
