import hashlib
import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from loomsight.llm import bpe

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.no_padding()
LIB.no_truncation()


def test_as_the_library():
    rnd, mine = random.Random(1), bpe.load(PATH)
    pool = [*"aabbcc  éßΣİŁ'srt1²½٣\n\t\x1c\x85　́é中ǅ!?##", "<|endoftext|>", "'s", "the", "ing"]
    for _ in range(600):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))
        want = LIB.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == want, text
        assert mine.decode(want, "joined") == LIB.decode(want, skip_special_tokens=False)


def test_long_words_stream():
    rnd, mine = random.Random(2), bpe.load(PATH)
    for k in range(30):
        word = "a" * rnd.randint(900, 3000) if k % 3 == 0 else "".join(rnd.choice(["th", "the", "in", "ing", "an", "tion", "aa"]) for _ in range(900))
        assert mine.encode(word).tolist() == LIB.encode(word, add_special_tokens=False).ids


def test_emitted_tokens_are_final():
    t, rnd = bpe.load(PATH).transducer, random.Random(3)
    inner = bpe.load(PATH).inner
    for _ in range(20):
        symbols = [inner[ord(rnd.choice("aeinorst"))] for _ in range(1500)]
        out, most = [], 0
        for s in symbols:
            out += t.feed([s])
            most = max(most, len(t.pending))
        assert most <= t.step
        assert out + t.finish() == t._merge(symbols)


def test_small_merge_list_lookahead():
    # b c merges first, so whether "a b" stays together depends on one further symbol
    merges = [(1, 2, 3), (0, 1, 4)]
    assert bpe.sufficient_lookahead(merges, {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}) == 2
    assert bpe.sufficient_lookahead([], {0: 1}) == 0


def test_text_mode_is_incremental():
    mine = bpe.load(PATH)
    ids = mine.encode("Día 中文 naïve").tolist()
    d = bpe.Decoder(mine)
    assert "".join(d.feed([i]) for i in ids) + d.feed([], True) == "día 中文 naïve "


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (3, "", 3), (1, "a b", 1)], "doc_id long, text string, ids long")
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()))
    ids = LIB.encode("a b", add_special_tokens=False).ids
    none = hashlib.sha256(b"").hexdigest()
    one = (1, 2, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == [one, one, (2, 0, none, none), (3, 0, none, none)]
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(docs, PATH).collect())[0] == (1, ids)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
