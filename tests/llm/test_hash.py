"""Texts written to meet a weak hash: the Thue-Morse word and its complement."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from loomsight.llm import common, divergence, minhash, wavelet

T = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
U = T.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [256, 1024, 2048])
def test_spans_differ(n):
    data = np.frombuffer((T[:n] + U[:n]).encode(), np.uint8)
    a, b = common.span_hash(common.prefix_hash(data), np.array([0, n]), np.array([n, 2 * n]))
    assert a != b


def test_equal_spans_are_equal_wherever_they_stand():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, (1 << 22) + 4096).astype(np.uint8)  # long data: terms are reduced first
    data[-300:] = data[100:400]
    alone = common.prefix_hash(data[100:400])
    far, near = common.span_hash(common.prefix_hash(data), np.array([len(data) - 300, 100]), np.array([len(data), 400]))
    assert far == near == common.span_hash(alone, np.array([0]), np.array([300]))[0]


def test_tokens():
    lib, mine = Tokenizer.from_file(P.path("byte_bpe_50k.json")), wavelet.ByteTokens(P.path("byte_bpe_50k.json"))
    for n in (1024, 2048):
        for t in (T[:n] + "\n" + U[:n], " " + T[:n] + " " + U[:n], T[:n] + "." + U[:n]):
            assert mine.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_windows_and_shingles(spark):
    tail = " ".join(f"w{k}" for k in range(7))
    docs = spark.createDataFrame([(1, "en", f"{T} {tail} {U} {tail}"), (2, "en", f"{T} w x y z"), (3, "en", f"{U} w x y z")], "doc_id long, lang string, text string")
    assert divergence.measure(docs).filter("doc_id = 1").first().n_repeat_words == 0
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs.filter("doc_id > 1"), 85).collect()}
    assert found == {2: 2, 3: 3}
