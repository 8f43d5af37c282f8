import random

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import brute as near
from tests.llm.test_suffix import brute as repeats

SETS = {"en": "the cat sat on the mat and they were there with that dog near house".split(), "de": "der hund und die katze sind nicht auf dem tisch mit einem haus dort".split()}


def corpus():
    rnd = random.Random(8)
    text = lambda lang, n: " ".join(rnd.choice(SETS[lang]) + rnd.choice("abcdefgh") for _ in range(n))
    item = text("en", 30)
    passage = text("de", 60)
    rows = [(k, text(("en", "de")[k % 2], 60), ("en", "de")[k % 2]) for k in range(120)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(10)]  # copies
    rows += [(300 + k, rows[k][1] + " tail", rows[k][2]) for k in range(6)]  # near copies
    rows += [(400 + k, f"{text('de', 40)} {passage} {text('de', 40)}", "de") for k in range(3)]
    rows += [(500 + k, f"{text('en', 40)} {item} {text('en', 40)}", "en") for k in range(2)]
    rows += [(600, "ЖЖЖ ΩΩΩ ЩЩ " * 40, None), (601, None, "en"), (602, "12 34", None)]
    return rows, item


def test_run_against_brute_force(spark, tmp_path):
    rows, item = corpus()
    docs = [(a, b, c, "s", len(b or "")) for a, b, c in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(a, b) for a, b, _ in rows if a < 600]  # the last three are no known language
    kept = {a for a, _, _, k in near(left, 80) if k}
    left = [(a, b) for a, b in left if a in kept]
    assert not {200, 205, 209, 300, 305} & kept and {0, 5, 119, 401, 501} <= kept
    cut = {a: (n, removed) for a, n, removed, _, _ in repeats(left)}
    assert all(cut[a][1] > 200 for a in (400, 401, 402)) and cut[3][1] == 0
    left = [(a, b) for a, b in left if item not in b]
    assert {a for a, _ in left} & {500, 501} == set() and set(got) == {a for a, _ in left}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.no_padding()
    lib.no_truncation()
    for a, b in left:
        ids = lib.encode(b, add_special_tokens=False).ids
        if cut[a][1] == 0:
            assert got[a].ids == ids and got[a].n_tokens == len(ids)
        else:
            assert 0 < got[a].n_tokens < len(ids)



def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (7, text), (7, text + " more"), (9, "quite another text of a few words"), (9, "not at all like the other one here"), (None, None), (3, None), (None, "a lone row without an id but with words")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, __row int, component_id int")
    got = corpus_pipeline._near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = [(7, text), (9, rows[3][1]), (9, rows[4][1]), (None, None), (3, None), (None, rows[7][1])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
