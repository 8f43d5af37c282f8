from loomsight.llm import chat
from pyspark.sql import functions as F


def test_parts_and_attachments(spark):
    part = lambda t, text=None, ref=None, w=None, h=None, s=None, p=None: (t, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="i1", w=28, h=15), part("text", " and "), part("audio", ref="a1", s=1.5)]),
        (1, 1, "assistant", [part("text", "<|im_end|>\n"), part("document", ref="d1", p=2), part("text", "ok")]),
        (2, 0, None, None),
    ]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(chat.PART))])
    out = chat.format_chat(spark.createDataFrame(rows, schema))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = got[1]
    assert one.formatted == "<|im_start|>user\nsee <|image|> and <|audio|><|im_end|>\n<|im_start|>assistant\n<\\|im_end|>\n<|document|>ok<|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in one.attachments] == [("image", "i1", 4), ("audio", "a1", 38), ("document", "d1", 1024)]
    assert one.attachment_tokens == 1066 and one.loss == "<|im_end|>\nok"
    assert [tuple(t) for t in one.turns][1][0] == "assistant"
    assert got[2].formatted == "<|im_start|>\n<|im_end|>\n" and [tuple(t) for t in got[2].turns] == [("", "")]


def test_escapes_come_back(spark):
    texts = ["<|", "<\\|", "<\\\\|x<|", "<<||", "a\n<|im_end|>\n", "", "\\", "%0A", "<|im_start|>é"]
    df = spark.createDataFrame([(k, 0, t + "%<\n", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {k: [(t + "%<\n", t)] for k, t in enumerate(texts)}


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, None, "assistant", None), (None, None, "assistant", None)], "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    assert [(r.conv_id, r.n_turns) for r in out.collect()] == [(None, 2)]
    assert chat.format_chat(df.limit(0).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0
