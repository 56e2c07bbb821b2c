import random

from pyspark.sql import functions as F

from corpusflow.llm.chat import format_conversations, read_loss, read_turns, text_turns

ROW = "conv_id long, turn long, role string, text string"


def read(df):
    out = df.select("conv_id", "formatted", read_turns().alias("turns"), read_loss().alias("learned"), "loss")
    return {r.conv_id: r for r in out.collect()}


def test_round_trip(spark):
    rng = random.Random(5)
    bits = ["\\", "<", ">", "\\l", "\\g", "</turn>\n", "<turn user>\n", "\n", "é", "😀", "a b", "", "\\\\", "### Assistant:", "<image 1.1>"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "sys>tem\n", "a\\<b"]), text))
    got = read(format_conversations(text_turns(spark.createDataFrame(rows, ROW))))
    for conv in range(60):
        own = sorted(r for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2], r[3]) for r in own]
        assert list(got[conv].learned) == [r[3] for r in own if r[2] == "assistant"]


def test_odd_rows(spark):
    rows = [(1, 2, "user", "b"), (1, None, "user", "a"), (1, 2, "user", "b"), (1, 3, None, None), (None, 0, "assistant", "x"), (2, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as n", "2 as head", "3 as body")
    got = read(format_conversations(text_turns(df)))
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("user", "b"), ("user", "b"), ("", "")]
    assert got[None].learned == ["x"] and len(got[2].learned[0]) == 300_000
    assert format_conversations(text_turns(df.limit(0))).count() == 0


def test_parts(spark):
    part = "array<struct<kind:string,text:string,uri:string,units:double>>"
    rows = [
        (1, 0, "user", [("text", "see <this>: ", None, None), ("image", None, "s3://a.png", 2.0), ("text", " and ", None, None), ("audio", None, "b.wav", 1.5)]),
        (1, 1, "assistant", [("text", "ok", None, None), None, ("document", None, "c.pdf", None), ("vi>deo", None, None, 3.0)]),
        (1, 2, "user", None),
    ]
    out = format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}"))
    r = out.withColumn("learned", read_loss()).first()
    assert r.formatted == (
        "<turn user>\nsee \\lthis\\g: <image 1.2> and <audio 1.4></turn>\n"
        "<turn assistant>\nok<document 2.2><vi\\gdeo 2.3></turn>\n<turn user>\n</turn>\n"
    )
    assert [tuple(a) for a in r.attachments] == [
        (1, 2, "image", "s3://a.png", 512), (1, 4, "audio", "b.wav", 38), (2, 2, "document", "c.pdf", 600), (2, 3, "vi>deo", None, 0),
    ]
    assert r.attachment_tokens == 1150
    assert r.learned == ["ok<document 2.2><vi>deo 2.3>"]
    assert out.select(F.expr("transform(loss, s -> substring(formatted, cast(s.start as int) + 1, 2))")).first()[0] == ["ok"]
