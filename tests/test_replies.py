from pyspark.sql import functions as F

from keepsieve.functions import replies
from keepsieve.operators.query import primary_link


def test_answers(spark):
    body = '{"answers":{"a":{"type":"boolean","probability":0.75},"b":{"type":"choice","choice":"x","probabilities":{"x":0.6}}}}'
    df = spark.createDataFrame([(body,), (None,), ("no",)], "b string").withColumn("m", replies.answers(F.col("b")))
    r = df.select(replies.probability_of(F.col("m")["a"], "true"), replies.probability_of(F.col("m")["a"], "false"), replies.probability_of(F.col("m")["b"], "x"), F.col("m")["b"]["choice"]).collect()
    assert tuple(r[0]) == (0.75, 0.25, 0.6, "x") and tuple(r[1]) == (None,) * 4
    assert [x[0] for x in spark.createDataFrame([("0.5",), ("x",), (None,)], "v string").select(replies.dollars(F.col("v"))).collect()] == [0.5, None, None]


def test_agent_replies(spark):
    ev = spark.createDataFrame([(1, 1, '{"part":{"text":"a"}}'), (1, 2, '{"type":"step"}'), (1, 3, '{"result":"```json\\n{\\"title\\":\\"T\\"}\\n```"}'), (2, 1, "broken")], "reply int, line_no int, line string")
    got = replies.last_text(ev).select("reply", replies.title_and_summary(F.col("text"))["title"].alias("t")).collect()
    assert [tuple(r) for r in got] == [(1, "T")]


def test_plain_helpers():
    assert replies.cookies("# c\n.x.com\tTRUE\t/\tTRUE\t0\tct0\tv\nauth=1; b=2") == {"ct0": "v", "auth": "1", "b": "2"}
    assert replies.question_problem("choice", 300) and replies.question_problem("score", 1) and replies.question_problem("score", 5) is None
    assert replies.retry_seconds(9, 1.0) == 16.0


def test_primary_link(spark):
    row = "array<struct<resolved:string,kind:string,title:string,body:string>>"
    df = spark.createDataFrame([([("a", "unknown", None, None), ("b", "video", "t", ""), ("c", "article", "t", ""), ("d", "image", None, "text")],), ([("a", "unknown", None, None)],), ([],), (None,)], f"links {row}")
    assert [r[0] for r in df.select(primary_link(F.col("links"))).collect()] == ["d", "a", None, None]
