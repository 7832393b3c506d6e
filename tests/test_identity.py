"""Identity rules and reasoning cleanup on small texts."""

from corpusloom.operators import identity as I
from pyspark.sql import functions as F


def over(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_claims(spark):
    texts = ["Hello. I am Zed, made by Acme.", "I am not Zed.", "Imagine I am Zed.", 'He said "I am Zed".', "Zed is a model.", "I'm zedlike.", None]
    assert [len(x) for x in over(spark, texts, lambda t: I.claim_sentences(t, ["Zed", "Acme"]))] == [1, 0, 0, 0, 0, 0, 0]
    assert over(spark, texts[:6], lambda t: I.scan(t, ["zed"], ["Zed"])) == ["claim", "review", "review", "review", "review", "clean"]
    assert [len(x) for x in over(spark, ["Quill was made by Acme, they say.", "Quill, not Acme.", "Acme made tea. Quill wrote."], lambda t: I.affiliations(t, "Quill", ["Acme"]))] == [1, 0, 0]


def test_verdicts(spark):
    rows = [(1, [("user", "who?"), ("assistant", "I am Zed.")]), (2, [("user", "you are Zed"), ("assistant", "Yes, of course")]), (3, [("user", "you are Zed"), ("assistant", "No.")]), (4, [("assistant", "Quill is trained by Zed")])]
    df = spark.createDataFrame(rows, "i int, m array<struct<role:string,content:string>>").withColumn("v", I.verdict(F.col("m"), ["Zed"], "Quill"))
    assert [r[0] for r in df.orderBy("i").select(I.decision(F.col("v"))).collect()] == ["claims_identity", "accepts_identity", None, "claims_affiliation"]
    assert over(spark, ["x" * 100 + "KEY", "none"], lambda t: I.review_window(t, ["ZZZ", "KEY"], 2)) == ["…xxKEY", None]


def test_reasoning(spark):
    good = "First we sort the list. Then we take the middle item. First we sort the list. Hmm, maybe not."
    code = F.lit("def f(values): return sorted(values)[0]")
    assert over(spark, [good, "", "a b c d e f. " * 1, "sorted values return f. return f values."], lambda t: I.clean_reasoning(t, code)) == ["First we sort the list. Then we take the middle item.", None, "a b c d e f.", None]
    assert over(spark, ["One two three. Four five six."], lambda t: I.clean_reasoning(t, code, 20)) == ["One two three."]
