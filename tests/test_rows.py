"""Source layouts and structured rows."""

from corpusloom.operators import rows as R
from pyspark.sql import functions as F


def test_layouts(spark):
    df = spark.createDataFrame([(1, " a ", "b"), (2, "", "b")], "i int, problem string, solution string")
    assert [r.messages and [tuple(m) for m in r.messages] for r in R.to_chat(df, "problem_solution").orderBy("i").collect()] == [[("user", "a"), ("assistant", "b")], None]
    df = spark.createDataFrame([(1, [("Human", "x"), ("gpt", "y")]), (2, []), (3, [("robot", "x")]), (4, [("user", " ")])], "i int, messages array<struct<role:string,content:string>>")
    assert [r.messages and [tuple(m) for m in r.messages] for r in R.to_chat(df, "messages").orderBy("i").collect()] == [[("user", "x"), ("assistant", "y")], None, None, None]


def test_problems(spark):
    df = spark.createDataFrame([("s", ["1"], ["2"], 0), ("", ["1"], ["2"], 0), ("s", ["1"], [], 0), ("s", None, ["2"], 0), ("s", ["1"], ["2"], 3)], "s string, a array<string>, b array<string>, n int").coalesce(1)
    got = df.select(R.problem_reason(F.col("s"), F.col("a"), F.col("b"), F.col("n")).alias("r"), R.test_cases(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.r for r in got] == [None, "empty_statement", "no_or_mismatched_tests", "no_or_mismatched_tests", "image_in_statement"] and tuple(got[0].c[0]) == ("1", "2")


def test_json_rows(spark):
    df = spark.createDataFrame(
        [('{"summary": "a summary of enough length", "flow": ["x"]}', "1", '["pass","PASS","pass","pass","pass"]', '{"a": {"score": 5}}'), ('{"summary": "short", "flow": ["x"]}', "1.0", '["pass"]', "{}"), ("bad", "x", "bad", "bad")],
        "d string, s string, t string, j string",
    ).coalesce(1)
    got = df.select(R.described(F.col("d")).isNotNull().alias("d"), R.all_tests_pass(F.col("s"), F.col("t"), F.col("j")).alias("p")).collect()
    assert [(r.d, r.p) for r in got] == [(True, True), (False, False), (False, False)]


def test_small_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3], [False, True, True], "C++17", ["interactive"], [("assistant", "<think> </think>\nx")])], "ids array<int>, m array<boolean>, l string, tags array<string>, chat array<struct<role:string,content:string>>")
    r = df.select(
        R.shifted(F.col("ids"), F.col("m")).alias("s"), R.supported_language(F.col("l"), ["python", "c++"]).alias("ok"), R.category(F.lit("b"), {"x": ["a"], "y": ["b"]}).alias("c"),
        R.without_empty_think(F.col("chat"))[0]["content"].alias("t"), *R.record(F.lit(" q "), "src", extra=F.lit(1)),
    ).first()
    assert (r.s.x, r.s.y, r.s.mask, r.ok, r.c, r.t) == ([1, 2], [2, 3], [True, True], True, "y", "x") and r.source == "src" and r.extra == 1
    assert R.only_untagged(df, "tags", "interactive").count() == 0
    many = spark.range(400).select("id", F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content"))).alias("m"))
    with_system = many.where(F.size(R.maybe_system(F.col("m"), "S", 0.25, 1, F.col("id"))) == 2).count()
    assert 60 < with_system < 140
