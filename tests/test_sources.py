"""Readers, writers, streams and the registry."""

import gzip
import json

import pytest
from corpusloom.sources import tables as S
from corpusloom.streaming import events as E
from pyspark.sql import functions as F


def test_names():
    assert S.classify("a/b.JSONL.gz") == "jsonl" and S.classify("x.pq") == "parquet" and S.classify("report.json") is None
    assert S.source_key("a/c.jsonl") == S.source_key("a/c.parquet") == "a/c"
    assert S.widen("bigint", "double") == "double" and S.widen("bigint", "boolean") == "string" and S.widen(None, "bigint") == "bigint"
    assert S.preset_of(["conversations", "gt"]) == "agent" and S.preset_of(["x"]) == "generic"


def test_read_and_write(spark, tmp_path):
    rows = [{"text": f"t{i}", "n": i} for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"text": "z", "n": 9}) + "\n")
    (tmp_path / "report.json").write_text("{}")
    df = S.read_source(spark, str(tmp_path), columns=["text", "n"])
    assert sorted(r.n for r in df.collect()) == [0, 1, 2, 3, 4, 9] and S.footprint(spark, str(tmp_path)) > 0
    S.write_corpus(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="exists"):
        S.write_corpus(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    S.split_write(df, F.col("n") > 3, f"{tmp_path}/kept", f"{tmp_path}/dropped")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 2 and spark.read.parquet(f"{tmp_path}/dropped").count() == 4
    S.write_chunks(df.withColumn("chunk_index", F.col("n") % 2), f"{tmp_path}/chunks")
    assert spark.read.parquet(f"{tmp_path}/chunks/chunk_index=1").count() == 3
    S.write_report(spark, f"{tmp_path}/r.json", {"rows": 6})
    assert json.loads((tmp_path / "r.json").read_text()) == {"rows": 6}
    with pytest.raises(FileExistsError):
        S.write_report(spark, f"{tmp_path}/r.json", {})
    digests = S.file_digests(spark, f"{tmp_path}/*.jsonl")
    assert digests.count() == 1 and S.unseen_files(spark, digests, digests).count() == 0


def test_broken_lines_and_arrays(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('﻿{"a": 1}\r\n\n{bad\n{"a": 2}')
    got = S.read_tolerant(spark, f"{tmp_path}/x.jsonl", "a int").collect()
    assert [r._corrupt for r in got if r._corrupt] == ["{bad"]
    lines = S.read_lines(spark, f"{tmp_path}/x.jsonl").orderBy("line").collect()
    assert [(r.line, r.value) for r in lines] == [(1, '{"a": 1}'), (3, "{bad"), (4, '{"a": 2}')]
    (tmp_path / "y.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in S.read_array(spark, f"{tmp_path}/y.json", "a int").collect()) == [1, 2]


def test_code_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "skip").mkdir()
    for name, data in {"src/a.py": b"x = 1\n" * 20, "src/b.py": b"x", "src/c.py": b"\0" * 100, "skip/d.py": b"y = 2\n" * 20, "src/e.txt": b"z" * 100}.items():
        (tmp_path / name).write_bytes(data)
    got = S.read_code_tree(spark, str(tmp_path), [".py"], skip=["skip"]).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.py"]


def test_conform_and_presets(spark):
    df = spark.createDataFrame([("t", {"k": 1}, [("user", 1)], [1, 2])], "text string, meta map<string,int>, conv array<struct<role:string,n:int>>, v array<int>")
    assert dict(S.planned_schema(df)) == {"text": "string", "meta": "string", "conv": "array<struct<role:string,n:string>>", "v": "array<int>"}
    r = S.conform(df).first()
    assert r.meta == '{"k":1}' and r.conv[0].n == "1" and r.v == [1, 2]
    assert S.require_preset(df, "pretrain") is df
    with pytest.raises(ValueError):
        S.require_preset(df, "sft")


def test_stream_is_written_once(spark, tmp_path):
    spark.range(50).withColumn("ts", F.timestamp_seconds(F.col("id") + 1_000_000_000)).write.parquet(f"{tmp_path}/in")
    schema = "id long, ts timestamp"
    for _ in range(2):
        stream = E.first_seen(E.read_stream(spark, f"{tmp_path}/in", schema), ["id"], "ts", "1 hour")
        E.append_once(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    seen = []
    E.each_batch(E.read_stream(spark, f"{tmp_path}/in", schema), lambda df, n: seen.append(df.count()), f"{tmp_path}/state2").awaitTermination()
    assert sum(seen) == 50
    assert E.progress(10, 100, 5)["left"] == 45


def test_registry_without_the_training_data_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'build_reason_ladder' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120).returncode == 0


def test_no_folder_of_our_own_on_a_cluster(spark):
    from types import SimpleNamespace

    from corpusloom.sources import staging

    nowhere = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nowhere)))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session)
    assert staging.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: "hdfs://all/"))) == "hdfs://all"
    mark = staging.stored_count()
    one, two = (staging.stored(spark.range(n), "t") for n in (3, 4))
    staging.forget(one)
    assert two.count() == 4 and staging.drop_stored(spark, since=mark) == 1


def test_strict_lines_name_the_broken_one(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match=r"a\.jsonl:3"):
        S.read_strict(spark, str(tmp_path / "a.jsonl"), "a int").collect()


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\ufeffone\r\n\n" + "".join(f"line {n}\n" for n in range(3, 4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.line: r.value for r in S.read_lines(spark, str(tmp_path / "x.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {1: "one", **{n: f"line {n}" for n in range(3, 4000)}}
