"""Sources and sinks: tables written in some form and read back, against the tables themselves."""

from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.operators import joins as J
from corpusloom.operators import plans as L
from corpusloom.operators import rows as R
from corpusloom.operators import sampling as S
from corpusloom.plans.registry import query, read
from corpusloom.sources import tables as Z
from corpusloom.sources.staging import fresh_path

NAMES = ["a.parquet", "b.PQ", "c.jsonl", "d.ndjson", "e.jsonl.gz", "f.json.gz", "g.json", "h.txt"]


@query(
    "source_classify",
    """SELECT * FROM (VALUES ('a.parquet', 'parquet', 'a'), ('b.PQ', 'parquet', 'b'), ('c.jsonl', 'jsonl', 'c'), ('d.ndjson', 'jsonl', 'd'), ('e.jsonl.gz', 'jsonl', 'e'),
('f.json.gz', 'jsonl', 'f'), ('g.json', NULL, 'g.json'), ('h.txt', NULL, 'h.txt')) t(name, kind, key)""",
)
def classify(spark, sf):
    return spark.createDataFrame([(n, Z.classify(n), Z.source_key(n)) for n in NAMES], "name string, kind string, key string")


@query("source_resolve", "SELECT 'parquet' AS kind, count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def resolve(spark, sf):
    """A folder with both formats: the Parquet files are the corpus."""
    path, orders = fresh_path(spark, "both"), read(spark, sf, "orders")
    orders.write.parquet(path)
    orders.limit(5).write.mode("append").json(path)
    kind, _ = Z.source_files(spark, path)
    return Z.read_source(spark, path, columns=["o_custkey"]).agg(F.lit(kind).alias("kind"), F.count("*").alias("n_rows"), F.sum("o_custkey").alias("total"))


@query("source_parquet", "SELECT doc_id, md5(text) AS digest FROM documents WHERE lang = 'en'")
def parquet(spark, sf):
    path = fresh_path(spark, "corpus")
    Z.write_corpus(read(spark, sf, "documents"), path)
    return Z.read_source(spark, path, columns=["doc_id", "text", "lang"]).where("lang = 'en'").select("doc_id", F.md5("text").alias("digest"))


@query("source_jsonl", "SELECT doc_id, md5(text) AS digest, n_chars FROM documents")
def jsonl(spark, sf):
    path = fresh_path(spark, "lines")
    Z.write_jsonl(read(spark, sf, "documents"), path, gzip=True)
    return Z.read_strict(spark, path, "doc_id long, text string, n_chars long").select("doc_id", F.md5("text").alias("digest"), "n_chars")


@query("source_tolerant", "SELECT count(*) AS n_rows, count(*) FILTER (c_custkey % 7 = 0) AS n_broken, CAST(sum(c_custkey) FILTER (c_custkey % 7 <> 0) AS BIGINT) AS total FROM customer")
def tolerant(spark, sf):
    path = fresh_path(spark, "broken")
    line = F.to_json(F.struct("c_custkey", "c_name"))
    read(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.rtrim(F.substring(line, 1, 12))).otherwise(line).alias("value")).write.text(path)
    rows = Z.read_tolerant(spark, path, "c_custkey long, c_name string").select("c_custkey", "_corrupt")
    return rows.agg(F.count("*").alias("n_rows"), F.count("_corrupt").alias("n_broken"), F.sum(F.when(F.col("_corrupt").isNull(), F.col("c_custkey"))).alias("total"))


@query("source_array", "SELECT n_nationkey, n_name FROM nation")
def array(spark, sf):
    path = fresh_path(spark, "array")
    rows = read(spark, sf, "nation").agg(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name"))).alias("r"))
    rows.select(F.concat(F.lit("[\n"), F.array_join("r", ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.text(path)
    return Z.read_array(spark, path, "n_nationkey int, n_name string")


@query("source_lines", "SELECT CAST(i AS BIGINT) + 1 AS line, 'line ' || i AS value FROM range(5000) t(i) WHERE i % 5 <> 0")
def lines(spark, sf):
    path = fresh_path(spark, "text")
    text = F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit("line "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "\r").otherwise("")))
    spark.range(0, 5000, 1, 1).select(text.alias("value")).write.text(path)
    return Z.read_lines(spark, path).select("line", "value")


@query("source_tail", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1000")
def tail(spark, sf):
    """What follows the consumed head of a table."""
    return S.numbered(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey").where("row_number >= 1000").select("o_orderkey")


@query("source_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def lookup(spark, sf):
    keys = read(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.lookup(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), keys, "o_orderkey")


@query("source_spaced", "SELECT CAST(i * 25 // 7 AS BIGINT) AS shard, 1 AS round FROM range(7) t(i) UNION ALL SELECT f[CAST(i * 18 // 6 AS BIGINT) + 1], 2 FROM range(6) t(i), (SELECT list(s ORDER BY s) AS f FROM range(25) r(s) WHERE s NOT IN (SELECT i * 25 // 7 FROM range(7) t(i)))")
def spaced(spark, sf):
    first = S.spaced(25, 7)
    second = S.spaced(25, 6, frozenset(first))
    return spark.createDataFrame([(s, 1) for s in first] + [(s, 2) for s in second], "shard long, round int")


@query("source_code_tree", "SELECT item_id, md5(text || chr(10)) AS digest FROM benchmark WHERE octet_length(encode(text)) + 1 BETWEEN 40 AND 81920")
def code_tree(spark, sf):
    path = fresh_path(spark, "tree")
    read(spark, sf, "benchmark").select(F.col("text").alias("value"), "item_id").repartition("item_id").write.partitionBy("item_id").text(path)
    found = Z.read_code_tree(spark, path, [".txt"], skip=["node_modules"])
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.md5("text").alias("digest"))


@query(
    "source_layouts",
    """SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10)) = '' THEN NULL ELSE md5('user' || chr(31) || source || chr(30) || 'assistant' || chr(31) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS digest, layout
FROM documents, (VALUES ('prompt_completion'), ('instruction_response'), ('problem_solution')) t(layout)""",
)
def layouts(spark, sf):
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e")
    out = None
    for name, (a, b) in R.LAYOUTS.items():
        own = R.to_chat(read(spark, sf, "documents").select("doc_id", F.col("source").alias(a), F.col("text").alias(b)), name)
        part = own.select("doc_id", F.md5(joined).alias("digest"), F.lit(name).alias("layout"))
        out = part if out is None else out.unionByName(part)
    return out


@query("source_footers", "SELECT count(*) AS n_rows, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns, 'ZSTD' AS codecs, true AS grows FROM orders")
def footers(spark, sf):
    """The footers of a written corpus, and whether its footprint is their uncompressed size and 5 percent."""
    path = fresh_path(spark, "footers")
    Z.write_corpus(read(spark, sf, "orders"), path)
    found = Z.footers(spark, path)
    size = sum(int(f["bytes"] * 1.05) for f in found)
    row = (sum(f["rows"] for f in found), ",".join(found[0]["columns"]), ",".join(sorted({c for f in found for c in f["codecs"]})), Z.footprint(spark, path) == size > 0)
    return spark.createDataFrame([row], "n_rows long, columns string, codecs string, grows boolean")


@query("source_unseen", "SELECT 1 AS n_files, 0 AS n_again, 1 AS n_changed, sha256('[{\"a\":1}]' || chr(10)) AS sha256")
def unseen(spark, sf):
    """A file counts as seen with the same path and digest only."""
    path = fresh_path(spark, "seen")
    one = spark.range(1).select(F.lit('[{"a":1}]').alias("value")).coalesce(1)
    one.write.text(path)
    first = Z.file_digests(spark, path).where("path LIKE '%.txt'")
    other = first.withColumn("sha256", F.lit("0"))
    counts = [Z.unseen_files(spark, first, m).count() for m in (first, other)]
    streamed = Z.file_digests(spark, path, whole=0).where("path LIKE '%.txt'").select("sha256")
    return streamed.select(F.lit(first.count()).alias("n_files"), F.lit(counts[0]).alias("n_again"), F.lit(counts[1]).alias("n_changed"), "sha256")


@query("sink_raw", "SELECT md5(to_json({c_custkey: c_custkey, c_name: c_name})) AS digest FROM customer WHERE c_custkey % 3 = 0")
def raw(spark, sf):
    """Lines that a filter on the parsed rows keeps, byte for byte."""
    path, kept = fresh_path(spark, "raw"), fresh_path(spark, "kept")
    Z.write_jsonl(read(spark, sf, "customer").select("c_custkey", "c_name"), path)
    Z.write_raw(Z.read_raw(spark, path, "c_custkey long").where("row.c_custkey % 3 = 0"), kept)
    return spark.read.text(kept).select(F.md5("value").alias("digest"))


@query("sink_chunks", "SELECT doc_id // 100 AS chunk_index, count(*) AS n_rows, CAST(sum(count(*)) OVER (ORDER BY doc_id // 100) AS BIGINT) AS \"end\" FROM documents GROUP BY 1")
def chunks(spark, sf):
    path = fresh_path(spark, "chunks")
    Z.write_chunks(L.fixed_chunks(read(spark, sf, "documents"), "doc_id", 100), path)
    bounds = Z.recorded_bounds(spark, path)
    return bounds.select(F.col("chunk_index").cast("long").alias("chunk_index"), "n_rows", "end")


@query("sink_chunk_read", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id // 100 = 1")
def chunk_read(spark, sf):
    path = fresh_path(spark, "chunks")
    Z.write_chunks(L.fixed_chunks(read(spark, sf, "documents"), "doc_id", 100), path)
    return Z.read_chunk(spark, path, 1).select("doc_id", F.md5("text").alias("digest"))


@query("sink_split", "SELECT doc_id, lang = 'en' AS kept FROM documents")
def split(spark, sf):
    kept, dropped = fresh_path(spark, "kept"), fresh_path(spark, "dropped")
    Z.split_write(read(spark, sf, "documents"), F.col("lang") == "en", kept, dropped)
    return spark.read.parquet(kept).select("doc_id", F.lit(True).alias("kept")).unionByName(spark.read.parquet(dropped).select("doc_id", F.lit(False).alias("kept")))


@query("sink_report", "SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars, 'documents' AS name FROM documents")
def report(spark, sf):
    path = fresh_path(spark, "report") + ".json"
    sums = read(spark, sf, "documents").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars")).first().asDict()
    Z.write_report(spark, path, {"name": "documents", **sums})
    return spark.read.schema("n_rows long, n_chars long, name string").option("multiLine", True).json(path)


@query("sink_provenance", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def provenance(spark, sf):
    path = fresh_path(spark, "provenance")
    Z.write_with_provenance(read(spark, sf, "documents"), path, "doc_id", ["text"], ["source", "lang"])
    rows, origin = (spark.read.schema(s).json(f"{path}/{d}") for s, d in (("doc_id long, text string", "rows"), ("doc_id long, source string", "provenance")))
    return J.zip_rows(rows, origin, "doc_id").select("doc_id", F.md5("text").alias("digest"), "source")


@query("sink_compile", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def compiled(spark, sf):
    folder, target = fresh_path(spark, "folder"), fresh_path(spark, "compiled")
    Z.write_jsonl(read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").coalesce(1), f"{folder}/in")
    part = next(n for n, _ in Z._listing(spark, f"{folder}/in") if n.endswith(".json"))
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(f"{folder}/customers.jsonl"))
    done = Z.compile_folder(spark, folder, target)
    return spark.read.parquet(*done)


@query(
    "schema_fold",
    """SELECT * FROM (VALUES ('id', 'bigint', false), ('mixed', 'string', false), ('number', 'double', false), ('late', 'boolean', true), ('tags', 'array<string>', false),
('chat', 'array<struct<`role`:string,`content`:string,`extra`:string>>', false), ('never', 'string', true), ('either', 'string', false)) t(name, type, nullable)""",
)
def fold(spark, sf):
    """The schema that all lines together have, folded from parts of them."""
    i = F.col("o_orderkey")
    chat = F.when(i % 2 == 0, F.lit('[{"content": "x", "role": "user"}]')).otherwise(F.lit('[{"role": "user", "extra": 1}, {"content": "y"}]'))
    pieces = [
        F.lit('{"id": '), i.cast("string"), F.lit(', "mixed": '), F.when(i % 2 == 0, "true").otherwise("3"), F.lit(', "number": '), F.when(i % 3 == 0, "1").otherwise("2.5"),
        F.when(i % 4 == 0, ', "late": true').otherwise(""), F.lit(', "tags": '), F.when(i % 2 == 0, "[]").otherwise('["a"]'), F.lit(', "chat": '), chat,
        F.when(i % 2 == 0, ', "never": null').otherwise(""), F.lit(', "either": '), F.when(i % 2 == 0, "[1]").otherwise("7"), F.lit("}"),
    ]
    return spark.createDataFrame(Z.folded_schema(read(spark, sf, "orders").select(F.concat(*pieces).alias("value"))), "name string, type string, nullable boolean")


@query("schema_conform", "SELECT doc_id, md5(to_json({lang: lang, source: source})) AS about, md5('n' || chr(31) || n_chars) AS parts FROM documents")
def conform(spark, sf):
    nested = read(spark, sf, "documents").select("doc_id", F.struct("lang", "source").alias("about"), F.array(F.struct(F.lit("n").alias("name"), F.col("n_chars").alias("value"))).alias("parts"))
    out = Z.conform(nested)
    return out.select("doc_id", F.md5("about").alias("about"), F.md5(F.concat_ws("\x1f", F.col("parts")[0]["name"], F.col("parts")[0]["value"])).alias("parts"))


@query("schema_presets", "SELECT * FROM (VALUES ('text', 'pretrain'), ('conversations', 'sft'), ('chosen,rejected', 'dpo'), ('conversations,gt', 'agent'), ('x', 'generic')) t(columns, preset)")
def presets(spark, sf):
    return spark.createDataFrame([(c, Z.preset_of(c.split(","))) for c in ("text", "conversations", "chosen,rejected", "conversations,gt", "x")], "columns string, preset string")


@query("rows_all_text", "SELECT doc_id, md5(concat_ws(chr(10), text, lang, source, 'a', 'b')) AS digest FROM documents")
def all_text(spark, sf):
    d = read(spark, sf, "documents").withColumn("more", F.array(F.struct(F.lit("a").alias("x"), F.lit(3).alias("n")), F.struct(F.lit("b").alias("x"), F.lit(4).alias("n")), F.struct(F.lit(None).cast("string").alias("x"), F.lit(5).alias("n"))))
    return d.select("doc_id", F.md5(Z.all_text(d)).alias("digest"))


@query("store_datasets", "SELECT * FROM (VALUES ('a', 1), ('b', 1)) t(dataset, n_files)")
def datasets(spark, sf):
    path = fresh_path(spark, "datasets")
    for k, name in enumerate(("a.jsonl", "b.parquet", "notes.json")):
        Z.write_report(spark, f"{path}/{name}", {"k": k})
    return Z.datasets(spark, path).select("dataset", F.col("n_files").cast("int").alias("n_files"))


@query("store_known_digests", "SELECT count(*) AS n_files, count(*) AS n_known FROM (VALUES (1)) t(x)")
def known(spark, sf):
    path = fresh_path(spark, "known")
    Z.write_report(spark, f"{path}/a.jsonl", {"k": 1})
    files = Z.listing(spark, path)
    manifest = files.withColumn("sha256", F.lit("abc"))
    return Z.known_digests(files, manifest).agg(F.count("*").alias("n_files"), F.count("sha256").alias("n_known"))


@query("store_record_keys", "SELECT count(DISTINCT md5(text)) AS n FROM documents")
def record_keys(spark, sf):
    """An index of keys, grown by the new shards of a manifest only."""
    d = read(spark, sf, "documents").select(H.text_key(F.col("text")).alias("key"), "doc_id")
    old = J.exclusion_index(d.where("doc_id % 2 = 0"), key="key")
    return J.exclusion_index(old, d.where("doc_id % 2 = 1"), key="key").agg(F.count("*").alias("n"))
