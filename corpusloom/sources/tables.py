"""Reading and writing corpora: JSON lines and Parquet, whole directories, reports and plans."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

PARQUET, JSONL = (".parquet", ".pq"), (".jsonl", ".ndjson", ".jsonl.gz", ".json.gz")
#: The fields of a message, in the order of the published schema.
MESSAGE = "array<struct<role:string,content:string,reasoning_content:string,tools:string,tool_calls:string>>"
MESSAGE_FIELDS = ["role", "content", "reasoning_content", "tools", "tool_calls"]
PRESETS = {"pretrain": ["text"], "sft": ["conversations"], "dpo": ["chosen", "rejected"], "agent": ["conversations", "gt"]}


def classify(path: str) -> str | None:
    """parquet, jsonl or None. A plain .json file is a report and never a corpus."""
    low = path.lower()
    return "parquet" if low.endswith(PARQUET) else "jsonl" if low.endswith(JSONL) else None


def _listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files at a path of any file system, with sizes, sorted."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(where) if s.isFile())


def source_files(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The format and sorted files of a source; of a directory with both formats, Parquet."""
    names = [n for n, _ in _listing(spark, path)]
    for kind in ("parquet", "jsonl"):
        found = [n for n in names if classify(n) == kind]
        if found:
            return kind, found
    raise ValueError(f"no corpus files in {path}")


def source_key(path: str) -> str:
    """The name of a corpus whatever holds it: a.jsonl and a.parquet are one."""
    low = path.rstrip("/")
    for end in (*JSONL, *PARQUET):
        if low.lower().endswith(end):
            return low[: -len(end)]
    return low


def read_source(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A source of either format; only the columns asked for are read from Parquet."""
    kind, files = source_files(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    out = reader.parquet(*files) if kind == "parquet" else reader.option("mode", "FAILFAST").json(files)
    return out.select(*columns) if columns else out


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines where a broken line is a row of its own: _corrupt holds it, the fields are null."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array of records."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines without byte order mark and carriage return; blank ones left out. Adds file and line.

    Files are read in splits. A line's number, from 1, is its place in its split after the lines of the
    file's earlier splits, which one count for each split gives.
    """
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = own.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", "first", before.alias("before"))
    each = own.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")
    plain = F.regexp_replace(F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), "\r$", "")
    return each.select("file", "line", plain.alias("value")).where(F.trim("value") != "")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken line is an error that names its file and line. Blank lines are left out."""
    lines = read_lines(spark, path)
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    where = F.concat(F.lit("broken JSON at "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    return lines.select(F.when(parsed["_corrupt"].isNotNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True)).alias("ok"), parsed.alias("row")).where("ok").select("row.*").drop("_corrupt")


def read_raw(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the untouched line (value) beside the parsed record (row), so that a line can be copied byte for byte."""
    return spark.read.text(path).select("value", F.from_json("value", schema).alias("row"))


def write_raw(df: DataFrame, path: str) -> None:
    """The untouched lines of read_raw."""
    df.select("value").write.mode("errorifexists").text(path)


def read_code_tree(spark: SparkSession, path: str, suffixes: list[str], least: int = 40, most: int = 80 * 1024, skip: list[str] | None = None) -> DataFrame:
    """Text files of a code tree: size bounds, no NUL near the start, little broken text, no skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    own = files.where(F.col("length").between(least, most) & F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(*suffixes))
    for s in skip or []:
        own = own.where(~F.col("path").contains(f"/{s}/"))
    text = own.where(F.position(F.lit(b"\x00"), F.substring("content", 1, 8192)) == 0).select("path", "length", F.decode("content", "UTF-8").alias("text"))
    broken = F.char_length("text") - F.char_length(F.replace("text", F.lit("�"), F.lit("")))
    return text.where(broken <= 0.05 * F.char_length("text"))


#: What a byte of a file becomes in memory, of JSON lines and of a footer's uncompressed sizes.
JSONL_GROWTH, PARQUET_GROWTH = 1.25, 1.05


def footers(spark: SparkSession, path: str) -> list[dict]:
    """Of each Parquet file at a path: its rows, row groups, codecs, uncompressed bytes and columns, from the footer alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name, _ in _listing(spark, path):
        if classify(name) != "parquet":
            continue
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf))
        try:
            groups = [g for g in reader.getFooter().getBlocks()]
            schema = reader.getFooter().getFileMetaData().getSchema()
            out.append(
                {
                    "path": name,
                    "rows": sum(g.getRowCount() for g in groups),
                    "groups": len(groups),
                    "codecs": sorted({c.getCodec().toString() for g in groups for c in g.getColumns()}),
                    "bytes": sum(g.getTotalByteSize() for g in groups),
                    "columns": [schema.getFieldName(k) for k in range(schema.getFieldCount())],
                }
            )
        finally:
            reader.close()
    return out


def footprint(spark: SparkSession, path: str) -> int:
    """The bytes a source is expected to take in memory: of Parquet by the footers, of JSON lines by the files' sizes."""
    kind, files = source_files(spark, path)
    if kind == "parquet":
        return sum(int(f["bytes"] * PARQUET_GROWTH) for f in footers(spark, path))
    sizes = dict(_listing(spark, path))
    return sum(int(sizes[f] * JSONL_GROWTH) for f in files)


def preset_of(columns: list[str]) -> str:
    """The preset whose required columns are there; generic if none's are."""
    for name in ("agent", "sft", "dpo", "pretrain"):
        if all(c in columns for c in PRESETS[name]):
            return name
    return "generic"


def require_preset(df: DataFrame, preset: str) -> DataFrame:
    """df, if the preset's columns are there and not null everywhere."""
    need = PRESETS.get(preset, [])
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    if need:
        filled = df.agg(*[F.count(c).alias(c) for c in need]).first().asDict()
        if empty := [c for c, n in filled.items() if not n]:
            raise ValueError(f"columns always null: {empty}")
    return df


def widen(a: str | None, b: str | None) -> str:
    """The type that holds both of two scalar types: bigint and double give double, other pairs string."""
    if a is None or b is None or a == b:
        return a or b or "string"
    return "double" if {a, b} == {"bigint", "double"} else "string"


def kind_of(value) -> list:
    """The kind of one JSON value: [null], [scalar, type], [list, kind of its items] or [fields, names]."""
    match value:
        case None:
            return ["null"]
        case bool():
            return ["scalar", "boolean"]
        case int():
            return ["scalar", "bigint" if -(2**63) <= value < 2**63 else "string"]
        case float():
            return ["scalar", "double"]
        case list():
            return ["list", reduce(merged, [_item(v) for v in value], ["null"])]
        case _:
            return ["scalar", "string"]


def _item(value) -> list:
    return ["fields", *value] if isinstance(value, dict) else ["scalar", "string"] if isinstance(value, list) else kind_of(value)


def merged(a: list, b: list) -> list:
    """The kind that holds two: a null gives way, lists merge by item, fields are united, and other pairs are text."""
    match a, b:
        case (["null"], kind) | (kind, ["null"]):
            return kind
        case ["scalar", x], ["scalar", y]:
            return ["scalar", widen(x, y)]
        case ["list", x], ["list", y]:
            item = merged(x, y)
            mixed = "fields" in (x[0], y[0]) and x[0] != y[0] and "null" not in (x[0], y[0])
            return ["scalar", "string"] if mixed else ["list", item]
        case ["fields", *x], ["fields", *y]:
            return ["fields", *dict.fromkeys([*x, *y])]
    return ["scalar", "string"]


def type_of(kind: list) -> str:
    """The column type of a kind; lists of objects are lists of structs of text, the message fields in their order."""
    match kind:
        case ["scalar", name]:
            return name
        case ["list", ["fields", *names]]:
            known = [n for n in MESSAGE_FIELDS if n in names]
            return "array<struct<" + ",".join(f"`{n}`:string" for n in known + [n for n in names if n not in known]) + ">>"
        case ["list", item]:
            return f"array<{type_of(item)}>"
    return "string"


def folded_schema(lines: DataFrame, value: str = "value") -> list[tuple[str, str, bool]]:
    """(column, type, whether null or missing somewhere) over all JSON objects of a text column.

    Each task folds its lines into one kind for every column; only these folds, as large as the schema,
    come to the driver, which merges them in the order of the tasks. A line that is no object is an error.
    """

    def fold(frames):
        kinds, seen, rows = {}, {}, 0
        for frame in frames:
            for text in frame[value]:
                row = json.loads(text)
                if not isinstance(row, dict):
                    raise ValueError(f"no JSON object: {text[:80]}")
                rows += 1
                for name, v in row.items():
                    kinds[name] = merged(kinds.get(name, ["null"]), kind_of(v))
                    seen[name] = seen.get(name, 0) + (v is not None)
        yield pd.DataFrame({"fold": [json.dumps([kinds, seen, rows])]})

    parts = [json.loads(r[0]) for r in lines.select(value).mapInPandas(fold, "fold string").collect()]
    kinds: dict[str, list] = {}
    for part, _, _ in parts:
        for name, kind in part.items():
            kinds[name] = merged(kinds.get(name, ["null"]), kind)
    rows = sum(n for _, _, n in parts)
    return [(name, type_of(kind), sum(seen.get(name, 0) for _, seen, _ in parts) < rows) for name, kind in kinds.items()]


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the schema that all of them fold to; what fits no type stays as JSON text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    schema = ", ".join(f"`{name}` {kind}" for name, kind, _ in folded_schema(lines))
    return spark.read.schema(schema).json(path)


def planned_schema(df: DataFrame) -> list[tuple[str, str]]:
    """Column types as published: scalars as they are, lists of objects as structs of text, other objects as JSON text."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("array<struct<"):
            fields = df.schema[name].dataType.elementType.fieldNames()
            kind = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
        elif kind.startswith(("struct<", "map<")):
            kind = "string"
        out.append((name, kind))
    return out


def conform(df: DataFrame) -> DataFrame:
    """df in its planned schema."""
    cols = []
    for (name, plan), (_, kind) in zip(planned_schema(df), df.dtypes, strict=True):
        c = F.col(f"`{name}`")
        if plan == "string" and kind.startswith(("struct<", "map<")):
            c = F.to_json(c)
        elif plan.startswith("array<struct<"):
            fields = df.schema[name].dataType.elementType
            text = lambda v, f: F.to_json(v) if f.dataType.typeName() in ("struct", "array", "map") else v.cast("string")
            c = F.transform(c, _as_text(fields, text))
        cols.append(c.alias(name))
    return df.select(*cols)


def _as_text(fields, text):
    def each(m):
        return F.struct(*[text(m[f.name], f).alias(f.name) for f in fields.fields])

    return each


def write_corpus(df: DataFrame, path: str, text: str = "text", row_group: int = 128 * 2**20) -> None:
    """Parquet with zstd and no dictionary for the text; an existing path is never overwritten."""
    df.write.option("compression", "zstd").option("parquet.block.size", row_group).option(f"parquet.enable.dictionary#{text}", "false").mode("errorifexists").parquet(path)


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk_index") -> None:
    """A folder for each chunk, so that a chunk is read alone, and beside them the recorded bounds (_bounds)."""
    df.repartition(chunk).write.option("compression", "zstd").partitionBy(chunk).mode("errorifexists").parquet(path)
    counts = df.groupBy(chunk).agg(F.count("*").alias("n_rows"))
    end = F.sum("n_rows").over(Window.orderBy(chunk))  # a row for each chunk
    counts.withColumn("end", end).coalesce(1).write.mode("errorifexists").json(f"{path}/_bounds")


def recorded_bounds(spark: SparkSession, path: str) -> DataFrame:
    """chunk, n_rows and end (rows up to and with the chunk) as write_chunks has recorded them."""
    return spark.read.json(f"{path}/_bounds")


def read_chunk(spark: SparkSession, path: str, number: int, chunk: str = "chunk_index") -> DataFrame:
    return spark.read.parquet(path).where(F.col(chunk) == number)


def write_with_provenance(df: DataFrame, path: str, key: str, columns: list[str], provenance: list[str]) -> None:
    """Rows (key, columns) and, row for row under the same key, where they come from as gzip JSON lines."""
    write_jsonl(df.select(key, *columns), f"{path}/rows")
    write_jsonl(df.select(key, *provenance), f"{path}/provenance", gzip=True)


def compile_folder(spark: SparkSession, folder: str, target: str) -> dict[str, int]:
    """Every JSON lines file of a folder to a Parquet corpus of its name; rows of each. Other files are left alone."""
    done = {}
    for name, _ in _listing(spark, folder):
        if classify(name) == "jsonl":
            out = f"{target}/{source_key(name).rsplit('/', 1)[-1]}"
            write_corpus(read_folded(spark, name), out)
            done[out] = spark.read.parquet(out).count()
    return done


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.option("compression", "gzip" if gzip else "none").mode("errorifexists").json(path)


def split_write(df: DataFrame, keep, kept: str, dropped: str) -> None:
    """Kept and dropped rows to two places; together they are all rows."""
    flag = F.coalesce(keep, F.lit(False))
    write_corpus(df.where(flag), kept)
    write_corpus(df.where(~flag), dropped)


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A JSON report beside a corpus, written under another name and then renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = fs.create(part, True)
    stream.write(bytearray((json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    stream.close()
    fs.rename(part, target)


def file_digests(spark: SparkSession, path: str, whole: int = 1 << 29) -> DataFrame:
    """path, length and SHA-256 of each file. Files above `whole` bytes are digested in a stream, not as one value."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = []
    for name, size in _listing(spark, path) if files.where(F.col("length") > whole).select("length").take(1) else []:
        if size > whole:
            where = jvm.org.apache.hadoop.fs.Path(name)
            stream = where.getFileSystem(conf).open(where)
            large.append((name, size, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
            stream.close()
    return small.unionByName(spark.createDataFrame(large, small.schema)) if large else small


def unseen_files(spark: SparkSession, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no earlier run has recorded with the same digest."""
    return files.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def known_digests(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, length, modified) with the digest that the manifest has for the same path, length and time, or null."""
    return files.join(manifest.select("path", "length", "modified", "sha256"), ["path", "length", "modified"], "left")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, length and modified of the files in a folder: a manifest to choose from."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.withColumn("name", F.substring_index("path", "/", -1))


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Corpora in a folder: name, files, bytes, and a version that changes when a file does."""
    corpora = listing(spark, folder).where(F.lower("name").rlike(r"\.(?:parquet|pq|jsonl|ndjson)(?:\.gz)?$"))
    stem = F.regexp_replace(F.lower("name"), r"\.(?:parquet|pq|jsonl|ndjson)(?:\.gz)?$", "")
    mark = F.concat_ws(":", "name", "length", F.unix_micros("modified").cast("string"))
    grouped = corpora.withColumn("dataset", stem).groupBy("dataset").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.array_sort(F.collect_list(mark)).alias("m"))
    return grouped.select("dataset", "n_files", "bytes", F.sha2(F.array_join("m", "|"), 256).alias("version"))


def all_text(df: DataFrame) -> Column:
    """All strings of a row, however deep, a line each: in the order of the columns, null and empty ones left out."""

    def strings(kind, c: Column) -> Column | None:
        match kind:
            case StringType():
                return F.array(c)
            case StructType():
                inner = [x for x in (strings(f.dataType, c[f.name]) for f in kind.fields) if x is not None]
                return F.concat(*inner) if inner else None
            case ArrayType():
                if strings(kind.elementType, F.lit(None)) is None:
                    return None
                none = F.array().cast("array<string>")
                return F.coalesce(F.flatten(F.transform(c, lambda x: F.coalesce(strings(kind.elementType, x), none))), none)
            case MapType():
                return strings(ArrayType(kind.valueType), F.map_values(c))
        return None

    found = [x for x in (strings(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields) if x is not None]
    return F.array_join(F.filter(F.concat(*found), lambda x: x != ""), "\n") if found else F.lit("")
