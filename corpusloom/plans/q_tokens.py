"""Tokens, training rows, labels and packed blocks, with the bytes of a text as its tokens."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import blocks as B
from corpusloom.operators import rows as R
from corpusloom.operators import tokens as K
from corpusloom.plans.q_chat import M, chats
from corpusloom.plans.registry import query, read

MOST = 512


@query("tokens_count", "SELECT doc_id, octet_length(encode(text)) + 2 AS n FROM documents")
def count(spark, sf):
    return read(spark, sf, "documents").select("doc_id", K.token_count(F.col("text")).cast("long").alias("n"))


BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER))"


@query(
    "tokens_text_rows",
    f"""SELECT doc_id, length, md5(array_to_string(list_concat(list_concat([256], b[1:{MOST} - 2]), [257]), ',')) AS ids FROM (SELECT doc_id, least(octet_length(encode(text)), {MOST} - 2) + 2 AS length, {BYTES.format('text')} AS b FROM documents)""",
)
def text_rows(spark, sf):
    out = K.text_rows(read(spark, sf, "documents").select("doc_id", "text"), "text", MOST)
    return out.select("doc_id", F.col("length").cast("long").alias("length"), F.md5(F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ",")).alias("ids"))


@query(
    "tokens_chat_rows",
    f"""SELECT conv_id, CAST(sum(octet_length(encode('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)))) AS BIGINT) AS length,
CAST(coalesce(sum(octet_length(encode(content || '<|im_end|>' || chr(10)))) FILTER (role = 'assistant'), 0) AS BIGINT) AS n_labels,
md5(coalesce(string_agg(content || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS labelled
FROM {M} GROUP BY conv_id HAVING sum(octet_length(encode('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)))) <= 4096""",
)
def chat_rows(spark, sf):
    """Whole chats of at most 4,096 tokens; the labels spell the answers with their end marks."""
    out = K.chat_rows(chats(spark, sf), "messages", 4096)
    own = F.filter("labels", lambda x: x != K.NO_LOSS)
    spelt = F.decode(F.unhex(F.array_join(F.transform(own, lambda i: F.lpad(F.hex(i.cast("long")), 2, "0")), "")), "UTF-8")
    return out.select("conv_id", F.col("length").cast("long").alias("length"), F.size(own).cast("long").alias("n_labels"), F.md5(spelt).alias("labelled"))


@query("tokens_template", f"SELECT conv_id, md5('<s>' || string_agg('[' || role || '] ' || content || chr(10), '' ORDER BY turn) || '[assistant] ') AS digest FROM {M} GROUP BY conv_id")
def template(spark, sf):
    plain = K.Template(before="[{role}] ", after="\n", answer="[assistant] ", first="<s>")
    return chats(spark, sf).select("conv_id", F.md5(K.render(F.col("messages"), plain, ask=True)).alias("digest"))


@query(
    "tokens_packed",
    f"""WITH d AS (SELECT doc_id, least(octet_length(encode(text)), {MOST} - 2) + 2 AS n FROM documents)
SELECT n AS length, CAST(count(*) AS BIGINT) AS n_segments, CAST(0 AS BIGINT) AS n_bad FROM d GROUP BY n""",
)
def packed(spark, sf):
    """The segments of all blocks by length; a bad one is not a whole example, trains its first token, or lies in a block of another size."""
    out = K.text_rows(read(spark, sf, "documents").select("doc_id", "text"), "text", MOST).withColumn("labels", F.col("input_ids"))
    blocks = K.pack_rows(out.select("doc_id", "input_ids", "labels"), "doc_id", "doc_id", 2 * MOST)
    one = F.filter(F.array_distinct("segment_ids"), lambda s: s >= 0)
    places = lambda s: F.filter(F.sequence(F.lit(0), F.lit(2 * MOST - 1)), lambda i: F.get("segment_ids", i) == s)
    each = blocks.select("input_ids", "labels", "segment_ids", "valid_tokens", F.explode(one).alias("s")).withColumn("at", places(F.col("s")))
    first, last, n = F.col("at")[0], F.element_at("at", -1), F.size("at")
    whole = (F.get("input_ids", first) == 256) & (F.get("input_ids", last) == 257) & (last - first + 1 == n)
    cut = F.get("labels", first) == F.when(F.col("s") > 0, K.NO_LOSS).otherwise(256)
    sized = (F.size("input_ids") == 2 * MOST) & (F.size("labels") == 2 * MOST) & (F.col("valid_tokens") == F.size(F.filter("segment_ids", lambda x: x >= 0)))
    return each.groupBy(n.cast("long").alias("length")).agg(F.count("*").alias("n_segments"), F.count_if(~(whole & cut & sized)).alias("n_bad"))


@query("blocks_places", "SELECT doc_id, least(n_chars, 500) AS length, true AS fits, true AS gapless FROM documents WHERE n_chars > 0")
def places(spark, sf):
    """Every example lies whole in its block, right after the ones before it."""
    out = B.pack_blocks(read(spark, sf, "documents").select("doc_id", F.least("n_chars", F.lit(500)).alias("n")), "doc_id", "n", "doc_id", 2048)
    before = F.coalesce(F.sum("length").over(Window.partitionBy("pack_group", "block").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.select("doc_id", F.col("length").cast("long").alias("length"), (F.col("offset") + F.col("length") <= 2048).alias("fits"), (F.col("offset") == before).alias("gapless"))


@query("blocks_bucket_places", "SELECT doc_id, CASE WHEN n_chars <= 512 THEN 512 WHEN n_chars <= 2048 THEN 2048 ELSE 8192 END AS bucket, true AS fits, true AS gapless FROM documents WHERE n_chars BETWEEN 1 AND 8192")
def bucket_places(spark, sf):
    n = F.col("n_chars")
    d = read(spark, sf, "documents").select("doc_id", "n_chars", F.when(n <= 512, 512).when(n <= 2048, 2048).otherwise(8192).alias("bucket"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    out = B.pack_buckets(d, "doc_id", "n_chars", "bucket", "h", 256)
    before = F.coalesce(F.sum("length").over(Window.partitionBy("bucket", "pack_group", "block").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.select("doc_id", "bucket", (F.col("offset") + F.col("length") <= F.col("bucket")).alias("fits"), (F.col("offset") == before).alias("gapless"))


@query("blocks_step_time", "SELECT CAST(r AS INTEGER) AS n_rows, CAST(l AS INTEGER) AS length, round(0.03 + 0.53 * 0.8 * r * l / 28672.0 + 0.53 * 0.2 * r * l * l / (28672.0 * 1024), 9) AS seconds FROM range(1, 60, 7) a(r), range(128, 4097, 128) b(l)")
def step_time(spark, sf):
    return spark.createDataFrame([(r, n, round(B.step_seconds(r, n), 9)) for r in range(1, 60, 7) for n in range(128, 4097, 128)], "n_rows int, length int, seconds double")


@query("blocks_count", "SELECT 30 AS n_blocks, 41 AS other")
def block_count(spark, sf):
    """Best fit on counts alone: 20 of 7 and 20 of 3 in tens and 10 of 10; 40 of 6 and 8 of 2 in tens."""
    return spark.createDataFrame([(B.count_blocks([(7, 20), (3, 20), (10, 10)], 10), B.count_blocks([(6, 40), (2, 8), (8, 1)], 10))], "n_blocks int, other int")


@query("tokens_preference", "SELECT doc_id, n - 1 AS n, n - 2 AS last_x, n - 1 AS last_y, true AS last_mask FROM (SELECT doc_id, CAST(3 + doc_id % 5 AS INTEGER) AS n FROM documents)")
def preference(spark, sf):
    n = (F.col("doc_id") % 5 + 3).cast("int")
    ids = F.sequence(F.lit(0), n - 1)
    pair = read(spark, sf, "documents").select("doc_id", R.shifted(ids, F.transform(ids, lambda i: i > 0)).alias("p"))
    end = lambda c: F.element_at(F.col(c), -1)
    return pair.select("doc_id", F.size("p.x").alias("n"), end("p.x").alias("last_x"), end("p.y").alias("last_y"), end("p.mask").alias("last_mask"))


@query("tokens_lengths_kept", "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 2 <= 1000")
def kept(spark, sf):
    return B.within(read(spark, sf, "documents"), K.token_count(F.col("text")), 1000).select("doc_id")
