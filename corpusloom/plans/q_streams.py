"""Window, session and stream queries over events."""

from pyspark.sql import functions as F

from corpusloom.plans.registry import query, read
from corpusloom.sources.staging import fresh_path
from corpusloom.streaming import events as E


@query(
    "stream_tumbling",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def tumbling(spark, sf):
    return E.tumbling(read(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query(
    "stream_sliding",
    """SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY ALL""",
)
def sliding(spark, sf):
    return E.sliding(read(spark, sf, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query(
    "stream_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM f)
SELECT min(ts) AS start, user_id, count(*) AS n FROM r GROUP BY user_id, s""",
)
def sessions(spark, sf):
    return E.sessions(read(spark, sf, "events"), "ts", "30 minutes", ["user_id"])


@query(
    "stream_rolling_rate",
    """WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM f)
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, s ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) / 600, 6) AS rate FROM r""",
)
def rolling_rate(spark, sf):
    return E.rolling_rate(read(spark, sf, "events"), "user_id", "ts", "value", 600, 3600).select("event_id", F.round("rate", 6).alias("rate"))


@query("stream_append_once", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type")
def append_once(spark, sf):
    """Reads the table as a stream twice with one checkpoint; the second run adds nothing."""
    base = fresh_path(spark, "stream")
    table = read(spark, sf, "events")
    for _ in range(2):
        stream = E.read_stream(spark, f"{sf}/events.parquet*", table.schema)
        E.append_once(stream, f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.schema(table.schema).parquet(f"{base}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("stream_token_timing", "SELECT user_id, (epoch_us(min(ts)) - epoch_us(min(ts - INTERVAL '2 seconds'))) / 1000 AS first_ms, CASE WHEN count(*) > 1 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000 / (count(*) - 1), 4) END AS per_token_ms, count(*) AS n_tokens FROM events GROUP BY user_id")
def token_timing(spark, sf):
    e = read(spark, sf, "events").withColumn("started", F.col("ts") - F.expr("INTERVAL 2 SECONDS"))
    return E.token_timing(e, "user_id", "ts", "started").withColumn("per_token_ms", F.round("per_token_ms", 4))
