"""Streams over the given tables, run until all that is there is processed."""
from pyspark.sql import functions as F

from docquarry.registry.base import NOISY, noisy, query, sql_collapse, table
from docquarry.registry.cleaning import CLEAN
from docquarry.session import fresh_path
from docquarry.streaming import ingest as I
from docquarry.streaming import monitor as M

OVER, SIZE = 150, 800
CLEANED = f"""{CLEAN}, cd AS (SELECT doc_id, string_split({sql_collapse("string_agg(line, ' ' ORDER BY grp)")}, ' ') AS ws FROM stitched GROUP BY doc_id),
pc AS (SELECT doc_id, array_to_string(ws[s + 1:s + {SIZE}], ' ') AS text FROM cd, unnest(range(0, greatest(len(ws) - {OVER}, 1), {SIZE - OVER})) AS t(s))"""


def run_ingest(spark, sf):
    arriving = fresh_path(spark, "arriving")
    noisy(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), "text").repartition(4).write.parquet(arriving)
    stream = spark.readStream.schema("document_id string, text string").option("maxFilesPerTrigger", 2).parquet(arriving)
    out = fresh_path(spark, "ingested")
    I.start_ingest(stream, out, fresh_path(spark, "checkpoint")).awaitTermination()
    return out


@query("st1_incremental_ingest", f"WITH {CLEANED} SELECT DISTINCT sha256({sql_collapse('lower(text)')}) AS text_hash FROM pc")
def st1(spark, sf):
    return I.read_chunks(spark, run_ingest(spark, sf)).select("text_hash")


@query("st1_ingest_status", f"""WITH {NOISY} SELECT CAST(doc_id AS VARCHAR) AS document_id, 'completed' AS status FROM noisy""")
def st1s(spark, sf):
    return I.read_status(spark, run_ingest(spark, sf)).select("document_id", "status")


@query("st2_quality_monitor", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, confidence_tier, queries, avg_latency_ms, max_latency_ms FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS confidence_tier, count(*) AS queries, round(avg(value), 4) AS avg_latency_ms, max(value) AS max_latency_ms FROM events GROUP BY 1, 2)
WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def st2(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = fresh_path(spark, "windows")
    log = events.select("ts", F.col("event_type").alias("confidence_tier"), F.col("value").alias("latency_ms"))
    M.start_monitor(log, out, fresh_path(spark, "checkpoint")).awaitTermination()
    df = spark.read.parquet(out)
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


WINDOW_STEP = "ln(1.01 / 0.99)"


@query("st2_latency_percentiles", f"""WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS confidence_tier,
  CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {WINDOW_STEP}) AS INTEGER) END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY w, confidence_tier ORDER BY bucket NULLS FIRST) AS below, sum(n) OVER (PARTITION BY w, confidence_tier) AS total,
  coalesce(2 * exp(bucket * {WINDOW_STEP}) / (1 + 1.01 / 0.99), 0) AS v FROM b WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, confidence_tier,
  {', '.join(f"round(min(v) FILTER (WHERE below >= ceil({p} * total)), 6) AS p{round(100 * p)}" for p in (0.5, 0.95, 0.99))} FROM c GROUP BY 1, 2""")
def st2p(spark, sf):
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = fresh_path(spark, "sketches")
    log = events.select("ts", F.col("event_type").alias("confidence_tier"), F.col("value").alias("latency_ms"))
    M.start_sketches(log, out, fresh_path(spark, "checkpoint")).awaitTermination()
    df = M.read_percentiles(spark, out).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return df.select("window_start", "confidence_tier", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])
