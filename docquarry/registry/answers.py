"""Context, history, references, tiers. Every document stands as a question
whose results are all its own chunks."""
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.operators import answers as G
from docquarry.registry.base import CHUNKS, chunks, lit, query, table

TIER = "CASE WHEN doc_id % 3 = 0 THEN 'MEDIUM' ELSE 'HIGH' END"
RESULTS = f"""{CHUNKS}, re AS (SELECT doc_id AS query_id, page_number AS rank, chunk_id, page_content AS text, filename, page_number % 4 + 1 AS page_number, document_type,
  carrier, line_of_business, heading_path, {TIER} AS confidence_tier, 1.0 / (page_number + doc_id % 5) AS score FROM wc
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def results(spark, sf):
    bad = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return chunks(spark, sf).join(bad, "doc_id", "left_anti").select(
        F.col("doc_id").alias("query_id"), F.col("page_number").alias("rank"), "chunk_id", F.col("page_content").alias("text"), "filename",
        (F.col("page_number") % 4 + 1).alias("page_number"), "document_type", "carrier", "line_of_business", "heading_path",
        F.expr(TIER).alias("confidence_tier"), (1.0 / (F.col("page_number") + F.col("doc_id") % 5)).alias("score"))


@query("g01_context_assembly", f"""WITH {RESULTS} SELECT query_id, string_agg(concat('--- Context ', rank, ' | ', filename, ' (p.', page_number, ', ', document_type, ', ', carrier, '/', line_of_business,
  ') ---', chr(10), text), concat(chr(10), chr(10)) ORDER BY rank) AS context_text FROM re GROUP BY query_id""")
def g01(spark, sf):
    return G.assemble_context(results(spark, sf))


@query("g02_history_window", """SELECT conv_id, string_agg(concat(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END, trim(text, concat(' ', chr(10)))), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3 AND trim(text) != '' GROUP BY conv_id""")
def g02(spark, sf):
    return G.history_window(table(spark, sf, "conversations"))


# the chunks have no line breaks; an answer's lines are the lines of the conversation turns
@query("g03_extractive_fallback", """SELECT query_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS line_no FROM (
  SELECT query_id, line, min([rank, pos])[1] AS rank, min([rank, pos])[2] AS pos FROM (SELECT conv_id AS query_id, turn AS rank, i AS pos, trim(l[i]) AS line FROM (
    SELECT *, string_split(text, chr(10)) AS l FROM conversations), unnest(range(1, len(l) + 1)) AS t(i))
  WHERE length(line) > 40 AND NOT starts_with(line, '---') GROUP BY query_id, line)) WHERE line_no <= 5""")
def g03(spark, sf):
    return G.extractive_fallback(table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text"))


@query("g04_reference_list", f"""WITH {RESULTS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS reference_no FROM (
  SELECT query_id, filename, page_number, min(rank) AS first_rank, concat(any_value(carrier), ' | ', any_value(line_of_business)) AS scope FROM re GROUP BY 1, 2, 3)""")
def g04(spark, sf):
    return G.reference_list(results(spark, sf))


@query("g05_tier_downgrade", f"""WITH {RESULTS}, b AS (SELECT query_id, arg_min(confidence_tier, rank) AS t, max(score) AS s FROM re GROUP BY 1)
SELECT doc_id AS query_id, doc_id % 2 = 0 AS generation_degraded, round(s, 6) AS top_score, CASE WHEN t IS NULL THEN 'LOW' WHEN doc_id % 2 = 0 AND t = 'HIGH' THEN 'MEDIUM' ELSE t END AS confidence_tier,
  CASE WHEN t IS NULL THEN {lit(V.NO_ANSWER)} END AS fallback_answer FROM documents LEFT JOIN b ON query_id = doc_id""")
def g05(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 2 == 0).alias("generation_degraded"))
    return G.answer_tier(asked, results(spark, sf)).withColumn("top_score", F.round("top_score", 6))


@query("g06_source_rows", f"""WITH {RESULTS} SELECT query_id, rank AS relevance_rank, chunk_id AS document_id, filename, CAST(page_number AS VARCHAR) AS page_number,
  text AS chunk_text, round(score, 6) AS relevance_score FROM re""")
def g06(spark, sf):
    return G.source_rows(results(spark, sf))


@query("g07_query_log_analytics", """SELECT event_type AS confidence_tier, count(*) AS queries, round(avg(value), 4) AS avg_latency_ms, max(value) AS max_latency_ms,
  round(avg(value / 100), 6) AS avg_top_score, count(*) FILTER (WHERE user_id % 2 = 0) AS degraded FROM events GROUP BY 1""")
def g07(spark, sf):
    return G.query_log_summary(table(spark, sf, "events").select(
        F.col("event_type").alias("confidence_tier"), F.col("value").alias("latency_ms"), (F.col("value") / 100).alias("top_score"),
        (F.col("user_id") % 2 == 0).alias("generation_degraded")))


STEP = "ln(1.01 / 0.99)"


@query("g07_latency_percentiles", f"""WITH b AS (SELECT event_type AS confidence_tier, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {STEP}) AS INTEGER) END AS bucket, count(*) AS n
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY confidence_tier ORDER BY bucket NULLS FIRST) AS below, sum(n) OVER (PARTITION BY confidence_tier) AS total,
  coalesce(2 * exp(bucket * {STEP}) / (1 + 1.01 / 0.99), 0) AS v FROM b)
SELECT confidence_tier, {', '.join(f"round(min(v) FILTER (WHERE below >= ceil({p} * total)), 6) AS p{round(100 * p)}" for p in (0.5, 0.95, 0.99))} FROM c GROUP BY 1""")
def g07p(spark, sf):
    # a sketch per day and tier, as the log is written; those of all days are merged
    log = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("confidence_tier"), F.col("value").alias("latency_ms"))
    whole = G.merge_sketches(G.latency_sketch(log, "day", "confidence_tier"), "confidence_tier")
    found = G.percentiles(whole, "confidence_tier")
    return found.select("confidence_tier", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])
