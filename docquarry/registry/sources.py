"""Scans, stored tables and sinks."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.registry.base import CHUNKS, FILES, QUESTIONS, chunks, files, lit, query, questions, table
from docquarry.session import fresh_path
from docquarry.sources import files as S
from docquarry.sources import tables as B


@query("s01_file_scan")
def s01(spark, sf):
    return S.scan_files(spark, sf, "*.parquet", ["doc", "page"]).select("relative_path", "name", "length")


@query("s02_page_text_scan", """SELECT doc_id, i AS page, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
  unnest(range(1, len(l) + 1)) AS t(i)""")
def s02(spark, sf):
    return S.text_pages(table(spark, sf, "documents").select("doc_id", "text"), "\n")


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HTML = r"regexp_replace(regexp_replace(html, '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)>|<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>', chr(10), 'g')"
HTML = f"regexp_replace({HTML}, '<[^>]*>', ' ', 'g')"
for _e, _c in ENTITIES:
    HTML = f"replace({HTML}, {lit(_e)}, {lit(_c)})"
HTML = rf"trim(regexp_replace(regexp_replace({HTML}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), chr(10) || ' ')"


@query("s02_html_text", f"SELECT page_id, {HTML} AS text FROM pages")
def s02h(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.html_text(F.col("html")).alias("text"))


# rule lines between the paragraphs of a document
RULED = "replace(text, chr(10), concat(chr(10), CASE WHEN doc_id % 3 = 0 THEN '---' WHEN doc_id % 3 = 1 THEN '| --- |' ELSE '' END, chr(10)))"


@query("s05_markdown_pages", f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS page, p AS text FROM (
  SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (
    SELECT doc_id, list_transform(string_split_regex({RULED}, '(?m)^---$'), lambda x: trim(x, concat(chr(10), ' '))) AS l FROM documents)) WHERE p != ''""")
def s05(spark, sf):
    return S.markdown_pages(table(spark, sf, "documents").select("doc_id", F.expr(RULED).alias("text")))


@query("s05_markdown_pages_plain", f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS page, p AS text FROM (
  SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (
    SELECT doc_id, list_transform(string_split({RULED}, '---'), lambda x: trim(x, concat(chr(10), ' '))) AS l FROM documents)) WHERE p != ''""")
def s05p(spark, sf):
    return S.markdown_pages(table(spark, sf, "documents").select("doc_id", F.expr(RULED).alias("text")), "---")


CATALOG = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("page_content", T.StringType()), T.StructField("metadata", T.StructType([
    T.StructField("carrier", T.StringType()), T.StructField("line_of_business", T.StringType()), T.StructField("page_number", T.IntegerType())]))])


def catalog_rows(df):
    return df.select("chunk_id", "page_content", F.struct("carrier", "line_of_business", "page_number").alias("metadata"))


@query("s06_catalog_round_trip", f"WITH {CHUNKS} SELECT chunk_id, page_content, carrier, line_of_business, page_number FROM wc")
def s06(spark, sf):
    path, rows = fresh_path(spark, "catalog"), catalog_rows(chunks(spark, sf))
    B.write_catalog(rows.filter("metadata.page_number = 1"), path)
    B.write_catalog(rows.filter("metadata.page_number > 1"), path)
    return B.read_catalog(spark, path, CATALOG).select("chunk_id", "page_content", "metadata.*")


@query("s07_keyed_upsert", f"""WITH {CHUNKS}, inc AS (SELECT chunk_id, concat('new ', page_number % 7) AS page_content FROM wc WHERE page_number % 3 = 0
  UNION ALL SELECT concat('x', chunk_id), 'added' FROM wc WHERE page_number = 1)
SELECT chunk_id, page_content FROM wc WHERE chunk_id NOT IN (SELECT chunk_id FROM inc) UNION ALL SELECT * FROM inc""")
def s07(spark, sf):
    df = chunks(spark, sf).select("chunk_id", "page_content", "page_number")
    changed = df.filter("page_number % 3 = 0").select("chunk_id", F.expr("concat('new ', page_number % 7)").alias("page_content"), F.lit(2).alias("_seq"))
    older = changed.withColumn("page_content", F.lit("overtaken")).withColumn("_seq", F.lit(1))
    added = df.filter("page_number = 1").select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), F.lit("added").alias("page_content"), F.lit(1).alias("_seq"))
    return B.upsert(df.drop("page_number"), older.unionByName(changed).unionByName(added))


@query("s08_delete_by_document", f"WITH {CHUNKS} SELECT chunk_id, document_id FROM wc WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s08(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return B.delete_documents(chunks(spark, sf), gone).select("chunk_id", "document_id")


@query("s09_metadata_lookup", f"WITH {CHUNKS} SELECT count(*) AS stored, (SELECT count(*) FROM (SELECT * FROM wc WHERE carrier = 'SRC3' LIMIT 1)) AS found FROM wc")
def s09(spark, sf):
    df = chunks(spark, sf)
    found = B.lookup(df, carrier="SRC3").agg(F.count(F.lit(1)).alias("found"))
    return df.agg(F.count(F.lit(1)).alias("stored")).join(F.broadcast(found), how="cross")


@query("s10_index_freshness", f"""WITH {CHUNKS}, st AS (SELECT chunk_id FROM wc WHERE page_number % 4 != 0) SELECT chunk_id, (SELECT count(*) FROM wc) AS parsed,
  (SELECT count(*) FROM st) AS stored, (SELECT count(*) FROM wc) = (SELECT count(*) FROM st) AS fresh FROM wc WHERE chunk_id NOT IN (SELECT chunk_id FROM st)""")
def s10(spark, sf):
    parsed = chunks(spark, sf).select("chunk_id", "page_number")
    stored = parsed.filter("page_number % 4 != 0")
    return B.new_chunks(parsed, stored).select("chunk_id").join(F.broadcast(B.is_fresh(parsed, stored)), how="cross")


@query("s11_resumable_ingest", f"""WITH {FILES} SELECT relative_path AS filename FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def s11(spark, sf):
    df = files(spark, sf).select(F.col("relative_path").alias("filename"), "doc_id")
    status = F.when(F.col("quality") == 1, "completed").otherwise("failed")
    registry = df.join(table(spark, sf, "labels"), "doc_id").select("filename", status.alias("status"))
    return B.pending_files(df, registry).select("filename")


LOG = T.StructType([T.StructField("query", T.StringType()), T.StructField("confidence_tier", T.StringType()), T.StructField("latency_ms", T.DoubleType())])


@query("s12_query_log_sink", f"{'WITH ' + QUESTIONS} SELECT query, 'LOW' AS confidence_tier, query_id * 1.5 AS latency_ms FROM qs")
def s12(spark, sf):
    path = fresh_path(spark, "query-log")
    rows = questions(spark, sf).select("query", F.lit("LOW").alias("confidence_tier"), (F.col("query_id") * 1.5).alias("latency_ms"))
    B.append_query_log(rows, path)
    return spark.read.schema(LOG).json(path)


@query("s13_report_sink", f"WITH {CHUNKS} SELECT carrier, count(*) AS chunks FROM wc GROUP BY carrier")
def s13(spark, sf):
    path = fresh_path(spark, "report")
    B.write_report(chunks(spark, sf).groupBy("carrier").agg(F.count(F.lit(1)).alias("chunks")), path)
    return spark.read.schema("carrier string, chunks long").json(path)


@query("s14_evaluation_set_scan", "SELECT text AS query, substr(text, 1, 20) AS expected_heading, 1 AS keywords, 0 AS negatives FROM benchmark")
def s14(spark, sf):
    path = fresh_path(spark, "evaluation")
    b = table(spark, sf, "benchmark").select(F.col("text").alias("query"), F.substring("text", 1, 20).alias("expected_heading"),
                                             F.array(F.substring("text", 1, 4)).alias("expected_keywords"))
    # files that hold one JSON array each, as evaluation sets come, of about 100 items
    items = b.select(F.to_json(F.struct(*b.columns)).alias("item")).withColumn("file", F.pmod(F.xxhash64("item"), F.lit(1 + b.count() // 100)))
    arrays = items.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    df = S.evaluation_items(spark, path)
    return df.select("query", "expected_heading", F.size("expected_keywords").alias("keywords"), F.size("negative_keywords").alias("negatives"))
