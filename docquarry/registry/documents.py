"""Pages, duplicates and metadata from paths."""
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.operators import documents as D
from docquarry.registry.base import (CHUNKS, FILES, chunks, files, lit, query, sql_any, sql_collapse, table)

# every document also has a blank page and a short one; the whole text is their alternate
LOW = """low AS (SELECT doc_id, unnest([text, '  ', concat('short page ', doc_id)]) AS text, CASE WHEN doc_id % 2 = 0 THEN text END AS alt_text FROM documents)"""


def low_pages(spark, sf):
    more = F.array("text", F.lit("  "), F.concat(F.lit("short page "), F.col("doc_id")))
    return table(spark, sf, "documents").select("doc_id", F.explode(more).alias("_t"), F.expr("CASE WHEN doc_id % 2 = 0 THEN text END").alias("alt_text")).select(
        "doc_id", F.col("_t").alias("text"), "alt_text")


@query("s03_low_text_repair", f"""WITH {LOW} SELECT doc_id, low_text, ocr_used, CASE WHEN ocr_used THEN alt_text ELSE text END AS text FROM (
  SELECT *, length(trim(text)) < 20 AS low_text,
  length(trim(text)) < 20 AND length(trim(coalesce(alt_text, ''))) > length(trim(text)) AS ocr_used FROM low)""")
def s03(spark, sf):
    return D.repair_low_text(low_pages(spark, sf)).drop("alt_text")


@query("s04_empty_page_filter", f"WITH {LOW} SELECT doc_id, text FROM low WHERE trim(text) != ''")
def s04(spark, sf):
    return D.drop_blank_pages(low_pages(spark, sf)).select("doc_id", "text")


@query("d01_exact_dedup", f"""WITH {FILES} SELECT min(relative_path) AS relative_path, sha256(text) AS file_hash FROM files GROUP BY sha256(text)""")
def d01(spark, sf):
    return D.distinct_files(files(spark, sf), "text")


FIRST = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ' ' ELSE string_split(text, chr(10))[1] END"
KEY = rf"CASE WHEN f IS NOT NULL THEN concat('t', sha256(lower(regexp_replace(f, '\s+', '', 'g')))) ELSE concat('b', sha256(text)) END"


@query("d02_near_dedup_first_page", f"""WITH {FILES} SELECT {KEY} AS page_hash, min(relative_path) AS relative_path
FROM (SELECT *, {FIRST} AS f FROM files) GROUP BY 1""")
def d02(spark, sf):
    first = F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ' ' ELSE substring_index(text, chr(10), 1) END")
    return D.distinct_first_pages(files(spark, sf).withColumn("first_page", first), content="text")


@query("d03_chunk_dedup", f"""WITH {CHUNKS} SELECT h AS text_hash, min(chunk_index) AS chunk_index, arg_min(chunk_id, chunk_index) AS chunk_id,
  count(*) AS copies FROM (SELECT *, sha256({sql_collapse('lower(page_content)')}) AS h FROM wc) GROUP BY h""")
def d03(spark, sf):
    df = chunks(spark, sf).select("chunk_index", "chunk_id", "page_content")
    kept = D.distinct_chunks(df).select("text_hash", "chunk_index", "chunk_id")
    copies = df.groupBy(D.fingerprint(F.col("page_content")).alias("text_hash")).agg(F.count(F.lit(1)).alias("copies"))
    return kept.join(copies, "text_hash")


@query("d03_chunk_dedup_counts", f"""WITH {CHUNKS} SELECT sum(n) AS total_chunks, count(*) AS unique_chunks, sum(n - 1) AS skipped_chunks
FROM (SELECT count(*) AS n FROM wc GROUP BY sha256({sql_collapse('lower(page_content)')}))""")
def d03c(spark, sf):
    return D.chunk_duplicates(chunks(spark, sf))


@query("d04_document_id", f"WITH {FILES} SELECT relative_path, substr(md5(relative_path), 1, 16) AS document_id FROM files")
def d04(spark, sf):
    return files(spark, sf).select("relative_path", D.document_id(F.col("relative_path")).alias("document_id"))


PREFIX = "|".join(V.CARRIER_PREFIXES)
PARTS = f"""fp AS (SELECT *, CASE WHEN len(p) > 0 AND regexp_matches(p[1], '^({PREFIX})[-_](.+)$', 'i')
    THEN list_concat([upper(regexp_extract(p[1], '^({PREFIX})[-_](.+)$', 1, 'i')), regexp_extract(p[1], '^({PREFIX})[-_](.+)$', 2, 'i')], p[2:])
    ELSE p END AS q, regexp_replace(name, '\\.[^.]*$', '') AS stem
  FROM (SELECT *, string_split(relative_path, '/')[:-2] AS p, string_split(relative_path, '/')[-1] AS name FROM files))"""
NORMAL = "lower(trim(regexp_replace({}, '[_-]+', ' ', 'g')))"


@query("d05_folder_metadata", f"""WITH {FILES}, {PARTS} SELECT relative_path, q[1] AS category_1, q[2] AS category_2, q[3] AS category_3,
  q[4] AS category_4, q[5] AS category_5, upper(trim(q[1])) AS carrier, {NORMAL.format('q[2]')} AS line_of_business, q[2] AS line_of_business_raw,
  q[3] AS product, q[4] AS sub_product, array_to_string(q, ' > ') AS folder_hierarchy, len(q) AS folder_depth, stem AS document_name FROM fp""")
def d05(spark, sf):
    return D.folder_metadata(files(spark, sf).select("relative_path"))


@query("d06_compound_folder_split", f"WITH {FILES}, {PARTS} SELECT relative_path, array_to_string(q, '/') AS folders FROM fp")
def d06(spark, sf):
    return files(spark, sf).select("relative_path", F.array_join(D.split_compound(D.folders(F.col("relative_path"))), "/").alias("folders"))


@query("d07_token_normalise", f"WITH {FILES}, {PARTS} SELECT relative_path, {NORMAL.format('stem')} AS token FROM fp")
def d07(spark, sf):
    return files(spark, sf).select("relative_path", D.normal_token(D.stem(F.col("relative_path"))).alias("token"))


HAY = NORMAL.format("replace(relative_path, '/', ' ')")


def sql_types(pick, default):
    arms = " ".join(f"WHEN {sql_any(HAY, words)} THEN {pick(kind, p)}" for kind, p, words in V.DOCUMENT_TYPES)
    return f"CASE {arms} ELSE {default} END"


@query("d08_document_type", f"""WITH {FILES} SELECT relative_path, {sql_types(lambda k, p: lit(k), lit(V.DEFAULT_TYPE))} AS document_type,
  {sql_types(lambda k, p: str(p), V.DEFAULT_PRIORITY)} AS document_priority FROM files""")
def d08(spark, sf):
    return files(spark, sf).select("relative_path", D.classify(F.col("relative_path")).alias("c")).select("relative_path", "c.*")


SQL_LOB = lambda x: "CASE " + " ".join(f"WHEN contains({x}, {lit(k)}) THEN {lit(v)}" for k, v in V.PATH_LOBS) + " END"
SPACED = lambda x: f"lower(translate({x}, '_-', '  '))"


@query("d09_metadata_by_contains", f"""WITH {FILES}, {PARTS} SELECT relative_path,
  CASE WHEN contains(lower(relative_path), 'sbi') THEN 'SBI' WHEN contains(lower(relative_path), 'hdfc') THEN 'HDFC' ELSE 'Other' END AS carrier,
  coalesce(list_filter(list_transform(p, lambda f: {SQL_LOB(SPACED('f'))}), lambda v: v IS NOT NULL)[1], {SQL_LOB(SPACED('name'))}, 'Other') AS line_of_business,
  coalesce(p[3], trim(translate(stem, '_-', '  '))) AS product_name, array_to_string(p, ' > ') AS full_path_hierarchy FROM fp""")
def d09(spark, sf):
    return D.metadata_by_contains(files(spark, sf).select("relative_path"))


SQL_KIND = "CASE " + " ".join(f"WHEN {sql_any('lower(name)', w)} THEN {lit(k)}" for w, k in V.NAME_TYPES) + " ELSE 'Document' END"


@query("d10_metadata_by_depth", f"""WITH {FILES}, {PARTS} SELECT relative_path, CASE WHEN len(p) >= 2 THEN p[1] ELSE 'General' END AS carrier,
  CASE WHEN len(p) >= 2 THEN p[2] WHEN len(p) = 1 THEN p[1] ELSE 'Other' END AS lob, CASE WHEN len(p) >= 3 THEN p[3] END AS scheme_name,
  {SQL_KIND} AS document_type FROM fp""")
def d10(spark, sf):
    return D.metadata_by_depth(files(spark, sf).select("relative_path"))


@query("d11_flatten_pages", f"""WITH {FILES}, {PARTS} SELECT substr(md5(relative_path), 1, 16) AS document_id, i AS page, l[i] AS text,
  {sql_types(lambda k, p: lit(k), lit(V.DEFAULT_TYPE))} AS document_type, upper(trim(q[1])) AS carrier
FROM (SELECT *, string_split(text, chr(10)) AS l FROM fp), unnest(range(1, len(l) + 1)) AS t(i)""")
def d11(spark, sf):
    docs = files(spark, sf).withColumn("document_id", D.document_id(F.col("relative_path")))
    pages = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select(
        "document_id", (F.col("p") + 1).alias("page"), "text")
    meta = D.folder_metadata(docs.select("document_id", "relative_path")).withColumn(
        "document_type", D.classify(F.col("relative_path")).document_type)
    return D.flatten_pages(pages, meta.select("document_id", "document_type", "carrier"))


@query("d12_breakdown", f"""WITH {CHUNKS} SELECT 'carrier' AS dimension, carrier AS value, count(*) AS chunks FROM wc GROUP BY carrier
UNION ALL SELECT 'line_of_business', line_of_business, count(*) FROM wc GROUP BY line_of_business""")
def d12(spark, sf):
    return D.breakdown(chunks(spark, sf))
