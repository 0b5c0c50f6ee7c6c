"""Reports on what ingestion produced."""
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.operators import diagnostics as Q
from docquarry.operators import sections as T
from docquarry.operators.documents import distinct_chunks
from docquarry.registry.base import CHUNKS, chunks, lit, query, sql_collapse, table
from docquarry.registry.chunks import CHUNK_TABLE, built
from docquarry.registry.sections import SECTIONS, atoms

HASH = f"sha256({sql_collapse('lower(page_content)')})"
BLANKED = "bk0 AS (SELECT * REPLACE (CASE WHEN doc_id % 17 = 0 AND page_number = 1 THEN '  ' ELSE page_content END AS page_content) FROM wc)"


def blanked(spark, sf):
    gone = (F.col("doc_id") % 17 == 0) & (F.col("page_number") == 1)
    return chunks(spark, sf).withColumn("page_content", F.when(gone, "  ").otherwise(F.col("page_content")))


@query("q01_structure_counts", f"""WITH {SECTIONS} SELECT document_id, coalesce(s1, 0) AS sections, coalesce(s2, 0) AS subsections, coalesce(t, 0) AS tables, coalesce(l, 0) AS lists FROM (
  SELECT document_id, count(*) FILTER (WHERE level = 1) AS s1, count(*) FILTER (WHERE level >= 2) AS s2 FROM sec GROUP BY 1) FULL OUTER JOIN (
  SELECT document_id, count(*) FILTER (WHERE block_type = 'table') AS t, count(*) FILTER (WHERE block_type = 'bullet_group') AS l FROM bl GROUP BY 1) USING (document_id)""")
def q01(spark, sf):
    a = atoms(spark, sf)
    spans = T.block_spans(a).withColumn("block_type", F.when(F.col("kind") == "bullet", "bullet_group").otherwise(F.col("kind")))
    return Q.structure_counts(T.section_rows(a), spans)


@query("q02_document_stats", f"""WITH {CHUNKS} SELECT document_id, count(*) AS chunks, round(avg(length(page_content)), 1) AS average_chunk_size,
  count(*) - count(DISTINCT {HASH}) AS duplicate_chunks, count(DISTINCT {HASH}) AS unique_chunks FROM wc GROUP BY 1""")
def q02(spark, sf):
    return Q.document_stats(chunks(spark, sf))


@query("q03_corpus_report", f"""WITH {CHUNKS}, {BLANKED}, x AS (SELECT count(DISTINCT document_id) AS d, count(*) AS n, count(*) FILTER (WHERE trim(page_content) = '') AS e,
  count(DISTINCT {HASH}) FILTER (WHERE trim(page_content) != '') AS u, avg(length(page_content)) AS a, median(length(page_content)) AS m, max(length(page_content)) AS mx, min(length(page_content)) AS mn FROM bk0)
SELECT d AS documents_processed, n AS total_chunks, u AS unique_chunks, n - u - e AS duplicate_chunks, round((n - u - e) / n, 4) AS duplicate_ratio, e AS empty_chunks, n - u AS skipped_chunks,
  round(a, 1) AS average_chunk_size, CAST(floor(m) AS INT) AS median_chunk_length, mx AS max_chunk_length, mn AS min_chunk_length, round(n / d, 1) AS average_chunks_per_document FROM x""")
def q03(spark, sf):
    return Q.corpus_report(blanked(spark, sf))


@query("q04_type_histogram", f"WITH {CHUNK_TABLE} SELECT chunk_type, count(*) AS chunks FROM ck GROUP BY 1")
def q04(spark, sf):
    return Q.type_histogram(built(spark, sf, "chunk_type"))


SHARES = " UNION ALL ".join(f"SELECT {lit(k)} AS key, round(avg(CASE WHEN {k} IS NOT NULL AND CAST({k} AS VARCHAR) != '' THEN 1.0 ELSE 0.0 END), 3) AS completeness FROM ck" for k in V.COMPLETENESS_KEYS)


@query("q05_metadata_completeness", f"WITH {CHUNK_TABLE} {SHARES}")
def q05(spark, sf):
    return Q.metadata_completeness(built(spark, sf, *V.COMPLETENESS_KEYS))


def largest(name, kind):
    @query(name, f"""WITH {CHUNK_TABLE} SELECT chunk_id, source, section_title, heading_path, length(page_content) AS length, page_start FROM ck WHERE chunk_type = {lit(kind)}
ORDER BY length DESC, chunk_id LIMIT 10""")
    def run(spark, sf):
        columns = ("chunk_id", "chunk_type", "source", "section_title", "heading_path", "page_content", "bullet_count", "page_start")
        return Q.largest_chunks(built(spark, sf, *columns, where=F.col("chunk_type") == kind), kind).drop("bullet_count")


largest("q06_largest_tables", "table")
largest("q06_largest_bullet_groups", "bullet_group")


@query("q07_ingest_metrics", f"WITH {CHUNKS} SELECT (SELECT count(*) FROM documents) AS documents, sum(1) AS chunks, (SELECT count(*) FROM pages) AS pages, count(DISTINCT {HASH}) AS collection_size FROM wc")
def q07(spark, sf):
    c = chunks(spark, sf)
    return Q.ingest_metrics(table(spark, sf, "documents"), table(spark, sf, "pages"), c, distinct_chunks(c.select("chunk_index", "page_content")))
