"""Registration, and the views that the queries are run on.

The given tables hold plain prose; headings, bullets, tables, paths and the
like are derived from them by one rule that both engines evaluate, so every
query reads the whole of a given table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.joins import is_small
from docquarry.operators.retrieve import FEW_QUERIES
from docquarry.session import cut, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


TEXTS = ("documents", "pages", "conversations", "embeddings")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def sql_rx(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {lit(pattern)}{', ' + lit('i') if ignore_case else ''})"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


# --- document paths ---------------------------------------------------------------
PATH = """concat(
  CASE doc_id % 4 WHEN 0 THEN concat('SBI-', lang, '/') WHEN 1 THEN concat('hdfc_group ', lang, '/', source, '/')
    WHEN 2 THEN concat('Acme/', lang, '_Health-Plan/', source, '/Sub_Plan/') ELSE '' END,
  CASE doc_id % 9 WHEN 0 THEN 'Policy_Wording' WHEN 1 THEN 'cis' WHEN 2 THEN 'Schedule-A' WHEN 3 THEN 'handbook'
    WHEN 4 THEN 'Brochure' WHEN 5 THEN 'faq' WHEN 6 THEN 'flyer' WHEN 7 THEN 'Guideline_travel' ELSE 'notes' END,
  '_', doc_id, '.txt')"""


def files(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").withColumn("relative_path", F.expr(PATH))


FILES = f"files AS (SELECT *, {PATH} AS relative_path FROM documents)"

# --- noisy lines (for cleaning) -----------------------------------------------------
# a noisy line stands before the given one, or has all of it; nothing of the text is lost
NOISE = """CASE (doc_id * 3 + {n}) % 19
  WHEN 0 THEN concat('Policy Wording', chr(10), {x}) WHEN 1 THEN concat(' Record of Changes', chr(10), {x})
  WHEN 2 THEN concat('2/20/25 revised', chr(10), {x}) WHEN 3 THEN concat('Page 12', chr(10), {x})
  WHEN 4 THEN concat('------', chr(10), {x}) WHEN 5 THEN concat({x}, ' see https://example.com/a?b=1 now')
  WHEN 6 THEN concat('• ', {x}) WHEN 7 THEN concat('Scope of cover.......5', chr(10), {x})
  WHEN 8 THEN concat('  ', replace({x}, ' ', '   '), ' ')
  WHEN 9 THEN concat('x', replace({x}, '.', ''), 'con-')
  WHEN 10 THEN concat('5-1-13 Waiting period terms 5-9', chr(10), {x}) WHEN 11 THEN concat('January 5, 2024 edition', chr(10), {x})
  WHEN 12 THEN concat('“', {x}, '” ﬁne − don’t ﬄ') WHEN 13 THEN concat('   ', chr(10), {x}) WHEN 14 THEN concat('a . . . . . . b', chr(10), {x})
  WHEN 15 THEN concat('- item one-', chr(10), {x}) WHEN 16 THEN concat('5-1-13', chr(10), {x}) WHEN 17 THEN concat('42', chr(10), {x}) ELSE {x} END"""


def noisy(spark, sf) -> DataFrame:
    """documents with noisy text"""
    body = f"array_join(transform(split(text, chr(10)), (x, i) -> {NOISE.format(x='x', n='(i + 1)')}), chr(10))"
    return table(spark, sf, "documents").select("doc_id", F.expr(body).alias("text"))


NOISY = f"""noisy AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: {NOISE.format(x='x', n='i')}), chr(10)) AS text FROM documents)"""


def noisy_lines(spark, sf) -> DataFrame:
    """one row per noisy line, trimmed, blank ones dropped; n counts from 1"""
    from docquarry.functions.text import strip
    df = noisy(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\R")).alias("n", "line"))
    return df.select("doc_id", (F.col("n") + 1).alias("n"), strip(F.col("line")).alias("line")).filter("line != ''")


NOISY_LINES = f"""{NOISY}, nl AS (SELECT doc_id, n, trim(line) AS line FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM noisy))
  WHERE trim(line) != '')"""

# --- structured pages (for sections and chunks) ----------------------------------------
BREAKS = """replace(text, CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE ', ' END,
  CASE WHEN doc_id % 2 = 0 THEN concat('.', chr(10)) ELSE concat(',', chr(10)) END)"""
# a structural line stands beside the given one, or has all of it; {L} makes a list
SHAPE = """CASE WHEN doc_id % 7 = 5 THEN {L}({x}) WHEN doc_id % 7 = 3 THEN {L}(concat('- ', {x}))
  ELSE CASE (doc_id * 5 + {n}) % 17
  WHEN 0 THEN {L}(concat('1.', {n} % 3 + 1, ' ', CASE {n} % 4 WHEN 0 THEN 'Benefits and Limits' WHEN 1 THEN 'Hospital Cover'
    WHEN 2 THEN 'claims procedure' ELSE 'Definitions' END), {x})
  WHEN 1 THEN {L}(concat('- ', {x}))
  WHEN 2 THEN {L}(concat('(a) ', {x}, ' 12% of Rs. 500 for 30 days'))
  WHEN 3 THEN {L}({x}, '| Plan | Limit | Period |')
  WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN {L}('| --- | --- | --- |', concat('| ', {x}, ' | 7 | 1 month |'))
    ELSE {L}(concat('| ', {x}, ' | ', {n}, ' |')) END
  WHEN 5 THEN {L}(concat('| ', {x}, ' | Rs. ', {n} * 100, ' | ', {n}, ' months |'))
  WHEN 6 THEN {L}({x}, '3.2')
  WHEN 7 THEN {L}(CASE WHEN doc_id % 3 = 1 THEN '| lone | row |' ELSE 'GENERAL EXCLUSIONS' END, {x})
  WHEN 8 THEN {L}(concat('Scope of Cover ', {n}), {x})
  WHEN 9 THEN {L}({x}, '2.1.4.1')
  WHEN 10 THEN {L}(concat({x}, ' see Section 4.2(a), Clause IV and section 4.2(a)'))
  WHEN 11 THEN {L}({x}, 'A-12')
  WHEN 12 THEN {L}('What is a waiting period?', {x})
  WHEN 13 THEN {L}(concat('"Hospital" means ', {x}))
  ELSE {L}({x}) END END"""
LINES_PER_PAGE = 6


def pages(spark, sf) -> DataFrame:
    """(document_id, page, text): six structured lines per page"""
    shaped = f"flatten(transform(split({BREAKS}, chr(10)), (x, i) -> {SHAPE.format(x='x', n='(i + 1)', L='array')}))"
    df = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.expr(shaped).alias("l"))
    per = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / LINES_PER_PAGE).cast("int")),
                      lambda p: F.array_join(F.slice("l", p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"))
    return df.select("document_id", F.posexplode(per).alias("page", "text")).withColumn("page", F.col("page") + 1)


PAGE_LINES = f"""raw AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM (
  SELECT doc_id, flatten(list_transform(string_split({BREAKS}, chr(10)), lambda x, i: {SHAPE.format(x='x', n='i', L='list_value')})) AS l FROM documents)),
tl AS (SELECT document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY n) - 1 AS line_no, line FROM (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, (n - 1) // {LINES_PER_PAGE} + 1 AS page, n, trim(x) AS line FROM raw)
  WHERE line != '')"""


def documents_meta(spark, sf) -> DataFrame:
    """document rows with all metadata from their path"""
    from docquarry.operators.documents import classify, folder_metadata
    df = files(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), "relative_path",
                                 F.element_at(F.split("relative_path", "/"), -1).alias("source"))
    return folder_metadata(df).select("*", classify(F.col("relative_path")).alias("c")).select("*", "c.*").drop("c")


# --- plain chunks, queries and vectors (for search and evaluation) ------------------------
WINDOW, OVERLAP = 120, 20
CARRIERS = tuple((f"SRC{i}", f"src{i}") for i in range(20))
LOBS = (("en", ("the", "and")), ("fr", ("les", "des")), ("de", ("und", "der")), ("es", ("los", "las")))
FILE = """concat(CASE doc_id % 5 WHEN 0 THEN 'Policy-Wording_' WHEN 1 THEN 'Group_Term-' ELSE 'notes_' END, source, '_', doc_id, '.txt')"""
QUERY = """CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, ' SRC', item_id % 20)
  WHEN 2 THEN concat(text, ' src3 src5 claim form') ELSE concat(text, ' Src', item_id % 20, ' group term benefit 30%') END"""


def stored_chunks(spark, sf, vectors: bool = False) -> DataFrame:
    """the chunk view as a table, for queries that read it more than twice"""
    return cut(chunks(spark, sf, vectors), "chunks")


def chunks(spark, sf, vectors: bool = False) -> DataFrame:
    """windows of words as chunks; one page per window"""
    from docquarry.operators.chunks import token_windows
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    df = table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.expr(FILE).alias("filename"), F.upper("source").alias("carrier"), F.col("lang").alias("line_of_business"),
        F.expr("CASE quality WHEN 1 THEN 100 WHEN 0 THEN 20 ELSE 55 END").alias("document_priority"),
        token_windows(F.col("text"), WINDOW, OVERLAP).alias("w"))
    df = df.select("*", F.size("w").alias("_n"), F.posexplode("w").alias("i", "page_content")).withColumns({
        "chunk_id": F.concat_ws("_", "doc_id", "i"), "document_id": F.col("doc_id").cast("string"), "page_number": F.col("i") + 1,
        "chunk_index": F.col("doc_id") * 1000 + F.col("i"),
        "heading_path": F.concat(F.lit("Part "), F.col("i") + 1, F.lit(" > "), F.substring("page_content", 1, 20)),
        "document_type": F.lit("document"),
        "previous_chunk_id": F.when(F.col("i") > 0, F.concat_ws("_", "doc_id", F.col("i") - 1)),
        "next_chunk_id": F.when(F.col("i") < F.col("_n") - 1, F.concat_ws("_", "doc_id", F.col("i") + 1))})
    if vectors:  # vec_id = doc_id is a stand-in: the vectors were not made from the texts
        v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("i"), "embedding")
        df = df.join(v, ["doc_id", "i"], "left")
    return df.drop("w", "_n", "i")


CHUNKS = rf"""words AS (SELECT d.*, CASE l.quality WHEN 1 THEN 100 WHEN 0 THEN 20 ELSE 55 END AS document_priority,
  string_split({sql_collapse('text')}, ' ') AS ws FROM documents d LEFT JOIN labels l USING (doc_id)),
starts AS (SELECT *, unnest(range(0, greatest(len(ws) - {OVERLAP}, 1), {WINDOW - OVERLAP})) AS s,
  len(range(0, greatest(len(ws) - {OVERLAP}, 1), {WINDOW - OVERLAP})) AS nw FROM words),
wc0 AS (SELECT *, s // {WINDOW - OVERLAP} AS i, array_to_string(ws[s + 1:s + {WINDOW}], ' ') AS page_content FROM starts),
wc AS (SELECT doc_id, {FILE} AS filename, upper(source) AS carrier, lang AS line_of_business, document_priority, page_content,
  concat(doc_id, '_', i) AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, i + 1 AS page_number, doc_id * 1000 + i AS chunk_index,
  concat('Part ', i + 1, ' > ', substr(page_content, 1, 20)) AS heading_path, 'document' AS document_type,
  CASE WHEN i > 0 THEN concat(doc_id, '_', i - 1) END AS previous_chunk_id,
  CASE WHEN i < nw - 1 THEN concat(doc_id, '_', i + 1) END AS next_chunk_id FROM wc0)"""


def few_questions(spark, sf) -> bool:
    """may a few dozen rows per question be sent to all tasks?"""
    return is_small(questions(spark, sf), FEW_QUERIES)


def questions(spark, sf, vectors: bool = False) -> DataFrame:
    df = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(QUERY).alias("query"))
    if vectors:
        df = df.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return df


QUESTIONS = f"qs AS (SELECT item_id AS query_id, {QUERY} AS query FROM benchmark)"
