"""Keyword statistics and scores, vectors."""
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.operators import cells as C
from docquarry.operators import index as X
from docquarry.operators import retrieve as R
from docquarry.registry.base import CARRIERS, CHUNKS, LOBS, QUESTIONS, chunks, lit, query, questions, sql_any, stored_chunks, table
from docquarry.session import cut, fresh_path

CONFIG = R.SearchConfig(carriers=CARRIERS, lobs=LOBS, fuzzy=False)
TOK = lambda x: f"regexp_extract_all(lower({x}), {lit(V.TOKEN)})"
TOKENS = f"ct AS (SELECT *, {TOK('page_content')} AS toks, len({TOK('page_content')}) AS dl FROM wc)"
POSTINGS = f"{TOKENS}, po AS (SELECT chunk_id, carrier, line_of_business, term, dl, count(*) AS tf FROM (SELECT chunk_id, carrier, line_of_business, dl, unnest(toks) AS term FROM ct) GROUP BY ALL)"
STATS = f"{POSTINGS}, st AS (SELECT term, count(*) AS df FROM po GROUP BY term), co AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ct)"


@query("x01_tokenise", f"WITH {CHUNKS}, {TOKENS} SELECT chunk_id, dl, array_to_string(toks, ' ') AS tokens FROM ct")
def x01(spark, sf):
    t = X.tokens(F.col("page_content"))
    return chunks(spark, sf).select("chunk_id", F.size(t).alias("dl"), F.array_join(t, " ").alias("tokens"))


@query("x02_postings", f"WITH {CHUNKS}, {POSTINGS} SELECT chunk_id, term, dl, tf FROM po")
def x02(spark, sf):
    return X.postings(chunks(spark, sf)).select("chunk_id", "term", "dl", "tf")


@query("x02_term_stats", f"WITH {CHUNKS}, {STATS} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM st, co")
def x02s(spark, sf):
    df = chunks(spark, sf)
    return X.term_stats(df).join(F.broadcast(X.corpus_stats(df)), how="cross").withColumn("avgdl", F.round("avgdl", 6))


SETS = "GROUPING SETS ((carrier, line_of_business{t}), (carrier{t}), (line_of_business{t}), ({t0}))"
SCOPED = f"""{POSTINGS}, sst AS (SELECT carrier, line_of_business, term, count(*) AS df FROM po GROUP BY {SETS.format(t=', term', t0='term')}),
sco AS (SELECT carrier, line_of_business, count(*) AS n, avg(dl) AS avgdl FROM ct GROUP BY {SETS.format(t='', t0='')}),
sraw AS (SELECT sst.*, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM sst JOIN sco
  ON sst.carrier IS NOT DISTINCT FROM sco.carrier AND sst.line_of_business IS NOT DISTINCT FROM sco.line_of_business),
sidf AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY carrier, line_of_business) ELSE raw END AS weight FROM sraw)"""


@query("x03_scoped_stats", f"WITH {CHUNKS}, {SCOPED} SELECT carrier, line_of_business, term, df, n, round(avgdl, 6) AS avgdl FROM sraw")
def x03(spark, sf):
    df = cut(X.chunk_terms(chunks(spark, sf).select("carrier", "line_of_business", "page_content")), "chunk-terms")  # read by both
    t, c = X.scoped_term_stats(df).alias("t"), X.scoped_corpus_stats(df).alias("c")
    same = [F.col(f"t.{s}").eqNullSafe(F.col(f"c.{s}")) for s in X.SCOPE]
    return t.join(c, same).select("t.*", "n", F.round("avgdl", 6).alias("avgdl"))


QT = lambda text, src: f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK(text)}) AS term FROM {src}) GROUP BY ALL)"
PART = "qtf * weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"
GLOBAL = f"""{STATS}, raw0 AS (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM st, co),
idf AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw0) ELSE raw END AS weight FROM raw0),
{QT('query', 'qs')}, sc AS (SELECT query_id, chunk_id, sum({PART}) AS score FROM qt JOIN po USING (term) JOIN idf USING (term) GROUP BY 1, 2)"""


@query("x04_bm25_scores", f"WITH {CHUNKS}, {QUESTIONS}, {GLOBAL} SELECT query_id, chunk_id, round(score, 6) AS score FROM sc")
def x04(spark, sf):
    return X.bm25_scores(stored_chunks(spark, sf), questions(spark, sf), query_text="query").withColumn("score", F.round("score", 6))


# --- what a query is about; the scope of the search ----------------------------------
NAMED = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(query), {lit(a)}) THEN {lit(n)} END" for n, a in CARRIERS) + "], lambda x: x IS NOT NULL)"
WORD = lambda kws: f"regexp_matches(lower(query), {lit('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(' + '|'.join(kws) + ')($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')})"
LOB = "CASE " + " ".join(f"WHEN {WORD(k)} THEN {lit(n)}" for n, k in LOBS) + " END"
ADMIN = sql_any("lower(query)", V.ADMIN_KEYWORDS)
DETECTED = f"""{QUESTIONS}, qd AS (SELECT query_id, query, len({NAMED}) > 1 AS is_comparison, CASE WHEN len({NAMED}) = 1 THEN ({NAMED})[1] END AS carrier,
  CASE WHEN NOT {ADMIN} THEN {LOB} END AS line_of_business, {ADMIN} AS is_admin,
  CASE WHEN {ADMIN} THEN concat(query, {lit(V.ADMIN_EXPANSION)}) ELSE query END AS search_query FROM qs)"""
SCOPED_SCORES = f"""{SCOPED}, {QT('search_query', 'qd')},
ssc AS (SELECT qt.query_id, po.chunk_id, sum({PART}) AS score FROM qt JOIN qd USING (query_id)
  JOIN sidf ON sidf.term = qt.term AND sidf.carrier IS NOT DISTINCT FROM qd.carrier AND sidf.line_of_business IS NOT DISTINCT FROM qd.line_of_business
  JOIN po ON po.term = qt.term AND (qd.carrier IS NULL OR qd.carrier = po.carrier) AND (qd.line_of_business IS NULL OR qd.line_of_business = po.line_of_business) GROUP BY 1, 2)"""


@query("x04_bm25_scoped_scores", f"WITH {CHUNKS}, {DETECTED}, {SCOPED_SCORES} SELECT query_id, chunk_id, round(score, 6) AS score FROM ssc")
def x04s(spark, sf):
    scoped = R.detect_scope(questions(spark, sf), CONFIG)
    return X.scoped_bm25_scores(X.build_index(stored_chunks(spark, sf)), scoped).withColumn("score", F.round("score", 6))


TOP = lambda s: f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {s} WHERE score > 0) WHERE rank <= 25"


@query("x04_bm25_top", f"WITH {CHUNKS}, {QUESTIONS}, {GLOBAL} {TOP('sc')}")
def x04t(spark, sf):
    scores = X.bm25_scores(stored_chunks(spark, sf), questions(spark, sf), query_text="query")
    return R.sparse_candidates(scores).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("x04_stored_index_top", f"WITH {CHUNKS}, {DETECTED}, {SCOPED_SCORES} {TOP('ssc')}")
def x04i(spark, sf):
    path = fresh_path(spark, "keyword-index")
    X.write_index(X.build_index(stored_chunks(spark, sf)), path)
    scores = X.scoped_bm25_scores(X.read_index(spark, path), R.detect_scope(questions(spark, sf), CONFIG))
    return R.sparse_candidates(scores).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("x05_hashed_vectors")
def x05(spark, sf):
    c, q = X.encode_hashed(chunks(spark, sf).select("chunk_id", "page_content"), questions(spark, sf))
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 4)
    return c.select("chunk_id", norm.alias("norm")).unionByName(q.select(F.concat(F.lit("q"), "query_id").alias("chunk_id"), norm.alias("norm")))


@query("x05_model_vectors", f"""WITH {CHUNKS}, b AS (SELECT chunk_id, encode(page_content) AS e FROM wc) SELECT chunk_id, 1.0 AS norm FROM b""")
def x05m(spark, sf):
    def make():  # stands in for a model: byte length and vowel count
        return lambda texts: [[len(t.encode()), 1 + sum(t.count(v) for v in "aeiou")] for t in texts]
    df = X.encode_with(chunks(spark, sf).select("chunk_id", "page_content"), "page_content", make, X.query_prefix("a-bge-model"))
    return df.select("chunk_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 4).alias("norm"))


DOT = "list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))"


@query("x06_vector_knn", f"""SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT a.vec_id AS query_id, CAST(b.vec_id AS VARCHAR) AS chunk_id, round({DOT}, 9) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label)) WHERE rank <= 25""")
def x06(spark, sf):
    # every vector asks for its nearest ones of the same label, the label being the scope
    v = table(spark, sf, "embeddings").withColumn("carrier", F.col("label").cast("string"))
    return X.nearest(v.withColumn("chunk_id", F.col("vec_id").cast("string")), v.withColumnRenamed("vec_id", "query_id")).select(
        "query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("x06_vector_knn_all", f"""SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT item_id AS query_id, CAST(b.vec_id AS VARCHAR) AS chunk_id, round({DOT}, 9) AS score FROM benchmark JOIN embeddings a ON a.vec_id = item_id, embeddings b)) WHERE rank <= 25""")
def x06a(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    return X.nearest(v, questions(spark, sf, vectors=True)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("x06_cells_all", f"""SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT a.vec_id AS query_id, CAST(b.vec_id AS VARCHAR) AS chunk_id, round({DOT}, 9) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label)) WHERE rank <= 25""")
def x06c(spark, sf):
    # all cells probed: what the blocks of cells find together is the exact result
    v = table(spark, sf, "embeddings").withColumn("carrier", F.col("label").cast("string"))
    index = C.build_vector_index(v.withColumn("chunk_id", F.col("vec_id").cast("string")))
    return C.nearest_in_cells(index, v.withColumnRenamed("vec_id", "query_id"), probes=len(index.centres)).select(
        "query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("x06_approximate_knn")
def x06n(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("carrier", F.col("label").cast("string"))
    path = fresh_path(spark, "vector-index")
    C.write_vector_index(C.build_vector_index(v.withColumn("chunk_id", F.col("vec_id").cast("string"))), path)
    return C.nearest_in_cells(C.read_vector_index(spark, path), v.withColumnRenamed("vec_id", "query_id")).select(
        "query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))
