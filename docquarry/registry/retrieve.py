"""Scope, fusion, ranking and context."""
from dataclasses import replace

from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions import similarity as Y
from docquarry.operators import index as X
from docquarry.operators import retrieve as R
from docquarry.registry.base import CARRIERS, CHUNKS, LOBS, QUESTIONS, chunks, few_questions, lit, query, questions, sql_any, stored_chunks, table
from docquarry.registry.index import ADMIN, CONFIG, DETECTED, DOT, LOB, SCOPED_SCORES, TOK
from docquarry.session import cut

def detected(spark, sf, vectors=False):
    return R.detect_scope(questions(spark, sf, vectors), CONFIG)


@query("r01_carrier_detection", f"WITH {DETECTED} SELECT query_id, carrier, is_comparison FROM qd")
def r01(spark, sf):
    return questions(spark, sf).select("query_id", R.detect_carrier(F.col("query"), CARRIERS).alias("carrier"), R.is_comparison(F.col("query"), CARRIERS).alias("is_comparison"))


@query("r02_lob_detection", f"WITH {DETECTED}, x AS (SELECT query_id, query FROM qs) SELECT query_id, {'CASE '}" + " ".join(
    "WHEN regexp_matches(lower(query), '(^|[^\\p{L}\\p{N}_])(" + "|".join(k) + ")($|[^\\p{L}\\p{N}_])') THEN " + lit(n) for n, k in LOBS) + " END AS line_of_business FROM x")
def r02(spark, sf):
    return questions(spark, sf).select("query_id", R.detect_lob(F.col("query"), LOBS).alias("line_of_business"))


def messages(spark, sf):
    """what users typed, with misspelt names"""
    said = F.concat(F.element_at(F.array(F.lit("sorce"), F.lit("saral suraksa "), F.lit("retirment ")), (F.col("turn") % 3 + 1).cast("int")), F.col("conv_id") % 20, F.lit(" "), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lower(said).alias("q"))


SOURCES = tuple((f"SRC{i}", f"source{i}") for i in range(20))
MESSAGES = """msg AS (SELECT conv_id, turn, lower(concat((['sorce', 'saral suraksa ', 'retirment '])[turn % 3 + 1], conv_id % 20, ' ', text)) AS q FROM conversations)"""


def sql_common(word, text, first="0", size=None):
    """length of the longest common subsequence of a text and letters of a word, by the bits of the word's places"""
    n = size or f"len({word})"
    places = (f"list_transform(string_split({text}, ''), lambda c: CAST(list_sum(list_transform(range(0, len({word})), "
              f"lambda k: CASE WHEN substr({word}, k + 1, 1) = c THEN 1::BIGINT << k ELSE 0 END)) AS BIGINT) >> {first})")
    full = f"((1::BIGINT << ({n})) - 1)"
    return f"(({n}) - bit_count(list_reduce({places}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})))"


def sql_fuzzy_carrier(source, key, text, aliases):
    rows = ", ".join(f"({lit(n)}, {lit(a)}, {j})" for j, (n, a) in enumerate(aliases))
    return f"""tk AS (SELECT {key}, word, min(i) AS i FROM (SELECT {key}, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM (
  SELECT {key}, {TOK(text)} AS t FROM {source})) GROUP BY ALL),
al(name, alias, j) AS (VALUES {rows}),
ws AS (SELECT word, name, j, 200.0 * {sql_common('alias', 'word')} / (len(word) + len(alias)) AS score FROM (SELECT DISTINCT word FROM tk), al
  WHERE 200.0 * least(len(word), len(alias)) >= {V.FUZZY_THRESHOLD} * (len(word) + len(alias))),
fz AS (SELECT {key}, first(name ORDER BY score DESC, i, j) AS found FROM tk JOIN ws USING (word) WHERE score >= {V.FUZZY_THRESHOLD} GROUP BY {key})"""


@query("r03_fuzzy_carrier", f"WITH {MESSAGES}, {sql_fuzzy_carrier('msg', 'conv_id, turn', 'q', SOURCES)} SELECT conv_id, turn, found AS carrier FROM msg LEFT JOIN fz USING (conv_id, turn)")
def r03(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", Y.fuzzy_carrier(F.array_distinct(X.tokens(F.col("q"))), SOURCES).alias("carrier"))


# the windows of a message that overlap a piece of a keyword; longer keywords than messages do not occur
def sql_fuzzy_lob(source, key, text):
    rows, pieces, j = [], [], 0
    for lob, kws in V.LOB_KEYWORDS:
        for kw in kws:
            if len(kw) >= V.FUZZY_MIN_KEYWORD:
                k = int((1 - V.FUZZY_THRESHOLD / 100) * 2 * len(kw) + 1e-9)
                cuts = [i * len(kw) // (k + 1) for i in range(k + 2)]
                rows.append(f"({lit(lob)}, {lit(kw)}, {j}, [{', '.join(lit(kw[lo:hi]) for lo, hi in zip(cuts, cuts[1:]))}])")
                j += 1
    return f"""kw(lob, word, j, pieces) AS (VALUES {', '.join(rows)}),
win AS (SELECT DISTINCT word, substr({text}, greatest(p, 1), least(p + len(word) - 1, len({text})) - greatest(p, 1) + 1) AS w, {key} FROM (
  SELECT {key}, {text}, word, unnest(range(2 - len(word), len({text}) + 1)) AS p FROM {source}, kw WHERE len(list_filter(pieces, lambda x: contains({text}, x))) > 0)),
wsc AS (SELECT word, w, 200.0 * {sql_common('word', 'w')} / (len(w) + len(word)) AS score FROM (SELECT DISTINCT word, w FROM win)),
fl AS (SELECT {key}, first(lob ORDER BY score DESC, len(word) DESC, j) AS found FROM win JOIN wsc USING (word, w) JOIN kw USING (word)
  WHERE score >= {V.FUZZY_THRESHOLD} GROUP BY {key})"""


@query("r04_fuzzy_lob", f"WITH {MESSAGES}, {sql_fuzzy_lob('msg', 'conv_id, turn', 'q')} SELECT conv_id, turn, found AS line_of_business FROM msg LEFT JOIN fl USING (conv_id, turn)")
def r04(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", Y.fuzzy_lob(F.col("q")).alias("line_of_business"))


@query("r05_admin_intent", f"WITH {DETECTED} SELECT query_id, is_admin, search_query FROM qd")
def r05(spark, sf):
    return detected(spark, sf).select("query_id", "is_admin", "search_query")


HITS = """hits AS (SELECT qd.query_id, count(v.chunk_id) AS hits FROM qd LEFT JOIN {rows} v
  ON (qd.carrier IS NULL OR qd.carrier = v.carrier) AND (qd.line_of_business IS NULL OR qd.line_of_business = v.line_of_business) GROUP BY 1)"""
VECTORS = "ve AS (SELECT wc.*, embedding FROM wc JOIN embeddings e ON e.vec_id = wc.doc_id AND wc.page_number = 1)"


@query("r06_metadata_filter", f"WITH {CHUNKS}, {DETECTED}, {HITS.format(rows='wc')} SELECT query_id, carrier, line_of_business, nullif(hits, 0) AS hits FROM qd JOIN hits USING (query_id)")
def r06(spark, sf):
    return R.scope_sizes(detected(spark, sf), chunks(spark, sf)).select("query_id", "carrier", "line_of_business", "hits")


# all vectors; every third question names a carrier that no chunk has, so that its filter finds nothing
NOWHERE = "query_id % 3 = 0"
OPEN = f"""qx AS MATERIALIZED (SELECT * EXCLUDE (carrier), carrier || CASE WHEN {NOWHERE} THEN ' elsewhere' ELSE '' END AS carrier FROM qd),
vx AS MATERIALIZED (SELECT chunk_id, carrier || '' AS carrier, line_of_business || '' AS line_of_business FROM ve),
{HITS.format(rows='vx').replace('qd', 'qx')}, qo AS (SELECT * EXCLUDE (carrier, line_of_business, hits), CASE WHEN hits > 0 THEN carrier END AS carrier,
  CASE WHEN hits > 0 THEN line_of_business END AS line_of_business, hits = 0 AS fell_back FROM qx JOIN hits USING (query_id))"""


@query("r07_empty_filter_fallback", f"WITH {CHUNKS}, {DETECTED}, {VECTORS}, {OPEN} SELECT query_id, carrier, line_of_business, fell_back FROM qo")
def r07(spark, sf):
    asked = detected(spark, sf).withColumn("carrier", F.concat("carrier", F.when(F.expr(NOWHERE), F.lit(" elsewhere")).otherwise(F.lit(""))))
    return R.open_empty_scopes(asked, chunks(spark, sf, vectors=True).filter("embedding IS NOT NULL")).select("query_id", "carrier", "line_of_business", "fell_back")


SPARSE = """sr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {s} WHERE score > 0) WHERE rank <= 25)"""


@query("r08_sparse_top", f"WITH {CHUNKS}, {DETECTED}, {SCOPED_SCORES}, {SPARSE.format(s='ssc')} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM sr")
def r08(spark, sf):
    scores = X.scoped_bm25_scores(X.build_index(stored_chunks(spark, sf)), detected(spark, sf))
    return R.sparse_candidates(scores).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


DENSE = f"""dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT qd.query_id, b.chunk_id, round({DOT}, 9) AS score FROM qd JOIN embeddings a ON a.vec_id = qd.query_id JOIN ve b
  ON (qd.carrier IS NULL OR qd.carrier = b.carrier) AND (qd.line_of_business IS NULL OR qd.line_of_business = b.line_of_business))) WHERE rank <= 25)"""
FUSED = f"""{VECTORS}, {DENSE}, {SPARSE.format(s='ssc')},
fu AS (SELECT query_id, chunk_id, max(d) AS dense_rank, max(s) AS sparse_rank, coalesce(1.0 / (60 + max(d)), 0) + coalesce(1.0 / (60 + max(s)), 0) AS rrf FROM (
  SELECT query_id, chunk_id, rank - 1 AS d, NULL AS s FROM dn UNION ALL SELECT query_id, chunk_id, NULL, rank - 1 FROM sr) GROUP BY 1, 2)"""
FO = "ORDER BY rrf DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, chunk_id"
SEARCH = f"{CHUNKS}, {DETECTED}, {SCOPED_SCORES}, {FUSED}"
POOL = f"""pj AS (SELECT fu.*, wc.* EXCLUDE (chunk_id, line_of_business), query, is_admin, is_comparison FROM fu JOIN wc USING (chunk_id) JOIN (SELECT query_id, query, is_admin, is_comparison FROM qd) USING (query_id)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id {FO}) AS fused_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, upper(coalesce(carrier, 'OTHER')) {FO}) AS side_no FROM pj) WHERE NOT is_comparison OR side_no <= 8) WHERE fused_rank <= 15)"""


def fused(spark, sf, c=None):
    c, q = c or stored_chunks(spark, sf, vectors=True), detected(spark, sf, vectors=True)
    return R.fuse(X.nearest(c.filter("embedding IS NOT NULL"), q), R.sparse_candidates(X.scoped_bm25_scores(X.build_index(c), q)))


def pool(spark, sf, c=None):
    c = c or stored_chunks(spark, sf, vectors=True)
    df = R.fetch(c.drop("line_of_business", "embedding"), fused(spark, sf, c), few_questions(spark, sf))
    return R.balanced_pool(df.join(detected(spark, sf).select("query_id", "query", "is_admin", "is_comparison"), "query_id"))


@query("r09_rank_fusion", f"WITH {SEARCH} SELECT query_id, chunk_id, dense_rank, sparse_rank, round(rrf, 8) AS rrf FROM fu")
def r09(spark, sf):
    return fused(spark, sf).withColumn("rrf", F.round("rrf", 8))


@query("r10_top_fused", f"WITH {SEARCH} SELECT query_id, chunk_id, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id {FO}) AS fused_rank FROM fu) WHERE fused_rank <= 15")
def r10(spark, sf):
    return R.top_fused(fused(spark, sf)).select("query_id", "chunk_id", "fused_rank")


@query("r11_balanced_pool", f"WITH {SEARCH}, {POOL} SELECT query_id, chunk_id, carrier, fused_rank FROM pool")
def r11(spark, sf):
    return pool(spark, sf).select("query_id", "chunk_id", "carrier", "fused_rank")


# --- ranking features, over every chunk against one question per chunk -----------------
PAIRS = f"pr AS (SELECT wc.*, query, is_admin FROM wc JOIN qd ON qd.query_id = doc_id % (SELECT count(*) FROM benchmark))"


def pairs(spark, sf):
    # each chunk meets one question: the number of questions is a single value
    n = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("nq"))
    c = chunks(spark, sf).join(F.broadcast(n), how="cross").withColumn("query_id", F.col("doc_id") % F.col("nq"))
    return c.join(detected(spark, sf).select("query_id", "query", "is_admin"), "query_id")


SHARE = lambda c: f"len(list_intersect(list_distinct({TOK('query')}), list_distinct({TOK(c)}))) / greatest(len(list_distinct({TOK('query')})), 1)"
SEMANTIC = f"1.0 / (1.0 + exp(-(6.0 * {SHARE('page_content')} - 3.0)))"
AUTHORITY = "least(document_priority, 100) / 100.0"
HITRX = r"rs\.?|inr|₹|\d+%|\d+\.\d+"
# RE2's \b is by ASCII, so the one word with a boundary is counted apart; the other forms never overlap it
NUMERIC = rf"least((len(regexp_extract_all(lower(page_content), '{HITRX}')) + len(regexp_extract_all(regexp_replace(lower(page_content), '[^\p{{L}}\p{{N}}_]', '  ', 'g'), '(?:^| )table(?: |$)'))) / 8.0, 1.0)"
PROCEDURAL = f"CASE WHEN is_admin AND {sql_any('lower(page_content)', V.PROCEDURAL)} THEN 0.35 ELSE 0.0 END"
PRODUCT = "CASE WHEN " + " OR ".join(f"(contains(lower(query), {lit(p)}) AND contains(translate(lower(filename), '-_', '  '), {lit(p)}))" for p in V.PRODUCT_NAMES) + " THEN 0.40 ELSE 0.0 END"
BLEND = f"(0.65 * {SEMANTIC} + 0.25 * {AUTHORITY} + 0.10 * {NUMERIC}) / 1.0"


def feature(name, column, value, sql):
    @query(name, f"WITH {CHUNKS}, {DETECTED}, {PAIRS} SELECT chunk_id, round({sql}, 6) AS {column} FROM pr")
    def run(spark, sf):
        return pairs(spark, sf).select("chunk_id", F.round(value(), 6).alias(column))


feature("r12_semantic_score", "semantic_score", lambda: R.sigmoid(R.lexical_logit(F.col("query"), F.col("page_content"))), SEMANTIC)
feature("r13_authority", "authority", lambda: R.authority(F.col("document_priority")), AUTHORITY)
feature("r14_numeric_density", "numeric_density", lambda: R.numeric_density(F.col("page_content")), NUMERIC)
feature("r15_weighted_blend", "blended", lambda: R.blend(R.sigmoid(R.lexical_logit(F.col("query"), F.col("page_content"))), R.authority(F.col("document_priority")), R.numeric_density(F.col("page_content"))), BLEND)
feature("r16_procedural_boost", "boost", lambda: R.procedural_boost(F.col("is_admin"), F.concat(F.col("page_content"), F.when(F.col("page_number") == 2, " Claim Form").otherwise(""))),
        PROCEDURAL.replace("lower(page_content)", "lower(concat(page_content, CASE WHEN page_number = 2 THEN ' Claim Form' ELSE '' END))"))
feature("r17_product_boost", "boost", lambda: R.product_boost(F.col("query"), F.col("filename")), PRODUCT)

SCORED = f"{SEARCH}, {POOL}, scd AS (SELECT *, {SEMANTIC} AS semantic_score, {BLEND} + {PROCEDURAL} + {PRODUCT} AS score FROM pool)"
TIERED = f"""{SCORED}, ti AS (SELECT *, CASE WHEN top >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence_tier FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM scd) WHERE top >= 0.7 - 0.2)"""
CHOSEN = f"""{TIERED}, se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, score DESC, fused_rank) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, fused_rank) > 3 AS late FROM ti)) WHERE position <= 5)"""
STITCHED = f"""{CHOSEN}, sx AS (SELECT se.*, CASE WHEN position <= 2 THEN concat_ws(chr(10), right(p.page_content, 400), se.page_content, left(n.page_content, 400)) ELSE se.page_content END AS text
  FROM se LEFT JOIN wc p ON p.chunk_id = se.previous_chunk_id LEFT JOIN wc n ON n.chunk_id = se.next_chunk_id)"""


def tiered(spark, sf, c=None):
    return R.confidence_tier(R.score_candidates(pool(spark, sf, c), CONFIG))


def chosen(spark, sf, c):
    return cut(R.diversify(tiered(spark, sf, c)), "selected")


@query("r18_confidence_tier", f"WITH {TIERED} SELECT query_id, chunk_id, confidence_tier, round(score, 6) AS score FROM ti")
def r18(spark, sf):
    return tiered(spark, sf).select("query_id", "chunk_id", "confidence_tier", F.round("score", 6).alias("score"))


@query("r19_diversity_cap", f"WITH {CHOSEN} SELECT query_id, chunk_id, document_id, position FROM se")
def r19(spark, sf):
    return R.diversify(tiered(spark, sf)).select("query_id", "chunk_id", "document_id", "position")


@query("r20_neighbour_stitching", f"WITH {STITCHED} SELECT query_id, chunk_id, position, text FROM sx")
def r20(spark, sf):
    c = stored_chunks(spark, sf, vectors=True)
    return R.stitch(chosen(spark, sf, c), c, few_questions(spark, sf)).select("query_id", "chunk_id", "position", "text")


SIB = """sib AS (SELECT filename, page_number - 1 AS page_number, arg_max(chunk_id, chunk_index) AS sid, arg_max(page_content, chunk_index) AS stext FROM wc GROUP BY 1, 2),
sw AS (SELECT sx.*, sid, stext FROM sx LEFT JOIN sib USING (filename, page_number))"""
# the budget as a fold over a query's few rows
SIZE = lambda t: f"greatest(length({t}) // 4, 1)"
EMPTY = "{'used': CAST(0 AS BIGINT), 'ids': CAST([] AS VARCHAR[]), 'sibs': CAST([] AS BOOLEAN[]), 'cid': '', 'n': CAST(0 AS BIGINT), 'sid': '', 'sn': CAST(0 AS BIGINT)}"
STEP = """lambda a, x: CASE WHEN list_contains(a.ids, x.cid) OR a.used + x.n > {b} THEN a
  WHEN x.sid IS NOT NULL AND x.sid != x.cid AND NOT list_contains(a.ids, x.sid) AND a.used + x.n + x.sn <= {b}
  THEN {{'used': a.used + x.n + x.sn, 'ids': list_concat(a.ids, [x.cid, x.sid]), 'sibs': list_concat(a.sibs, [FALSE, TRUE]), 'cid': '', 'n': CAST(0 AS BIGINT), 'sid': '', 'sn': CAST(0 AS BIGINT)}}
  ELSE {{'used': a.used + x.n, 'ids': list_append(a.ids, x.cid), 'sibs': list_append(a.sibs, FALSE), 'cid': '', 'n': CAST(0 AS BIGINT), 'sid': '', 'sn': CAST(0 AS BIGINT)}} END"""
CONTEXT = lambda budget: f"""{STITCHED}, {SIB},
fo AS (SELECT query_id, list_reduce(list({{'used': CAST(0 AS BIGINT), 'ids': CAST([] AS VARCHAR[]), 'sibs': CAST([] AS BOOLEAN[]), 'cid': chunk_id, 'n': CAST({SIZE('text')} AS BIGINT),
  'sid': sid, 'sn': CAST({SIZE('stext')} AS BIGINT)}} ORDER BY position), {STEP.format(b=budget)}, {EMPTY}) AS f FROM sw GROUP BY query_id),
ctx AS (SELECT query_id, i AS rank, f.ids[i] AS chunk_id, f.sibs[i] AS is_sibling_expansion FROM fo, unnest(range(1, len(f.ids) + 1)) AS t(i))"""


def context(spark, sf, budget=V.TOKEN_BUDGET):
    c = stored_chunks(spark, sf, vectors=True)
    few = few_questions(spark, sf)
    return R.pack_context(R.with_siblings(R.stitch(chosen(spark, sf, c), c, few), c, few), budget)


@query("r21_token_budget", f"WITH {CONTEXT(700)} SELECT query_id, rank, chunk_id FROM ctx")
def r21(spark, sf):
    return context(spark, sf, 700).select("query_id", "rank", "chunk_id")


@query("r22_sibling_expansion", f"WITH {CONTEXT(3500)} SELECT query_id, rank, chunk_id, is_sibling_expansion FROM ctx")
def r22(spark, sf):
    return context(spark, sf).select("query_id", "rank", "chunk_id", "is_sibling_expansion")


# the result rows: a sibling takes its scores from the chunk that brought it in
RESULT = f"""{CONTEXT(3500)}, rs AS (SELECT ctx.query_id, ctx.rank, ctx.chunk_id, ctx.is_sibling_expansion,
  CASE WHEN ctx.is_sibling_expansion THEN wc.page_content ELSE sx.text END AS text, sx.score, sx.semantic_score, sx.confidence_tier,
  wc.filename, wc.page_number, wc.document_id, wc.carrier, wc.line_of_business, wc.document_type, wc.heading_path FROM ctx JOIN wc ON wc.chunk_id = ctx.chunk_id
  LEFT JOIN ctx o ON o.query_id = ctx.query_id AND o.rank = ctx.rank - 1 JOIN sx ON sx.query_id = ctx.query_id
  AND sx.chunk_id = CASE WHEN ctx.is_sibling_expansion THEN o.chunk_id ELSE ctx.chunk_id END)"""


@query("r23_result_rows", f"WITH {RESULT} SELECT query_id, rank, chunk_id, text, round(score, 6) AS score, round(semantic_score, 6) AS semantic_score, confidence_tier, is_sibling_expansion, filename, page_number FROM rs")
def r23(spark, sf):
    df = R.search(stored_chunks(spark, sf, vectors=True), questions(spark, sf, vectors=True), CONFIG)
    return df.select("query_id", "rank", "chunk_id", "text", F.round("score", 6).alias("score"), F.round("semantic_score", 6).alias("semantic_score"),
                     "confidence_tier", "is_sibling_expansion", "filename", "page_number")


# names that no question has exactly, so that only the fuzzy pass finds carriers
MISSPELT = replace(CONFIG, carriers=tuple((n, a.replace("src", "sorc")) for n, a in CARRIERS), fuzzy=True)
FUZZY_DETECTED = f"""{QUESTIONS}, {sql_fuzzy_carrier('qs', 'query_id', 'query', MISSPELT.carriers)},
qd AS (SELECT query_id, query, false AS is_comparison, found AS carrier, CASE WHEN NOT {ADMIN} THEN {LOB} END AS line_of_business, {ADMIN} AS is_admin,
  CASE WHEN {ADMIN} THEN concat(query, {lit(V.ADMIN_EXPANSION)}) ELSE query END AS search_query FROM qs LEFT JOIN fz USING (query_id))"""


@query("r23_fuzzy_rows", f"WITH {RESULT.replace(DETECTED, FUZZY_DETECTED)} SELECT query_id, rank, chunk_id, text, round(score, 6) AS score, confidence_tier FROM rs")
def r23f(spark, sf):
    df = R.search(stored_chunks(spark, sf, vectors=True), questions(spark, sf, vectors=True), MISSPELT)
    return df.select("query_id", "rank", "chunk_id", "text", F.round("score", 6).alias("score"), "confidence_tier")


@query("r03_fuzzy_scope", f"WITH {FUZZY_DETECTED} SELECT query_id, carrier, line_of_business, is_admin FROM qd")
def r03s(spark, sf):
    return R.detect_scope(questions(spark, sf), MISSPELT).select("query_id", "carrier", "line_of_business", "is_admin")
