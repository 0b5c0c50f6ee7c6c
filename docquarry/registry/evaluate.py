"""Quality of results and answers; weights."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.operators import chunks as K
from docquarry.operators import evaluate as E
from docquarry.operators import index as X
from docquarry.operators import retrieve as R
from docquarry.registry.answers import RESULTS, results
from docquarry.registry.base import CHUNKS, few_questions, lit, query, questions, sql_any, sql_list, stored_chunks, table
from docquarry.registry.chunks import CHUNK_TABLE, ENRICHED, TYPE, built
from docquarry.registry.index import DOT, GLOBAL, TOK
from docquarry.registry.retrieve import PAIRS, SPARSE, VECTORS, detected, pairs
from docquarry.registry.index import DETECTED

ASK_TEXT = "concat(CASE doc_id % 6 WHEN 0 THEN 'SBI cover ' WHEN 1 THEN 'address of ' WHEN 2 THEN 'hdfc click ' ELSE '' END, source)"
WANTED = """CASE doc_id % 5 WHEN 0 THEN 'Part 2' WHEN 1 THEN 'no such heading' WHEN 2 THEN '' WHEN 3 THEN 'Title > Days'
  ELSE concat('Part 1 > ', substr(text, 1, 5)) END"""
ITEM = f"""doc_id AS query_id, {ASK_TEXT} AS query, {WANTED} AS expected_heading,
  substr(text, 1, 5) AS k1, substr(text, 700, 6) AS k2, 'Zzz' AS k3, substr(text, 300, 5) AS ng, doc_id % 4 = 0 AS neg"""
ITEMS = f"it AS (SELECT {ITEM} FROM documents)"


def items(spark, sf):
    df = table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.expr(ASK_TEXT).alias("query"), F.expr(WANTED).alias("expected_heading"),
        F.expr("array(substr(text, 1, 5), substr(text, 700, 6), 'Zzz')").alias("expected_keywords"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN array(substr(text, 300, 5)) ELSE array() END").alias("negative_keywords"))
    return df


HIT = lambda compat: f"""(({'' if compat else "heading_path != '' AND expected_heading != '' AND "}(contains(lower(heading_path), lower(expected_heading)) OR contains(lower(expected_heading), lower(heading_path))))
  OR (CAST(contains(lower(text), lower(k1)) AS INT) + CAST(contains(lower(text), lower(k2)) AS INT) + CAST(contains(lower(text), lower(k3)) AS INT)) / 3.0 >= 0.65)
  AND NOT (neg AND contains(lower(text), lower(ng)))"""
JUDGED = f"{RESULTS}, {ITEMS}, ju AS (SELECT re.*, {HIT(False)} AS hit FROM re JOIN it USING (query_id))"
FIRSTS = f"""{JUDGED}, fh AS (SELECT query_id, r IS NOT NULL AS hit, coalesce(r, -1) AS rank, coalesce(1.0 / r, 0) AS mrr, coalesce(n, 0) AS retrieved_count
  FROM it LEFT JOIN (SELECT query_id, min(rank) FILTER (WHERE hit) AS r, count(*) AS n FROM ju GROUP BY 1) USING (query_id))"""


def judged(spark, sf, compat=False):
    return E.hit_test(results(spark, sf).join(items(spark, sf).drop("query"), "query_id"), compat)


def firsts(spark, sf):
    return E.first_hits(items(spark, sf), judged(spark, sf))


@query("e01_hit_test", f"WITH {JUDGED} SELECT query_id, rank, hit FROM ju")
def e01(spark, sf):
    return judged(spark, sf).select("query_id", "rank", "hit")


@query("e01_hit_test_compat", f"WITH {RESULTS}, {ITEMS} SELECT query_id, rank, {HIT(True)} AS hit FROM re JOIN it USING (query_id)")
def e01c(spark, sf):
    return judged(spark, sf, True).select("query_id", "rank", "hit")


@query("e02_first_hit_rank", f"WITH {FIRSTS} SELECT query_id, hit, rank, round(mrr, 6) AS mrr, retrieved_count FROM fh")
def e02(spark, sf):
    return firsts(spark, sf).withColumn("mrr", F.round("mrr", 6))


@query("e02_retrieval_metrics", f"""WITH {FIRSTS} SELECT count(*) AS total_queries, round(avg(CAST(hit AS DOUBLE)), 4) AS hit_rate, round(avg(CASE WHEN hit AND rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5,
  round(avg(CASE WHEN hit AND rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_10, round(avg(mrr), 4) AS mrr FROM fh""")
def e02m(spark, sf):
    return E.retrieval_metrics(firsts(spark, sf))


@query("e03_query_diversity", f"""WITH {RESULTS}, {ITEMS}, d AS (SELECT query_id, count(DISTINCT filename) / count(*) AS a, count(DISTINCT heading_path) / count(*) AS b,
  count(DISTINCT concat(filename, '#', page_number)) / count(*) AS c FROM re GROUP BY 1)
SELECT query_id, round(coalesce(a, 0), 6) AS document_diversity, round(coalesce(b, 0), 6) AS section_diversity, round(coalesce(c, 0), 6) AS page_diversity FROM it LEFT JOIN d USING (query_id)""")
def e03(spark, sf):
    df = E.diversity(items(spark, sf), results(spark, sf))
    return df.select("query_id", *[F.round(c, 6).alias(c) for c in df.columns if c != "query_id"])


@query("e04_global_unique", f"WITH {RESULTS} SELECT count(DISTINCT concat(filename, '#', page_number)) AS unique_source_pages, count(DISTINCT heading_path) AS unique_headings FROM re")
def e04(spark, sf):
    return E.coverage_totals(results(spark, sf))


DUPES = f"""{RESULTS}, wd AS (SELECT query_id, rank, list_distinct({TOK('text')}) AS w FROM re),
dp AS (SELECT query_id, count(*) AS n FROM wd a JOIN wd b USING (query_id) WHERE a.rank < b.rank AND len(a.w) > 0 AND len(b.w) > 0
  AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.85 GROUP BY 1),
du AS (SELECT query_id, r AS results, coalesce(n, 0) AS duplicate_pairs FROM (SELECT query_id, count(*) AS r FROM re GROUP BY 1) LEFT JOIN dp USING (query_id))"""


@query("e05_jaccard_duplicates", f"WITH {DUPES} SELECT * FROM du")
def e05(spark, sf):
    return E.near_duplicates(results(spark, sf))


@query("e05_duplicate_ratio", f"WITH {DUPES} SELECT sum(duplicate_pairs) AS duplicate_pairs, sum(results) AS results, round(sum(duplicate_pairs) / (sum(results) / 2.0), 4) AS duplicate_ratio FROM du")
def e05r(spark, sf):
    return E.duplicate_ratio(E.near_duplicates(results(spark, sf)))


CLASSES = f"""dw AS (SELECT doc_id, list_sort(list_distinct({TOK("coalesce(text, '')")})) AS w FROM documents),
cl AS (SELECT w, min(doc_id) AS class_id FROM dw GROUP BY w)"""


@query("e05_corpus_duplicate_pairs", f"""WITH {CLASSES}, cw AS (SELECT class_id, len(w) AS n, unnest(w) AS t FROM cl),
sh AS (SELECT a.class_id AS class_a, b.class_id AS class_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM cw a JOIN cw b ON a.t = b.t AND a.class_id < b.class_id
  AND least(a.n, b.n) >= {V.DUPLICATE_JACCARD} * greatest(a.n, b.n) GROUP BY 1, 2)
SELECT class_a, class_b, round(c / (na + nb - c), 6) AS similarity FROM sh WHERE c / (na + nb - c) > {V.DUPLICATE_JACCARD}""")
def e05c(spark, sf):
    _, found = E.corpus_duplicates(table(spark, sf, "documents"), "doc_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query("e05_corpus_duplicate_classes", f"WITH {CLASSES} SELECT doc_id AS id, class_id FROM dw JOIN cl USING (w)")
def e05m(spark, sf):
    return E.corpus_duplicates(table(spark, sf, "documents"), "doc_id")[0]


DOC = "CASE WHEN contains(lower(query), 'sbi') OR contains(lower(query), 'saral') THEN 'sbi' WHEN contains(lower(query), 'hdfc') OR contains(lower(query), 'click') OR contains(lower(query), 'health protector') THEN 'hdfc' ELSE '' END"
CATEGORY = f"""{FIRSTS}, sn AS (SELECT query_id, count(*) AS n, bool_or(contains(lower(filename), {DOC}) OR contains(lower(carrier), {DOC})) AS seen FROM re JOIN it USING (query_id) GROUP BY 1),
fc AS (SELECT query_id, query, CASE WHEN hit THEN 'None (Hit)' WHEN {sql_any('lower(query)', V.BOILERPLATE_TERMS)} OR {sql_any('lower(expected_heading)', V.BOILERPLATE_TERMS)} THEN {lit(V.FAILURES[0])}
  WHEN len(list_filter(string_split(lower(expected_heading), '>'), lambda p: trim(p) IN {sql_list(V.LAYOUT_HEADINGS)})) > 0 THEN {lit(V.FAILURES[1])}
  WHEN n IS NULL THEN {lit(V.FAILURES[2])} WHEN {DOC} != '' AND NOT seen THEN {lit(V.FAILURES[3])} ELSE {lit(V.FAILURES[4])} END AS failure_cluster
  FROM it JOIN (SELECT query_id, hit FROM fh) USING (query_id) LEFT JOIN sn USING (query_id))"""


def categories(spark, sf):
    return E.failure_category(items(spark, sf), firsts(spark, sf), results(spark, sf))


@query("e06_failure_clusters", f"WITH {CATEGORY} SELECT query_id, query, failure_cluster FROM fc")
def e06(spark, sf):
    return categories(spark, sf)


@query("e06_failure_counts", f"WITH {CATEGORY} SELECT failure_cluster, count(*) AS queries FROM fc GROUP BY 1")
def e06c(spark, sf):
    return categories(spark, sf).groupBy("failure_cluster").agg(F.count(F.lit(1)).alias("queries"))


# --- answers ---------------------------------------------------------------------
ANSWER = "concat('Rs. 1,500 of the ICU cover, SBI page ', doc_id % 4 + 1, ' and for 30 days PAGE', doc_id % 3 + 1, '. Hospital Cash policy 12% ', text, ' page 2')"
ANSWERS = f"aw AS (SELECT {ITEM}, {ANSWER} AS answer FROM documents)"


def answers(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.expr(ANSWER).alias("answer"))
    return a.join(items(spark, sf), "query_id")


KEYSCORE = f"""ks AS (SELECT query_id, m / greatest(w, 1) AS p, m / 3.0 AS r FROM (SELECT query_id, CAST(contains(lower(answer), lower(k1)) AS INT) + CAST(contains(lower(answer), lower(k2)) AS INT)
  + CAST(contains(lower(answer), lower(k3)) AS INT) AS m, len({TOK('answer')}) AS w FROM aw))"""


@query("e07_keyword_scores", f"""WITH {ANSWERS}, {KEYSCORE} SELECT query_id, round(p, 6) AS keyword_precision, round(r, 6) AS keyword_recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS keyword_f1 FROM ks""")
def e07(spark, sf):
    df = E.keyword_scores(answers(spark, sf))
    return df.select("query_id", *[F.round(c, 6).alias(c) for c in ("keyword_precision", "keyword_recall", "keyword_f1")])


# RE2 knows ASCII word boundaries only: other letters become underscores, which are word characters too
PLAIN = r"regexp_replace(answer, '[^\x00-\x7F]', '_', 'g')"
FOUND = ", ".join(f"regexp_extract_all({PLAIN}, {lit(p)}, 0{', ' + lit('i') if i else ''})" for p, i in V.ENTITY_PATTERNS)
ENTITIES = f"""en AS (SELECT query_id, list_distinct(list_filter(list_transform(flatten([{FOUND}, list_filter(regexp_extract_all({PLAIN}, {lit(V.CAPITALISED)}), lambda w: lower(w) NOT IN {sql_list(V.CAPITALISED_STOP)})]),
  lambda e: trim(e, concat(' ', chr(10)))), lambda e: e != '')) AS ents FROM aw)"""


@query("e08_entities", f"WITH {ANSWERS}, {ENTITIES} SELECT query_id, len(ents) AS entities, array_to_string(list_sort(ents), '|') AS names FROM en")
def e08(spark, sf):
    e = E.entities(F.col("answer"))
    df = answers(spark, sf).select("query_id", F.array_sort(e).alias("e"))
    return df.select("query_id", F.size("e").alias("entities"), F.array_join("e", "|").alias("names"))


GROUNDED = f"""{ENTITIES}, cx AS (SELECT query_id, lower(string_agg(text, ' ' ORDER BY rank)) AS ctx FROM re GROUP BY 1),
gr AS (SELECT query_id, len(ents) AS entities, CASE WHEN len(ents) = 0 THEN 1.0 ELSE len(list_filter(ents, lambda e: contains(coalesce(ctx, ''), lower(e)))) / len(ents) END AS g FROM en LEFT JOIN cx USING (query_id))"""


def grounded(spark, sf):
    from docquarry.operators.answers import in_order
    ctx = results(spark, sf).groupBy("query_id").agg(in_order(F.col("text"), F.col("rank"), " ").alias("context_text"))
    return E.groundedness(answers(spark, sf).join(ctx, "query_id", "left").fillna("", ["context_text"]))


@query("e09_groundedness", f"WITH {RESULTS}, {ANSWERS}, {GROUNDED} SELECT query_id, entities, round(g, 6) AS groundedness, round(1.0 - g, 6) AS hallucination_rate FROM gr")
def e09(spark, sf):
    return grounded(spark, sf).select("query_id", "entities", F.round("groundedness", 6).alias("groundedness"), F.round("hallucination_rate", 6).alias("hallucination_rate"))


CITED = rf"""ci0 AS (SELECT query_id, answer, string_split_regex(lower({PLAIN}), '\bpage\s*\d+\b') AS b, regexp_extract_all(lower({PLAIN}), '\bpage\s*\d+\b') AS m,
  regexp_extract_all({PLAIN}, '\bpage\s*(\d+)\b', 1, 'i') AS p FROM aw),
ci AS (SELECT query_id, i - 1 AS citation_no, CAST(p[i] AS INT) AS page, CASE WHEN contains(back, 'sbi') THEN 'sbi' WHEN contains(back, 'hdfc') THEN 'hdfc' ELSE 'unknown' END AS doc_type FROM (
  SELECT *, right(concat(array_to_string(list_transform(range(1, i), lambda j: concat(b[j], m[j])), ''), b[i]), 100) AS back FROM ci0, unnest(range(1, len(p) + 1)) AS t(i)))"""


@query("e10_citations", f"WITH {ANSWERS}, {CITED} SELECT * FROM ci")
def e10(spark, sf):
    return E.citations(answers(spark, sf))


CORRECT = f"""{CITED}, ok AS (SELECT ci.query_id, citation_no, coalesce(bool_or(re.query_id IS NOT NULL AND (doc_type = 'unknown' OR contains(lower(filename), doc_type) OR contains(lower(carrier), doc_type))), FALSE) AS ok
  FROM ci LEFT JOIN re ON re.query_id = ci.query_id AND re.page_number = ci.page GROUP BY 1, 2),
cc AS (SELECT query_id, coalesce(n, 0) AS citations_found, coalesce(c, 1.0) AS citation_correctness FROM aw LEFT JOIN (SELECT query_id, count(*) AS n, avg(CAST(ok AS DOUBLE)) AS c FROM ok GROUP BY 1) USING (query_id))"""


@query("e10_citation_correctness", f"WITH {RESULTS}, {ANSWERS}, {CORRECT} SELECT query_id, citations_found, round(citation_correctness, 6) AS citation_correctness FROM cc")
def e10c(spark, sf):
    return E.citation_correctness(answers(spark, sf), results(spark, sf)).withColumn("citation_correctness", F.round("citation_correctness", 6))


@query("e11_metric_averages", f"""WITH {RESULTS}, {ANSWERS}, {KEYSCORE}, {GROUNDED} SELECT count(*) AS queries, round(avg(r), 6) AS avg_keyword_recall, round(avg(g), 6) AS avg_groundedness,
  round(avg(query_id * 0.5), 6) AS avg_latency_ms FROM ks JOIN gr USING (query_id)""")
def e11(spark, sf):
    df = E.keyword_scores(grounded(spark, sf)).withColumn("latency_ms", F.col("query_id") * 0.5)
    return E.metric_averages(df, ["keyword_recall", "groundedness", "latency_ms"])


# --- evaluation set ------------------------------------------------------------------
LAST = "coalesce(list_filter(list_transform(string_split(heading_path, '>'), lambda p: trim(p)), lambda p: p != '')[-1], 'the policy')"
ASK = lambda k: "concat(" + lit(V.EVAL_TEMPLATES[k].split("{}")[0]) + ", h, " + lit(V.EVAL_TEMPLATES[k].split("{}")[1]) + ")"
ASKED = "CASE " + " ".join(f"WHEN semantic_type = '{k}' THEN {ASK(k)}" for k in ("exclusion", "benefit", "coverage", "waiting_period", "eligibility", "claim_process")) + \
    f" WHEN contains(path, 'definition') THEN {ASK('definition')} ELSE {ASK('other')} END"
PTEXT = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
KEYS = rf"""list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(h, '[\p{{L}}\p{{N}}_]{{4,}}'), lambda w: lower(w)), lambda w: w NOT IN {sql_list(V.HEADING_STOP)}),
  regexp_extract_all({PTEXT}, {lit(V.EVAL_NUMBER)}), list_transform(regexp_extract_all({PTEXT}, {lit(V.EVAL_DURATION)}, 0, 'i'), lambda w: lower(w)),
  list_transform(regexp_extract_all({PTEXT}, {lit(V.EVAL_MONEY)}, 0, 'i'), lambda w: lower(w)))))"""


@query("e12_evaluation_set", f"""WITH {CHUNK_TABLE}, {ENRICHED}, cl AS (SELECT *, {KEYS} AS keys FROM (SELECT *, {TYPE} AS semantic_type, {LAST} AS h FROM en
  WHERE length(text) >= 60 AND NOT {sql_any('path', V.EVAL_BOILERPLATE)} AND NOT {sql_any('low', V.EVAL_TEXT_BOILERPLATE)})),
al AS (SELECT {ASKED} AS query, 0 AS phase, chunk_index, heading_path, keys FROM cl WHERE len(keys) > 0 UNION ALL SELECT {ASK('relaxed')}, 1, chunk_index, heading_path, keys FROM cl)
SELECT query, phase, chunk_index, heading_path AS expected_heading, array_to_string(keys, '|') AS expected_keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY chunk_index) AS rn FROM al) WHERE rn = 1 ORDER BY phase, chunk_index LIMIT 100""")
def e12(spark, sf):
    linked = built(spark, sf, "document_id", "relative_path", "local_index", "text", "heading_path", "semantic_type")
    c = K.index_chunks(linked, stored=True).select("chunk_index", "text", "heading_path", "semantic_type")
    return E.evaluation_set(c).withColumn("expected_keywords", F.array_join("expected_keywords", "|"))


# --- features and weights --------------------------------------------------------------
STOP = "[" + ", ".join(lit(w) for w in V.RANK_STOP) + "]"
ASKEDW = rf"list_filter(list_distinct({TOK('regexp_replace(lower(query), ' + lit('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's]') + ', ' + lit('') + ', ' + lit('g') + ')')}), lambda w: NOT list_contains({STOP}, w))"
EXPANSIONS = {"claim": ("reimbursement", "form"), "the": ("and",)}
MORE = "list_distinct(list_concat(q, CASE WHEN list_contains(q, 'claim') THEN ['reimbursement', 'form'] ELSE [] END, CASE WHEN list_contains(q, 'the') THEN ['and'] ELSE [] END))"
NOISE = " + ".join(f"CAST(contains(plain, {lit(t)}) AS INT) + 2 * CAST(contains(lower(heading_path), {lit(t)}) AS INT)" for t in V.RANK_BOILERPLATE)
FEATURES = lambda src: rf"""f0 AS (SELECT *, {ASKEDW} AS q, lower(trim(page_content)) AS c, {TOK('page_content')} AS tk, list_filter(list_distinct({TOK('page_content')}), lambda w: NOT list_contains({STOP}, w)) AS dk,
  regexp_replace(lower(page_content), '[_-]+', ' ', 'g') AS plain, lower(concat_ws(' ', heading_path, '', heading_path, carrier, filename)) AS meta FROM {src}),
f1 AS (SELECT *, {MORE} AS more, {NOISE} AS noise FROM f0),
ft AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: contains(meta, w))) / len(q) ELSE 0 END AS meta_score,
  0.2 * (5 / 6.0) + 0.2 * (0.5 * CASE WHEN regexp_matches(heading_path, '[0-9]') THEN 1.0 ELSE 0.0 END + 0.5 * least(len(string_split(lower(heading_path), '/')) / 5.0, 1.0))
    + 0.3 * CASE WHEN len(tk) > 0 THEN len(dk) / len(tk) ELSE 0 END + 0.3 * 0.8 AS specificity,
  CASE WHEN len(more) > 0 THEN len(list_filter(more, lambda w: contains(c, w))) / len(more) ELSE 0 END AS coverage, 1.0 AS boost,
  (1.0 - least(noise / 4.0, 1.0)) * document_priority / 100.0 * CASE WHEN policy IS NULL THEN 1.0 WHEN lower(policy) = lower(carrier) THEN 2.0
    WHEN contains(lower(query), 'src5') AND lower(carrier) != 'src5' THEN 0.1 ELSE 1.0 END AS penalty FROM f1)"""


def features(df):
    wide = df.withColumns({"section_title": F.col("heading_path"), "clause_type": F.lit(""), "product_name": F.col("filename"), "section_id": F.lit(""),
                           "heading_confidence": F.lit(None).cast("double"), "semantic_type": F.lit("general"), "intent": F.lit("coverage")})
    return E.rerank_features(wide, EXPANSIONS, ("src5",))


@query("e13_rerank_features", f"""WITH {CHUNKS}, {DETECTED}, {PAIRS}, px AS (SELECT pr.*, qd.carrier AS policy FROM pr JOIN qd ON qd.query = pr.query), {FEATURES('px')}
SELECT chunk_id, round(meta_score, 6) AS meta_score, round(specificity, 6) AS specificity, round(coverage, 6) AS coverage, boost, round(penalty, 6) AS penalty FROM ft""")
def e13(spark, sf):
    policy = detected(spark, sf).select("query_id", F.col("carrier").alias("policy"))
    df = features(pairs(spark, sf).join(policy, "query_id"))
    return df.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("meta_score", "specificity", "coverage")], "boost", F.round("penalty", 6).alias("penalty"))


SUBS = f"""{CHUNKS}, {DETECTED}, {GLOBAL}, {VECTORS}, {SPARSE.format(s='sc')},
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT qs.query_id, b.chunk_id, round({DOT}, 9) AS score FROM qs JOIN embeddings a ON a.vec_id = qs.query_id, ve b)) WHERE rank <= 25),
sl AS (SELECT query_id, 0 AS sub_no, chunk_id, rank FROM sr UNION ALL SELECT query_id, 1, chunk_id, rank FROM dn),
sf AS (SELECT sl.query_id, sl.chunk_id, sum(CASE WHEN sub_no = 0 THEN 1.0 ELSE 0.5 END / (60 + rank - 1) * CASE WHEN qd.carrier = wc.carrier THEN 2.0 ELSE 1.0 END) AS rrf
  FROM sl JOIN wc USING (chunk_id) JOIN qd USING (query_id) GROUP BY 1, 2)"""


def subquery_fusion(spark, sf, c=None):
    c, q = c or stored_chunks(spark, sf, vectors=True), questions(spark, sf, vectors=True)
    words = R.sparse_candidates(X.bm25_scores(c.drop("embedding"), q, query_text="query")).withColumn("sub_no", F.lit(0))
    near = X.nearest(c.filter("embedding IS NOT NULL").drop("carrier", "line_of_business"), q).withColumn("sub_no", F.lit(1))
    lists = words.select("query_id", "sub_no", "chunk_id", "rank").unionByName(near.select("query_id", "sub_no", "chunk_id", "rank"))
    of = detected(spark, sf).select("query_id", F.col("carrier").alias("policy"))
    routed = R.fetch(c.select("chunk_id", "carrier"), lists, few_questions(spark, sf)).join(of, "query_id").withColumn(
        "routed", F.coalesce(F.col("policy") == F.col("carrier"), F.lit(False)))
    return E.fuse_subqueries(routed)


@query("e14_subquery_fusion", f"WITH {SUBS} SELECT query_id, chunk_id, round(rrf, 8) AS rrf FROM sf")
def e14(spark, sf):
    return subquery_fusion(spark, sf).withColumn("rrf", F.round("rrf", 8))


# relevance: the chunk shares at least half of the question's words
RELEVANT = f"len(list_intersect(list_distinct({TOK('query')}), list_distinct({TOK('page_content')}))) * 2 >= len(list_distinct({TOK('query')}))"
GRID = f"""{SUBS}, px AS (SELECT sf.query_id, sf.rrf, wc.*, qd.query, qd.carrier AS policy FROM sf JOIN wc USING (chunk_id) JOIN qd USING (query_id)), {FEATURES('px')},
fx AS (SELECT query_id, rrf, meta_score, specificity, coverage, boost * penalty AS factor, {RELEVANT} AS hit, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS position FROM ft),
gd AS (SELECT a.i AS a, b.i AS b, c.i AS c, 20 - a.i - b.i - c.i AS d FROM range(21) a(i), range(21) b(i), range(21) c(i) WHERE a.i + b.i + c.i <= 20),
rk AS (SELECT a, b, c, d, query_id, hit, row_number() OVER (PARTITION BY a, b, c, query_id ORDER BY round((rrf * a * 0.05 + meta_score * b * 0.05 + specificity * c * 0.05 + coverage * d * 0.05) * factor, 9) DESC, position) AS rank FROM fx, gd),
gs AS (SELECT a * 0.05 AS w1, b * 0.05 AS w2, c * 0.05 AS w3, d * 0.05 AS w4, round(sum(rr) / (SELECT count(*) FROM benchmark), 6) AS mrr FROM (
  SELECT a, b, c, d, query_id, coalesce(1.0 / min(rank) FILTER (WHERE hit AND rank <= 6), 0) AS rr FROM rk GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)"""


def candidate_features(spark, sf):
    q = detected(spark, sf).select("query_id", "query", F.col("carrier").alias("policy"))
    c = stored_chunks(spark, sf, vectors=True)
    df = R.fetch(c.drop("embedding"), subquery_fusion(spark, sf, c), few_questions(spark, sf)).join(q, "query_id")
    ask = F.array_distinct(X.tokens(F.col("query")))
    both = F.size(F.array_intersect(ask, X.tokens(F.col("page_content"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")
    return features(df).withColumn("hit", both * 2 >= F.size(ask)).withColumn("position", F.row_number().over(order))


@query("e15_weight_grid", f"WITH {GRID} SELECT round(w1, 2) AS w1, round(w2, 2) AS w2, round(w3, 2) AS w3, round(w4, 2) AS w4, mrr FROM gs")
def e15(spark, sf):
    return E.grid_search(candidate_features(spark, sf), questions(spark, sf))


@query("e15_best_weights", f"WITH {GRID} SELECT round(w1, 2) AS w1, round(w2, 2) AS w2, round(w3, 2) AS w3, round(w4, 2) AS w4, mrr FROM gs ORDER BY mrr DESC, 1, 2, 3, 4 LIMIT 1")
def e15b(spark, sf):
    return E.best_weights(E.grid_search(candidate_features(spark, sf), questions(spark, sf)))


# every eighth question has no answer; an answer that was not generated lowers the tier
REPLIED = ("doc_id AS query_id", "doc_id * 0.25 AS latency_ms", "doc_id % 3 = 0 AS generation_degraded",
           "concat('Page ', doc_id, ': ', source) AS answer", "CASE WHEN doc_id % 3 = 0 THEN 'LOW' END AS confidence_tier")


@query("e16_query_report", f"""WITH {RESULTS}, rp AS (SELECT {', '.join(REPLIED)} FROM documents WHERE doc_id % 8 != 0)
SELECT doc_id AS query_id, source AS query, coalesce(n, 0) AS retrieved_chunks_count, coalesce(rp.confidence_tier, t, 'LOW') AS confidence_tier, coalesce(c, '') AS citations,
  latency_ms, generation_degraded, answer FROM documents LEFT JOIN rp ON rp.query_id = doc_id LEFT JOIN (
  SELECT query_id, count(*) AS n, arg_min(confidence_tier, rank) AS t, string_agg(concat(filename, ':', page_number), ',' ORDER BY rank) AS c FROM re GROUP BY 1) AS cn ON cn.query_id = doc_id""")
def e16(spark, sf):
    docs = table(spark, sf, "documents")
    replied = docs.filter("doc_id % 8 != 0").selectExpr(*REPLIED)
    df = E.query_report(docs.select(F.col("doc_id").alias("query_id"), F.col("source").alias("query")), results(spark, sf), replied)
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c.filename, F.lit(":"), c.page_number)), ",")
    return df.withColumn("citations", F.coalesce(cited, F.lit("")))


@query("e17_failure_report", f"""WITH {CATEGORY} SELECT query_id, failure_cluster, chunk_id, new_rank AS rank, round(score, 6) AS final_score FROM (
  SELECT re.*, failure_cluster, row_number() OVER (PARTITION BY re.query_id ORDER BY score DESC, chunk_id) AS new_rank FROM re JOIN fc USING (query_id) WHERE failure_cluster != 'None (Hit)') WHERE new_rank <= 10""")
def e17(spark, sf):
    df = E.failure_report(firsts(spark, sf), categories(spark, sf), results(spark, sf).drop("rank").withColumnRenamed("score", "final_score"))
    return df.select("query_id", "failure_cluster", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"))
