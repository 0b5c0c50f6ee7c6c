"""Quality of search results and answers, and tuning of the ranking weights."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.joins import guarded_join, keep_first
from docquarry.functions.text import contains_any, let, rx, strip, tokens
from docquarry.operators.index import top_k
from docquarry.session import cut, discard, release

SHARE, SHARES = 2_000_000, 8  # words, at least, of the texts whose words are put in order at once; shares at most
MAX_DF, DF_SHIFT = (1 << 22) - 1, 40  # bits of the number of classes, and of the hash, in the place of a word

def _count(words: Column, text: Column) -> Column:
    """How many of the words occur in the (lower-case) text."""
    return let(text, lambda t: F.size(F.filter(words, lambda w: t.contains(F.lower(w)))))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# --- search results -----------------------------------------------------------------
def hit_test(judged: DataFrame, compat: bool = False) -> DataFrame:
    """Adds ``hit``. ``judged``: text, heading_path, expected_heading,
    expected_keywords, negative_keywords. A blank heading matches any other
    only with ``compat``."""
    text, have = F.lower("text"), F.lower(F.coalesce("heading_path", F.lit("")))
    want = F.lower(F.coalesce("expected_heading", F.lit("")))
    heading = have.contains(want) | want.contains(have)
    if not compat:
        heading = heading & (have != "") & (want != "")
    share = _ratio(_count(F.col("expected_keywords"), text), F.size("expected_keywords"))
    negative = _count(F.coalesce("negative_keywords", F.array().cast("array<string>")), text) > 0
    return judged.withColumn("hit", (heading | (share >= V.KEYWORD_HIT)) & ~negative)


def first_hits(items: DataFrame, judged: DataFrame) -> DataFrame:
    """Rank of the first hit per query; -1 and 0 for a miss."""
    ranks = judged.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("_r"), F.count(F.lit(1)).alias("retrieved_count"))
    return items.select("query_id").join(ranks, "query_id", "left").select(
        "query_id", F.col("_r").isNotNull().alias("hit"), F.coalesce("_r", F.lit(-1)).alias("rank"),
        F.coalesce(1.0 / F.col("_r"), F.lit(0.0)).alias("mrr"), F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"))


def retrieval_metrics(firsts: DataFrame) -> DataFrame:
    within = lambda k: F.round(F.avg(F.when(F.col("hit") & (F.col("rank") <= k), 1.0).otherwise(0.0)), 4)
    return firsts.agg(
        F.count(F.lit(1)).alias("total_queries"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"),
        within(5).alias("recall_at_5"), within(10).alias("recall_at_10"), F.round(F.avg("mrr"), 4).alias("mrr"))


def diversity(items: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct documents, headings and pages over results, per query. Counted
    by the partial-aggregated distinct sets of a query's few results."""
    n = F.count(F.lit(1))
    share = lambda *c: (F.size(F.collect_set(F.struct(*[F.coalesce(F.col(x).cast("string"), F.lit("unknown")) for x in c]))) / n)
    per = results.groupBy("query_id").agg(
        share("filename").alias("document_diversity"), share("heading_path").alias("section_diversity"),
        share("filename", "page_number").alias("page_diversity"))
    return items.select("query_id").join(per, "query_id", "left").fillna(0.0)


def coverage_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_distinct(F.struct("filename", "page_number")).alias("unique_source_pages"),
        F.count_distinct("heading_path").alias("unique_headings"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _first_words(above: float) -> Column:
    """Of ``n`` words, as many as may be missing in a set that is like enough, and one more."""
    return F.col("n") - F.ceil(F.col("n") * above).cast("int") + 1


def _meeting(sets: DataFrame, within: list[str], key: str, above: float) -> DataFrame:
    """Pairs (within, key_a, key_b), key_a < key_b, of ``sets`` (within, key, w, n) that share one of the first
    words of both and whose sizes are near enough. Words travel one by one; the sets do not. ``w`` may hold
    the first words only."""
    heads = sets.filter("n > 0").select(*within, key, "n", F.posexplode(F.slice("w", F.lit(1), _first_words(above))).alias("i", "t"))
    side = lambda s: heads.select(*within, "t", F.col(key).alias(f"{key}_{s}"), F.col("n").alias(f"n_{s}"), F.col("i").alias(f"i_{s}"))
    near = (F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.least("n_a", "n_b") >= above * F.greatest("n_a", "n_b"))
    # at the first word that both have, what follows in either must be enough
    enough = (1 + above) * F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= above * (F.col("n_a") + F.col("n_b")) - 1e-6
    return side("a").join(side("b"), [*within, "t"]).filter(near & enough).select(*within, f"{key}_a", f"{key}_b").distinct()


def corpus_duplicates(texts: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                      above: float = V.DUPLICATE_JACCARD) -> tuple[DataFrame, DataFrame]:
    """Texts of a whole corpus with nearly the same words: (id, class_id) of every row, and pairs
    (class_a, class_b, similarity), class_a < class_b, of classes whose Jaccard is above the threshold.

    Rows of the same set of words are one class, named by its smallest id, however many they are. Words are ordered
    by the number of classes that have them, then by their hash, in one number; so texts meet by the words that the fewest
    have, and the words that only one has come first and meet none. The words of a share of the classes are put in order
    at a time, and what that has shuffled is released. Null and empty texts have no words: one class
    without pairs. Null ids name no class but one that has no other; other columns are not read."""
    bare = texts.select(texts[id_col].alias("id"), F.array_sort(F.array_distinct(tokens(texts[text_col]))).alias("w"))
    named = bare.withColumn("key", F.unhex(F.md5(F.array_join("w", " ").cast("binary"))))
    classes = cut(named.groupBy("key").agg(F.min("id").alias("class_id"), F.min("w").alias("w")), "word_sets")
    member = guarded_join(named.select("id", "key"), classes.select("key", "class_id"), ["key"], spread=F.col("id")).select("id", "class_id")
    release(texts)
    h = F.xxhash64("t").alias("h")
    counts = classes.select(F.explode("w").alias("t")).groupBy(h).agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    counts = cut(counts, "word_counts")
    release(texts)
    # equal places are another chance to meet, never one less
    place = F.shiftleft(F.least(F.coalesce("df", F.lit(1).cast("long")), F.lit(MAX_DF)), DF_SHIFT).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << DF_SHIFT) - 1)))
    size = classes.agg(F.sum(F.size("w"))).first()[0] or 0
    shares = max(1, min(SHARES, -(-size // SHARE)))
    heads = []
    for i in range(shares):
        mine = classes.filter(F.pmod(F.xxhash64("key"), F.lit(shares)) == i)
        # a class has a word once, so the most frequent word has no more rows than there are classes
        placed = mine.select("key", "class_id", F.explode("w").alias("t")).select("key", "class_id", h).join(counts, "h", "left")
        sets = placed.groupBy("key", "class_id").agg(F.array_sort(F.collect_list(place)).alias("w"), F.count(F.lit(1)).cast("int").alias("n"))
        heads.append(cut(sets.select("class_id", "n", F.slice("w", F.lit(1), _first_words(above)).alias("w")), "word_heads"))
        release(texts)
    met = cut(_meeting(reduce(DataFrame.unionByName, heads), [], "class_id", above), "word_pairs")
    discard(counts)
    release(texts)
    # only the words of classes that met are shuffled once more with their pairs
    ids = met.select(F.explode(F.array("class_id_a", "class_id_b")).alias("class_id")).distinct()
    sets = cut(classes.select("class_id", "w").join(ids, "class_id", "left_semi"), "word_sets")
    release(texts)
    side = lambda s: sets.select(F.col("class_id").alias(f"class_id_{s}"), F.col("w").alias(f"w_{s}"))
    both = met.join(side("a"), "class_id_a").join(side("b"), "class_id_b").withColumn("similarity", jaccard(F.col("w_a"), F.col("w_b")))
    pairs = both.filter(F.col("similarity") > above)
    return member, pairs.select(F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"), "similarity")


def near_duplicates(results: DataFrame, above: float = V.DUPLICATE_JACCARD) -> DataFrame:
    """Number of pairs of a query's results with nearly the same words.

    Words are ordered by their hash. Sets whose Jaccard is above the threshold
    share one of the first words of both, as many as may be missing and one more,
    so results meet by query and such a word, not each with each; sizes too far
    apart are left out before the sets are compared. ``rank`` is unique within
    a query; any number of results may belong to one."""
    words = F.array_sort(F.transform(F.array_distinct(tokens(F.col("text"))), lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t"))))
    sets = results.select("query_id", "rank", F.transform(words, lambda x: x.t).alias("w")).withColumn("n", F.size("w"))
    met = _meeting(sets, ["query_id"], "rank", above)
    side = lambda s: sets.select("query_id", F.col("rank").alias(f"rank_{s}"), F.col("w").alias(f"w_{s}"))
    alike = met.join(side("a"), ["query_id", "rank_a"]).join(side("b"), ["query_id", "rank_b"]).filter(jaccard(F.col("w_a"), F.col("w_b")) > above)
    pairs = alike.groupBy("query_id").agg(F.count(F.lit(1)).alias("_pairs"))
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    return counts.join(pairs, "query_id", "left").select("query_id", "results", F.coalesce("_pairs", F.lit(0)).cast("int").alias("duplicate_pairs"))


def duplicate_ratio(pairs: DataFrame) -> DataFrame:
    total = F.sum("results")
    return pairs.agg(F.sum("duplicate_pairs").alias("duplicate_pairs"), total.alias("results"),
                     F.round(F.when(total > 1, F.sum("duplicate_pairs") / (total / 2.0)).otherwise(0.0), 4).alias("duplicate_ratio"))


def failure_category(items: DataFrame, firsts: DataFrame, results: DataFrame, expected=V.EXPECTED_DOCUMENT) -> DataFrame:
    """Why a query missed, by the first rule that applies."""
    boilerplate, layout, empty, wrong, ranking, none = V.FAILURES
    q, heading = F.lower("query"), F.lower(F.coalesce("expected_heading", F.lit("")))
    parts = F.filter(F.transform(F.split(heading, ">"), strip), lambda p: p != "")
    doc = reduce(lambda c, r: c.when(contains_any(q, r[1]), r[0]), expected[1:],
                 F.when(contains_any(q, expected[0][1]), expected[0][0])).otherwise("")
    asked = items.select("query_id", "query", "expected_heading", doc.alias("_doc"))
    found = results.join(asked.select("query_id", "_doc"), "query_id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.lower(F.coalesce("filename", F.lit(""))).contains(F.lower("_doc"))
              | F.lower(F.coalesce("carrier", F.lit(""))).contains(F.lower("_doc"))).alias("_seen"))
    category = (
        F.when(F.col("hit"), none)
        .when(contains_any(q, V.BOILERPLATE_TERMS) | contains_any(heading, V.BOILERPLATE_TERMS), boilerplate)
        .when(F.exists(parts, lambda p: p.isin(*V.LAYOUT_HEADINGS)), layout)
        .when(F.col("_n").isNull(), empty).when((F.col("_doc") != "") & ~F.col("_seen"), wrong).otherwise(ranking))
    return asked.join(firsts.select("query_id", "hit"), "query_id").join(found, "query_id", "left").select(
        "query_id", "query", category.alias("failure_cluster"))


# --- answers ------------------------------------------------------------------------
def keyword_scores(answers: DataFrame) -> DataFrame:
    """Keyword precision, recall and F1 of an answer against expected keywords."""
    hits = _count(F.col("expected_keywords"), F.lower("answer"))
    df = answers.withColumns({
        "keyword_precision": _ratio(hits, F.size(tokens(F.col("answer")))),
        "keyword_recall": _ratio(hits, F.size("expected_keywords"))})
    p, r = F.col("keyword_precision"), F.col("keyword_recall")
    return df.withColumn("keyword_f1", _ratio(2 * p * r, p + r))


def entities(text: Column) -> Column:
    """Numbers, money, durations, abbreviations, names and key noun phrases."""
    found = [F.regexp_extract_all(text, F.lit(rx(p, ignore)), F.lit(0)) for p, ignore in V.ENTITY_PATTERNS]
    names = F.filter(F.regexp_extract_all(text, F.lit(rx(V.CAPITALISED)), F.lit(0)), lambda w: ~F.lower(w).isin(*V.CAPITALISED_STOP))
    return F.array_distinct(F.filter(F.transform(F.concat(*found, names), strip), lambda e: e != ""))


def groundedness(answers: DataFrame) -> DataFrame:
    """Share of an answer's entities that its context contains."""
    df = answers.withColumn("_e", entities(F.col("answer")))
    n = F.size("_e")
    share = F.when(n == 0, 1.0).otherwise(_count(F.col("_e"), F.lower("context_text")) / n)
    return df.withColumn("entities", n).withColumn("groundedness", share).withColumn(
        "hallucination_rate", 1.0 - F.col("groundedness")).drop("_e")


def citations(answers: DataFrame, carriers=V.CARRIER_ALIASES) -> DataFrame:
    """Cited pages with the carrier named in the 100 characters before. Where a
    citation starts follows from the texts between citations."""
    pattern = rx(V.CITATION, True)
    text = F.col("answer")
    df = answers.withColumns({
        "_cited": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        "_pages": F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        "_between": F.split(text, pattern)})
    length = lambda arr, n: F.aggregate(F.slice(arr, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    start = length(F.col("_between"), F.col("_i") + 1) + length(F.col("_cited"), F.col("_i"))
    back = F.least(start, F.lit(V.CITATION_LOOKBACK))
    before = F.lower(F.substr(text, start - back + 1, back))
    named = reduce(lambda c, r: c.when(before.contains(r[1]), r[1]), carriers[1:],
                   F.when(before.contains(carriers[0][1]), carriers[0][1])).otherwise("unknown")
    return df.select("*", F.posexplode("_pages").alias("_i", "_p")).select(
        "query_id", F.col("_i").alias("citation_no"), F.col("_p").cast("int").alias("page"), named.alias("doc_type"))


def citation_correctness(answers: DataFrame, results: DataFrame, carriers=V.CARRIER_ALIASES) -> DataFrame:
    """Share of citations that name a retrieved page (of the right carrier)."""
    cited = citations(answers, carriers)
    src = results.select("query_id", F.col("page_number").alias("page"), F.lower(F.coalesce("filename", F.lit(""))).alias("_f"),
                         F.lower(F.coalesce("carrier", F.lit(""))).alias("_c"))
    doc = F.col("doc_type")
    ok = F.col("_f").isNotNull() & ((doc == "unknown") | F.col("_f").contains(doc) | F.col("_c").contains(doc))
    each = cited.join(src, ["query_id", "page"], "left").groupBy("query_id", "citation_no").agg(
        F.coalesce(F.max(ok), F.lit(False)).alias("_ok"))
    per = each.groupBy("query_id").agg(F.count(F.lit(1)).alias("citations_found"), F.avg(F.col("_ok").cast("double")).alias("citation_correctness"))
    return answers.select("query_id").join(per, "query_id", "left").fillna({"citations_found": 0, "citation_correctness": 1.0})


def metric_averages(scores: DataFrame, metrics: list[str]) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 6).alias(f"avg_{m}") for m in metrics])


# --- evaluation sets ------------------------------------------------------------------
def last_heading(path: Column) -> Column:
    parts = F.filter(F.transform(F.split(path, ">"), strip), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("the policy"))


def keywords(text: Column, heading: Column) -> Column:
    words = F.filter(F.transform(F.regexp_extract_all(heading, F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)), F.lower),
                     lambda w: ~w.isin(*V.HEADING_STOP))
    numbers = F.regexp_extract_all(text, F.lit(rx(V.EVAL_NUMBER)), F.lit(0))
    lowered = [F.transform(F.regexp_extract_all(text, F.lit(rx(p, True)), F.lit(0)), F.lower) for p in (V.EVAL_DURATION, V.EVAL_MONEY)]
    return F.array_sort(F.array_distinct(F.concat(words, numbers, *lowered)))


def evaluation_set(chunks: DataFrame, size: int = V.EVAL_SIZE) -> DataFrame:
    """Question, expected heading and keywords from chunks that are neither
    short nor boilerplate; one per question, in chunk order. Plainer questions
    fill up what is missing. ``chunks``: chunk_index, text, heading_path, semantic_type."""
    path, text = F.lower("heading_path"), F.lower("text")
    clean = chunks.filter(
        (F.length("text") >= V.EVAL_MIN_CHARS) & ~contains_any(path, V.EVAL_BOILERPLATE) & ~contains_any(text, V.EVAL_TEXT_BOILERPLATE)
    ).withColumn("_h", last_heading(F.col("heading_path"))).withColumn("expected_keywords", keywords(F.col("text"), F.col("_h")))

    def ask(kind):
        before, after = V.EVAL_TEMPLATES[kind].split("{}")
        return F.concat(F.lit(before), "_h", F.lit(after))

    kind = F.col("semantic_type")
    question = F.when(kind == "exclusion", ask("exclusion"))
    for k in ("benefit", "coverage", "waiting_period", "eligibility", "claim_process"):
        question = question.when(kind == k, ask(k))
    question = question.when(path.contains("definition"), ask("definition")).otherwise(ask("other"))
    cols = ["query", "phase", "chunk_index", F.col("heading_path").alias("expected_heading"), "expected_keywords"]
    strict = clean.filter(F.size("expected_keywords") > 0).withColumns({"query": question, "phase": F.lit(0)}).select(*cols)
    relaxed = clean.withColumns({"query": ask("relaxed"), "phase": F.lit(1)}).select(*cols)
    once = keep_first(strict.unionByName(relaxed), ["query"], ["chunk_index"])
    return once.orderBy("phase", "chunk_index").limit(size)


# --- ranking features and weights ---------------------------------------------------------
PARTS = ("rrf", "meta_score", "specificity", "coverage")


def rerank_features(candidates: DataFrame, expansions: dict[str, tuple[str, ...]] | None = None,
                    known_carriers: tuple[str, ...] = ()) -> DataFrame:
    """Features of (query, chunk) candidates: meta_score, specificity, coverage,
    boost, penalty. ``policy`` is the policy detected in the query, or null or blank.

    For routing, the words of three characters or more count, and where
    ``product_name`` is blank those of ``product``, if there is such a column. A
    known carrier without such words is never asked for."""
    blank = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    title, path, carrier, product = blank("section_title"), blank("heading_path"), blank("carrier"), blank("product_name")
    content = F.lower(strip(F.coalesce("page_content", F.lit(""))))
    stop = F.array(*[F.lit(w) for w in V.RANK_STOP])
    asked = F.array_except(F.array_distinct(tokens(F.regexp_replace(F.lower("query"), rx(r"[^\w\s]"), ""))), stop)
    df = candidates.withColumns({"_q": asked, "_c": content, "_t": tokens(content)})
    q, c = F.col("_q"), F.col("_c")
    meta = F.concat_ws(" ", title, blank("clause_type"), path, carrier, product)
    filled = lambda k: F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", 1).otherwise(0)
    rich = sum((filled(k) for k in ("carrier", "product_name", "document_type", "section_title", "clause_type", "page_number")), F.lit(0)) / 6.0
    has_id = F.when((filled("section_id") == 1) | title.rlike(r"\p{Nd}"), 1.0).otherwise(0.0)
    depth = F.least(F.size(F.split(path, "/")) / 5.0, F.lit(1.0))
    density = _ratio(F.size(F.array_except(F.array_distinct("_t"), stop)), F.size("_t"))
    confidence = F.coalesce(F.when(F.col("heading_confidence") != 0, F.col("heading_confidence")), F.lit(0.8))
    more = q
    if expansions:
        table = F.create_map(*[x for w, e in expansions.items() for x in (F.lit(w), F.array(*[F.lit(v) for v in e]))])
        more = F.array_distinct(F.concat(q, F.flatten(F.transform(q, lambda w: F.coalesce(
            F.try_element_at(table, w), F.array().cast("array<string>"))))))
    plain = F.regexp_replace(c, "[_-]+", " ")
    noise = sum((F.when(plain.contains(t), 1).otherwise(0) + F.when(path.contains(t), 2).otherwise(0) for t in V.RANK_BOILERPLATE), F.lit(0))
    priority = F.coalesce(F.when(F.col("document_priority") != 0, F.col("document_priority")), F.lit(100)) / 100.0
    plainly = F.array(*[F.lit(w) for w in V.ROUTING_STOP])
    words = lambda x: F.array_except(F.array_distinct(tokens(x)), plainly)
    named = F.when(product != "", product).otherwise(blank("product")) if "product" in candidates.columns else product
    policy, carrier_words = words(blank("policy")), words(carrier)
    routed = F.arrays_overlap(policy, words(named)) | F.arrays_overlap(policy, carrier_words)
    names = [sorted(set(re.findall(r"\w{3,}", name.lower())) - set(V.ROUTING_STOP)) for name in known_carriers]
    others = [
        reduce(lambda a, b: a & b, [F.lower("query").contains(w) for w in name])
        & ~F.arrays_overlap(carrier_words, F.array(*[F.lit(w) for w in name]))
        for name in names if name]
    other = reduce(lambda a, b: a | b, others, F.lit(False))
    routing = F.when(blank("policy") == "", 1.0).when(routed, V.ROUTED).when(other, V.MISROUTED).otherwise(1.0)
    return df.withColumns({
        "meta_score": _ratio(_count(q, meta), F.size(q)),
        "specificity": 0.2 * rich + 0.2 * (0.5 * has_id + 0.5 * depth) + 0.3 * density + 0.3 * confidence,
        "coverage": _ratio(_count(more, c), F.size(more)),
        "boost": F.when((F.col("intent") != "general") & (blank("semantic_type") == F.col("intent")), V.INTENT_BOOST).otherwise(1.0),
        "penalty": (1.0 - F.least(noise / 4.0, F.lit(1.0))) * priority * routing,
    }).drop("_q", "_c", "_t")


def fuse_subqueries(ranked: DataFrame, k: float = V.FUSION_K) -> DataFrame:
    """Weighted fusion of ranked lists: (query_id, sub_no, chunk_id, rank from 1,
    routed). The first sub-query weighs 1, the others a half; chunks of the
    detected policy count double."""
    weight = F.when(F.col("sub_no") == 0, 1.0).otherwise(V.SUBQUERY_WEIGHT)
    share = weight / (k + F.col("rank") - 1) * F.when(F.col("routed"), V.ROUTED).otherwise(1.0)
    return ranked.groupBy("query_id", "chunk_id").agg(F.sum(share).alias("rrf"))


def weight_grid(step: float = V.GRID_STEP) -> np.ndarray:
    """All four-part weights in steps that sum to one: 1,771 rows for 0.05."""
    n = round(1 / step)
    return np.array([(a, b, c, n - a - b - c) for a in range(n + 1) for b in range(n + 1 - a) for c in range(n + 1 - a - b)]) * step


BLOCK = 512  # candidates of a query that travel as one row


def _scores(rows: list, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of every candidate under every weight vector, its position, is it a hit)."""
    f = np.array([[r[p] for p in PARTS] for r in rows])
    score = np.round(f @ grid.T * np.array([r["factor"] for r in rows])[:, None], 9)
    return score, np.array([r["position"] for r in rows]), np.array([r["hit"] for r in rows], dtype=bool)


def _best_hits(rows: list, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Score and position of the best hit under every weight vector; None without hits."""
    score, position, hit = _scores(rows, grid)
    if not hit.any():
        return None
    at = score[hit].argmax(axis=0)  # rows are in order of position: the first of equals
    return score[hit][at, np.arange(len(grid))], position[hit][at]


def _ahead(rows: list, grid: np.ndarray, top: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many candidates come before (top, at) under every weight vector."""
    score, position, _ = _scores(rows, grid)
    return ((score > top) | ((score == top) & (position[:, None] < at))).sum(axis=0)


def _long_queries(blocks: DataFrame, grid: np.ndarray, k: int) -> DataFrame:
    """(combo, rr) sums over queries of several blocks: the best hit of every query and weight vector, then the
    number of candidates before it. Blocks of a query are rows of any task; a query is as many rows as vectors."""
    combos = np.arange(len(grid))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, rows in zip(pdf["query_id"], pdf["rows"]):
                found = _best_hits(rows, grid)
                if found is not None:
                    yield pd.DataFrame({"query_id": q, "combo": combos, "top": found[0], "at": found[1]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, rows, tops in zip(pdf["query_id"], pdf["rows"], pdf["tops"]):
                top, at = np.array([t["top"] for t in tops]), np.array([t["at"] for t in tops])
                yield pd.DataFrame({"query_id": q, "combo": combos, "n": _ahead(rows, grid, top, at)})

    key = blocks.schema["query_id"].dataType.simpleString()
    first = F.min_by(F.struct("top", "at"), F.struct(-F.col("top"), "at"))
    tops = blocks.mapInPandas(best, f"query_id {key}, combo int, top double, at long").groupBy("query_id", "combo").agg(first.alias("b"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("combo", "b"))), lambda x: x.b)
    tops = cut(tops.groupBy("query_id").agg(row.alias("tops")), "grid_tops")
    met = guarded_join(blocks, tops, ["query_id"], spread=F.col("block"))
    ranks = met.mapInPandas(count, f"query_id {key}, combo int, n long").groupBy("query_id", "combo").agg((1 + F.sum("n")).alias("rank"))
    return ranks.groupBy("combo").agg(F.sum(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"))


def grid_search(features: DataFrame, items: DataFrame, k: int = 6, step: float = V.GRID_STEP, block: int = BLOCK) -> DataFrame:
    """Mean reciprocal rank of every weight vector. ``features``: query_id,
    position (counts up along a query, unique in it), rrf, meta_score,
    specificity, coverage, boost, penalty, hit. Candidates travel as one row per
    query and ``block`` of positions. A query of one block is ranked in its row,
    and each task sums over such queries; for longer ones the best hits of their
    blocks are compared and what comes before them is counted."""
    row = F.struct("position", *[F.col(p).cast("double").alias(p) for p in PARTS],
                   (F.col("boost") * F.col("penalty")).cast("double").alias("factor"), "hit")
    number = F.floor(F.col("position") / block)
    blocks = cut(features.groupBy("query_id", number.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows")), "grid_blocks")
    long = cut(blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id"), "grid_long")
    grid = weight_grid(step)
    combos = np.arange(len(grid))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grid))
        for pdf in batches:
            for rows in pdf["rows"]:
                found = _best_hits(rows, grid)
                if found is not None:
                    rank = 1 + _ahead(rows, grid, *found)
                    total += np.where(rank <= k, 1.0 / rank, 0.0)
        yield pd.DataFrame({"combo": combos, "rr": total})

    some = not long.isEmpty()
    short = blocks.join(long, "query_id", "left_anti") if some else blocks
    sums = short.select("rows").mapInPandas(run, "combo int, rr double")
    if some:
        sums = sums.unionByName(_long_queries(guarded_join(blocks, long, ["query_id"], spread=F.col("block")), grid, k))
    vectors = blocks.sparkSession.createDataFrame(
        [(i, *[round(float(w), 2) for w in grid[i]]) for i in range(len(grid))], "combo int, w1 double, w2 double, w3 double, w4 double")
    sums = vectors.join(sums, "combo", "left").fillna(0.0, ["rr"])
    n = items.agg(F.count(F.lit(1)).alias("n"))  # a single row
    return sums.groupBy("combo", "w1", "w2", "w3", "w4").agg(F.sum("rr").alias("rr")).join(F.broadcast(n), how="cross").select(
        "w1", "w2", "w3", "w4", F.round(F.col("rr") / F.col("n"), 6).alias("mrr"))


def best_weights(grid: DataFrame) -> DataFrame:
    """Highest MRR; the smallest weights, left to right, among equals."""
    w = ["w1", "w2", "w3", "w4"]
    return grid.orderBy(F.desc("mrr"), *w).limit(1)


# --- reports ------------------------------------------------------------------------------
def query_report(queries: DataFrame, results: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row per query with its ordered citations, one per result, so as many as the search returns at most.

    ``answers`` (query_id, latency_ms, generation_degraded, answer, confidence_tier; one row per query at most)
    adds the first three; its tier goes before that of the best result, as answering may lower it. They are null
    for queries without an answer."""
    per = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("confidence_tier", "rank").alias("_tier"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "filename", "page_number"))),
                    lambda s: F.struct(s.filename.alias("filename"), s.page_number.alias("page_number"))).alias("citations"))
    rows = queries.join(per, "query_id", "left")
    tiers = [F.col("_tier"), F.lit("LOW")]
    if answers is not None:
        own = F.col("confidence_tier").alias("_own")
        rows = rows.join(answers.select("query_id", "latency_ms", "generation_degraded", "answer", own), "query_id", "left")
        tiers.insert(0, F.col("_own"))
    return rows.withColumns({"retrieved_chunks_count": F.coalesce("_n", F.lit(0)), "confidence_tier": F.coalesce(*tiers)}).drop("_n", "_tier", "_own")


def failure_report(firsts: DataFrame, categories: DataFrame, scored: DataFrame, n: int = 10) -> DataFrame:
    """Missed queries with their best candidates and the scores of each."""
    missed = firsts.filter(~F.col("hit")).select("query_id").join(categories.select("query_id", "failure_cluster"), "query_id")
    best = top_k(scored.join(missed, "query_id"), n, [F.desc("final_score"), F.col("chunk_id")])
    return best
