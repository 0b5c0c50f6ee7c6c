"""Many queries at once: scope, candidates, fusion, ranking, context."""
from __future__ import annotations

from collections.abc import Callable

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.joins import is_small
from docquarry.functions.similarity import fuzzy_carrier, fuzzy_lob
from docquarry.functions.text import any_of, contains_any, let, rx, tokens
from docquarry.operators.cells import nearest_in_cells
from docquarry.operators.index import SCOPE, SCOPES, KeywordIndex, build_index, nearest, scoped_bm25_scores, top_k
from docquarry.session import cut


@dataclass(frozen=True)
class SearchConfig:
    """What a corpus brings along, and the knobs of the ranking."""

    carriers: tuple = V.CARRIER_ALIASES
    lobs: tuple = V.LOB_KEYWORDS
    products: tuple = V.PRODUCT_NAMES
    fuzzy: bool = True
    fuzzy_threshold: float = V.FUZZY_THRESHOLD
    confidence: float = V.CONFIDENCE
    weights: tuple = (V.WEIGHT_SEMANTIC, V.WEIGHT_AUTHORITY, V.WEIGHT_NUMERIC)
    max_per_document: int = V.MAX_PER_DOCUMENT
    token_budget: int = V.TOKEN_BUDGET


# --- what a query is about --------------------------------------------------------
def carriers_named(query: Column, carriers) -> Column:
    low = F.lower(query)
    return F.filter(F.array(*[F.when(low.contains(alias), F.lit(name)) for name, alias in carriers]), lambda x: x.isNotNull())


def detect_carrier(query: Column, carriers=V.CARRIER_ALIASES) -> Column:
    """The one carrier named in the query; null if none or several are."""
    named = carriers_named(query, carriers)
    return F.when(F.size(named) == 1, F.element_at(named, 1))


def is_comparison(query: Column, carriers=V.CARRIER_ALIASES) -> Column:
    return F.size(carriers_named(query, carriers)) > 1


def detect_lob(query: Column, lobs=V.LOB_KEYWORDS) -> Column:
    """First line of business, in order, with a keyword as a whole word."""
    low = F.lower(query)
    return F.coalesce(*[F.when(low.rlike(rx(rf"\b(?:{any_of(kws)})\b")), F.lit(lob)) for lob, kws in lobs])


def detect_scope(queries: DataFrame, config: SearchConfig = SearchConfig(), query: str = "query") -> DataFrame:
    """Adds carrier, line_of_business, is_comparison, is_admin, search_query.
    The fuzzy pass sees only what the exact pass left open."""
    q = F.col(query)
    df = queries.withColumns({
        "is_comparison": is_comparison(q, config.carriers),
        "carrier": detect_carrier(q, config.carriers),
        "line_of_business": detect_lob(q, config.lobs),
    })
    if config.fuzzy:
        low = F.lower(q)
        open_carrier = F.when(F.col("carrier").isNull() & ~F.col("is_comparison"), tokens(low))
        open_lob = F.when(F.col("line_of_business").isNull(), low)
        df = df.withColumns({
            "carrier": F.coalesce("carrier", fuzzy_carrier(open_carrier, config.carriers, config.fuzzy_threshold)),
            "line_of_business": F.coalesce("line_of_business", fuzzy_lob(open_lob, config.lobs, config.fuzzy_threshold)),
        })
    return admin_intent(df, query)


def admin_intent(queries: DataFrame, query: str = "query") -> DataFrame:
    """Administrative questions get more search words and no line of business."""
    q = F.col(query)
    admin = contains_any(F.lower(q), V.ADMIN_KEYWORDS)
    return queries.withColumns({
        "is_admin": admin,
        "line_of_business": F.when(~admin, F.col("line_of_business")),
        "search_query": F.when(admin, F.concat(q, F.lit(V.ADMIN_EXPANSION))).otherwise(q),
    })


def scope_counts(rows: DataFrame) -> DataFrame:
    """Rows per scope; counted at the finest scope and rolled up."""
    fine = rows.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("c"))
    return fine.groupingSets(SCOPES, *SCOPE).agg(F.sum("c").alias("hits"))


def scope_sizes(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``hits``: how many rows pass each query's filter (null: none). The
    pairs themselves are never built; the searches apply the filter inside
    their own joins."""
    q, c = queries.alias("q"), scope_counts(rows).alias("c")
    same = [F.col(f"q.{s}").eqNullSafe(F.col(f"c.{s}")) for s in SCOPE]
    return q.join(c, same, "left").select("q.*", "hits")


def open_empty_scopes(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """A filter that no vector passes is dropped. Decided from the counts per
    scope, before the search, so there is one search and not two."""
    found = scope_sizes(queries, vectors)
    kept = F.col("hits").isNotNull()
    return found.withColumns({s: F.when(kept, F.col(s)) for s in SCOPE}).withColumn("fell_back", ~kept).drop("hits")


# --- candidates --------------------------------------------------------------------
def sparse_candidates(scores: DataFrame, k: int = V.TOP_SPARSE) -> DataFrame:
    return top_k(scores.filter(F.col("score") > 0), k, [F.desc(F.round("score", 9)), F.col("chunk_id")])


def fuse(dense: DataFrame, sparse: DataFrame, k: float = V.FUSION_K) -> DataFrame:
    """Reciprocal rank fusion over 1-based ``rank`` columns; ranks count from 0
    in the formula."""
    one = lambda df, mine, other: df.select(
        "query_id", "chunk_id", (F.col("rank") - 1).cast("int").alias(mine), F.lit(None).cast("int").alias(other))
    both = one(dense, "dense_rank", "sparse_rank").unionByName(one(sparse, "sparse_rank", "dense_rank"))
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.groupBy("query_id", "chunk_id").agg(
        F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank")
    ).withColumn("rrf", share("dense_rank") + share("sparse_rank"))



def _fused_order() -> list[Column]:
    return [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.col("chunk_id")]


def top_fused(fused: DataFrame, k: int = V.TOP_FUSED) -> DataFrame:
    return top_k(fused, k, _fused_order(), name="fused_rank")


def balanced_pool(fused: DataFrame, per_side: int = V.PER_SIDE, k: int = V.TOP_FUSED) -> DataFrame:
    """For comparisons: at most ``per_side`` per carrier before the overall cut.
    ``fused`` has carrier and is_comparison."""
    side = F.upper(F.coalesce(F.when(F.col("carrier") != "", F.col("carrier")), F.lit("OTHER")))
    w = Window.partitionBy("query_id", "_side").orderBy(*_fused_order())
    pool = fused.withColumn("_side", side).withColumn("_n", F.row_number().over(w)).filter(
        ~F.col("is_comparison") | (F.col("_n") <= per_side))
    return top_fused(pool.drop("_n", "_side"), k)


def fetch(chunks: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """Rows of ``chunks`` for wanted (query, chunk) pairs. With few queries the
    pairs are a few dozen per query and are sent to the chunks."""
    return chunks.join(F.broadcast(wanted) if few else wanted, "chunk_id")


# --- ranking -----------------------------------------------------------------------
def lexical_logit(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: share of the query's words in the text."""
    q = F.array_distinct(tokens(query))
    share = F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))
    return 6.0 * share - 3.0


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def authority(priority: Column) -> Column:
    return F.least(F.coalesce(priority.try_cast("double"), F.lit(float(V.DEFAULT_PRIORITY))), F.lit(100.0)) / 100.0


def numeric_density(text: Column) -> Column:
    return F.least(F.regexp_count(F.lower(text), F.lit(rx(V.NUMERIC_HIT))) / V.NUMERIC_FULL, F.lit(1.0))


def blend(semantic: Column, auth: Column, numeric: Column, weights=SearchConfig.weights) -> Column:
    ws, wa, wn = weights
    return (ws * semantic + wa * auth + wn * numeric) / max(ws + wa + wn, 1e-6)


def procedural_boost(is_admin: Column, text: Column) -> Column:
    return F.when(is_admin & contains_any(F.lower(text), V.PROCEDURAL), V.PROCEDURAL_BOOST).otherwise(0.0)


def product_boost(query: Column, filename: Column, products=V.PRODUCT_NAMES) -> Column:
    name = F.translate(F.lower(F.coalesce(filename, F.lit(""))), "-_", "  ")
    hit = let(F.struct(F.lower(query).alias("q"), name.alias("n")), lambda v: F.exists(
        F.array(*[F.lit(p) for p in products]), lambda p: v.q.contains(p) & v.n.contains(p)))
    return F.when(hit, V.PRODUCT_BOOST).otherwise(0.0)


def score_candidates(candidates: DataFrame, config: SearchConfig = SearchConfig(), logit: Column | None = None) -> DataFrame:
    """``candidates``: query, is_admin, page_content, filename, document_priority.
    ``logit`` is the reranker's output; the default needs no model."""
    text = F.col("page_content")
    semantic = sigmoid(logit if logit is not None else lexical_logit(F.col("query"), text))
    return candidates.withColumn("semantic_score", semantic).withColumn(
        "score",
        blend(F.col("semantic_score"), authority(F.col("document_priority")), numeric_density(text), config.weights)
        + procedural_boost(F.col("is_admin"), text)
        + product_boost(F.col("query"), F.col("filename"), config.products),
    )


def confidence_tier(scored: DataFrame, confidence: float = V.CONFIDENCE) -> DataFrame:
    """Queries whose best score is too low lose all rows; others get a tier."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("_top", top).filter(F.col("_top") >= confidence - V.REJECT_MARGIN).withColumn(
        "confidence_tier", F.when(F.col("_top") >= confidence, "HIGH").otherwise("MEDIUM")).drop("_top")


def diversify(scored: DataFrame, per_document: int = V.MAX_PER_DOCUMENT, k: int = V.TOP_FINAL) -> DataFrame:
    """At most ``per_document`` per document; free places are refilled in order."""
    order = [F.desc("score"), F.col("fused_rank")]
    w = Window.partitionBy("query_id", F.coalesce("document_id", "filename")).orderBy(*order)
    late = scored.withColumn("_late", F.row_number().over(w) > per_document)
    return top_k(late, k, [F.col("_late"), *order], name="position").drop("_late")


# --- context -----------------------------------------------------------------------
def stitch(selected: DataFrame, chunks: DataFrame, few: bool, first: int = V.STITCHED, chars: int = V.STITCH_CHARS) -> DataFrame:
    """The first results get the end of the chunk before and the start of the
    chunk after. ``selected`` has at most five rows per query."""
    near = F.col("position") <= first
    ids = selected.filter(near).select(F.explode(F.array("previous_chunk_id", "next_chunk_id")).alias("chunk_id")).distinct()
    texts = chunks.select("chunk_id", "page_content").join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")
    side = lambda name, out: texts.select(F.col("chunk_id").alias(name), F.col("page_content").alias(out))
    df = selected.join(side("previous_chunk_id", "_before"), "previous_chunk_id", "left").join(
        side("next_chunk_id", "_after"), "next_chunk_id", "left")
    return df.withColumn("text", F.when(near, F.concat_ws(
        "\n", F.right("_before", F.lit(chars)), "page_content", F.left("_after", F.lit(chars)))
    ).otherwise(F.col("page_content"))).drop("_before", "_after")


def page_siblings(chunks: DataFrame) -> DataFrame:
    """The last chunk of every page."""
    return chunks.filter(F.col("filename").isNotNull() & F.col("page_number").isNotNull()).groupBy("filename", "page_number").agg(
        F.max_by(F.struct("chunk_id", "page_content"), F.struct("chunk_index", "chunk_id")).alias("sibling"))


def with_siblings(selected: DataFrame, chunks: DataFrame, few: bool) -> DataFrame:
    """Adds ``sibling``: the last chunk of the next page of the same file."""
    wanted = selected.select("filename", (F.col("page_number") + 1).alias("page_number")).distinct()
    near = chunks.join(F.broadcast(wanted) if few else wanted, ["filename", "page_number"], "left_semi")
    nxt = page_siblings(near).withColumn("page_number", F.col("page_number") - 1)
    return selected.join(nxt, ["filename", "page_number"], "left")


def pack_context(selected: DataFrame, budget: int = V.TOKEN_BUDGET) -> DataFrame:
    """Greedy fill of the token budget in order of position: a result that does
    not fit is passed over with its sibling, smaller ones after it may fit; a
    sibling already in suppresses that chunk later. At most five rows per query
    are folded. Needs text, sibling, score, semantic_score, confidence_tier."""
    size = lambda t: F.greatest(F.floor(F.length(t) / V.CHARS_PER_TOKEN), F.lit(1)).cast("int")
    row = F.struct(
        "position", "chunk_id", "text", "score", "semantic_score", "confidence_tier", "document_id", "filename", "page_number",
        F.col("sibling.chunk_id").alias("sid"), F.col("sibling.page_content").alias("stext"))
    grouped = selected.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def out(x, cid, text, sibling):
        return F.struct(
            cid.alias("chunk_id"), text.alias("text"), x.score.alias("score"), x.semantic_score.alias("semantic_score"),
            x.confidence_tier.alias("confidence_tier"), x.document_id.alias("document_id"), x.filename.alias("filename"),
            (x.page_number + (1 if sibling else 0)).cast("int").alias("page_number"), F.lit(sibling).alias("is_sibling_expansion"))

    def step(acc, x):
        fits = ~F.array_contains(acc.ids, x.chunk_id) & (acc.used + size(x.text) <= budget)
        used = acc.used + size(x.text)
        ids = F.concat(acc.ids, F.array(x.chunk_id))
        extra = F.coalesce(x.sid.isNotNull() & ~F.array_contains(ids, x.sid) & (used + size(x.stext) <= budget), F.lit(False))
        mine = F.array(out(x, x.chunk_id, x.text, False))
        both = F.array(out(x, x.chunk_id, x.text, False), out(x, x.sid, x.stext, True))
        return F.struct(
            F.when(fits & extra, used + size(x.stext)).when(fits, used).otherwise(acc.used).alias("used"),
            F.when(fits & extra, F.concat(ids, F.array(x.sid))).when(fits, ids).otherwise(acc.ids).alias("ids"),
            F.when(fits & extra, F.concat(acc.rows, both)).when(fits, F.concat(acc.rows, mine)).otherwise(acc.rows).alias("rows"))

    kinds = ("struct<chunk_id:string,text:string,score:double,semantic_score:double,confidence_tier:string,"
             "document_id:string,filename:string,page_number:int,is_sibling_expansion:boolean>")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"), F.array().cast(f"array<{kinds}>").alias("rows"))
    packed = grouped.select("query_id", F.posexplode(F.aggregate("_rows", start, step, lambda a: a.rows)).alias("_i", "_r"))
    return packed.select("query_id", (F.col("_i") + 1).alias("rank"), "_r.*")


# --- the whole search ----------------------------------------------------------------
# up to here the candidates (ids and ranks, at most 50 per query) are sent to all tasks
FEW_QUERIES = 2_000


def search(
    chunks: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig(),
    logit: Column | None = None, embedding: str = "embedding", index: KeywordIndex | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None, vector_index=None,
) -> DataFrame:
    """Queries (query_id, query, embedding) to ranked context rows. ``chunks``
    carries its vector in ``embedding`` (null: keyword search only). A stored
    ``index`` saves building one. ``encode`` adds the queries' ``embedding`` from
    their ``search_query``, so that the words added to an administrative
    question count in the vector search too. With a ``vector_index`` (see
    ``cells``) only its nearest cells are searched, else all vectors."""
    few = is_small(queries.select("query_id", "query"), FEW_QUERIES)
    vectors = chunks.filter(F.col(embedding).isNotNull()).select("chunk_id", *SCOPE, F.col(embedding).alias("embedding"))
    scoped = open_empty_scopes(detect_scope(queries if encode is None else queries.drop("embedding"), config), vectors)
    scoped = scoped if encode is None else encode(scoped)
    scoped = cut(scoped, "queries")
    dense = nearest(vectors, scoped, V.TOP_DENSE) if vector_index is None else nearest_in_cells(vector_index, scoped, V.TOP_DENSE)
    sparse = sparse_candidates(scoped_bm25_scores(index or build_index(chunks), scoped))
    fused = fuse(dense, sparse)
    need = ["chunk_id", "page_content", "filename", "document_id", "document_priority", "carrier",
            "page_number", "previous_chunk_id", "next_chunk_id"]
    about = scoped.select("query_id", "query", "is_admin", "is_comparison")
    pool = balanced_pool(fetch(chunks.select(*need), fused, few).join(about, "query_id"))
    chosen = diversify(confidence_tier(score_candidates(pool, config, logit), config.confidence), config.max_per_document)
    chosen = cut(chosen, "selected")  # five rows per query; read by the two look-ups below
    return pack_context(with_siblings(stitch(chosen, chunks, few), chunks, few), config.token_budget)
