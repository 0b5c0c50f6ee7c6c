"""Sections and blocks to enriched, linked chunks; plain text splitters."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions import scan as S
from docquarry.functions.joins import guarded_join
from docquarry.functions.packing import greedy_packs
from docquarry.functions.text import collapse, contains_any, holds_any, let, rx, strip
from docquarry.operators.sections import block_rows, parse_pages, section_rows
from docquarry.session import cut, release, temporary_stages

SHARE = 64 << 20  # characters of text, at least, of the documents that are made into chunks at once
SHARES = 8  # at most, as each reads the whole input for its own documents


# --- enrichment of one chunk ----------------------------------------------------
def content_flags(text: Column) -> dict[str, Column]:
    return {
        "contains_numbers": text.rlike(rx(V.HAS_NUMBER)),
        "contains_percentage": text.rlike(rx(V.HAS_PERCENT)),
        "contains_duration": text.rlike(rx(V.HAS_DURATION, True)),
        "contains_money": text.rlike(rx(V.HAS_MONEY, True)),
    }


def references(text: Column) -> Column:
    """Cross-references in order of first appearance, joined by ``|``. All their
    first letters are s, c or a; elsewhere the pattern is not tried."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rx("(?=[sca])" + V.REFERENCE, True)), F.lit(1)), collapse)
    firsts = let(F.transform(found, lambda x: F.struct(F.lower(x).alias("low"), x.alias("ref"))), lambda f: F.filter(
        f, lambda x, i: F.array_position(f.low, x.low) == i + 1))
    return F.array_join(firsts.ref, "|")


def semantic_type(text: Column, chunk_type: Column, low: Column, path: Column) -> Column:
    """First rule that applies; ``low`` and ``path`` are the lower-case text and
    heading path."""
    def has(kind):
        return holds_any(path, V.SEMANTIC_KEYWORDS[kind]) | holds_any(low, V.SEMANTIC_KEYWORDS[kind])

    return (
        F.when(chunk_type.isin("table", "table_row") | (text.contains("[Context: ") & text.contains("| Col ")), "table")
        .when(has("faq") | low.rlike(rx(V.QUESTION)), "faq")
        .when(has("exclusion"), "exclusion")
        .when(has("waiting_period"), "waiting_period")
        .when(has("claim_process") | path.contains("claim"), "claim_process")
        .when(has("premium"), "premium")
        .when(has("eligibility"), "eligibility")
        .when(has("hospital_network"), "hospital_network")
        .when(path.contains("definition") | text.rlike(rx(V.DEFINITION)), "definition")
        .when(has("benefit"), "benefit")
        .when(has("coverage"), "coverage")
        .when(has("contact"), "contact")
        .otherwise("general")
    )


def enrich(chunks: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    return chunks.withColumns({"_low": F.lower(c), "_path": F.lower("heading_path")}).withColumns({
        **content_flags(c), "references": references(c),
        "semantic_type": semantic_type(c, F.col("chunk_type"), F.col("_low"), F.col("_path")),
    }).drop("_low", "_path")


def chunk_id(document: Column, path: Column, block: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("_", document, collapse(F.lower(path)), block.cast("string"), collapse(F.lower(text))))


def _filled(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def product_label(lob: Column, sub_product: Column, product: Column, document_name: Column) -> Column:
    cleaned = strip(F.replace(F.regexp_replace(document_name, rx(V.NAME_TAIL, True), ""), F.lit("_"), F.lit(" ")))
    return _filled(lob, sub_product, product, cleaned)


def with_context(text: Column, path: Column, carrier: Column | None = None, product: Column | None = None) -> Column:
    """Text behind its ``[Context: …]`` line; parts that are blank are left out."""
    parts = []
    if carrier is not None:
        parts = [F.concat(F.lit("Carrier: "), _filled(carrier)), F.concat(F.lit("Product: "), product)]
    inside = F.concat_ws(" | ", *parts, F.concat(F.lit("Heading: "), _filled(path)))
    return F.when(inside == "", text).otherwise(F.concat(F.lit("[Context: "), inside, F.lit("] \n\n"), text))


def retrieval_text(number: Column, title: Column, path: Column, content: Column) -> Column:
    return F.concat_ws(" ", _filled(number), _filled(title), _filled(path), _filled(content))


# --- tables -----------------------------------------------------------------------
def cells(row: Column) -> Column:
    return F.filter(F.transform(F.split(F.btrim(row, F.lit("|")), r"\|"), strip), lambda c: c != "")


def table_row_texts(lines: Column, title: Column) -> Column:
    """Array of (row, text): each data row as ``header = cell; …``. The rule
    under the header is skipped; blank rows keep their number."""
    return let(cells(F.element_at(lines, 1)), lambda header: _row_texts(lines, header, title))


def _row_texts(lines: Column, header: Column, title: Column) -> Column:
    ruled = F.coalesce(F.try_element_at(lines, F.lit(2)).rlike(r"^[-:| ]*$"), F.lit(False))
    body = F.slice(lines, F.when(ruled, 3).otherwise(2), F.size(lines))
    label = F.concat(F.lit("Table ("), F.when(title != "", title).otherwise("Data"), F.lit("): "))

    def content(own):
        n = F.least(F.size(header), F.size(own))
        named = F.zip_with(F.slice(header, F.lit(1), n), F.slice(own, F.lit(1), n),
                           lambda h, c: F.concat(h, F.lit(" = "), c))
        return F.array_join(F.when(F.size(header) > 0, named).otherwise(own), "; ")

    rows = F.transform(body, lambda r, i: F.struct((i + 1).alias("row"), cells(r).alias("cells")))
    return F.transform(
        F.filter(rows, lambda r: F.size(r.cells) > 0),
        lambda r: F.struct(r.row.alias("row"), F.concat(label, content(r.cells), F.lit(".")).alias("text")),
    )


# --- bullets and paragraphs -------------------------------------------------------
def bullet_packs(atoms: DataFrame, max_chars: int = V.MAX_CHARS, segmented: bool = False) -> DataFrame:
    """Bullet items of a block, packed; items are never gathered by block."""
    items = atoms.filter(F.col("kind") == "bullet").select(
        "document_id", "section_seq", "block_no", "seg", "page", "line_no", "text")
    key, order = ["document_id", "section_seq", "block_no"], ["page", "line_no"]
    packs = greedy_packs(items, key, order, F.length("text"), int(max_chars * V.BULLET_FACTOR), segmented)
    texts = F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda s: s.text)
    return packs.groupBy(*key, "pack").agg(
        F.min("seg").alias("seg"), F.array_join(texts, "\n").alias("text"), F.count(F.lit(1)).cast("int").alias("bullet_count"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, V.SENTENCE_BREAK), strip), lambda x: x != "")


def sentence_packs(blocks: DataFrame, max_chars: int = V.MAX_CHARS, segmented: bool = False) -> DataFrame:
    """Sentences of each run of paragraphs, packed up to ``max_chars``."""
    items = blocks.filter(F.col("block_type") == "paragraph").select(
        "document_id", "section_seq", "run_no", "seg", "block_no", "page_start", "page_end",
        F.posexplode(sentences(F.element_at("lines", 1))).alias("sent_no", "sentence"))
    key, order = ["document_id", "section_seq", "run_no"], ["block_no", "sent_no"]
    packs = greedy_packs(items, key, order, F.length("sentence"), max_chars, segmented)
    texts = F.transform(F.sort_array(F.collect_list(F.struct(*order, "sentence"))), lambda s: s.sentence)
    return packs.groupBy(*key, "pack").agg(
        F.min("seg").alias("seg"), F.array_join(texts, " ").alias("text"), F.min("block_no").alias("block_no"),
        F.min_by("page_start", F.struct(*order)).alias("page_start"), F.max_by("page_end", F.struct(*order)).alias("page_end"))


def merge_short_packs(
    packs: DataFrame, max_chars: int = V.MAX_CHARS, min_chars: int = V.MIN_MERGE, segmented: bool = False
) -> DataFrame:
    """A short pack joins the one before it if both fit. A pack is only closed
    before a sentence it has no room for, so the pack after a short one is long:
    short packs never follow each other and each merge is with one neighbour."""
    if max_chars <= 2 * min_chars:
        raise ValueError("max_chars must be more than twice min_chars")
    key = ["document_id", "section_seq", "run_no"]
    n = F.length("text")
    df = S.neighbours(packs.withColumn("_n", n), ["pack"], ["text", "page_end", "_n"], segmented, key)
    limit = max_chars * V.MERGE_FACTOR
    joins = lambda short, room: F.coalesce((short < min_chars) & (room + short <= limit), F.lit(False))
    df = df.withColumns({
        "_joins": joins(F.col("_n"), F.col("prev._n")), "_takes": joins(F.col("next._n"), F.col("_n"))})
    df = S.running_total(df, ["pack"], F.col("_joins").cast("int"), "_before", segmented, key)
    return df.filter(~F.col("_joins")).select(
        *key, "seg", (F.col("pack") - F.col("_before")).cast("int").alias("idx"), "block_no",
        F.when(F.col("_takes"), F.concat_ws(" ", "text", "next.text")).otherwise(F.col("text")).alias("text"),
        "page_start",
        F.when(F.col("_takes"), F.greatest("page_end", "next.page_end")).otherwise(F.col("page_end")).alias("page_end"),
    )


# --- the chunk table --------------------------------------------------------------
def _attach(rows: DataFrame, attributes: DataFrame, on: list[str], segmented: bool) -> DataFrame:
    """Join attributes of a document, section, run or block to its many rows.
    Only a document longer than a segment can make such a key hot; its rows are
    then spread over salted copies of the attributes."""
    if not segmented:
        return rows.join(attributes, on)
    return guarded_join(rows, attributes, on, spread=F.struct(*[c for c in rows.columns if c not in on]))


def chunk_units(atoms: DataFrame, max_chars: int = V.MAX_CHARS, segmented: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """Tables (whole), bullet packs and sentence packs in one table, each with
    its place in the document and in the numbering of its section."""
    blocks = block_rows(atoms, bullet_lines=False) if blocks is None else blocks
    tables = blocks.filter(F.col("block_type") == "table").select(
        "document_id", "seg", "section_seq", "block_no", F.lit(0).alias("sub"), F.lit("table").alias("chunk_type"),
        F.array_join("lines", "\n").alias("text"), "lines", F.lit(None).cast("int").alias("bullet_count"),
        "page_start", "page_end")
    bullets = _attach(
        bullet_packs(atoms, max_chars, segmented),
        blocks.filter(F.col("block_type") == "bullet_group").select("document_id", "block_no", "page_start", "page_end"),
        ["document_id", "block_no"], segmented
    ).select(
        "document_id", "seg", "section_seq", "block_no", F.col("pack").cast("int").alias("sub"),
        F.lit("bullet_group").alias("chunk_type"), "text", F.lit(None).cast("array<string>").alias("lines"),
        "bullet_count", "page_start", "page_end")
    packs = sentence_packs(blocks, max_chars, segmented)
    if segmented:
        packs = cut(packs, "packs")
    runs = blocks.filter(F.col("block_type") == "paragraph").groupBy("document_id", "run_no").agg(F.min("block_no").alias("_first"))
    merged = merge_short_packs(packs, max_chars, segmented=segmented)
    paragraphs = _attach(merged, runs, ["document_id", "run_no"], segmented).select(
        "document_id", "seg", "section_seq", F.col("_first").alias("block_no"), F.col("idx").alias("sub"),
        F.lit("paragraph").alias("chunk_type"), "text", F.lit(None).cast("array<string>").alias("lines"),
        F.lit(None).cast("int").alias("bullet_count"), "page_start", "page_end")
    return tables.unionByName(bullets).unionByName(paragraphs)


def build_chunks(
    atoms: DataFrame, documents: DataFrame, max_chars: int = V.MAX_CHARS, segmented: bool = False,
) -> DataFrame:
    """The chunk table. ``documents`` has document_id, source, relative_path,
    document_type, document_priority and the folder metadata. Blocks are
    written to the shared folder, since five steps read them. Documents of one
    segment are then shuffled by their id, once: no later step shuffles the texts."""
    blocks = cut(block_rows(atoms, bullet_lines=False), "blocks")
    release(blocks)
    if not segmented:
        atoms, blocks = atoms.repartition("document_id"), blocks.repartition("document_id")
    units = chunk_units(atoms, max_chars, segmented, blocks)
    sections = section_rows(atoms, segmented, blocks).select(
        "document_id", "section_seq", "section_number", F.col("title").alias("section_title"),
        F.col("level").alias("section_level"), F.array_join("heading_path", " > ").alias("heading_path"),
        "heading_confidence", "first_block")
    text_cols = ("carrier", "category_1", "line_of_business", "product", "sub_product", "document_name")
    docs = documents.select(
        "document_id", "source", "relative_path", "document_type", "document_priority",
        *[F.coalesce(c, F.lit("")).alias(c) for c in text_cols])
    df = _attach(_attach(units, sections, ["document_id", "section_seq"], segmented), docs, ["document_id"], segmented)
    index = F.col("block_no") - F.col("first_block")
    block = (
        F.when(F.col("chunk_type") == "bullet_group", F.concat_ws("_", index, F.col("sub")))
        .when(F.col("chunk_type") == "paragraph", (index + F.col("sub")).cast("string"))
        .otherwise(index.cast("string"))
    )
    df = df.withColumn("_id", chunk_id(F.col("document_id"), F.col("heading_path"), block, F.col("text")))
    is_table = F.col("chunk_type") == "table"

    def part(row, kind, cid, parent, text):
        return F.struct(row.cast("int").alias("row"), kind.alias("chunk_type"), cid.alias("chunk_id"),
                        parent.alias("parent_chunk_id"), text.alias("text"))

    whole = F.array(part(F.lit(0), F.col("chunk_type"), F.col("_id"), F.lit(""), F.col("text")))
    rows = F.transform(table_row_texts(F.col("lines"), F.col("section_title")), lambda r: part(
        r.row, F.lit("table_row"), F.concat(F.col("_id"), F.lit("_row_"), r.row.cast("string")), F.col("_id"), r.text))
    keep = [c for c in df.columns if c not in ("chunk_type", "text", "lines", "_id", "first_block")]
    df = df.select(*keep, F.inline(F.when(is_table, F.concat(whole, rows)).otherwise(whole)))
    kind = F.col("chunk_type")
    product = product_label(*[F.col(c) for c in ("line_of_business", "sub_product", "product", "document_name")])
    carrier = _filled(F.col("carrier"), F.col("category_1"))
    content = F.when(kind == "table_row", with_context(F.col("text"), F.col("heading_path"))).otherwise(
        with_context(F.col("text"), F.col("heading_path"), carrier, product))
    df = enrich(df).withColumns({
        "page_content": content, "filename": F.col("source"), "page_number": F.col("page_start"),
        "is_parent": F.when(kind == "table", True).when(kind == "table_row", False),
        "contains_table": kind.isin("table", "table_row"), "contains_bullets": kind == "bullet_group",
    }).withColumn("retrieval_text", retrieval_text(
        F.col("section_number"), F.col("section_title"), F.col("heading_path"), F.col("page_content")))
    return link_chunks(df, segmented)


def shares(texts: DataFrame) -> int:
    """Shares of the documents ``texts`` (text) that ``chunk_shares`` takes one after the other."""
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, min(SHARES, -(-size // SHARE)))


def chunk_shares(
    pages: DataFrame, documents: DataFrame, n: int, pick: Callable[[DataFrame], DataFrame], max_chars: int = V.MAX_CHARS,
) -> DataFrame:
    """What ``pick`` takes of the chunk table of all ``pages``, made in ``n`` shares of the documents and written.

    Stages and shuffles of a share are deleted before the next, so at any time the
    disk holds those of one share and what has been picked. A document is in one share."""
    parts = []
    for i in range(n):
        mine = lambda df: df.filter(F.pmod(F.xxhash64("document_id"), F.lit(n)) == i)
        with temporary_stages(pages.sparkSession) as inner:
            atoms, segmented = parse_pages(mine(pages), write_stages=True)
            release(atoms)
            parts.append(cut(pick(build_chunks(atoms, mine(documents), max_chars, segmented)), "chunks"))
            inner.remove(parts[-1]._cut_path)
        del atoms
        release(pages)
    return reduce(DataFrame.unionByName, parts)


CHUNK_ORDER = ["block_no", "sub", "row"]


def link_chunks(chunks: DataFrame, segmented: bool = False, order: list[str] = tuple(CHUNK_ORDER)) -> DataFrame:
    """Neighbours and position inside the document."""
    df = S.neighbours(chunks, list(order), ["chunk_id"], segmented)
    df = S.running_total(df, list(order), F.lit(1), "local_index", segmented)
    return df.withColumns({
        "previous_chunk_id": F.coalesce("prev.chunk_id", F.lit("")),
        "next_chunk_id": F.coalesce("next.chunk_id", F.lit("")),
        "local_index": (F.col("local_index") - 1).cast("long"),
    }).drop("prev", "next")


def document_offsets(counts: DataFrame, order: str = "relative_path") -> DataFrame:
    """Number of chunks in the documents before each one. A global sort gives
    order-keeping ids; the sums per sort partition are few rows, so neither the
    documents nor the chunks pass through one task."""
    ranged = cut(
        counts.orderBy(order).withColumn("_rid", F.monotonically_increasing_id()), "offsets"
    ).withColumn("_part", F.shiftright("_rid", 33))
    sums = ranged.groupBy("_part").agg(F.sum("n").alias("_n"))
    starts = sums.select("_part", F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # one row per sort partition: at most spark.sql.shuffle.partitions rows
    inside = F.sum("n").over(Window.partitionBy("_part").orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(starts), "_part").withColumn(
        "offset", F.col("_start") + F.coalesce(inside, F.lit(0))).drop("_rid", "_part", "_start", "n")


def index_chunks(chunks: DataFrame, order: str = "relative_path", stored: bool = False) -> DataFrame:
    """``chunk_index`` over the corpus, documents in path order. The chunks are
    written first, unless they are stored: they are read for the counts and for the result."""
    chunks = chunks if stored else cut(chunks, "chunks")
    counts = chunks.groupBy("document_id").agg(F.first(order).alias(order), F.count(F.lit(1)).alias("n"))
    offsets = document_offsets(counts, order).drop(order)
    return chunks.join(offsets, "document_id").withColumn(
        "chunk_index", F.col("offset") + F.col("local_index")).drop("offset")


# --- splitters ----------------------------------------------------------------------
def windows(n: Column, size: int, overlap: int) -> Column:
    """Start offsets of windows of ``size`` that overlap and cover 0..n."""
    return F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))


def char_windows(text: Column, size: int, overlap: int) -> Column:
    return let(text, lambda t: F.transform(windows(F.length(t), size, overlap), lambda s: F.substr(t, s + 1, F.lit(size))))


def token_windows(text: Column, size: int = V.SPLIT_TOKENS, overlap: int = V.SPLIT_OVERLAP) -> Column:
    return let(F.split(collapse(text), " "), lambda words: F.transform(
        windows(F.size(words), size, overlap), lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")))


def split_tokens(
    pages: DataFrame, heading: str = "heading", size: int = V.SPLIT_TOKENS, overlap: int = V.SPLIT_OVERLAP
) -> DataFrame:
    """Token windows of every page behind their ``[Section: …]`` label."""
    df = pages.filter(strip(F.col("text")) != "").select("*", F.posexplode(token_windows(F.col("text"), size, overlap)).alias("window", "_w"))
    labelled = F.concat(F.lit("[Section: "), F.col(heading), F.lit("] "), F.col("_w"))
    return df.withColumn("chunk_text", labelled).withColumn(
        "chunk_id", F.sha2(collapse(F.lower("chunk_text")), 256)).drop("_w", "text")


def markdown_sections(text: Column) -> Column:
    """Split before ``#``…``####`` lines; oversized sections are cut into
    windows, each behind the section's heading line."""
    parts = F.filter(F.transform(F.split(text, r"(?m)(?=^[^\S\n]*#{1,4} [^\S\n]*\S)"), strip), lambda x: x != "")

    def sized(p):
        first = F.substring_index(p, "\n", 1)
        headed = first.rlike(r"^#{1,4} \s*\S")
        head = F.when(headed, F.concat(first, F.lit("\n"))).otherwise("")
        body = F.when(headed, F.substr(p, F.length(first) + 2, F.length(p))).otherwise(p)
        pieces = let(head, lambda h: F.transform(char_windows(body, V.SUB_CHARS, V.SUB_OVERLAP), lambda w: strip(F.concat(h, w))))
        return F.when(F.length(p) > V.SECTION_CHARS, pieces).otherwise(F.array(p))

    return F.flatten(F.transform(parts, sized))


def parent_children(pages: DataFrame, segmented: bool = False) -> DataFrame:
    """Heading sections as parents, 350-character children carrying the parent.

    ``chunk_index`` counts the children of a document from 0, over pages, parents
    and children in order; ``chunk_id`` is ``{document_id}_{chunk_index}``. A page's
    children are made in its row, so only their numbers run along the document.
    ``pages``: document_id, page (one row each), seg, text; null texts have no children."""
    cut_up = F.transform(markdown_sections(F.col("text")), lambda p: F.struct(
        p.alias("parent_text"), char_windows(p, V.CHILD_CHARS, V.CHILD_OVERLAP).alias("children")))
    rows = F.flatten(F.transform(cut_up, lambda p, i: F.transform(p.children, lambda c, j: F.struct(
        i.alias("parent_no"), p.parent_text.alias("parent_text"), j.alias("child_no"), c.alias("child_text")))))
    split = pages.select("document_id", "page", "seg", F.coalesce(rows, F.array()).alias("_rows"))
    upto = S.running_total(split, ["page"], F.size("_rows"), "_upto", segmented)
    out = upto.select("document_id", "page", (F.col("_upto") - F.size("_rows")).alias("_before"), F.posexplode("_rows").alias("_at", "_r"))
    index = (F.col("_before") + F.col("_at")).alias("chunk_index")
    return out.select("document_id", "page", index, F.concat_ws("_", "document_id", index).alias("chunk_id"), "_r.*")


def heading_candidate(line: Column) -> Column:
    """May a line serve as the active heading? Text rules only."""
    low, n = F.lower(line), F.length(line)
    return (
        (n >= 4) & (n <= 80) & ~line.rlike(rx(V.CARRY_GARBAGE[0])) & ~line.rlike(rx(V.CARRY_GARBAGE[1]))
        & ~contains_any(low, V.CARRY_NOISE)
        & (reduce(lambda a, b: a | b, [low.startswith(p) for p in V.CARRY_PREFIXES]) | contains_any(low, V.CARRY_KEYWORDS))
    )


def carry_headings(pages: DataFrame, default: str = "General", segmented: bool = False) -> DataFrame:
    """The last heading on a page, else the one carried from earlier pages."""
    found = F.filter(F.transform(F.split("text", r"\R"), strip), heading_candidate)
    df = pages.withColumn("_own", F.try_element_at(found, F.lit(-1)))
    out = df.withColumn("_h", F.last("_own", ignorenulls=True).over(S.running(S.local(["page"]))))
    if segmented:
        per = df.groupBy("document_id", "seg").agg(S.last_value(F.col("_own"), ["page"]).alias("_l"))
        w = S.before(Window.partitionBy("document_id").orderBy("seg"))
        out = S.add_carry(out, per.select("document_id", "seg", F.last("_l", ignorenulls=True).over(w).alias("_c"))).withColumn(
            "_h", F.coalesce("_h", "_c")).drop("_c")
    return out.withColumn("heading", F.coalesce("_h", F.lit(default))).drop("_own", "_h")


def fill_empty_document(text: Column, filename: Column) -> Column:
    note = F.concat(F.lit("This document '"), filename, F.lit("' has no extractable text; placeholder chunk."))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", note).otherwise(text)
