"""Lines to headings, sections and content blocks.

Pages in, one row per page; everything that runs along a document is a window
inside a segment of pages plus a carry per segment (``functions.scan``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions import scan as S
from docquarry.functions.text import any_of, is_title, is_upper, rx, strip
from docquarry.session import cut

LINE_ORDER = ["page", "line_no"]
ATOM_ORDER = ["page", "line_no", "atom"]


# --- one line -----------------------------------------------------------------
def bare(title: Column) -> Column:
    return F.btrim(title, F.lit(" ."))


def heading_like(x: Column) -> Column:
    """Short, not ended by punctuation, and at least three quarters of its
    words capitalised, numeric or connectors. Words are counted by pattern."""
    edge = r"[()\[\],:;]*"
    words = F.regexp_count(x, F.lit(r"(?U)(?<!\S)\S*?[\p{L}\p{N}]\S*"))
    strong = F.regexp_count(x, F.lit(
        rf"(?U)(?<!\S)(?:\p{{Lu}}\S*|\S*?\p{{Nd}}\S*|{edge}(?i:{any_of(V.CONNECTORS)}){edge})(?!\S)"))
    n = F.length(x)
    return (
        (n >= V.HEADING_MIN) & (n <= V.HEADING_MAX) & ~x.rlike(r"[.?!;:]$") & ~x.contains("....")
        & ~x.contains(" . . .") & ~x.rlike(rx(V.LEADING_LABEL)) & (words > 0)
        & (strong >= V.HEADING_RATIO * words)
    )


def is_garbage(title: Column) -> Column:
    return (
        title.rlike(rx(V.GARBAGE_TITLES[0])) | title.rlike(rx(V.GARBAGE_TITLES[1]))
        | (~title.rlike(r"(?U)\S\s+\S") & title.rlike(r"\p{Nd}"))
    )


def section_number(x: Column) -> Column:
    return F.regexp_extract(x, rx(V.SECTION_HEADING, True), 1)


def section_title(x: Column) -> Column:
    return bare(F.regexp_extract(x, rx(V.SECTION_HEADING, True), 2))


def standalone_id(x: Column) -> Column:
    return F.regexp_extract(x, rx(V.SECTION_ID, True), 1)


def numbered_heading(x: Column) -> Column:
    title = section_title(x)
    return (
        x.rlike(rx(V.SECTION_HEADING, True))
        & (x.rlike(rx(V.NUMBERED_HEADING, True)) | heading_like(title)) & ~is_garbage(title)
    )


def ends_sentence(x: Column) -> Column:
    return (x.rlike(r'[.?!]$|\."$')) & ~x.rlike(rx(V.LIST_LABEL))


def requested_level(number: Column, title: Column) -> Column:
    parts = F.size(F.filter(F.split(number, "[.-]"), lambda p: p != ""))
    return (
        F.when(number != "", F.greatest(parts, F.lit(1)))
        .when(is_upper(title) & (F.length(title) < 50), 1).otherwise(2)
    )


def heading_confidence(number: Column, title: Column, level: Column) -> Column:
    t = strip(title)
    n, upper, numbered = F.length(t), is_upper(t), number != ""
    hundredths = (
        F.lit(50)
        + F.when(number.rlike("[.-]"), 30).when(numbered, 15).otherwise(0)
        + F.when(upper & (n < 30), 20).when(upper, 10)
           .when(is_title(t) | t.rlike(r"^\p{Lu}"), 5).otherwise(-25)
        + F.when((n < 3) & ~numbered, -30).when(n < 5, F.when(upper, 0).otherwise(-10))
           .when((n >= 10) & (n <= 50), 5).when(n > 80, -10).otherwise(0)
        + F.when((level == 1) & upper, 5).when((level > 1) & numbered, 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), hundredths)) / 100.0


# --- lines of a corpus ----------------------------------------------------------
def page_lines(pages: DataFrame) -> DataFrame:
    """One row per non-blank line of cleaned pages (they have no blank lines)."""
    text = F.filter(F.transform(F.split("text", r"\R"), strip), lambda x: x != "")
    return pages.select("document_id", "seg", "page", F.posexplode(text).alias("line_no", "line"))


def line_shapes(lines: DataFrame) -> DataFrame:
    """What a line is by its own text: table, numbered, id, like (a heading by
    looks), bullet or text."""
    x = F.col("line")
    return lines.withColumn("shape", (
        F.when(x.rlike(rx(V.TABLE_ROW)), "table").when(numbered_heading(x), "numbered")
        .when(x.rlike(rx(V.SECTION_ID, True)), "id").when(heading_like(x), "like")
        .when(x.rlike(rx(V.BULLET_LINE)), "bullet").otherwise("text")
    ))


def _previous_id_carry(shaped: DataFrame, source: Column) -> DataFrame:
    per = shaped.groupBy("document_id", "seg").agg(S.last_value(source, LINE_ORDER).alias("_last"))
    w = Window.partitionBy("document_id").orderBy("seg")
    return per.select("document_id", "seg", F.last("_last", ignorenulls=True).over(S.before(w)).alias("_carry"))


def line_kinds(shaped: DataFrame, segmented: bool = False) -> DataFrame:
    """Adds ``kind`` (table, heading, id, bullet, paragraph) with the heading's
    number and title, and ``pending``: the section id on the previous line that
    is not a table row."""
    x, shape = F.col("line"), F.col("shape")
    source = F.when(shape == "id", standalone_id(x)).when(shape != "table", F.lit(""))
    df = shaped.withColumn("_prev", F.last(source, ignorenulls=True).over(S.before(S.local(LINE_ORDER))))
    if segmented:
        df = S.add_carry(df, _previous_id_carry(shaped, source)).withColumn(
            "_prev", F.coalesce("_prev", "_carry")).drop("_carry")
    pending = F.coalesce("_prev", F.lit(""))
    by_looks = (shape == "like") & ((F.col("pending") != "") | ~is_garbage(x))
    kind = (
        F.when(shape == "table", "table").when((shape == "numbered") | by_looks, "heading")
        .when(shape == "id", "id")
        .when((shape == "bullet") | ((shape == "like") & x.rlike(rx(V.BULLET_LINE))), "bullet")
        .otherwise("paragraph")
    )
    return (
        df.withColumn("pending", F.when((shape == "table") | (shape == "numbered") | (shape == "id"), "").otherwise(pending))
        .withColumn("kind", kind)
        .withColumns({
            "number": F.when(shape == "numbered", section_number(x)).when(F.col("kind") == "heading", F.col("pending")).otherwise(""),
            "title": F.when(shape == "numbered", section_title(x)).when(F.col("kind") == "heading", bare(x)).otherwise(""),
        })
        .drop("_prev")
    )


def line_atoms(kinds: DataFrame) -> DataFrame:
    """Content atoms and separators. An id that turned out to prefix ordinary
    text becomes a paragraph atom of its own before that text."""
    def atom(no, kind, text, ended):
        return F.struct(F.lit(no).alias("atom"), kind.alias("kind"), text.alias("text"), ended.alias("ended"))

    kind = F.col("kind")
    own = atom(1, kind, F.col("line"), (kind == "paragraph") & ends_sentence(F.col("line")))
    prefix = atom(0, F.lit("paragraph"), F.col("pending"), F.lit(False))
    prefixed = kind.isin("bullet", "paragraph") & (F.col("pending") != "")
    return kinds.select(
        "document_id", "seg", "page", "line_no", "number", "title",
        F.inline(F.when(prefixed, F.array(prefix, own)).otherwise(F.array(own))),
    )


def _starts(kind, prev_kind, prev_ended, prev_content):
    content = kind.isin("table", "bullet", "paragraph")
    block = content & (prev_kind.isNull() | (prev_kind != kind) | ((kind == "paragraph") & prev_ended))
    run = block & ((kind != "paragraph") | prev_content.isNull() | (prev_content != "paragraph"))
    return block.cast("int"), run.cast("int")


def _atom_carry(a: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per segment: the state in which it starts."""
    is_heading = F.col("kind") == "heading"
    state = F.struct("kind", "ended")
    per = a.groupBy("document_id", "seg").agg(
        S.first_value(F.struct("kind", "page"), ATOM_ORDER).alias("f"),
        S.last_value(state, ATOM_ORDER).alias("l"),
        S.last_value(F.when(F.col("kind") != "id", F.col("kind")), ATOM_ORDER).alias("content"),
        F.sum(is_heading.cast("int")).alias("n"), F.min("_rel").alias("low"),
        F.sum("_block").alias("blocks"), F.sum("_run").alias("runs"),
    )
    last = pages.groupBy("document_id", "seg").agg(F.max("page").alias("p"))
    w = Window.partitionBy("document_id").orderBy("seg")
    prior = lambda c: F.last(c, ignorenulls=True).over(S.before(w))
    total = lambda c: F.coalesce(F.sum(c).over(S.before(w)), F.lit(0))
    df = last.join(per, ["document_id", "seg"], "left").withColumns({
        "last_page": F.max("p").over(Window.partitionBy("document_id")),
        "c_kind": prior("l.kind"), "c_ended": prior("l.ended"), "c_content": prior("content"),
        "c_next": F.first("f.page", ignorenulls=True).over(S.after(w)),
        "c_n": total("n"),
    })
    block, run = _starts(F.col("f.kind"), F.col("c_kind"), F.col("c_ended"), F.col("c_content"))
    df = df.withColumns({
        "c_low": F.min(F.col("low") - F.col("c_n")).over(S.before(w)),
        "f_block": F.coalesce(block, F.lit(0)), "f_run": F.coalesce(run, F.lit(0)),
    })
    return df.select(
        "document_id", "seg", "last_page", "c_next", "c_n", "c_low",
        (F.col("f_block") + total(F.col("f_block") + F.coalesce("blocks", F.lit(0)))).alias("c_block"),
        (F.col("f_run") + total(F.col("f_run") + F.coalesce("runs", F.lit(0)))).alias("c_run"),
    )


def number_atoms(atoms: DataFrame, pages: DataFrame, segmented: bool = False) -> DataFrame:
    """Adds to every atom the section (count of headings so far), the heading's
    level, block and run numbers, and the page on which its block would end.

    The t-th heading has level ``t + min(0, min over s<=t of (requested_s - s))``,
    which is the stack rule ``min(requested, depth)`` in closed form.
    """
    w = S.local(ATOM_ORDER)
    kind = F.col("kind")
    is_heading = kind == "heading"
    a = atoms.withColumns({
        "_pk": F.lag("kind").over(w), "_pe": F.lag("ended").over(w), "_next": F.lead("page").over(w),
        "_pc": F.last(F.when(kind != "id", kind), ignorenulls=True).over(S.before(w)),
        "_n": F.sum(is_heading.cast("int")).over(S.running(w)),
    })
    block, run = _starts(kind, F.col("_pk"), F.col("_pe"), F.col("_pc"))
    inner = F.col("_pk").isNotNull()  # the first atom's own start belongs to the carry
    if segmented:
        # what precedes a segment decides on its first paragraph's run as well
        run = F.when(F.col("_pc").isNull() & (kind == "paragraph") & inner, F.lit(None)).otherwise(run)
    a = a.withColumns({
        "_block": F.when(inner, block).otherwise(0),
        "_run": F.when(inner, run).otherwise(0),
        "_rel": F.when(is_heading, requested_level(F.col("number"), F.col("title")) - F.col("_n")),
    })
    if segmented:
        a = _resolve_open_runs(a)
        carry = _atom_carry(a, pages)
    else:
        first_block, first_run = _starts(kind, F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string"))
        a = a.withColumns({
            "_block": F.when(inner, F.col("_block")).otherwise(first_block),
            "_run": F.when(inner, F.col("_run")).otherwise(first_run),
        })
        carry = pages.groupBy("document_id", "seg").agg(F.max("page").alias("last_page")).withColumns({
            "c_next": F.lit(None).cast("int"), "c_n": F.lit(0), "c_low": F.lit(None).cast("long"),
            "c_block": F.lit(0), "c_run": F.lit(0),
        })
    a = a.withColumns({
        "_low": F.min("_rel").over(S.running(w)),
        "_sb": F.sum("_block").over(S.running(w)), "_sr": F.sum("_run").over(S.running(w)),
    })
    section = F.col("c_n") + F.col("_n")
    low = F.least(F.lit(0), F.col("c_low"), F.col("_low") - F.col("c_n"))
    return S.add_carry(a, carry).select(
        "document_id", "seg", *ATOM_ORDER, "kind", "text", "number", "title",
        section.cast("int").alias("section_seq"),
        F.when(is_heading, section + low).cast("int").alias("level"),
        (F.col("c_block") + F.col("_sb")).cast("int").alias("block_no"),
        (F.col("c_run") + F.col("_sr")).cast("int").alias("run_no"),
        F.when(F.col("ended"), F.col("page")).otherwise(
            F.coalesce("_next", "c_next", "last_page")).cast("int").alias("page_end"),
    )


def _resolve_open_runs(a: DataFrame) -> DataFrame:
    """A segment may open with section ids only; whether the first paragraph
    after them goes on with the run before the segment is known from the last
    content of the earlier segments."""
    per = a.groupBy("document_id", "seg").agg(
        S.last_value(F.when(F.col("kind") != "id", F.col("kind")), ATOM_ORDER).alias("content"))
    w = Window.partitionBy("document_id").orderBy("seg")
    prior = per.select("document_id", "seg", F.last("content", ignorenulls=True).over(S.before(w)).alias("_before"))
    goes_on = F.coalesce(F.col("_before") == "paragraph", F.lit(False))
    return S.add_carry(a, prior).withColumn(
        "_run", F.coalesce("_run", F.when(goes_on, 0).otherwise(1))).drop("_before")


# --- tables of sections and blocks ------------------------------------------------
def heading_rows(atoms: DataFrame, segmented: bool = False) -> DataFrame:
    """Headings with their path and confidence. Levels rise by one at most, so
    the last title on each level up to a heading's own is its path."""
    h = atoms.filter(F.col("kind") == "heading")
    order = ["section_seq"]
    levels = {f"_t{k}": F.when(F.col("level") == k, F.col("title")) for k in range(1, V.MAX_LEVELS + 1)}
    df = h.withColumns({n: F.last(c, ignorenulls=True).over(S.running(S.local(order))) for n, c in levels.items()})
    if segmented:
        per = h.groupBy("document_id", "seg").agg(*[S.last_value(c, order).alias(n) for n, c in levels.items()])
        w = S.before(Window.partitionBy("document_id").orderBy("seg"))
        carry = per.select("document_id", "seg", *[F.last(n, ignorenulls=True).over(w).alias(f"c{n}") for n in levels])
        df = S.add_carry(df, carry).withColumns({n: F.coalesce(n, f"c{n}") for n in levels})
    path = F.filter(F.slice(F.array(*levels), F.lit(1), F.col("level")), lambda t: t.isNotNull() & (t != ""))
    return df.select(
        "document_id", "seg", "section_seq", "level", F.col("number").alias("section_number"), "title",
        path.alias("heading_path"), heading_confidence(F.col("number"), F.col("title"), F.col("level")).alias("heading_confidence"),
        "page",
    )


def block_rows(atoms: DataFrame, bullet_lines: bool = True) -> DataFrame:
    """Content blocks with their lines. A paragraph is one line of text. A
    table and a paragraph are one value each by what they are; a list of bullets
    can be left open (``bullet_lines=False``) where its items are packed apart."""
    item = F.struct(*ATOM_ORDER, "text")
    if not bullet_lines:
        item = F.when(F.col("kind") != "bullet", item)
    lines = F.transform(F.sort_array(F.collect_list(item)), lambda s: s.text)
    return (
        atoms.filter(F.col("kind").isin("table", "bullet", "paragraph"))
        .groupBy("document_id", "section_seq", "block_no", "run_no", "kind")
        .agg(lines.alias("_lines"), F.min("seg").alias("seg"), F.min("page").alias("page_start"),
             F.max_by("page_end", F.struct(*ATOM_ORDER)).alias("page_end"))
        .select(
            "document_id", "seg", "section_seq", "block_no", "run_no",
            F.when(F.col("kind") == "bullet", "bullet_group").otherwise(F.col("kind")).alias("block_type"),
            F.when(F.col("kind") == "paragraph", F.array(F.array_join("_lines", " "))).otherwise(F.col("_lines")).alias("lines"),
            "page_start", "page_end",
        )
    )


def block_spans(atoms: DataFrame) -> DataFrame:
    """Blocks without their lines: partial aggregates only."""
    return (
        atoms.filter(F.col("kind").isin("table", "bullet", "paragraph"))
        .groupBy("document_id", "section_seq", "block_no", "run_no", "kind")
        .agg(F.min("page").alias("page_start"), F.max_by("page_end", F.struct(*ATOM_ORDER)).alias("page_end"))
    )


def section_rows(atoms: DataFrame, segmented: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """Sections in reading order (which is pre-order), with page range and the
    number of their first block. Section 0 is what precedes the first heading.
    ``blocks`` saves counting the blocks again."""
    spans = (block_spans(atoms) if blocks is None else blocks).groupBy("document_id", "section_seq").agg(
        F.min("page_start").alias("_ps"), F.max(F.greatest("page_start", "page_end")).alias("_pe"),
        F.min("block_no").alias("first_block"),
    )
    heads = heading_rows(atoms, segmented).drop("seg")
    return heads.join(spans, ["document_id", "section_seq"], "full_outer").select(
        "document_id", "section_seq", F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("section_number", F.lit("")).alias("section_number"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"),
        F.coalesce("heading_confidence", F.lit(1.0)).alias("heading_confidence"),
        F.least("page", "_ps").alias("page_start"), F.greatest("page", "_pe").alias("page_end"), "first_block",
    )


def parse_pages(
    pages: DataFrame, per_segment: int = S.PAGES_PER_SEGMENT, write_stages: bool = False
) -> tuple[DataFrame, bool]:
    """Cleaned pages (document_id, page, text) to numbered atoms. Returns the
    atoms and whether a document is longer than a segment. Stages are written
    to the shared folder when asked for or when carries make them read twice."""
    pages = S.with_segments(pages, per_segment)
    segmented = S.has_long_documents(pages, per_segment)
    keep = (lambda df, n: cut(df, n)) if (segmented or write_stages) else (lambda df, n: df)
    shaped = line_shapes(page_lines(pages))
    if segmented:
        shaped = keep(shaped, "lines")
    atoms = line_atoms(line_kinds(shaped, segmented))
    if segmented:
        atoms = keep(atoms, "kinds")
    return keep(number_atoms(atoms, pages, segmented), "atoms"), segmented
