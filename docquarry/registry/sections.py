"""Lines to headings, sections and blocks."""
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.scan import with_segments
from docquarry.operators import sections as T
from docquarry.registry.base import PAGE_LINES, lit, pages, query, sql_list, sql_rx


def sql_like(x):
    toks = rf"list_filter(string_split_regex(trim({x}), '\s+'), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))"
    strong = (rf"list_filter({toks}, lambda t: regexp_matches(t, '^\p{{Lu}}') OR regexp_matches(t, '\p{{Nd}}') "
              f"OR lower(trim(t, '()[],:;')) IN {sql_list(V.CONNECTORS)})")
    return (f"(length({x}) BETWEEN {V.HEADING_MIN} AND {V.HEADING_MAX} AND NOT regexp_matches({x}, '[.?!;:]$') AND NOT contains({x}, '....') "
            f"AND NOT contains({x}, ' . . .') AND NOT {sql_rx(x, V.LEADING_LABEL)} AND len({toks}) > 0 "
            f"AND len({strong}) >= {V.HEADING_RATIO} * len({toks}))")


def sql_garbage(t):
    return (rf"({sql_rx(t, V.GARBAGE_TITLES[0])} OR {sql_rx(t, V.GARBAGE_TITLES[1])} OR "
            rf"(NOT regexp_matches({t}, '\S\s+\S') AND regexp_matches({t}, '\p{{Nd}}')))")


def sql_upper(t):
    return rf"(regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '\p{{Ll}}'))"


NUM = f"regexp_extract(line, {lit(V.SECTION_HEADING)}, 1, 'i')"
TITLE = f"trim(regexp_extract(line, {lit(V.SECTION_HEADING)}, 2, 'i'), ' .')"
IDS = f"regexp_extract(line, {lit(V.SECTION_ID)}, 1, 'i')"
SHAPES = f"""{PAGE_LINES},
tt AS (SELECT *, {NUM} AS num, {TITLE} AS htitle, {IDS} AS sid, {sql_like('line')} AS looks FROM tl),
ts AS (SELECT *, CASE WHEN {sql_rx('line', V.TABLE_ROW)} THEN 'table'
  WHEN {sql_rx('line', V.SECTION_HEADING, True)} AND ({sql_rx('line', V.NUMBERED_HEADING, True)} OR {sql_like('htitle')}) AND NOT {sql_garbage('htitle')} THEN 'numbered'
  WHEN {sql_rx('line', V.SECTION_ID, True)} THEN 'id' WHEN looks THEN 'like'
  WHEN {sql_rx('line', V.BULLET_LINE)} THEN 'bullet' ELSE 'text' END AS shape FROM tt)"""
KINDS = f"""{SHAPES},
tp AS (SELECT *, CASE WHEN shape IN ('table', 'numbered', 'id') THEN '' ELSE coalesce(last_value(CASE WHEN shape = 'id' THEN sid WHEN shape != 'table' THEN '' END IGNORE NULLS)
  OVER (PARTITION BY document_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS pending FROM ts),
tk0 AS (SELECT *, CASE WHEN shape = 'table' THEN 'table' WHEN shape = 'numbered' OR (shape = 'like' AND (pending != '' OR NOT {sql_garbage('line')})) THEN 'heading'
  WHEN shape = 'id' THEN 'id' WHEN {sql_rx('line', V.BULLET_LINE)} THEN 'bullet' ELSE 'paragraph' END AS kind FROM tp),
tk AS (SELECT *, CASE WHEN shape = 'numbered' THEN num WHEN kind = 'heading' THEN pending ELSE '' END AS number,
  CASE WHEN shape = 'numbered' THEN htitle WHEN kind = 'heading' THEN trim(line, ' .') ELSE '' END AS title,
  kind = 'paragraph' AND regexp_matches(line, '[.?!]$|\\."$') AND NOT {sql_rx('line', V.LIST_LABEL)} AS ended FROM tk0)"""
REQUESTED = f"""CASE WHEN number != '' THEN greatest(len(list_filter(string_split_regex(number, '[.-]'), lambda p: p != '')), 1)
  WHEN {sql_upper('title')} AND length(title) < 50 THEN 1 ELSE 2 END"""
W = "(PARTITION BY document_id ORDER BY page, line_no, atom"
ATOMS = f"""{KINDS},
atm AS (SELECT document_id, page, line_no, 1 AS atom, kind, line AS text, number, title, ended FROM tk
  UNION ALL SELECT document_id, page, line_no, 0, 'paragraph', pending, '', '', FALSE FROM tk WHERE kind IN ('bullet', 'paragraph') AND pending != ''),
an0 AS (SELECT *, lag(kind) OVER {W}) AS pk, lag(ended) OVER {W}) AS pe, lead(page) OVER {W}) AS np,
  last_value(CASE WHEN kind != 'id' THEN kind END IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
  CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER {W}) AS INT) AS section_seq FROM atm),
an1 AS (SELECT *, CASE WHEN kind IN ('table', 'bullet', 'paragraph') AND (pk IS NULL OR pk != kind OR (kind = 'paragraph' AND pe)) THEN 1 ELSE 0 END AS bs,
  CASE WHEN kind = 'heading' THEN {REQUESTED} - section_seq END AS rel FROM an0),
lastp AS (SELECT document_id, max(page) AS last_page FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, (n - 1) // 6 + 1 AS page FROM raw) GROUP BY 1),
an AS (SELECT *, sum(bs) OVER {W}) AS block_no, sum(CASE WHEN bs = 1 AND (kind != 'paragraph' OR pc IS NULL OR pc != 'paragraph') THEN 1 ELSE 0 END) OVER {W}) AS run_no,
  CASE WHEN kind = 'heading' THEN section_seq + least(0, min(rel) OVER {W})) END AS level,
  CASE WHEN ended THEN page ELSE coalesce(np, last_page) END AS page_end FROM an1 JOIN lastp USING (document_id))"""
N = "length(title)"
UP = sql_upper("title")
CONFIDENCE = rf"""greatest(0, least(100, 50 + CASE WHEN regexp_matches(number, '[.-]') THEN 30 WHEN number != '' THEN 15 ELSE 0 END
  + CASE WHEN {UP} AND {N} < 30 THEN 20 WHEN {UP} THEN 10
    WHEN regexp_matches(title, '^\p{{Lu}}') OR (regexp_matches(title, '[\p{{Lu}}\p{{Ll}}]') AND NOT regexp_matches(title, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(title, '\p{{L}}\p{{Lu}}')) THEN 5 ELSE -25 END
  + CASE WHEN {N} < 3 AND number = '' THEN -30 WHEN {N} < 5 THEN CASE WHEN {UP} THEN 0 ELSE -10 END
    WHEN {N} BETWEEN 10 AND 50 THEN 5 WHEN {N} > 80 THEN -10 ELSE 0 END
  + CASE WHEN level = 1 AND {UP} THEN 5 WHEN level > 1 AND number != '' THEN 5 ELSE 0 END)) / 100.0"""
WS = "(PARTITION BY document_id ORDER BY section_seq)"
TITLES = ", ".join(f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER {WS}" for k in range(1, V.MAX_LEVELS + 1))
HEADINGS = f"""{ATOMS},
hd AS (SELECT document_id, section_seq, level, number AS section_number, title, page,
  array_to_string(list_filter([{TITLES}][:level], lambda t: t IS NOT NULL AND t != ''), ' > ') AS heading_path, {CONFIDENCE} AS heading_confidence
  FROM an WHERE kind = 'heading')"""
BLOCKS = f"""{HEADINGS},
bl AS (SELECT document_id, section_seq, block_no, run_no, CASE kind WHEN 'bullet' THEN 'bullet_group' ELSE kind END AS block_type,
  CASE kind WHEN 'paragraph' THEN string_agg(text, ' ' ORDER BY page, line_no, atom) ELSE string_agg(text, chr(10) ORDER BY page, line_no, atom) END AS text,
  list(text ORDER BY page, line_no, atom) AS lines,
  min(page) AS page_start, arg_max(page_end, [page, line_no, atom]) AS page_end
  FROM an WHERE kind IN ('table', 'bullet', 'paragraph') GROUP BY document_id, section_seq, block_no, run_no, kind)"""
SECTIONS = f"""{BLOCKS},
sp AS (SELECT document_id, section_seq, min(page_start) AS ps, max(greatest(page_start, page_end)) AS pe, min(block_no) AS first_block FROM bl GROUP BY 1, 2),
sec AS (SELECT coalesce(hd.document_id, sp.document_id) AS document_id, coalesce(hd.section_seq, sp.section_seq) AS section_seq, coalesce(level, 0) AS level,
  coalesce(section_number, '') AS section_number, coalesce(title, '') AS title, coalesce(heading_path, '') AS heading_path,
  coalesce(heading_confidence, 1.0) AS heading_confidence, least(page, ps) AS page_start, greatest(page, pe) AS page_end, first_block
  FROM hd FULL OUTER JOIN sp ON hd.document_id = sp.document_id AND hd.section_seq = sp.section_seq)"""


def shaped(spark, sf):
    return T.line_shapes(T.page_lines(with_segments(pages(spark, sf))))


def atoms(spark, sf):
    return T.parse_pages(pages(spark, sf))[0]


@query("t01_line_classifier", f"WITH {KINDS} SELECT document_id, page, line_no, kind FROM tk")
def t01(spark, sf):
    return T.line_kinds(shaped(spark, sf)).select("document_id", "page", "line_no", "kind")


@query("t02_heading_heuristic", f"WITH {PAGE_LINES} SELECT document_id, page, line_no, {sql_like('line')} AS heading_like FROM tl")
def t02(spark, sf):
    return T.page_lines(with_segments(pages(spark, sf))).select("document_id", "page", "line_no", T.heading_like(F.col("line")).alias("heading_like"))


@query("t03_numbered_heading", f"WITH {SHAPES} SELECT document_id, page, line_no, num AS number, htitle AS title FROM ts WHERE shape = 'numbered'")
def t03(spark, sf):
    x = F.col("line")
    return T.page_lines(with_segments(pages(spark, sf))).filter(~x.rlike(T.rx(V.TABLE_ROW)) & T.numbered_heading(x)).select(
        "document_id", "page", "line_no", T.section_number(x).alias("number"), T.section_title(x).alias("title"))


@query("t04_pending_section_id", f"WITH {KINDS} SELECT document_id, page, line_no, pending FROM tk WHERE pending != ''")
def t04(spark, sf):
    return T.line_kinds(shaped(spark, sf)).filter("pending != ''").select("document_id", "page", "line_no", "pending")


@query("t05_requested_level", f"WITH {KINDS} SELECT document_id, page, line_no, {REQUESTED} AS requested FROM tk WHERE kind = 'heading'")
def t05(spark, sf):
    return T.line_kinds(shaped(spark, sf)).filter("kind = 'heading'").select(
        "document_id", "page", "line_no", T.requested_level(F.col("number"), F.col("title")).alias("requested"))


@query("t06_effective_level", f"WITH {HEADINGS} SELECT document_id, section_seq, level FROM hd")
def t06(spark, sf):
    return atoms(spark, sf).filter("kind = 'heading'").select("document_id", "section_seq", "level")


@query("t07_heading_path", f"WITH {HEADINGS} SELECT document_id, section_seq, heading_path FROM hd")
def t07(spark, sf):
    return T.heading_rows(atoms(spark, sf)).select("document_id", "section_seq", F.array_join("heading_path", " > ").alias("heading_path"))


@query("t08_heading_confidence", f"WITH {HEADINGS} SELECT document_id, section_seq, heading_confidence FROM hd")
def t08(spark, sf):
    return T.heading_rows(atoms(spark, sf)).select("document_id", "section_seq", "heading_confidence")


@query("t09_block_segmentation", f"WITH {BLOCKS} SELECT document_id, section_seq, block_no, run_no, block_type, text FROM bl")
def t09(spark, sf):
    return T.block_rows(atoms(spark, sf)).select("document_id", "section_seq", "block_no", "run_no", "block_type", F.array_join("lines", "\n").alias("text"))


@query("t10_block_page_range", f"WITH {BLOCKS} SELECT document_id, block_no, page_start, page_end FROM bl")
def t10(spark, sf):
    return T.block_spans(atoms(spark, sf)).select("document_id", "block_no", "page_start", "page_end")


@query("t11_section_page_range", f"WITH {SECTIONS} SELECT document_id, section_seq, page_start, page_end, first_block FROM sec")
def t11(spark, sf):
    return T.section_rows(atoms(spark, sf)).select("document_id", "section_seq", "page_start", "page_end", "first_block")


@query("t12_preorder_traversal", f"WITH {SECTIONS} SELECT document_id, section_seq AS position, level, section_number, title, heading_path FROM sec")
def t12(spark, sf):
    # reading order is pre-order: a heading comes after its parent and before the next sibling of it
    return T.section_rows(atoms(spark, sf)).select(
        "document_id", F.col("section_seq").alias("position"), "level", "section_number", "title",
        F.array_join("heading_path", " > ").alias("heading_path")).orderBy("document_id", "position")
