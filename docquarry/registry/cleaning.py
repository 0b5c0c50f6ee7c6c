"""Line cleaning."""
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions import text as X
from docquarry.registry.base import (NOISY_LINES, lit, noisy, noisy_lines, query, sql_collapse,
                                     sql_list, sql_rx, table)

def lines_where(name, drop, sql_drop):
    @query(name, f"WITH {NOISY_LINES} SELECT doc_id, n, line FROM nl WHERE NOT ({sql_drop})")
    def run(spark, sf):
        return noisy_lines(spark, sf).filter(~drop(F.col("line")))


def lines_to(name, change, sql):
    @query(name, f"WITH {NOISY_LINES} SELECT doc_id, n, {sql} AS line FROM nl")
    def run(spark, sf):
        return noisy_lines(spark, sf).withColumn("line", change(F.col("line")))


@query("c01_line_explode", f"WITH {NOISY_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS line_no, line FROM nl")
def c01(spark, sf):
    return noisy(spark, sf).select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no") + 1)


SQL_HEADER = f"upper(line) IN {sql_list(V.HEADER_LINES)} OR lower(line) IN {sql_list(V.ADMIN_LINES)}"
SQL_DATE, SQL_PAGE = sql_rx("line", V.DATE_LINE, True), sql_rx("line", V.PAGE_LINE, True)
SQL_SEPARATOR = sql_rx("line", V.SEPARATOR_LINE)
SQL_URL = f"regexp_replace(line, {lit(V.URL)}, '', 'g')"


def sql_typography(x):
    x = f"translate({x}, {lit(V.TYPOGRAPHY_FROM)}, {lit(V.TYPOGRAPHY_TO)})"
    for glyph, letters in V.LIGATURES:
        x = f"replace({x}, {lit(glyph)}, {lit(letters)})"
    return x


def sql_bullets(x):
    return rf"regexp_replace({x}, {lit(V.BULLET_GLYPH)}, '\1- ')"


def sql_toc(x):
    return (f"{sql_rx(x, V.TOC_DOTS)} OR {sql_rx(x, V.TOC_SPACED_DOTS)} OR length({x}) - length(replace({x}, '.', '')) > "
            f"{V.TOC_MAX_DOTS} OR {sql_rx(x, V.TOC_ENTRY)}")


def sql_table_row(x):
    cells = f"list_filter(list_transform(string_split_regex(trim({x}), {lit(V.COLUMN_GAP)}), lambda c: trim(c)), lambda c: c != '')"
    return (f"CASE WHEN contains({x}, '  ') AND len({cells}) >= {V.COLUMN_MIN_CELLS} AND len(list_filter({cells}, lambda c: length(c) > "
            f"{V.COLUMN_MAX_CELL})) = 0 THEN concat('| ', array_to_string({cells}, ' | '), ' |') END")


lines_where("c02_header_admin_drop", X.is_header_line, SQL_HEADER)
lines_where("c03_date_line_drop", X.is_date_line, SQL_DATE)
lines_where("c04_page_number_drop", X.is_page_line, SQL_PAGE)
lines_where("c05_separator_drop", X.is_separator_line, SQL_SEPARATOR)
lines_to("c06_url_strip", X.strip_urls, SQL_URL)
lines_to("c07_typography", X.plain_typography, sql_typography("line"))
lines_to("c08_bullet_normalise", X.plain_bullets, sql_bullets("line"))
lines_where("c09_toc_drop", X.is_toc_line, sql_toc("line"))
lines_to("c10_columnar_row", lambda x: F.coalesce(X.table_row(x), x), f"coalesce({sql_table_row('line')}, line)")
lines_to("c11_whitespace_collapse", lambda x: F.when(X.table_row(x).isNull(), X.collapse(x)).otherwise(x),
         f"CASE WHEN {sql_table_row('line')} IS NULL THEN {sql_collapse('line')} ELSE line END")

# lines kept so far, then joined where a word was wrapped
STITCH = """
islands AS (SELECT *, sum(CASE WHEN rn > 1 AND ends_with(prev, '-') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY rn) AS island
  FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY rn) AS prev FROM kept)),
flags AS (SELECT *, coalesce(max(CASE WHEN starts_with(line, '|') OR starts_with(line, '- ') THEN 0 ELSE 1 END) OVER (
  PARTITION BY doc_id, island ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS joins FROM islands),
parts AS (SELECT *, sum(1 - joins) OVER (PARTITION BY doc_id ORDER BY rn) AS grp,
  coalesce(lead(joins) OVER (PARTITION BY doc_id ORDER BY rn), 0) AS next_joins FROM flags),
stitched AS (SELECT doc_id, grp, string_agg(CASE WHEN next_joins = 1 THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY rn) AS line
  FROM parts GROUP BY doc_id, grp)"""
SQL_PLAIN = sql_bullets(sql_typography(SQL_URL))
CLEAN = f"""{NOISY_LINES},
plain AS (SELECT doc_id, n, {SQL_PLAIN} AS x FROM nl WHERE NOT ({SQL_HEADER} OR {SQL_DATE} OR {SQL_PAGE} OR {SQL_SEPARATOR})),
cleaned AS (SELECT doc_id, n, coalesce({sql_table_row('x')}, {sql_collapse('x')}) AS line FROM plain WHERE NOT ({sql_toc('x')})),
kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM cleaned WHERE line != ''), {STITCH}"""


@query("c12_dehyphenation", f"""WITH {NOISY_LINES}, kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM nl),
{STITCH} SELECT doc_id, string_agg(line, chr(10) ORDER BY grp) AS text FROM stitched GROUP BY doc_id""")
def c12(spark, sf):
    df = noisy(spark, sf).select("doc_id", X.join_hyphens(F.array_join(X.lines(F.col("text")), "\n")).alias("text"))
    return df.filter("text != ''")


@query("c13_clean_pages", f"""WITH {CLEAN}, out AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY grp) AS text, count(*) AS lines_after
  FROM stitched GROUP BY doc_id)
SELECT doc_id, coalesce(out.text, '') AS text, len(string_split(noisy.text, chr(10))) AS lines_before, coalesce(lines_after, 0) AS lines_after
FROM noisy LEFT JOIN out USING (doc_id)""")
def c13(spark, sf):
    df = noisy(spark, sf).withColumn("clean", X.clean_text(F.col("text")))
    return df.select("doc_id", F.col("clean").alias("text"), X.line_count(F.col("text")).alias("lines_before"),
                     X.line_count(F.col("clean")).alias("lines_after"))


@query("c14_markdown_table", r"""SELECT conv_id, turn // 50 AS part, concat('| turn | role | text |', chr(10), '| --- | --- | --- |', chr(10),
  string_agg(concat('| ', turn, ' | ', role, ' | ', trim(replace(text, chr(10), ' ')), ' |'), chr(10) ORDER BY turn)) AS markdown
FROM conversations GROUP BY conv_id, turn // 50""")
def c14(spark, sf):
    # one table per fifty turns, so a table's rows are bounded however long the conversation
    cells = F.array(F.col("turn").cast("string"), F.col("role"), F.col("text"))
    per = table(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 50).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", cells.alias("cells")))).alias("r"))
    header = F.array(F.lit("turn"), F.lit("role"), F.lit("text"))
    return per.select("conv_id", "part", X.markdown_table(header, F.col("r.cells")).alias("markdown"))
