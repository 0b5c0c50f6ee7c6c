"""Column functions on text: trimming, tokens, line cleaning.

Every function takes and returns Columns and works inside one row, so none of
them causes a shuffle. Patterns get ``(?U)`` so that ``\\s \\w \\d \\b`` mean
the Unicode classes.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import fixed as V

# white space as str.strip() understands it
SPACE = "".join(
    chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
LINE_BREAK = r"\R|[\x1c-\x1e]"


def rx(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row. A lambda computes
    an outer expression anew for every element; its own argument it does not."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def any_of(words) -> str:
    """Alternation of literal words, as a pattern."""
    return "|".join("".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in w) for w in words)


def contains_any(c: Column, words) -> Column:
    return c.rlike(any_of(words))


def holds_any(c: Column, words) -> Column:
    """As ``contains_any``, by plain search of each word: faster on long texts."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return strip(F.regexp_replace(c, rx(r"\s+"), " "))


def tokens(c: Column) -> Column:
    """Lower-case words of three or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(V.TOKEN), F.lit(0))


def fingerprint(c: Column) -> Column:
    """Hash of the text with case and white space normalised."""
    return F.sha2(collapse(F.lower(c)), 256)


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def is_title(c: Column) -> Column:
    return c.rlike(r"[\p{Lu}\p{Ll}]") & ~c.rlike(r"(^|[^\p{L}])\p{Ll}") & ~c.rlike(r"\p{L}\p{Lu}")


# --- lines ------------------------------------------------------------------
def lines(text: Column) -> Column:
    """Trimmed, non-blank lines."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def is_header_line(x: Column) -> Column:
    return F.upper(x).isin(*V.HEADER_LINES) | F.lower(x).isin(*V.ADMIN_LINES)


def is_date_line(x: Column) -> Column:
    return x.rlike(rx(V.DATE_LINE, True))


def is_page_line(x: Column) -> Column:
    return x.rlike(rx(V.PAGE_LINE, True))


def is_separator_line(x: Column) -> Column:
    return x.rlike(V.SEPARATOR_LINE)


def strip_urls(x: Column) -> Column:
    return F.regexp_replace(x, rx(V.URL), "")


def plain_typography(x: Column) -> Column:
    x = F.translate(x, V.TYPOGRAPHY_FROM, V.TYPOGRAPHY_TO)
    for glyph, letters in V.LIGATURES:
        x = F.replace(x, F.lit(glyph), F.lit(letters))
    return x


def plain_bullets(x: Column) -> Column:
    return F.regexp_replace(x, rx(V.BULLET_GLYPH), "$1- ")


def is_toc_line(x: Column) -> Column:
    return (
        x.rlike(V.TOC_DOTS)
        | x.rlike(rx(V.TOC_SPACED_DOTS))
        | (F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))) > V.TOC_MAX_DOTS)
        | x.rlike(rx(V.TOC_ENTRY))
    )


def table_row(x: Column) -> Column:
    """Markdown row for a line of three or more short columns, else null."""
    cells = F.filter(F.transform(F.split(strip(x), V.COLUMN_GAP), strip), lambda c: c != "")
    good = (F.size(cells) >= V.COLUMN_MIN_CELLS) & ~F.exists(
        cells, lambda c: F.length(c) > V.COLUMN_MAX_CELL
    )
    return F.when(
        x.contains("  ") & good, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    )


def join_hyphens(text: Column) -> Column:
    """Undo word wraps at line ends. A group whose first line is a table row or
    a bullet is left alone; ``\\G`` lets a group go on past its first line."""
    return F.regexp_replace(text, r"(?md)(?:^(?!\||- )|\G(?!\A))([^\n]*)-\n", "$1")


def clean_lines(text: Column) -> Column:
    """All line rules but the de-hyphenation, as an array of lines."""
    kept = F.filter(
        lines(text),
        lambda x: ~(is_header_line(x) | is_date_line(x) | is_page_line(x) | is_separator_line(x)),
    )
    plain = F.transform(kept, lambda x: plain_bullets(plain_typography(strip_urls(x))))
    body = F.filter(plain, lambda x: ~is_toc_line(x))
    return F.filter(
        F.transform(body, lambda x: F.coalesce(table_row(x), collapse(x))), lambda x: x != ""
    )


def clean_text(text: Column) -> Column:
    return join_hyphens(F.array_join(clean_lines(F.coalesce(text, F.lit(""))), "\n"))


def line_count(text: Column) -> Column:
    """As str.splitlines() counts: a final break opens no further line."""
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, LINE_BREAK)))


def markdown_table(header: Column, rows: Column) -> Column:
    """Array of cells and array of cell arrays to a markdown table; null when
    every cell is blank."""
    def cell(x):
        return strip(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))

    def row(cells):
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit("---")), " | "), F.lit(" |"))
    filled = F.exists(F.flatten(F.concat(F.array(header), rows)), lambda x: cell(x) != "")
    return F.when(filled, F.array_join(F.concat(F.array(row(header), rule), F.transform(rows, row)), "\n"))
