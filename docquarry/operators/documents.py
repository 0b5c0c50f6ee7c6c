"""Operators on documents and pages: repair, ids, duplicates, metadata from paths."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.joins import keep_first
from docquarry.functions.text import any_of, contains_any, fingerprint, rx, strip


# --- pages ------------------------------------------------------------------
def repair_low_text(pages: DataFrame, min_chars: int = V.LOW_TEXT_CHARS) -> DataFrame:
    """A page of little text takes its alternate text if that is strictly longer.
    Adds ``low_text`` and ``ocr_used``."""
    n, m = F.length(strip(F.col("text"))), F.length(strip(F.coalesce("alt_text", F.lit(""))))
    low = n < min_chars
    return pages.withColumns({
        "low_text": low,
        "ocr_used": low & (m > n),
        "text": F.when(low & (m > n), F.col("alt_text")).otherwise(F.col("text")),
    })


def drop_blank_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(strip(F.col("text")) != "")


def flatten_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages with the attributes of their document. The join is left to the
    optimiser: the document table grows with the corpus."""
    return pages.join(documents, "document_id")


# --- duplicates -------------------------------------------------------------
def distinct_files(files: DataFrame, content: str = "content", order: str = "relative_path") -> DataFrame:
    """Byte-identical files: the first in path order stays. Only the path and
    the hash are grouped; the content itself is not shuffled."""
    keyed = files.select(order, F.sha2(F.col(content).cast("binary"), 256).alias("file_hash"))
    return keep_first(keyed, ["file_hash"], [order])


def distinct_first_pages(
    documents: DataFrame, first_page: str = "first_page", content: str = "content",
    order: str = "relative_path", keep_blank: bool = False,
) -> DataFrame:
    """Files whose first page is the same but for case and white space; files
    without pages are compared by bytes. All blank first pages count as one
    unless ``keep_blank``."""
    squeezed = F.lower(F.regexp_replace(F.col(first_page), rx(r"\s+"), ""))
    key = F.when(F.col(first_page).isNotNull(), F.concat(F.lit("t"), F.sha2(squeezed, 256))).otherwise(
        F.concat(F.lit("b"), F.sha2(F.col(content).cast("binary"), 256))
    )
    if keep_blank:
        key = F.when(squeezed == "", F.concat(F.lit("p"), F.col(order))).otherwise(key)
    return keep_first(documents.select(order, key.alias("page_hash")), ["page_hash"], [order])


def distinct_chunks(
    chunks: DataFrame, text: str = "page_content", order: list[str] = ("chunk_index",)
) -> DataFrame:
    """First chunk of every text (case and white space aside)."""
    return keep_first(chunks.withColumn("text_hash", fingerprint(F.col(text))), ["text_hash"], list(order))


def chunk_duplicates(chunks: DataFrame, text: str = "page_content") -> DataFrame:
    """Number of chunks kept and skipped by ``distinct_chunks``."""
    groups = chunks.groupBy(fingerprint(F.col(text)).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("total_chunks"), F.count(F.lit(1)).alias("unique_chunks"),
        F.sum(F.col("n") - 1).alias("skipped_chunks"),
    )


# --- ids and metadata from the path -------------------------------------------
def document_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 16)


def normal_token(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, "[_-]+", " ")))


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def split_compound(parts: Column, prefixes=V.CARRIER_PREFIXES) -> Column:
    """``PREFIX-rest`` or ``PREFIX_rest`` as first folder becomes two folders."""
    pattern = rf"(?i)^({any_of(prefixes)})[-_](.+)$"
    first = F.try_element_at(parts, F.lit(1))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    head = F.array(F.upper(F.regexp_extract(first, pattern, 1)), F.regexp_extract(first, pattern, 2))
    return F.when(first.rlike(pattern), F.concat(head, rest)).otherwise(parts)


def folder_metadata(df: DataFrame, path: str = "relative_path", prefixes=V.CARRIER_PREFIXES) -> DataFrame:
    """Positional metadata: five category levels, their four aliases, hierarchy,
    depth and the document's name."""
    parts = split_compound(folders(F.col(path)), prefixes)

    def level(i):
        return F.try_element_at(F.col("_parts"), F.lit(i))

    return (
        df.withColumn("_parts", parts)
        .withColumns({
            **{f"category_{i}": level(i) for i in range(1, 6)},
            "carrier": F.upper(strip(level(1))),
            "line_of_business": normal_token(level(2)),
            "line_of_business_raw": level(2),
            "product": level(3),
            "sub_product": level(4),
            "folder_hierarchy": F.array_join("_parts", " > "),
            "folder_depth": F.size("_parts"),
            "document_name": stem(F.col(path)),
        })
        .drop("_parts")
    )


def classify(path: Column, word_boundary: bool = False) -> Column:
    """(document_type, document_priority) by the first rule with a keyword in
    the path. Keywords match inside words ("act" in "contract") unless
    ``word_boundary``."""
    text = normal_token(F.replace(path, F.lit("/"), F.lit(" ")))

    def arm(words):
        pattern = any_of(words)
        return text.rlike(rx(rf"\b(?:{pattern})\b") if word_boundary else pattern)

    def value(kind, priority):
        return F.struct(F.lit(kind).alias("document_type"), F.lit(priority).alias("document_priority"))

    kind, priority, words = V.DOCUMENT_TYPES[0]
    rules = reduce(lambda c, r: c.when(arm(r[2]), value(r[0], r[1])), V.DOCUMENT_TYPES[1:],
                   F.when(arm(words), value(kind, priority)))
    return rules.otherwise(value(V.DEFAULT_TYPE, V.DEFAULT_PRIORITY))


def _first_match(text: Column, rules) -> Column:
    (word, name), *rest = rules
    return reduce(lambda c, r: c.when(text.contains(r[0]), r[1]), rest, F.when(text.contains(word), name))


def metadata_by_contains(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """Carrier by substring of the path; line of business by the first folder
    that names one, else by the file's name; product from the third folder or
    the file's name."""
    spaced = lambda c: F.lower(F.translate(c, "_-", "  "))
    parts, name = folders(F.col(path)), F.element_at(F.split(F.col(path), "/"), -1)
    named = F.filter(F.transform(parts, lambda p: _first_match(spaced(p), V.PATH_LOBS)), lambda v: v.isNotNull())
    return df.withColumns({
        "carrier": F.coalesce(_first_match(F.lower(F.col(path)), V.PATH_CARRIERS), F.lit("Other")),
        "line_of_business": F.coalesce(
            F.try_element_at(named, F.lit(1)), _first_match(spaced(name), V.PATH_LOBS), F.lit("Other")),
        "product_name": F.coalesce(
            F.try_element_at(parts, F.lit(3)), strip(F.translate(stem(F.col(path)), "_-", "  "))),
        "full_path_hierarchy": F.array_join(parts, " > "),
    })


def metadata_by_depth(df: DataFrame, path: str = "relative_path") -> DataFrame:
    parts = folders(F.col(path))
    depth, at = F.size(parts), lambda i: F.try_element_at(parts, F.lit(i))
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    (words, kind), *rest = V.NAME_TYPES
    kinds = reduce(lambda c, r: c.when(contains_any(name, r[0]), r[1]), rest, F.when(contains_any(name, words), kind))
    return df.withColumns({
        "carrier": F.when(depth >= 2, at(1)).otherwise("General"),
        "lob": F.when(depth >= 2, at(2)).when(depth == 1, at(1)).otherwise("Other"),
        "scheme_name": F.when(depth >= 3, at(3)),
        "document_type": kinds.otherwise("Document"),
    })


def breakdown(chunks: DataFrame) -> DataFrame:
    """Chunk counts by carrier and by line of business, in one pass."""
    return (
        chunks.groupBy("carrier", "line_of_business").agg(F.count(F.lit(1)).alias("n"))
        .groupingSets([["carrier"], ["line_of_business"]], "carrier", "line_of_business")
        .agg(F.sum("n").alias("chunks"), F.grouping("carrier").alias("_by_lob"))
        .select(
            F.when(F.col("_by_lob") == 1, "line_of_business").otherwise("carrier").alias("dimension"),
            F.when(F.col("_by_lob") == 1, F.col("line_of_business")).otherwise(F.col("carrier")).alias("value"),
            "chunks",
        )
    )
