"""Files to document and page rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import strip

EVAL_ITEM = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("difficulty", T.StringType()), T.StructField("expected_document", T.StringType()),
    T.StructField("expected_heading", T.StringType()),
    T.StructField("expected_keywords", T.ArrayType(T.StringType())),
    T.StructField("negative_keywords", T.ArrayType(T.StringType())),
])


def name_filter(name: Column, substrings: list[str] | None) -> Column:
    if not substrings:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.lower(name).contains(s.lower()) for s in substrings])


def scan_files(spark: SparkSession, root: str, glob: str = "*", name_contains: list[str] | None = None) -> DataFrame:
    """Every file below ``root``: relative path, name, size, content. The
    content is only read if it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    prefix = F.lit(root.rstrip("/") + "/")
    relative = F.element_at(F.split(F.col("path"), F.concat(F.lit(r"\Q"), prefix, F.lit(r"\E"))), -1)
    return files.select(
        relative.alias("relative_path"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content"
    ).filter(name_filter(F.col("name"), name_contains))


def text_pages(documents: DataFrame, separator: str = "\f", text: str = "text") -> DataFrame:
    """One row per page, from 1. ``separator`` is a pattern."""
    keep = [c for c in documents.columns if c != text]
    return documents.select(*keep, F.posexplode(F.split(text, separator)).alias("_p", "text")).select(
        *keep, (F.col("_p") + 1).alias("page"), "text")


def markdown_pages(documents: DataFrame, separator: str = r"(?m)^---$", text: str = "text") -> DataFrame:
    """Split at rule lines, drop blank pages, number the rest. ``separator="---"``
    also splits inside table rules."""
    keep = [c for c in documents.columns if c != text]
    parts = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    return documents.select(*keep, F.posexplode(parts).alias("_p", "text")).select(
        *keep, (F.col("_p") + 1).alias("page"), "text")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags removed; block tags end lines."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON array file of questions; absent negative keywords are none."""
    df = spark.read.schema(EVAL_ITEM).option("multiLine", True).json(path)
    return df.withColumn("negative_keywords", F.coalesce("negative_keywords", F.array().cast("array<string>")))
