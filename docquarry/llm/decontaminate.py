"""Benchmark passages in documents, found by winnowing."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import blobs, pick, pieces
from docquarry.llm.registry import query
from docquarry.session import cut, spread

WINDOW = 10  # words of a span that must be found
GRAM = 5  # words of a fingerprint; one is kept in every WINDOW - GRAM + 1 grams, so every such span has one
BITMAP = 1 << 24  # bits of the filter that is sent to all tasks: 2 MB, whatever the size of the benchmark
MEMO = 400_000  # hashed words that a Python worker remembers

#: Bytes of words as they are, A-Z as a-z, all others blank.
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then runs of a-z, 0-9 and all that is not ASCII."""
    return text.translate(_KEEP).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n words."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64)
    size = len(hashed) - n + 1
    h = np.full(size, np.uint64(n))
    for k in range(n):
        h = _mix(h * _MIX + hashed[k:k + size])
    return h


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest hash of every window of ``span`` grams, the last one if it stands there twice.
    The choice depends on the window's words only, so two texts with an equal window keep the same place of it."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    back = sliding_window_view(grams[::-1], span).argmin(1)[::-1]  # argmin gives the first of equals: the last in order
    return np.unique(np.arange(len(grams) - span + 1) + span - 1 - back)


class Hasher:
    """XXH64 of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        known = self.known
        for w in set(parts).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        if len(known) > MEMO:
            known.clear()
        return out


HIT = T.ArrayType(T.StructType([
    T.StructField("print", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("at", T.IntegerType()), T.StructField("words", T.ArrayType(T.BinaryType()))]))
_ARROW_HIT = pa.list_(pa.struct([("print", pa.int64()), ("size", pa.int32()), ("start", pa.int64()), ("at", pa.int32()),
                                 ("words", pa.list_(pa.binary()))]))


def marks(parts: list[bytes], hashed: np.ndarray, sizes: dict[int, int], keep) -> list[tuple]:
    """Fingerprints of a text that pass ``keep``: (hash, window size, first word of the context, place of the
    gram in it, words of the context). The context holds every window that contains the gram."""
    out = []
    for size, gram in sizes.items():
        grams = gram_hashes(hashed, gram)
        places = winnow(grams, size - gram + 1)
        for p in places[keep(grams[places])]:
            first = max(0, int(p) - (size - gram))
            out.append((int(grams[p].view(np.int64)), size, first, int(p) - first, parts[first:int(p) + size]))
    return out


def marked(docs: DataFrame, sizes: dict[int, int], bitmap: bytes | None = None, only: int | None = None, **columns: str) -> DataFrame:
    """(id, n_words, hits) of every row. ``bitmap`` leaves out fingerprints that no
    benchmark item has; with ``only`` an item's own size decides (see ``item_size``)."""
    plain = pick(docs, **columns)
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("hits", HIT)])
    shared = plain.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8) if shared is not None else None

        def keep(h: np.ndarray) -> np.ndarray:
            if bits is None:
                return np.ones(len(h), bool)
            slot = h & np.uint64(BITMAP - 1)
            return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        hasher = Hasher()
        for whole in batches:
            for batch in pieces(whole):
                counts, hits = [], []
                for text in blobs(batch["text"]):
                    parts = words(text)
                    mine = sizes if only is None else item_size(len(parts), only)
                    counts.append(len(parts))
                    hits.append([dict(zip(("print", "size", "start", "at", "words"), h)) for h in marks(parts, hasher(parts), mine, keep)])
                yield pa.record_batch([batch["id"], pa.array(counts, pa.int64()), pa.array(hits, _ARROW_HIT)], names=["id", "n_words", "hits"])

    return plain.mapInArrow(run, schema)


def item_size(n: int, window: int = WINDOW) -> dict[int, int]:
    """{window: gram} of an item of n words: a shorter item is one window, found by its own hash."""
    return {} if not n else {window: max(1, window // 2)} if n >= window else {n: n}


def fixed_bitmap(prints: DataFrame) -> bytes:
    """Bits of the low ends of all fingerprints: 512 rows of 4 KB at most, whatever the number of items."""
    low = F.col("print").bitwiseAND(F.lit(BITMAP - 1))
    parts = prints.select(low.alias("slot")).groupBy((F.col("slot") / 32768).cast("int").alias("part")).agg(
        F.expr("bitmap_construct_agg(CAST(slot % 32768 AS BIGINT))").alias("bits")).collect()
    out = bytearray(BITMAP // 8)
    for row in parts:
        out[row["part"] * 4096:(row["part"] + 1) * 4096] = row["bits"]
    return bytes(out)


def contaminated_spans(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> tuple[DataFrame, DataFrame]:
    """Every document row, (row, id, n_words), and the spans of it that a
    benchmark item has: (row, start, size, item), one per window of ``window``
    consecutive words (an item of fewer words is one window).

    Both sides keep the smallest hash of every few grams; equal hashes are joined
    and each hit is extended by comparing the words around it, so a hash never
    decides alone and every shared span is found. Documents send only hashes
    that pass a filter of fixed size. Null and empty texts have no words; items
    without words are left out; repeated rows are rows of their own."""
    listed = cut(marked(items, {}, None, window, id=item_col, text=item_text_col), "items")
    lengths = [r[0] for r in listed.filter("n_words > 0").select(F.least("n_words", F.lit(window)).alias("n")).distinct().collect()]
    sizes = {k: v for n in sorted(lengths) for k, v in item_size(int(n), window).items()}
    theirs = listed.select(F.col("id").alias("item"), F.inline("hits"))
    found = cut(marked(docs, sizes, fixed_bitmap(theirs), id=id_col, text=text_col).withColumn(
        "row", F.monotonically_increasing_id()), "marked")
    ours = found.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    # the same passage in many items or places of one item is one context
    contexts = theirs.groupBy("print", "size", "at", "words").agg(F.collect_set("item").alias("among"))
    met = ours.join(contexts.select("print", "size", F.col("at").alias("_at"), F.col("words").alias("_words"), "among"), ["print", "size"])
    # windows that hold the gram begin up to `at` words before it; all their words must be equal
    begins = F.expr("""filter(sequence(0, least(at, _at)), b -> slice(words, at - b + 1, size) = slice(_words, _at - b + 1, size)
        AND at - b + size <= size(words))""")
    spans = met.select("row", "start", "at", "size", "among", F.explode(begins).alias("b")).select(
        "row", (F.col("start") + F.col("at") - F.col("b")).alias("start"), "size", "among")
    return found.select("row", "id", "n_words"), spans


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit (words inside any found
    window), n_items, items_sha256 (of the ids sorted as strings, with commas),
    contaminated. See ``contaminated_spans`` for odd inputs; an empty benchmark
    leaves every document clean, an empty table gives no rows."""
    rows, spans = contaminated_spans(docs, items, id_col, text_col, item_col, item_text_col, window)
    ends = F.col("start") + F.col("size")
    cover = F.expr("max(end) OVER (PARTITION BY row ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    hit = spans.groupBy("row", "start").agg(F.max(ends).alias("end")).withColumn("covered", F.coalesce(cover, F.col("start"))).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("covered", "start"))).alias("n_hit"))
    named = spans.select("row", F.explode("among").alias("item")).select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return rows.join(hit.join(named, "row"), "row", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
dw AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
m AS (SELECT r, s, dw.k, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""


@query("op10_benchmark_decontamination", SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate(spread(spark.read.parquet(f"{sf}/documents.parquet")), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")
