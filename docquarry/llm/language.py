"""Language of texts, by n-gram filters that answer for all languages at once."""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import pick, pieces, texts
from docquarry.llm.registry import query
from docquarry.session import cut, discard, spread

SIZES = (3, 4)  # characters of an n-gram; blanks only at its ends
SLOTS = 1 << 20  # rows of the filters
HASHES = 3
MAX_TEXTS = 8000  # texts per language, about, from which n-grams are learned
MAX_LANGUAGES = 1024  # the most frequent ones are learned
LEAST, NEAR = 2, 0.5  # a language has an n-gram that it shows twice, and half as often as the language that shows it most
PART = 1 << 20  # characters that are looked at together
UNKNOWN = "und"

_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def ngrams(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size, (hashes, ends): of all n-grams of the texts, one after the other, and where those of each text end.

    All that is not a letter is a blank; n-grams have letters in the middle and letters or blanks at the ends."""
    low = [p.lower() for p in parts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    stops = np.cumsum([len(p) + 1 for p in low])
    for size in SIZES:
        inner = letter[1:len(letter) - size + 2].copy()
        for k in range(2, size - 1):
            inner &= letter[k:len(letter) - size + 1 + k]
        at = np.flatnonzero(inner)
        h = np.full(len(at), np.uint64(size))
        for k in range(size):
            h = h * _ODD + codes[at + k]
        yield _mix(h), np.searchsorted(at + 1, stops)


def _units(batch: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows and texts of bounded size together; longer texts come in several parts, cut every half PART."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(batch):
        for start in range(0, len(text), PART // 2):
            rows.append(row)
            parts.append(text[start:start + PART // 2])
            size += len(parts[-1]) + 1
            if size >= PART:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), parts


def held_out(key: Column) -> Column:
    """Rows that are not learned from; a null key is none of them."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def ngram_counts(sample: DataFrame) -> DataFrame:
    """(gram, lang, n) of a table (lang, text), lang being a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                of = batch["lang"].to_numpy()
                for rows, parts in _units(texts(batch["text"])):
                    for grams, ends in ngrams(parts):
                        lang = np.repeat(of[rows], np.diff(ends, prepend=0))
                        for one in np.unique(lang):
                            seen, n = np.unique(grams[lang == one], return_counts=True)
                            yield pa.record_batch([pa.array(seen.view(np.int64)), pa.array(np.full(len(seen), one, np.int32)),
                                                   pa.array(n, pa.int64())], names=["gram", "lang", "n"])

    return sample.mapInArrow(run, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


class Filters:
    """Bloom filters of all languages, sliced by bit: a row holds one bit per language, so the rows of an n-gram's
    places, ANDed, are the set of all languages that have it (and few others, whose share is known)."""

    def __init__(self, names: list[str], slots: np.ndarray, words: np.ndarray, masks: np.ndarray) -> None:
        self.names = names
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(names) <= n)
        self.rows = np.zeros((max(1, -(-len(names) // 64)), SLOTS), kind)
        self.rows[words, slots] = masks.view(np.uint64).astype(kind)
        fill = np.array([np.count_nonzero(self._bit(self.rows[k // 64], k)) / SLOTS for k in range(len(names))])
        self.false = fill ** HASHES  # chance that an n-gram no language showed passes

    @staticmethod
    def _bit(masks: np.ndarray, lang: int) -> np.ndarray:
        return (masks >> masks.dtype.type(lang % 64)) & masks.dtype.type(1)

    def count(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of every text, and per language those that its filter passes."""
        total, hits = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(self.names)), np.int64)
        for rows, parts in _units(batch):
            for grams, ends in ngrams(parts):
                begins = np.append(0, ends[:-1])
                np.add.at(total, rows, ends - begins)
                places = [(grams >> np.uint64(20 * k)).astype(np.int64) & (SLOTS - 1) for k in range(HASHES)]
                for w, table in enumerate(self.rows):
                    masks = table[places[0]]
                    for p in places[1:]:
                        masks &= table[p]
                    for k in range(64 * w, min(64 * w + 64, len(self.names))):
                        sums = np.append(0, np.cumsum(self._bit(masks, k), dtype=np.int64))
                        np.add.at(hits[:, k], rows, sums[ends] - sums[begins])
        return total, hits

    def decide(self, total: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language with most n-grams, and its share. Of n n-grams that a language lacks, n * false
        pass its filter all the same; these are taken off. The first of equal languages is taken."""
        found = np.maximum(0, (hits - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9))
        best = found.argmax(1)
        return best, found[np.arange(len(found)), best] / np.maximum(found.sum(1), 1e-300)


def train(docs: DataFrame) -> Filters:
    """Filters from a table (id, text, lang) without the rows held out and those of unknown language."""
    known = docs.filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    names = [r["lang"] for r in counts]  # the most frequent first: it decides where nothing else does
    limit = [(k, r["lang"], int(2.0 ** 64 * min(1.0, MAX_TEXTS / r["count"]) - 2 ** 63) if r["count"] > MAX_TEXTS else 2 ** 63 - 1)
             for k, r in enumerate(counts)]
    chosen = docs.sparkSession.createDataFrame(limit, T.StructType([
        T.StructField("k", T.IntegerType()), T.StructField("lang", docs.schema["lang"].dataType), T.StructField("limit", T.LongType())]))
    sample = known.join(F.broadcast(chosen), "lang").filter(F.xxhash64("id") <= F.col("limit")).select(F.col("k").alias("lang"), "text")
    grams = cut(ngram_counts(sample), "ngrams")
    sizes = F.broadcast(grams.groupBy("lang").agg(F.sum("n").alias("all")))
    rated = grams.filter(F.col("n") >= LEAST).join(sizes, "lang").withColumn("rate", F.col("n") / F.col("all"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("by"))
    member = most.select("gram", "top", F.inline("by")).filter(F.col("rate") >= NEAR * F.col("top"))
    places = F.array(*[F.shiftrightunsigned("gram", 20 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)])
    rows = member.select(F.explode(places).alias("slot"), F.floor(F.col("lang") / 64).cast("int").alias("word"),
                         F.expr("shiftleft(1L, lang % 64)").alias("bit")).groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toArrow()
    discard(grams)  # the filters are all that is needed of it
    return Filters(names, *(rows[c].to_numpy() for c in ("slot", "word", "mask")))


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", key_col: str | None = None) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (share of the language among the n-grams found, 0 to 1).

    Learns from a sample of the rows that are not held out (crc32 of the key mod 4 is not 2), about ``MAX_TEXTS``
    of each language chosen by hash, the ``MAX_LANGUAGES`` most frequent ones. The filters have ``SLOTS`` rows of
    one bit per language, so what is sent to the tasks does not grow with the data. Whole texts are scored.

    Null texts and texts without a letter are ``und`` with score 0, as are all if there is nothing to learn from.
    Texts of which no n-gram is known get the most frequent language with score 0. Rows with null key are
    neither learned from nor held out; repeated rows and null languages stay; no rows give no rows."""
    plain = pick(docs, id=id_col, text=text_col)
    learn = pick(docs, id=key_col or id_col, text=text_col, lang=lang_col)
    filters = train(learn)
    shared = plain.sparkSession.sparkContext.broadcast(filters)  # SLOTS rows
    keyed = pick(docs, id=id_col, key=key_col or id_col, text=text_col).select("id", "text", held_out(F.col("key")).alias("held_out"))
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in pieces(whole):
                some = batch.num_rows
                total, hits = model.count(texts(batch["text"]))
                names, score = [UNKNOWN] * some, np.zeros(some)
                if model.names:
                    best, share = model.decide(total, hits)
                    names = [str(model.names[b]) if n else UNKNOWN for b, n in zip(best, total)]
                    score = np.where(total > 0, share, 0.0)
                yield pa.record_batch([batch["id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                      names=["id", "held_out", "lang_pred", "score"])

    return keyed.mapInArrow(run, schema)


@query("op11_language_id")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return predict_language(spread(spark.read.parquet(f"{sf}/documents.parquet"))).withColumnRenamed("id", "doc_id")
