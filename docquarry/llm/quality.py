"""Document quality from positive and unlabelled texts."""
from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import pick, pieces, texts
from docquarry.llm.registry import query
from docquarry.llm.rules import measure
from docquarry.session import cut, spread

MAX_POSITIVES = 20_000  # labelled rows that the model is fitted on, and as many that estimate the prior
THRESHOLD = 0.7
ROUNDS = 14  # Newton steps of a fit; each reads the small table of statistics once
FIRST_RIDGE, RIDGE = 0.3, 1e-4  # from step to step; the last is 1 over the number of positives, where that is more
HALVINGS = 5
_SHARES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6)

#: Statistics of a text and the edges of their bins; a bin holds what is above its edge.
STATISTICS: dict[str, tuple[float, ...]] = {
    "log2_words": (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5, 12.5, 14.5),
    "symbols_per_char": _SHARES,
    "upper_per_char": _SHARES,
    "bangs_per_word": _SHARES,
    "pipes_per_word": _SHARES,
    "repeated_words": _SHARES,
    "repeated_lines": _SHARES,
    "chars_per_word": (1.5, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 14.0),
    "top_word": (0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.12, 0.2, 0.3, 0.5),
    "same_as_before": _SHARES,
    "distinct_words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "digits_per_char": _SHARES,
    "stops_per_word": (0.0, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0),
    "not_ascii": (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "words_per_line": (1.5, 3.0, 6.0, 10.0, 15.0, 20.0, 30.0, 45.0, 70.0, 120.0, 300.0),
}
WIDTHS = [len(e) + 1 for e in STATISTICS.values()]
STARTS = np.concatenate([[0], np.cumsum(WIDTHS)])
SIZE = int(STARTS[-1]) + 1  # one weight a bin, and the constant


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``; an empty text has 0 of everything."""
    n_words, chars, symbols, dup_lines, repeated, n_lines, upper, bangs = measure(text)
    words = text.encode().split()
    counts = Counter(words)
    n, c = max(1, n_words), max(1, chars)
    return [
        float(np.log2(n_words + 1)), symbols / c, upper / c, bangs / n, text.count("|") / n, repeated / n, dup_lines / max(1, n_lines), chars / n,
        max(counts.values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n, len(counts) / n, sum(map(text.count, "0123456789")) / c,
        (text.count(".") + text.count(",")) / n, (0 if text.isascii() else len(text.encode()) - len(text)) / c, n_words / max(1, n_lines),
    ]


def bins(values: np.ndarray) -> np.ndarray:
    """Bin of every statistic (n x 15, small integers)."""
    return np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(map(np.array, STATISTICS.values()))], axis=1).astype(np.int8)


def one_hot(binned: np.ndarray) -> np.ndarray:
    out = np.zeros((len(binned), SIZE), np.float32)
    out[:, -1] = 1
    out[np.arange(len(binned))[:, None], STARTS[:-1] + binned] = 1
    return out


@dataclass
class Model:
    """Weights of the bins, the estimated share of good texts, and what was seen in fitting."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    prior: float = 0.5
    positives: int = 0
    risk: float = 0.0
    corrected: int = 0

    def scores(self, binned: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[:-1][STARTS[:-1] + binned].sum(1) + self.weights[-1], -30, 30)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, key, bins) of every row; null texts are empty. ``id`` may be any
    column, a struct of all of them too; ``key`` finds the row's labels."""
    plain = pick(docs, id=id_col, key=key_col or id_col, text=text_col)
    schema = T.StructType([plain.schema["id"], plain.schema["key"], T.StructField("bins", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                found = bins(np.array([statistics(t) for t in texts(batch["text"])]).reshape(-1, len(STATISTICS)))
                yield pa.record_batch([batch["id"], batch["key"], pa.array([r.tobytes() for r in found], pa.binary())], names=schema.names)

    return plain.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, len(STATISTICS))


def _sums(rows: DataFrame, weights: np.ndarray) -> list[np.ndarray]:
    """Over all rows: their number, softplus(g), sum of sigma(g) x and of sigma(g)(1 - sigma(g)) x x'.
    Every task adds up its rows; tasks' sums are added by Spark in a tree of partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + SIZE + SIZE * SIZE)
        for whole in batches:
            for batch in pieces(whole, 8192):
                x = one_hot(_matrix(batch["bins"]))
                g = x @ weights
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                total += np.concatenate([[len(x), np.logaddexp(0, g).sum()], x.T @ s, ((x * (s * (1 - s))[:, None].astype(np.float32)).T @ x).ravel()])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])

    found = rows.select("bins").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 + SIZE + SIZE * SIZE)
    for at, value in found:
        total[at] = value
    n = max(1.0, total[0])
    return [total[0], total[1] / n, total[2:2 + SIZE] / n, total[2 + SIZE:].reshape(SIZE, SIZE) / n]


def fit(unlabelled: DataFrame, positive: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative unbiased risk of the logistic loss.

    With positives p, unlabelled rows u and class prior c it is
    c E_p[l(g)] + max(0, E_u[l(-g)] - c E_p[l(-g)]). l(g) - l(-g) = -g, so while
    the second part is positive the risk is convex, with the curvature of the
    unlabelled rows alone, and takes Newton steps under a ridge that gets
    weaker with each. A step that makes that part negative is corrected by halving it
    until the part is not negative any more: beyond, the risk only fits noise."""
    x = one_hot(positive)
    mean = x.mean(0).astype(float)
    model = Model(prior=prior, positives=len(x))
    w = np.zeros(SIZE)
    w[-1] = np.log(prior / (1 - prior))
    best, step, scale, ridge = w, np.zeros(SIZE), 1.0, FIRST_RIDGE
    for _ in range(ROUNDS):
        n, soft, slope, curve = _sums(unlabelled, w)
        negative = soft - prior * float(np.logaddexp(0, x @ w).mean())
        if negative < 0:
            model.corrected += 1
            scale /= 2
            if scale < 2.0 ** -HALVINGS:
                break
            w = best + scale * step
            continue
        best, scale = w, min(1.0, 2 * scale)
        model.risk = prior * float(np.logaddexp(0, -(x @ w)).mean()) + negative
        step = -np.linalg.solve(curve + ridge * np.eye(SIZE), slope - prior * mean + ridge * w)
        if np.abs(scale * step).max() < 1e-3:
            break
        w = best + scale * step
        ridge = max(RIDGE, 1 / len(x), ridge / 3)
    model.weights = best
    return model


def estimate_prior(unlabelled: DataFrame, model: Model, positive: np.ndarray, levels: int = 200, error: float = 0.05) -> float:
    """Share of good texts among the unlabelled, from their scores by a model that tells positives from unlabelled.

    At every cut the share of unlabelled rows above it over that of positives
    (which the model was not fitted on) bounds the prior from above; the cut with
    the least bound, confidence terms included, is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(levels, np.int64)
        for whole in batches:
            for batch in pieces(whole, 8192):
                counts += level_counts(_matrix(batch["bins"]))
        yield pa.record_batch([pa.array(np.arange(levels), pa.int32()), pa.array(counts)], names=["level", "n"])

    def level_counts(binned: np.ndarray) -> np.ndarray:
        return np.bincount(np.minimum((model.scores(binned) * levels).astype(int), levels - 1), minlength=levels)

    u = np.zeros(levels)
    for level, n in unlabelled.select("bins").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n")).collect():
        u[level] = n
    p = level_counts(positive)
    above_u, above_p = (np.cumsum(c[::-1])[::-1] / max(1, c.sum()) for c in (u, p))
    slack = np.sqrt(np.log(4 / error) / 2) * (1 / np.sqrt(max(1, u.sum())) + 1 / np.sqrt(max(1, p.sum())))
    usable = above_p > max(slack, 0.05)
    if not usable.any():
        return 0.5
    k = int(np.argmin(np.where(usable, (above_u + slack) / np.maximum(above_p, 1e-9), np.inf)))
    return float(np.clip(above_u[k] / above_p[k], 0.01, 0.99))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def trusted_keys(labels: DataFrame, label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Keys that all their labels call good and that are not held out, with the hash that deals them to the two halves."""
    good = pick(labels, key=label_id_col, good=label_col).groupBy("key").agg(F.min("good").alias("good"))
    return good.filter((F.col("good") == 1) & ~held_out(F.col("key"))).select("key", F.xxhash64(F.lit(1), "key").alias("h"))


def can_learn(keys: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", label_col: str = "quality", key_col: str = "doc_id") -> bool:
    """Whether both halves of the trusted positives, for the weights and for the prior, hold a row of the table."""
    known = trusted_keys(labels, label_id_col, label_col).join(pick(keys, key=key_col), "key", "left_semi")
    return known.select(F.pmod("h", F.lit(2)).alias("half")).distinct().count() == 2


def train(rows: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", label_col: str = "quality", max_positives: int = MAX_POSITIVES) -> Model:
    """Model from ``rows`` (key, bins), all of which are the unlabelled texts, and
    the keys that ``labels`` trusts to be good and that are not held out.

    At most ``max_positives`` of these (the smallest hashes of their keys) fit the
    weights and as many others estimate the class prior; everything else covers
    all rows. Labels of a key that disagree are not trusted. Without positives
    all weights are 0 and every score is 0.5."""
    trusted = rows.select("key", "bins").join(trusted_keys(labels, label_id_col, label_col), "key")
    parts = [_matrix(pa.array([bytes(r[0]) for r in trusted.filter(F.col("h") % 2 == k if k == 0 else F.col("h") % 2 != 0)
                               .orderBy("h", "bins").limit(max_positives).select("bins").collect()], pa.binary())) for k in (0, 1)]
    if not len(parts[0]) or not len(parts[1]):
        return Model()
    first = fit(rows, parts[0], 0.5)
    return fit(rows, parts[0], estimate_prior(rows, first, parts[1]))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality",
    max_positives: int = MAX_POSITIVES, key_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from 0.7).

    Scores depend on the text alone; ``key_col`` (the id by default) finds the labels. Null and empty texts are scored as texts
    with 0 of everything; null ids count as not held out and have no label; repeated rows
    are kept and count as often as they stand; an empty table gives no rows."""
    rows = cut(measured(docs, id_col, text_col, key_col), "quality_bins")
    model = train(rows, labels, label_id_col, label_col, max_positives)
    schema = T.StructType([rows.schema["id"], rows.schema["key"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["id"], batch["key"], pa.array(model.scores(_matrix(batch["bins"])), pa.float64())], names=schema.names)

    scored = rows.mapInArrow(run, schema)
    return scored.select("id", F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = quality_scores(spread(spark.read.parquet(f"{sf}/documents.parquet")), spark.read.parquet(f"{sf}/labels.parquet"))
    return found.withColumnRenamed("id", "doc_id")
