"""Quality rules whose cutoffs are certified on labelled documents."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import pick, pieces, texts
from docquarry.llm.registry import query
from docquarry.session import cut, spread

WINDOW = 5  # words of a repeated window
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")

#: rule -> (statistic of a document, cutoffs from the mildest to the strictest); a document above the cutoff is rejected
RULES = {
    "symbols": ("n_symbols / nullif(word_chars, 0)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines / nullif(n_lines, 0)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "upper": ("n_upper / nullif(word_chars, 0)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "bangs": ("n_bangs / nullif(n_words, 0)", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "long_words": ("word_chars / nullif(n_words, 0)", (100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0)),
    "short_words": ("n_words / nullif(word_chars, 0)", (1.0, 0.7, 0.5, 0.4, 0.35, 0.33, 0.3, 0.28)),
}
STEPS = 8  # from the mildest to the tuned cutoffs
MAX_STRATA = 10_000  # rows of the certificate; a stratum is a language, not a document


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that stand in a window of ``size`` words found at least twice.

    Windows are sorted by a hash; windows with equal hashes are compared by
    their words, and a text in which two differ is counted by a dictionary."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for k in range(size):
        window = (window ^ (window >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n, bool)
    pairs = np.flatnonzero(same)
    if all(words[i:i + size] == words[j:j + size] for i, j in zip(order[pairs].tolist(), order[pairs + 1].tolist())):
        twice[order[pairs]] = twice[order[pairs + 1]] = True
    else:
        seen: dict[tuple, int] = {}
        keys = [tuple(words[i:i + size]) for i in range(n)]
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        twice = np.array([seen[key] > 1 for key in keys])
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), upper, text.count("!"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """id, stratum (null: empty) and the counts of every row; null texts are empty."""
    plain = pick(docs, id=id_col, text=text_col, **({"stratum": stratum_col} if stratum_col else {}))
    plain = plain.withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit("")) if stratum_col else F.lit(""))
    schema = T.StructType([plain.schema["id"], plain.schema["stratum"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                rows = np.array([measure(t) for t in texts(batch["text"])], np.int64).reshape(-1, len(COUNTS))
                yield pa.record_batch([batch["id"], batch["stratum"], *map(pa.array, rows.T)], names=schema.names)

    return plain.mapInArrow(run, schema)


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def upper_tail_ok(rejected: int, n: int, rate: float, level: float) -> bool:
    """Is P(X <= rejected) <= level for X ~ Binomial(n, rate)? Then the exact
    (Clopper-Pearson) upper bound of the rejection rate is at most ``rate``."""
    if n <= 0 or rejected >= n:
        return False
    i = np.arange(rejected, dtype=float)
    log_pmf = n * math.log1p(-rate) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(rate) - math.log1p(-rate))])
    top = log_pmf.max()
    return bool(top + math.log(np.exp(log_pmf - top).sum()) <= math.log(level))


def certify(
    counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, confidence: float = 0.95,
) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}}: cutoffs that together reject at most ``risk``
    of a stratum's good documents, in all strata at once with ``confidence``.

    Labelled good documents that pass the base rules are split by the hash of
    their id. A quarter tunes: each rule's end point is its strictest cutoff
    that rejects at most a tenth of the risk there. The others are the holdout:
    all rules move together from their mildest cutoffs to their end points in
    ``STEPS`` steps, a stratum's steps are tested in order, and the last one
    before the first failure holds (fixed sequence, each step at the full
    level). The exact upper bound of a step's joint rejection rate must be at
    most ``risk`` at level (1 - confidence) / strata (Bonferroni). A stratum with
    too few labels gets no cutoff, and its documents are kept. Labels of an id
    that disagree make it not good."""
    good = pick(labels, id=id_col, good=label_col).groupBy("id").agg(F.min("good").alias("good")).filter("good = 1").select("id")
    held = counts.filter(f"NOT ({BASE_FAILED})").join(good, "id", "left_semi").withColumn(
        "tunes", F.crc32(F.col("id").cast("string").cast("binary")) % 8 < 2)

    def share(condition: str):
        return F.sum(F.expr(condition).cast("long"))

    over = [share(f"{stat} > {c}").alias(f"{rule}_{k}") for rule, (stat, cuts) in RULES.items() for k, c in enumerate(cuts)]
    tuned = held.filter("tunes").agg(F.count(F.lit(1)).alias("n"), *over).first()
    ends = {}
    for rule, (_, cuts) in RULES.items():
        fine = [k for k in range(len(cuts)) if (tuned[f"{rule}_{k}"] or 0) <= risk / 10 * tuned["n"]]
        if fine and tuned["n"]:
            ends[rule] = fine[-1]
    path = [{rule: RULES[rule][1][end * step // (STEPS - 1)] for rule, end in ends.items()} for step in range(STEPS)]
    joint = [share(" OR ".join(f"coalesce({RULES[r][0]} > {c}, false)" for r, c in at.items()) or "false").alias(f"step_{k}") for k, at in enumerate(path)]
    rows = held.filter("NOT tunes").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *joint).limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    chosen: dict[str, dict[str, float]] = {}
    for row in rows:
        for k, at in enumerate(path):
            if not upper_tail_ok(row[f"step_{k}"], row["n"], risk, (1 - confidence) / len(rows)):
                break
            chosen[row["stratum"]] = at
    return chosen


def apply_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang",
    label_id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, confidence: float = 0.95,
) -> DataFrame:
    """One row per input row: id, stratum, the counts, base_failed, kept, and the first rule that rejects it.

    Null and empty texts have no words and fail the base rules; null strata are
    one stratum; null ids have no label; repeated rows are kept apart; an empty
    table gives no rows, empty labels leave the base rules alone."""
    counts = cut(measured(docs, id_col, text_col, stratum_col), "rule_counts")
    chosen = certify(counts, labels, label_id_col, label_col, risk, confidence)
    spark = docs.sparkSession
    names = list(RULES)
    limits = spark.createDataFrame([(s, *(c.get(r) for r in names)) for s, c in chosen.items()], "stratum string, " + ", ".join(f"_{r} double" for r in names))
    rejected = F.coalesce(*[F.when(F.expr(f"{RULES[r][0]} > _{r}"), F.lit(r)) for r in names])
    # at most MAX_STRATA rows
    joined = counts.join(F.broadcast(limits), "stratum", "left").withColumn("base_failed", F.expr(BASE_FAILED)).withColumn(
        "rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(rejected))
    return joined.select("id", "stratum", *COUNTS, "base_failed", F.isnull("rule").alias("kept"), "rule")


@query("op5_quality_rules")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = apply_rules(spread(spark.read.parquet(f"{sf}/documents.parquet")), spark.read.parquet(f"{sf}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), *COUNTS[:5], "base_failed", "kept", "stratum", "rule")
