"""Whitened embeddings, from exact cross-products counted on bit planes."""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import pick
from docquarry.llm.registry import query
from docquarry.session import cut, spread

SCALE, SHIFT = 1024, 100_000  # a vector entry c becomes the integer floor(SCALE * c) + SHIFT
BLOCK = 4096  # rows whose bit planes are in memory together
SAFE = 1 << 62  # integers below it are added as 64 bits, others as Python's

_WHOLE = pa.decimal128(38, 0)
_SUMS = "dims int, d int, n long, s decimal(38,0), lo long, hi long"
_CROSS = "i int, j int, g decimal(38,0)"


def quantised(column: pa.Array, dims: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, row numbers, integers) of the rows of a list column that count, by number of entries.

    A row counts if it is not null, has entries, and none of them is null, not finite or beyond 2^62 / SCALE."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        if size and (dims is None or size == dims):
            at = np.flatnonzero(sizes == size)
            flat = column.take(pa.array(at)).flatten().cast(pa.float64())
            scaled = SCALE * pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
            good = (np.abs(scaled) < SAFE).all(1)  # false for NaN
            yield int(size), at[good], np.floor(scaled[good]).astype(np.int64) + SHIFT


def exact(x: np.ndarray, times: int) -> np.ndarray:
    """The same integers, as Python's where ``times`` of them could leave 64 bits."""
    most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x if most * times < SAFE else x.astype(object)


def _numbers(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _WHOLE)


def ranges(vectors: DataFrame) -> DataFrame:
    """(dims, d, n, s, lo, hi): number, sum, least and greatest of every dimension, by number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            for dims, _, x in quantised(batch["vec"], None):
                if len(x):
                    part = [len(x), exact(x, len(x)).sum(0).astype(object), x.min(0), x.max(0)]
                    old = kept.get(dims)
                    kept[dims] = part if old is None else [
                        old[0] + part[0], old[1] + part[1], np.minimum(old[2], part[2]), np.maximum(old[3], part[3])]
        for dims, (n, s, lo, hi) in kept.items():
            yield pa.record_batch([pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                                   _numbers(s), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["dims", "d", "n", "s", "lo", "hi"])

    return vectors.select("vec").mapInArrow(run, _SUMS).groupBy("dims", "d").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def bit_planes(y: np.ndarray, widths: list[int]) -> np.ndarray:
    """Bit k of dimension d of all rows as one row of 64-bit words; planes follow each other by dimension, then bit."""
    rows = np.zeros((sum(widths), -(-len(y) // 64) * 64), np.uint8)
    at = 0
    for d, width in enumerate(widths):
        rows[at:at + width, :len(y)] = (y[:, d][None, :] >> np.arange(width, dtype=np.uint64)[:, None]) & np.uint64(1)
        at += width
    return np.packbits(rows, axis=1).view(np.uint64)


def cross_products(y: np.ndarray, widths: list[int]) -> np.ndarray:
    """Sums of y_i * y_j over the rows for i <= j, exact: the number of rows in which both bits are set, times the
    weight of both. Only one plane is compared with the others at a time, so memory grows with the planes, not their square."""
    planes, starts = bit_planes(y, widths), np.cumsum([0, *widths])
    wide = 2 * max(widths, default=0) + int(len(y)).bit_length() > 62
    out = np.zeros((len(widths), len(widths)), object)
    weights = np.concatenate([1 << np.arange(w, dtype=object if wide else np.int64) for w in widths]) if len(planes) else np.zeros(0, np.int64)
    for i, width in enumerate(widths):
        others = [j for j in range(i, len(widths)) if widths[j]]
        if not width:
            continue
        total = np.zeros(len(planes) - starts[i], weights.dtype)
        for k in range(width):
            met = np.bitwise_count(planes[starts[i]:] & planes[starts[i] + k]).sum(1, dtype=np.int64)
            total = total + (met.astype(object) if wide else met) * (1 << k)
        out[i, others] = np.add.reduceat(total * weights[starts[i]:], starts[others] - starts[i]).astype(object)
    return out


def scatter(vectors: DataFrame, dims: int, low: list[int], widths: list[int]) -> DataFrame:
    """(i, j, g): sums of the products of dimensions, each counted from its least value; i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total = np.array(low, np.int64), np.zeros((dims, dims), object)
        for batch in batches:
            for _, _, x in quantised(batch["vec"], dims):
                for start in range(0, len(x), BLOCK):
                    total = total + cross_products((x[start:start + BLOCK] - base).view(np.uint64), widths)
        i, j = np.triu_indices(dims)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _numbers(total[i, j])], names=["i", "j", "g"])

    return vectors.select("vec").mapInArrow(run, _CROSS).groupBy("i", "j").agg(F.sum("g").alias("g"))


def eigen(n: int, sums: list[int], cross: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance, falling, unit eigenvectors as columns, and the trace. The centring is done on
    integers, n times the cross-product less the product of the sums; only then a double is made of it."""
    dims = len(sums)
    v = np.zeros((dims, dims))
    for (i, j), g in cross.items():
        v[i, j] = v[j, i] = (n * g - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    return values, axes * np.where(axes[np.abs(axes).argmax(0), np.arange(dims)] < 0, -1.0, 1.0), float(np.trace(v))


def project(vectors: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> DataFrame:
    """(id, deviation, w): exact sum of the squares of n * x - S, and the centred vector times the columns of ``turn``."""
    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("deviation", T.LongType()),
                           T.StructField("w", T.ArrayType(T.DoubleType()))])
    dims, width = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(map(abs, sums))
        base = np.array(sums, np.int64 if most < SAFE else object)
        for batch in batches:
            for _, at, x in quantised(batch["vec"], dims):
                moved = exact(x, 2 * n) * n - base  # |S| is at most n times the greatest |x|
                square = exact(moved, 1)
                far = max(abs(int(moved.min())), abs(int(moved.max()))) if len(x) else 0
                square = ((square if far * far * dims < SAFE else square.astype(object)) ** 2).sum(1)
                w = (moved / n).astype(np.float64) @ turn
                flat = pa.array(w.ravel(), pa.float64())
                yield pa.record_batch(
                    [batch["id"].take(pa.array(at)), pa.array([int(s) if s < 1 << 63 else None for s in square], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), flat)], names=["id", "deviation", "w"])

    return vectors.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, kept: int) -> float | None:
    """Largest absolute entry of the covariance of the first ``kept`` whitened values, as they are, less the identity."""
    if not kept:
        return None
    pairs = [(a, b) for a in range(kept) for b in range(a, kept)]
    got = whitened.select(*[F.col("w")[a].alias(f"w{a}") for a in range(kept)]).agg(
        F.count(F.lit(1)), *[F.sum(f"w{a}") for a in range(kept)], *[F.sum(F.col(f"w{a}") * F.col(f"w{b}")) for a, b in pairs]).first()
    n, means, products = got[0], [s / got[0] for s in got[1:kept + 1]], got[kept + 1:]
    return float(max(abs(p / n - means[a] * means[b] - (a == b)) for (a, b), p in zip(pairs, products)))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Entries become integers. One pass takes the range of every dimension; a second one packs the bits of all
    dimensions, counted from their least value, into words and counts, per pair of bits, the rows that have
    both: their weighted sums are the exact cross-products. The driver receives one number per pair of
    dimensions, whatever the number of rows. The third pass projects; its rows are written once, and the
    identity error is that of the written values.

    Null vectors, vectors with null or non-finite entries, with entries beyond 2^62 / 1024, without entries, or
    with another number of entries than most (the longer one of equals) are left out; repeated rows and null ids
    count and stay. A component without variance has whitened null and explained 0 and is left out of the
    identity error, which is null if no component has any. A deviation beyond 63 bits is null. Without vectors there are no rows."""
    plain = pick(vectors, id=id_col, vec=vector_col)
    found: dict[int, list] = {}
    for r in ranges(plain).collect():
        found.setdefault(r["dims"], []).append(r)
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), *T._parse_datatype_string(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if not found:
        return plain.sparkSession.createDataFrame([], schema)
    dims = max(found, key=lambda d: (found[d][0]["n"], d))
    stats = sorted(found[dims], key=lambda r: r["d"])
    n, sums, low = stats[0]["n"], [int(r["s"]) for r in stats], [r["lo"] for r in stats]
    cross = {(r["i"], r["j"]): int(r["g"]) for r in scatter(
        plain, dims, low, [(r["hi"] - r["lo"]).bit_length() for r in stats]).collect()}
    values, axes, trace = eigen(n, [s - n * b for s, b in zip(sums, low)], cross)
    top = min(components, dims)
    kept = int((values[:top] > trace * dims * np.finfo(float).eps).sum())
    turn = axes[:, :top] * np.array([1 / np.sqrt(e) if k < kept else 0.0 for k, e in enumerate(values[:top])])
    stage = cut(project(plain, n, sums, turn), "whitened")
    error = identity_error(stage, kept)
    share = F.array(*[F.lit(float(e / trace) if k < kept else 0.0) for k, e in enumerate(values[:top])])
    return stage.select("id", "deviation", F.posexplode("w").alias("k", "v")).select(
        "id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("k") < kept, F.col("v")).alias("whitened"), share[F.col("k")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(spread(spark.read.parquet(f"{sf}/embeddings.parquet"))).withColumnRenamed("id", "vec_id")
