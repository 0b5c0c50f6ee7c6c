"""Approximate nearest vectors: coarse cells, of which a query looks into the nearest."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.operators.index import KNN_SCHEMA, SCOPE, SCOPES, first_k, nearest, top_k
from docquarry.session import cut

MAX_CELLS = 4096  # centres go to every task
SAMPLE = 100_000  # vectors, about, from which the centres are made
JUDGES = 200  # queries, about, on which the number of probes is chosen
BLOCK = 16_384  # queries that meet a group of cells in one task, about; the group has twice as many vectors
PIECE = 2048  # vectors and queries whose scores are in memory at a time
RECALL = 0.95


@dataclass(frozen=True)
class VectorIndex:
    """Vectors (chunk_id, scope, embedding, cell) and the centres of the cells."""

    vectors: DataFrame
    centres: np.ndarray


def _scoped(df: DataFrame) -> DataFrame:
    for c in SCOPE:
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    return df.filter(F.col("embedding").isNotNull())


def nearest_cells(embedding: Column, centres: np.ndarray, n: int) -> Column:
    """The ``n`` nearest cells of a vector, nearest first. Unit vectors: the greatest dot product."""
    n = min(n, len(centres))

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got = []
            for start in range(0, len(batch), 1024):
                s = np.stack(batch.iloc[start:start + 1024].to_numpy()).astype(np.float64) @ centres.T
                some = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(s), 1))
                order = np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable")
                got.extend(np.take_along_axis(some, order, 1).astype(np.int32))
            yield pd.Series(got, index=batch.index)

    return find(embedding)


def build_vector_index(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Centres by k-means on a sample of about ``SAMPLE`` vectors, chosen by hash; every vector is then
    put into its nearest cell. The number of cells is the square root of that of the vectors, up to ``MAX_CELLS``."""
    v = _scoped(vectors).select("chunk_id", *SCOPE, "embedding")
    total = v.count()
    if not total:
        return VectorIndex(v.withColumn("cell", F.lit(0)), np.zeros((0, 0)))
    cells = min(MAX_CELLS, cells or max(1, round(total ** 0.5)))
    chosen = v if total <= SAMPLE else v.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(total)) < SAMPLE)
    # placed by a hash and sorted, so that a repeated run has the same sample in the same order
    sample = cut(chosen.select("chunk_id", array_to_vector("embedding").alias("features")).repartition(
        8, "chunk_id").sortWithinPartitions("chunk_id"), "vector-sample")
    model = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(sample)
    centres = np.stack(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return VectorIndex(v.withColumn("cell", nearest_cells(F.col("embedding"), centres, 1)[0]), centres)


def write_vector_index(index: VectorIndex, path: str) -> None:
    """A cell is a folder, so that a search reads only the cells that some query probes."""
    index.vectors.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = index.vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "cell int, centre array<double>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/centres")


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect())  # MAX_CELLS rows
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), np.array([r["centre"] for r in rows]))


def choose_probes(index: VectorIndex, queries: DataFrame, k: int = V.TOP_DENSE, recall: float = RECALL) -> int:
    """The least number of probed cells that finds ``recall`` of the true neighbours of a sample of queries.

    One exact search for about ``JUDGES`` queries; each true neighbour then has a rank, that of its cell among
    the cells of its query, and the wanted number is a quantile of these ranks."""
    asked = _scoped(queries)
    total = asked.count()
    some = asked if total <= JUDGES else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(total)) < JUDGES)
    if not total or not len(index.centres):
        return 1
    order = some.select("query_id", F.posexplode(nearest_cells(F.col("embedding"), index.centres, len(index.centres))).alias("place", "cell"))
    cell_of = index.vectors.select("chunk_id", "cell")
    ranks = nearest(index.vectors, some, k).join(cell_of, "chunk_id").join(order, ["query_id", "cell"]).groupBy("place").count()
    counted = {r["place"]: r["count"] for r in ranks.collect()}  # a row per cell at most
    need, seen = recall * sum(counted.values()), 0
    for place in range(len(index.centres)):
        seen += counted.get(place, 0)
        if seen >= need:
            return place + 1
    return len(index.centres)


def _cells_by_group(cells: Column, first: np.ndarray, last: np.ndarray) -> Column:
    """Array of [group, its cells among ``cells``, ...], one for every group in which one of them has vectors."""
    @F.pandas_udf("array<array<int>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got = []
            for row in batch:
                many = last[row] - first[row] + 1
                cell = np.repeat(row, many)
                group = np.repeat(first[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
                order = np.argsort(group, kind="stable")
                heads, starts = np.unique(group[order], return_index=True)
                got.append([np.concatenate([[g], some]).astype(np.int32) for g, some in zip(heads, np.split(cell[order], starts[1:]))])
            yield pd.Series(got, index=batch.index, dtype=object)

    return split(cells)


def group_scores(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of some vectors for each of some queries, in the query's scope and ``cells`` (null: all).

    Vectors of one cell and scope meet only the queries that ask for both, so no score is computed to be thrown
    away; a query whose k-th best score is beyond the best of a piece is left as it is."""
    vectors = vectors.sort_values("chunk_id", kind="stable")  # a place tells the order of names
    v, q = (np.stack(df["embedding"].to_numpy()).astype(np.float64) for df in (vectors, queries))
    by, any_, wanted = [], [], []
    for c in SCOPE:
        code, names = pd.factorize(vectors[c])
        by.append(code)
        any_.append(queries[c].isna().to_numpy())
        wanted.append(pd.Index(names).get_indexer(queries[c]) if len(names) else np.full(len(queries), -1))
    probing = None
    if queries["cells"].notna().all():
        lists = queries["cells"].to_list()
        flat, rows = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        heads, starts = np.unique(flat[order], return_index=True)
        probing = dict(zip(heads.tolist(), np.split(rows[order], starts[1:])))
        by.append(vectors["cell"].to_numpy())
    kinds, kind = np.unique(np.stack(by, axis=1), axis=0, return_inverse=True)
    members = np.split(np.argsort(kind.ravel(), kind="stable"), np.cumsum(np.bincount(kind.ravel(), minlength=len(kinds)))[:-1])
    top_s, top_p = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    for label, places in zip(kinds, members):
        asking = np.arange(len(queries)) if probing is None else probing.get(int(label[-1]), np.zeros(0, dtype=int))
        for mine, code, free in zip(wanted, label, any_):
            asking = asking[free[asking] | ((mine[asking] == code) & (code >= 0))]
        for at in range(0, len(places), PIECE):
            some = places[at:at + PIECE]
            for start in range(0, len(asking), PIECE):
                rows = asking[start:start + PIECE]
                s = np.round(q[rows] @ v[some].T, 9)
                s[np.isnan(s)] = -np.inf
                best = s.max(axis=1)
                better = (best > -np.inf) & (best >= top_s[rows, -1])
                rows, s = rows[better], s[better]
                keep = first_k(s, k)
                all_s = np.hstack([top_s[rows], np.take_along_axis(s, keep, 1)])
                all_p = np.hstack([top_p[rows], some[keep]])
                order = np.lexsort((all_p, -all_s), axis=1)[:, :k]
                top_s[rows], top_p[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_p, order, 1)
    i, j = np.nonzero(np.isfinite(top_s))
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[i], "chunk_id": vectors["chunk_id"].to_numpy(dtype=object)[top_p[i, j]], "score": top_s[i, j]})


def nearest_in_cells(index: VectorIndex, queries: DataFrame, k: int = V.TOP_DENSE, probes: int | None = None, complete: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank): the nearest of the vectors in the ``probes`` nearest cells, inside each
    query's scope; ``probes`` is chosen for a recall of ``RECALL`` if it is not given.

    Neighbouring cells make groups of about 2 * ``BLOCK`` vectors (a larger cell lies in several), queries make blocks
    of at most about ``BLOCK``; a group and a block are a task, neither passes the driver, so no cell is too large. A query
    goes once to every group that has one of its cells, not once to every cell, and a task sends its k best per query.
    Queries that get less than their scope holds (``complete``) are searched again, exactly."""
    spark = index.vectors.sparkSession
    asked = cut(_scoped(queries).select("query_id", *SCOPE, "embedding"), "probing")
    if not len(index.centres):
        return spark.createDataFrame([], KNN_SCHEMA + ", rank int")
    probes = probes or choose_probes(index, asked, k)
    mine = index.vectors
    if probes < len(index.centres):
        spots = cut(asked.withColumn("cells", nearest_cells(F.col("embedding"), index.centres, probes)), "probes")
        wanted = sorted(r[0] for r in spots.select(F.explode("cells")).distinct().collect())  # at most MAX_CELLS numbers: folders to read
        mine = mine.filter(F.col("cell").isin(wanted)) if len(wanted) < len(index.centres) else mine
    held = np.zeros(len(index.centres), dtype=np.int64)
    for r in mine.groupBy("cell").count().collect():  # at most MAX_CELLS numbers
        held[r["cell"]] = r["count"]
    before, size = np.cumsum(held) - held, 2 * BLOCK
    first, last = before // size, (before + held - 1) // size  # groups of a cell; none without vectors
    last[held == 0] = first[held == 0] - 1
    groups = max(1, -(-int(held.sum()) // size))
    blocks = max(-(-asked.count() // BLOCK), -(-2 * spark.sparkContext.defaultParallelism // groups))
    where = spark.createDataFrame([(i, int(b), int(n)) for i, (b, n) in enumerate(zip(before, held))], "cell int, before long, held long")
    group = F.floor((F.col("before") + F.pmod(F.xxhash64("chunk_id"), F.col("held"))) / size).cast("int")
    left = mine.join(F.broadcast(where), "cell").withColumn("g", group).drop("before", "held").withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if probes < len(index.centres):
        sent = spots.withColumn("c", F.explode(_cells_by_group(F.col("cells"), first, last))).withColumns(
            {"g": F.col("c")[0], "cells": F.slice("c", 2, F.size("c") - 1)}).drop("c")
    else:
        sent = asked.withColumn("cells", F.lit(None).cast("array<int>")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = sent.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def score(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(block):
            return pd.DataFrame({"query_id": np.zeros(0, dtype=np.int64), "chunk_id": np.zeros(0, dtype=object), "score": np.zeros(0)})
        return group_scores(some, block, k)

    tasks = groups * blocks
    a, b = (df.repartition(tasks, "g", "b").groupBy("g", "b") for df in (left, right))
    found = top_k(a.cogroup(b).applyInPandas(score, KNN_SCHEMA), k, [F.desc("score"), F.col("chunk_id")])
    if not complete or probes >= len(index.centres):
        return found
    found = cut(found, "in-cells")
    sizes = index.vectors.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("c")).groupingSets(SCOPES, *SCOPE).agg(F.sum("c").alias("hits"))
    sizes = sizes.groupBy(*SCOPE).agg(F.max("hits").alias("hits"))  # vectors without a scope of their own: any counts
    a, b = asked.alias("a"), sizes.alias("b")
    due = a.join(b, [F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")) for s in SCOPE]).select("a.*", F.least("hits", F.lit(k)).alias("due"))
    short = cut(due.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").filter(
        F.coalesce("n", F.lit(0)) < F.col("due")).drop("due", "n"), "short")
    if short.isEmpty():
        return found
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(nearest(index.vectors, short, k))


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true (query_id, chunk_id) pairs that were found."""
    both = true.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
