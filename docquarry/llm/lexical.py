"""Ranked lexical search over posting lists that are cut into blocks of similar documents."""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import blobs, pick, pieces
from docquarry.llm.registry import query
from docquarry.session import cut, spread

ITEMS, ITEM_BYTES = 512, 1 << 22  # queries that are answered together, and their bytes; more take more passes
SEGMENT = 2048  # documents whose lists are in memory together
CELLS = 1 << 25  # numbers of a segment's table; with many query words segments are smaller
BLOCK = 32  # documents of a block, about; never more than twice as many
SKETCH = 32  # random directions by which documents are compared when a list is cut
SEEDS = 16_384  # documents, about, that give the first bounds
UNIT = 1_000_000_000

#: A-Z as a-z, bytes of terms as they are, all others blank.
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then runs of a-z, 0-9 and all that is not ASCII."""
    return text.translate(_KEEP).split()


def forward(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tf) of every document: all its terms counted, those of ``known`` listed."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for whole in batches:
            for batch in pieces(whole):
                sizes, ids, tf, ends = [], [], [], [0]
                for text in blobs(batch["text"]):
                    words = terms(text)
                    counts = Counter(filter(wanted.__contains__, words))
                    sizes.append(len(words))
                    ids.extend(map(wanted.__getitem__, counts))
                    tf.extend(counts.values())
                    ends.append(len(ids))
                at = pa.array(ends, pa.int32())
                yield pa.record_batch([batch["id"], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                                       pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))], names=["id", "n", "terms", "tf"])

    return docs.mapInArrow(run, schema)


class Segment:
    """Documents as rows of term values, and the posting lists of their terms in blocks.

    A block holds documents of one list that are alike, and its summary the greatest value of every
    coordinate; as weights are not negative, no document of it scores more than the summary does."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int) -> None:
        order = pc.sort_indices(batch["id"], null_placement="at_start")  # places are in the order of ids, which decides ties
        batch = batch.take(order)
        self.ids = batch["id"]
        lists = batch["terms"]
        held = lists.value_lengths().to_numpy()
        flat, tf = lists.flatten().to_numpy(), batch["tf"].flatten().to_numpy().astype(np.int64)
        m = 100 - 25 + 25 * batch["n"].to_numpy() * n_docs // max(n_terms, 1)
        rows = np.repeat(np.arange(batch.num_rows), held)
        self.names, columns = np.unique(flat, return_inverse=True)
        self.values = np.zeros((batch.num_rows, len(self.names)), np.float32)  # integers below 2^24 are exact
        self.values[rows, columns] = UNIT * tf // (1000 * tf + 12 * m[rows])
        self.most = self.values.max(0) if batch.num_rows else np.zeros(len(self.names))
        turn = np.random.default_rng(len(self.names)).choice(np.array([-1, 1], np.float32), (len(self.names), SKETCH))
        sketch = self.values @ turn
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1)

    def blocks(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a posting list, alike ones together, and where its blocks begin."""
        members = np.flatnonzero(self.values[:, column])
        if len(members) <= BLOCK:
            return members, np.zeros(1, np.int64)
        near = (self.sketch[members] @ self.sketch[members[::BLOCK]].T).argmax(1)
        members, near = members[(order := np.argsort(near, kind="stable"))], near[order]
        new = np.flatnonzero(np.diff(near, prepend=-1))
        inside = np.arange(len(members)) - np.repeat(new, np.diff(np.append(new, len(members))))
        return members, np.flatnonzero(inside % (2 * BLOCK) == 0)

    def search(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int, floors: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, scores) of all documents that may be among an item's k best of those above its floor.

        Lists whose terms together cannot reach the floor are left out, then every block whose summary cannot."""
        queries, users = [], {}
        for q, (names, weights) in enumerate(asked):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1) if len(self.names) else names[:0]
            here = self.names[at] == names[:len(at)]
            columns, weights = at[here], weights[:len(at)][here]
            gain = weights * self.most[columns].astype(np.float64)
            rising = np.argsort(gain)
            needed = rising[np.cumsum(gain[rising]) >= floors[q]]
            queries.append((columns, weights))
            for c in columns[needed]:
                users.setdefault(int(c), []).append(q)
        found: dict[int, list] = {}
        for column, items in users.items():
            members, starts = self.blocks(column)
            wide = np.unique(np.concatenate([queries[q][0] for q in items]))
            asking = np.zeros((len(wide), len(items)))
            for j, q in enumerate(items):
                asking[np.searchsorted(wide, queries[q][0]), j] = queries[q][1]
            summary = np.maximum.reduceat(self.values[np.ix_(members, wide)], starts, axis=0)
            bounds = summary.astype(np.float64) @ asking
            ends = np.append(starts[1:], len(members))
            for j, q in enumerate(items):
                for b in np.flatnonzero(bounds[:, j] >= floors[q]):
                    found.setdefault(q, []).append((bounds[b, j], members[starts[b]:ends[b]]))
        for q, some in found.items():
            some.sort(key=lambda x: -x[0])
            limits = np.array([b for b, _ in some])
            first = int(np.searchsorted(np.cumsum([len(x) for _, x in some]), 2 * k)) + 1
            places = np.unique(np.concatenate([x for _, x in some[:first]]))
            scores = self._scores(places, *queries[q])
            floor = max(floors[q], np.partition(scores, -k)[-k]) if len(scores) >= k else floors[q]
            more = [x for limit, (_, x) in zip(limits[first:], some[first:]) if limit >= floor]
            if more:
                rest = np.setdiff1d(np.concatenate(more), places)
                places, scores = np.append(places, rest), np.append(scores, self._scores(rest, *queries[q]))
            good = scores >= floor
            yield q, places[good], scores[good]

    def _scores(self, places: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.values[np.ix_(places, columns)].astype(np.float64) @ weights


def best(index: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], k: int, n_docs: int, n_terms: int, floors: list[int], words: int) -> DataFrame:
    """(item, id, score): the k best documents of every task per item, and of equal scores those of the smallest id."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", index.schema["id"].dataType), T.StructField("score", T.LongType())])
    rows = max(64, min(SEGMENT, CELLS // max(1, words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in asked]
        limits = list(floors)
        kind = None
        for whole in batches:
            kind = whole.schema.field("id").type
            for batch in pieces(whole, rows):
                segment = Segment(batch, n_docs, n_terms)
                for q, places, scores in segment.search(asked, k, limits):
                    names = segment.ids.take(pa.array(places)).to_pylist()
                    kept[q] = heapq.nsmallest(k, [*kept[q], *((-int(s), n is not None, n) for s, n in zip(scores, names))])
                    if len(kept[q]) == k:
                        limits[q] = max(limits[q], -kept[q][-1][0])
        if kind is not None:
            flat = [(q, n, -s) for q, some in enumerate(kept) for s, _, n in some]
            yield pa.record_batch([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], kind),
                                   pa.array([r[2] for r in flat], pa.int64())], names=["item", "id", "score"])

    return index.mapInArrow(run, schema)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """The queries in blocks of bounded number and bytes; the driver holds one block at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and (len(held) >= ITEMS or size + len(row["text"] or b"") > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((row["id"], row["text"] or b""))
        size += len(held[-1][1])
    if held:
        yield held


def _answers(docs: DataFrame, held: list, item_type: T.DataType, k: int) -> DataFrame:
    """(item, rank, id, score) of one block of queries."""
    spark = docs.sparkSession
    counts = [Counter(terms(bytes(text))) for _, text in held]
    known = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    index = cut(forward(docs, known), "terms")
    n_docs, n_terms = index.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row per query term at most
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for w, i in known.items()}
    asked = []
    for c in counts:
        names = np.array(sorted(known[w] for w in c), np.int64)
        by_name = {known[w]: weight[w] * tf for w, tf in c.items()}
        asked.append((names, np.array([by_name[i] for i in names.tolist()], np.float64)))
    # scores are exact in doubles: below 2^53 as long as an item's weights sum up to less than 9e9
    if max((a[1].sum() for a in asked), default=0) * 1e6 >= 2 ** 53:
        raise ValueError("an item has more words than scores can be exact for; split it")
    floors = [1] * len(asked)
    if n_docs > 4 * SEEDS:
        share = F.lit(int(2.0 ** 64 * SEEDS / n_docs) - 2 ** 63).cast("long")
        seeds = best(index.filter(F.xxhash64("id") < share), asked, k, n_docs, n_terms, floors, len(known))
        least = seeds.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("r") == k)
        for r in least.collect():  # one number per query
            floors[r["item"]] = r["score"]
    found = best(index, asked, k, n_docs, n_terms, floors, len(known))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(held)], T.StructType([
        T.StructField("item", T.IntegerType()), T.StructField("name", item_type)]))
    return top.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The k best documents of every item, (item, rank, id, score), all if fewer score above 0.

    Documents become term counts once per block of items, with only the terms that some item has. Every task
    takes its documents in segments: per term a posting list, cut into blocks of similar documents with the
    greatest value of every coordinate as summary. A list or block is skipped if this exact bound is below the
    k-th best score known so far (at first that of a sample of documents), so the result is that of scoring all;
    nothing is shuffled but k rows per task and item.

    Null and empty texts have no terms; items without terms have no rows; repeated documents and items are rows
    of their own, equal scores go by ascending id, nulls first; empty tables give no rows. Very long texts are
    counted whole. An item of some 10^5 words or more, whose scores would not be exact, raises ValueError."""
    plain = pick(docs, id=id_col, text=text_col)
    asked = pick(items, id=item_col, text=item_text_col).withColumn("text", F.col("text").cast("binary"))
    parts = [_answers(plain, held, asked.schema["id"].dataType, k) for held in _item_blocks(asked)]
    if not parts:
        return docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField("item", asked.schema["id"].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField("id", plain.schema["id"].dataType), T.StructField("score", T.LongType())]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS c, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
i AS (SELECT q, item_id, t, count(*) AS reps FROM (SELECT q, item_id, unnest(w) AS t FROM
  (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p, s GROUP BY t),
x AS (SELECT q, item_id, r, doc_id, CAST(sum(reps * wt * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * c) // l)))) AS BIGINT) AS score
  FROM i JOIN p USING (t) JOIN f USING (t), s GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS k FROM x WHERE score > 0) WHERE k <= 20"""


@query("op12_lexical_search", SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = search(spread(spark.read.parquet(f"{sf}/documents.parquet")), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.withColumnRenamed("item", "item_id").withColumnRenamed("id", "doc_id")
