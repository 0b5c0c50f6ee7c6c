"""Documents packed into sequences by vector bin packing."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import pick, pieces, texts
from docquarry.llm.registry import query
from docquarry.llm.vocab import word_ids
from docquarry.session import cut, spread

CELL = 4096  # pieces that one task call packs, on average


def fill(sizes: np.ndarray, limits: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every item and its place in it, for items (n x d) under d limits.

    One bin is filled at a time: of the items that still fit, the one whose
    vector has the highest dot product with the bin's residual capacity (both in
    units of the limits) goes in, ties by order; if none fits, the next bin opens."""
    cap = np.asarray(limits, float)
    if (sizes > cap).any():
        raise ValueError("an item is larger than a bin")
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)  # equal items are one choice
    kind = kind.reshape(-1)
    order = np.argsort(kind, kind="stable")
    first = np.searchsorted(kind[order], np.arange(len(kinds)))
    left = np.bincount(kind, minlength=len(kinds))
    unit, taken = kinds / cap, np.zeros(len(kinds), np.int64)
    bins, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    now, at, room = 0, 0, cap.copy()
    alive = np.arange(len(kinds))
    for _ in range(len(sizes)):
        fits = (kinds[alive] <= room).all(1)
        if not fits.any():
            now, at, room = now + 1, 0, cap.copy()
            fits = np.ones(len(alive), bool)
        score = np.where(fits, unit[alive] @ (room / cap), -1.0)
        k = alive[int(score.argmax())]
        item = order[first[k] + taken[k]]
        bins[item], place[item] = now, at
        room -= kinds[k]
        at += 1
        taken[k] += 1
        if taken[k] == left[k]:
            alive = alive[alive != k]
    return bins, place


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, start, length, crc, doc_tokens) of every piece: documents are cut at
    multiples of ``capacity``. The ids themselves stay in the task; crc is the
    CRC-32 of a piece's ids as little-endian unsigned 32-bit numbers."""
    plain = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), *(
        T.StructField(n, T.LongType()) for n in ("start", "length", "crc", "doc_tokens"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(vocabulary)
        tail = [] if end_id is None else [end_id]
        for whole in batches:
            for batch in pieces(whole):
                owner, rows = [], []
                for n, found in enumerate(model.ids(texts(batch["text"]))):
                    ids = np.concatenate([found, np.array(tail, found.dtype)]).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start:start + capacity]
                        owner.append(n)
                        rows.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
                values = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.record_batch([batch["id"].take(pa.array(owner, pa.int64())), *map(pa.array, values.T)], names=schema.names)

    return plain.mapInArrow(run, schema)


def pack(found: DataFrame, capacity: int, max_segments: int, max_loss: int | None = None, loss_col: str | None = None) -> DataFrame:
    """``found`` with sequence_id and offset: pieces (column length) are put into
    sequences of at most ``capacity`` tokens, ``max_segments`` pieces and
    ``max_loss`` loss-bearing tokens (column ``loss_col``; all tokens if None).

    Pieces that fill a sequence stand alone. The others are dealt into cells of
    about ``CELL`` by the hash of their stored row number, whatever their
    document, so no task holds more than a cell, and only the last sequence of
    a cell is short of pieces. No rows give no rows."""
    rows = cut(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    n = rows.filter(~full).count()
    cells = max(1, -(-n // CELL))
    limits = (capacity, max_segments, capacity if max_loss is None else max_loss)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("_row")
        sizes = np.stack([cell["length"], np.ones(len(cell)), cell["loss"]], axis=1).astype(float)
        bins, place = fill(sizes, limits)
        out = pd.DataFrame({"_row": cell["_row"], "sequence_id": cell["cell"].to_numpy(np.int64) * (1 << 32) + bins, "place": place, "length": cell["length"]})
        out = out.sort_values(["sequence_id", "place"])
        out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
        return out[["_row", "sequence_id", "offset"]]

    loss = F.col("length" if loss_col is None else loss_col).alias("loss")
    packed = rows.filter(~full).select("_row", "length", loss, F.pmod(F.xxhash64("_row"), F.lit(cells)).alias("cell")).groupBy("cell").applyInPandas(
        run, "_row long, sequence_id long, offset long")
    # ids of full sequences lie above those of all cells
    alone = rows.filter(full).withColumn("sequence_id", F.lit(1 << 62) + F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    return rows.filter(~full).join(packed, "_row").unionByName(alone).drop("_row")


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, max_segments: int = 256, end_id: int | None = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, crc, doc_tokens, sequence_id, offset.

    Null and empty texts are the end token alone (without one they give no
    piece); very long texts become many full pieces; null ids and repeated rows
    are packed like others; an empty table gives no rows."""
    return pack(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity, max_segments)


def pack_turns(
    turns: DataFrame, vocabulary: str, capacity: int = 2048, max_segments: int = 64, max_loss: int | None = None, learned: tuple[str, ...] = ("assistant",),
    end_id: int | None = 1, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Instruction data: one row per piece of a turn, with id (conv_id, turn, role), loss_tokens and the columns of ``pack_documents``.

    Only turns of the roles ``learned`` bear loss; of these at most ``max_loss`` tokens come into a sequence (half the capacity by default,
    so that a batch's gradient does not hang on a few sequences), besides the limits on tokens and pieces. Pieces are as long as the
    smaller of both limits at most, so each fits. Null roles bear none; other odd inputs are as in ``pack_documents``."""
    max_loss = max_loss or max(1, capacity // 2)
    plain = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    bears = F.coalesce(F.col("role").isin(*learned), F.lit(False))
    named = plain.select(F.struct("conv_id", "turn", "role").alias("id"), "text", bears.alias("bears"))
    found = [token_pieces(named.filter("bears"), vocabulary, min(capacity, max_loss), end_id, "id", "text").withColumn("loss_tokens", F.col("length")),
             token_pieces(named.filter("NOT bears"), vocabulary, capacity, end_id, "id", "text").withColumn("loss_tokens", F.lit(0).cast("long"))]
    return pack(found[0].unionByName(found[1]), capacity, max_segments, max_loss, "loss_tokens")


def op8_columns(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    return op8_columns(pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))
