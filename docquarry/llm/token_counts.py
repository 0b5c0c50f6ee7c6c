"""Token counts of whole texts by batch encoding in Arrow functions."""
from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import pick, pieces, texts
from docquarry.llm.registry import query
from docquarry.llm.vocab import counter
from docquarry.session import spread


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20,
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    Only lengths leave the Arrow function. Texts are cut where no token can
    cross (see ``vocab``), so a very long text costs no more memory than others;
    what is not remembered is encoded in batches of ``batch_bytes``. Null and
    empty texts have 0 bytes and 0 tokens; null ids and repeated rows are kept;
    no rows give no rows. ``vocabulary`` is the path of a ``.model`` or ``.json``
    file that every executor can open."""
    plain = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField("id", plain.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    options = {"batch_bytes": batch_bytes} if vocabulary.endswith(".model") else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(vocabulary, **options)
        for whole in batches:
            for batch in pieces(whole):
                size = pc.fill_null(pc.binary_length(batch["text"].cast(pa.binary())), 0).cast(pa.int64())
                yield pa.record_batch([batch["id"], size, pa.array(lengths(texts(batch["text"])), pa.int64())],
                                      names=["id", "n_bytes", "n_tokens"])

    return plain.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


@query("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
