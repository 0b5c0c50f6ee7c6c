from pyspark.sql import functions as F

from docquarry.session import fresh_path
from docquarry.streaming import ingest as I


def test_ingest_adds_each_text_once(spark):
    arriving, out, check = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "check")

    def arrive(*rows):
        spark.createDataFrame(list(rows), "document_id string, text string").coalesce(1).write.mode("append").parquet(arriving)

    def run():
        stream = spark.readStream.schema("document_id string, text string").parquet(arriving)
        I.start_ingest(stream, out, check).awaitTermination()

    arrive(("a", "first text"), ("b", "First  TEXT"), ("c", "  "))
    run()
    arrive(("d", "first text"), ("e", "second text"))
    run()
    got = I.read_chunks(spark, out)
    assert sorted(r["document_id"] for r in got.collect()) == ["a", "c", "e"]
    status = {r["document_id"]: r["status"] for r in I.read_status(spark, out).collect()}
    assert status == {"a": "completed", "b": "completed", "c": "completed", "d": "completed", "e": "completed"}
    assert got.select(F.max("batch")).first()[0] == 1
