"""Arriving documents: generations, restarts and changes."""

from quire.streaming import ingest


def test_generations(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "doc_id long, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.parse_stream(stream, table, checkpoint).awaitTermination()

    arrive([(1, "%lw:p:1\nold\n\n%lw:p:2\nsame"), (2, "%lw:p:1\nother")])
    arrive([(1, "%lw:p:1\nnew\n\n%lw:p:2\nsame\n\nadded")])
    ingest.parse_stream(spark.readStream.schema(schema).parquet(source), table, checkpoint).awaitTermination()
    now = {(r["doc_id"], r["latex"]) for r in ingest.current(spark, table).collect()}
    assert now == {(1, "new"), (1, "same"), (1, "added"), (2, "other")}
    got = {(r["doc_id"], r["label"], r["action"]) for r in ingest.changes(spark, table, 0, 1).collect()}
    assert (1, 1, "replace") in got and (1, 2, "reuse") in got
