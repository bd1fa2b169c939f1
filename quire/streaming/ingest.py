"""Incremental parsing of arriving documents, and versions of their block maps.

A stream of (doc_id, text) rows is parsed batch by batch; each batch writes its own folder and
overwrites it if it is run again, so a restart adds no row twice. A document that arrives again
is its next generation: current() gives the rows of the newest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import documents as D


def parse_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Starts parsing what the stream (doc_id, text) brings into table; ends when all that is there is done."""

    def batch(rows: DataFrame, number: int) -> None:
        blocks = D.latex_blocks(rows, ["doc_id"], "text")
        blocks.write.mode("overwrite").parquet(f"{table}/generation={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The blocks of every document's newest generation."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("doc_id").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["doc_id", "generation"])


def changes(spark: SparkSession, table: str, before: int, after: int) -> DataFrame:
    """Block actions from one generation of the documents to a later one."""
    from quire.operators.joins import block_actions

    rows = spark.read.parquet(table).filter("kind <> 'error' and label is not null")
    old = rows.filter(F.col("generation") == before).select("doc_id", "label", "latex", F.col("block_no").alias("source_order"))
    new = rows.filter(F.col("generation") == after).select("doc_id", F.col("block_no").alias("seq"), "label", "latex")
    return block_actions(old, new, ["doc_id"])
