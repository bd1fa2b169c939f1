"""Exact deduplication by a stateful stream.

A structured stream feeds ``(digest, stable id, content locator)`` rows into a keyed
aggregate whose state lies on disk (RocksDB, checkpointed in the shared folder) and never
expires. A locator is a file and a row number in it. The state of a digest is the identifier and
locator of the row that stays and the number of rows seen. The bytes of every row that hits an
occupied key, and of the row that stays, are then fetched by their locators and compared in
full; texts that share a digest but not their bytes are grouped by the bytes. The text of a row
that stays goes out once for every GROUP rows of its group, so a large group is compared in many
tasks. Only DataFrame and SQL operations run on the executors.

Rows that don't come straight from Parquet files are written to the shared folder first, as only
files have locators.

Defined results: null text equals empty text; texts are equal when identical after
lower-casing A-Z; the largest id stays, by the order of its type; a null id loses to any other and
stays only where all ids of its text are null; rows that repeat id and text all carry the same
flags in ``classify`` and are reduced to one by ``keep_one``. Empty input gives empty output.
Columns other than id and text are not looked at, whatever their names. Long texts are hashed and
compared whole, in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOOM, fresh, lower_ascii, new_path, settings, stage

#: Rows of a group that are compared with one copy of the text that stays.
GROUP = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves megabytes for its logs
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


PLACE = ["q_file", "q_row"]


def _located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs, from files, and the locator of its rows."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["file_path"], at["row_index"])
    except AnalysisException:
        docs = stage(docs, "dedup-docs")
        at = docs.metadataColumn("_metadata")
    return docs, F.struct(at["file_path"].alias("q_file"), at["row_index"].alias("q_row"))


def _texts(docs: DataFrame, place: Column, id_col: str, text_col: str) -> DataFrame:
    """(q_id, q_text, q_file, q_row, q_at): q_at is a hash of the locator, to join by."""
    rows = docs.select(F.col(id_col).alias("q_id"), F.coalesce(F.col(text_col), F.lit("")).alias("q_text"), place.alias("q_place"))
    return rows.select("q_id", "q_text", "q_place.*").withColumn("q_at", F.xxhash64(*PLACE))


def feed(rows: DataFrame, path: str, checkpoint: str, ledger: str, per_trigger: int) -> None:
    """Runs every file under path through the keyed state once; each micro-batch appends the keys it changed to ledger."""
    spark = rows.sparkSession
    with settings(spark, STATE_CONF):
        seen = (
            spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", str(per_trigger)).parquet(path)
            .groupBy("q_digest")
            .agg(F.max(F.struct("q_id", *PLACE)).alias("top"), F.count(F.lit(1)).alias("q_size"))
        )

        def changed(batch: DataFrame, number: int) -> None:
            batch.select("q_digest", "top", "q_size").write.mode("overwrite").parquet(f"{ledger}/q_batch={number}")

        seen.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(changed).start().awaitTermination()


def _ledger(texts: DataFrame, digest, per_trigger: int) -> tuple[DataFrame, DataFrame]:
    """Rows (q_id, q_digest, q_file, q_row) and the final state (q_digest, top, q_size)."""
    spark = texts.sparkSession
    path, checkpoint, out = (new_path(spark, f"dedup-{x}") for x in ("rows", "state", "ledger"))
    rows = texts.select("q_id", digest(lower_ascii(F.col("q_text"))).alias("q_digest"), *PLACE)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    feed(rows, path, checkpoint, out, per_trigger)
    kinds = f"q_digest string, top struct<q_id: {rows.schema['q_id'].dataType.simpleString()}, q_file: string, q_row: bigint>, q_size bigint, q_batch int"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    states = spark.read.schema(kinds).parquet(out) if there else spark.createDataFrame([], kinds)
    last = states.groupBy("q_digest").agg(F.max(F.struct("q_size", "top")).alias("s")).select("q_digest", "s.top", "s.q_size")
    return rows, stage(last, "dedup-last")


def _is_top(top: str = "top") -> Column:
    return (F.col("q_row") == F.col(f"{top}.q_row")) & (F.col("q_file") == F.col(f"{top}.q_file"))


def _collisions(texts: DataFrame, rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests under which texts of different bytes lie: each hit is compared in full with the row that stays."""
    several = rows.join(state.filter("q_size > 1"), "q_digest").select("q_digest", *PLACE, F.xxhash64(*PLACE).alias("q_at"), _is_top().alias("q_top"), "q_size")
    several = stage(several, "dedup-several").filter("q_size > 1")
    with settings(texts.sparkSession, BLOOM):
        hits = stage(texts.drop("q_id").join(several, ["q_at", *PLACE]).select("q_digest", "q_text", "q_at", "q_top", "q_size"), "dedup-hits")
    parts = F.ceil(F.col("q_size") / GROUP).cast("int")
    stays = hits.filter("q_top").select("q_digest", F.col("q_text").alias("s_text"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("q_part"))
    rest = hits.filter("not q_top").withColumn("q_part", F.pmod("q_at", parts).cast("int")).join(stays, ["q_digest", "q_part"])
    differs = (F.col("q_text") != F.col("s_text")) & (lower_ascii(F.col("q_text")) != lower_ascii(F.col("s_text")))
    return stage(rest.filter(differs).select("q_digest").distinct(), "dedup-collisions")


def _judged(docs: DataFrame, place: Column, id_col: str, text_col: str, digest, per_trigger: int) -> DataFrame:
    """A row for each document: q_id, q_digest, q_file, q_row, top (id and locator of the row that stays), q_size."""
    texts = _texts(docs, place, id_col, text_col)
    rows, state = _ledger(texts, digest, per_trigger)
    mixed = _collisions(texts, rows, state)
    columns = ["q_id", "q_digest", *PLACE, "top", "q_size"]
    out = rows.join(state, "q_digest")
    if mixed.isEmpty():
        return out.select(*columns)
    norm = lower_ascii(F.col("q_text"))
    apart = texts.withColumn("q_digest", digest(norm)).join(mixed, "q_digest").withColumn("q_norm", norm)
    tops = apart.groupBy("q_digest", "q_norm").agg(F.max(F.struct("q_id", *PLACE)).alias("top"), F.count(F.lit(1)).alias("q_size"))
    return out.join(mixed, "q_digest", "left_anti").select(*columns).unionByName(apart.join(tops, ["q_digest", "q_norm"]).select(*columns))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, per_trigger: int = 1 << 29) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_digest."""
    docs, place = _located(docs)
    rows, keep = _judged(docs, place, id_col, text_col, digest, per_trigger), F.col("top.q_id")
    return rows.select(F.col("q_id").alias(id_col), keep.alias("keep_id"), F.col("q_size").alias("group_size"), F.col("q_id").eqNullSafe(keep).alias("kept"), F.col("q_digest").alias("text_digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    columns = docs.columns
    docs, place = _located(docs)
    gone = stage(_judged(docs, place, id_col, text_col, digest, 1 << 29).filter(~_is_top()).select(*PLACE), "dedup-gone")
    name = fresh(docs, "q_place")
    rows, gone = docs.withColumn(name, place), gone.select(F.struct(*PLACE).alias("q_gone"))
    kept = rows.join(gone, rows[name] == gone["q_gone"], "left_anti")
    return kept.select(*[kept[f"`{c}`"] for c in columns])
