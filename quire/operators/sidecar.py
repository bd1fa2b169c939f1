"""What LaTeX can't hold, kept beside it: a content-addressed store, and its pieces matched to blocks again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import nearest


def store(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects (.., sha256, payload) to payloads (sha256, payload, size), each once, and attachments, that is the rest."""
    payloads = objects.groupBy("sha256").agg(F.min("payload").alias("payload")).withColumn("size", F.octet_length("payload"))
    return payloads, objects.drop("payload")


def manifest(attachments: DataFrame, keys: list[str], source: str) -> DataFrame:
    """manifest: one JSON object a document with version, source hash and attachments in order."""
    names = [c for c in attachments.columns if c not in (*keys, source)]
    each = attachments.groupBy(*keys, source).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("attachments"))
    return each.select(*keys, F.to_json(F.struct(F.lit(1).alias("version"), F.col(source).alias("source_sha256"), "attachments")).alias("manifest"))


def load_manifest(manifests: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Attachments of manifests of this version. schema: the attachments' columns."""
    parsed = manifests.select(*keys, F.from_json("manifest", f"version int, source_sha256 string, attachments array<struct<{schema}>>").alias("m"))
    return parsed.filter("m.version = 1").select(*keys, "m.source_sha256", F.explode("m.attachments").alias("a")).select(*keys, "source_sha256", "a.*")


def manifest_issues(attachments: DataFrame, payloads: DataFrame) -> DataFrame:
    """(sha256, code): attachments without a payload, payloads nothing refers to, payloads whose bytes have another hash."""
    lost = attachments.select("sha256").distinct().join(payloads, "sha256", "left_anti").select("sha256", F.lit("missing-payload").alias("code"))
    idle = payloads.join(attachments.select("sha256").distinct(), "sha256", "left_anti").select("sha256", F.lit("unused-payload").alias("code"))
    damaged = payloads.filter(F.sha2("payload", 256) != F.col("sha256")).select("sha256", F.lit("other-bytes").alias("code"))
    return lost.unionByName(idle).unionByName(damaged)


def styles_by_text(rows: DataFrame, slots: DataFrame, doc: list[str], within: int = 10) -> DataFrame:
    """rows (doc, ordinal, text) with style: that of the slot (doc, ordinal, text, style) at the same ordinal if its text is the same, else that of the nearest slot of that text, not farther than within; null if the nearest disagree."""
    key = [*doc, "text"]
    held = slots.select(*key, F.col("ordinal").alias("a_owner"), F.col("ordinal").alias("a_ordinal"), "style")
    found = nearest(rows.select(*key, "ordinal", F.col("ordinal").alias("q_own")), held, key, "ordinal", "q_own", "style", within)
    return rows.join(found.select(*key, "ordinal", "style"), [*key, "ordinal"], "left")


def slots_by_number(rows: DataFrame, slots: DataFrame, doc: list[str], order: str, value: str) -> DataFrame:
    """The n-th row of a document with the value of its n-th slot."""
    number = lambda t: F.row_number().over(Window.partitionBy(*doc).orderBy(order)).alias("q_n")
    return rows.select("*", number(rows)).join(slots.select(*doc, value, number(slots)), [*doc, "q_n"], "left").drop("q_n")


def zipped(a: DataFrame, b: DataFrame, doc: list[str], order: str) -> DataFrame:
    """Rows of a and b paired by position in documents that have equally many on both sides; columns of b get the prefix b_."""
    w = Window.partitionBy(*doc)
    put = lambda t: t.withColumns({"q_n": F.row_number().over(w.orderBy(order)), "q_size": F.count(F.lit(1)).over(w)})
    right = put(b)
    right = right.select(*[F.col(c) if c in (*doc, "q_n", "q_size") else F.col(c).alias(f"b_{c}") for c in right.columns])
    return put(a).join(right, [*doc, "q_n", "q_size"]).drop("q_n", "q_size")


def opaque_matches(objects: DataFrame, attachments: DataFrame) -> DataFrame:
    """Objects whose ordinal, semantic hash and id are those of an attachment."""
    return objects.join(attachments, ["ordinal", "semantic_sha256", "object_id"])


def occurrences(texts: DataFrame, wanted: DataFrame, doc: list[str]) -> DataFrame:
    """Where in its document's text each wanted piece (doc, piece_id, piece, hint) stands, nearest to the hint, the earlier of two; overlapping occurrences count. begin is null where there is none."""
    text, piece = F.col("text"), F.col("piece")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(piece) + 1)), lambda k: (F.length(piece) > 0) & (F.substring(text, k, F.length(piece)) == piece))
    hits = F.transform(starts, lambda k: F.struct(F.abs(k - 1 - F.col("hint")).alias("far"), (k - 1).alias("begin")))
    out = wanted.join(texts, doc, "left")
    return out.select(*wanted.columns, F.array_min(hits)["begin"].alias("begin"))


def split_runs(runs: DataFrame, cuts: DataFrame, doc: list[str]) -> DataFrame:
    """runs (doc, run_no, begin, text) cut at offsets (doc, cut): (doc, run_no, piece_no, begin, text)."""
    inside = cuts.select(*doc, "cut").distinct().join(runs.select(*doc, "run_no", "begin", F.length("text").alias("q_len")), doc).filter("cut > begin and cut < begin + q_len")
    at = runs.join(inside.groupBy(*doc, "run_no").agg(F.array_sort(F.collect_list("cut")).alias("q_cuts")), [*doc, "run_no"], "left")
    edges = F.concat(F.array(F.col("begin").cast("long")), F.coalesce(F.transform("q_cuts", lambda x: x.cast("long")), F.array().cast("array<long>")), F.array((F.col("begin") + F.length("text")).cast("long")))
    pieces = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: F.struct(k.alias("piece_no"), F.get(edges, k).alias("a"), F.get(edges, k + 1).alias("b")))
    out = at.select(*doc, "run_no", "begin", "text", F.explode(pieces).alias("p"))
    return out.select(*doc, "run_no", "p.piece_no", F.col("p.a").alias("begin"), F.substring(F.col("text"), (F.col("p.a") - F.col("begin") + 1).cast("int"), (F.col("p.b") - F.col("p.a")).cast("int")).alias("text"))


def free_numbers(wanted: DataFrame, used: DataFrame, group: list[str]) -> DataFrame:
    """wanted (group, ordinal) with the least free numbers from 1, in order; used: (group, number).

    The k-th free number is k plus the used ones before it, and each used number u has u minus its rank free ones before it."""
    w = Window.partitionBy(*group).orderBy("number")
    gaps = used.select(*group, "number").distinct().filter("number > 0").withColumn("free", F.col("number") - F.row_number().over(w))
    counts = gaps.groupBy(*group, "free").agg(F.count(F.lit(1)).alias("here"))
    need = wanted.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("ordinal")))
    both = need.select(*group, "ordinal", "k", F.lit(0).alias("here")).unionByName(counts.select(*group, F.lit(None).cast(wanted.schema["ordinal"].dataType).alias("ordinal"), (F.col("free") + 1).cast("int").alias("k"), F.col("here").cast("int").alias("here")))
    before = F.sum("here").over(Window.partitionBy(*group).orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # a gap with f free numbers before it is passed by every k over f
    return both.withColumn("number", F.col("k") + before).filter("ordinal is not null").select(*group, "ordinal", "number")
