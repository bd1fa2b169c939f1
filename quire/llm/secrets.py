"""Secret scans over an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger is a
Parquet table keyed by ``(blob, rule version)``; a scan runs only on pairs the ledger has not
seen, whichever paths or earlier runs brought the blob, and findings are joined back to all
paths that hold it. Only DataFrame and SQL operations are used.

A match's place is found without leaving the JVM: ``split`` gives the text between matches,
``regexp_extract_all`` the matches, and running lengths the code-point offsets.

Defined results: null text counts as empty; matches are leftmost and do not overlap within a
kind; kinds may overlap each other. Repeated rows each get their findings, a null id is a path
like any other, an empty table gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stage


@dataclass(frozen=True)
class Rule:
    """kind; pattern of a match; gate: a cheaper pattern that every text with a match has; group, least: length that this group must have."""

    kind: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 1


#: Runs of 16 or 32 characters and more are asked for in the pattern itself: maximal runs are the same either way.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)password|passwd|secret|token|api_?key", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
)
#: What the second rule set adds.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("prefixed", r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", r"ghp_|gho_|xoxb-|xoxp-|sk_live_|glpat-"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", r"://[^\s/:@]{1,64}:"),
)
RULES = {"base-1": BASE, "extra-1": EXTRA}
ORDER = [r.kind for r in (*BASE, *EXTRA)]
SPAN = "array<struct<begin:int,rank:int,finish:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of a rule as structs (begin, rank, finish), in code points.

    The running lengths are taken in pieces of about the square root of their number, as an array grows by a copy."""
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    sizes = F.transform(F.arrays_zip(between.alias("a"), found.alias("b"), parts.alias("c")), lambda x: F.struct(size(x["a"]).alias("a"), size(x["b"]).alias("b"), size(x["c"]).alias("c")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        begin = acc["pos"] + x["a"]
        one = F.array(F.struct(begin.alias("begin"), F.lit(rank).alias("rank"), (begin + x["b"]).alias("finish")))
        return F.struct((begin + x["b"]).alias("pos"), F.when((x["b"] > 0) & (x["c"] >= rule.least), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def pieces(every):
        width = F.ceil(F.sqrt(F.size(every))).cast("int")
        at = F.sequence(F.lit(1), F.size(every), width)
        return F.transform(at, lambda k: F.aggregate(F.slice(every, k, width), start, step))

    def placed(some):
        starts = F.aggregate(some, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["pos"])))
        moved = lambda x, by: F.transform(x["out"], lambda s: F.struct((s["begin"] + by).alias("begin"), s["rank"].alias("rank"), (s["finish"] + by).alias("finish")))
        return _let(starts, lambda s: F.flatten(F.transform(some, lambda x, k: moved(x, F.get(s, k)))))

    every = _let(sizes, lambda x: _let(pieces(x), placed))
    return F.when(text.rlike(rule.gate), every.cast(SPAN)).otherwise(F.array().cast(SPAN))


class BlobLedger:
    """The ledger at a path in shared storage; it survives sessions and grows by appends of unseen pairs."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "blob-ledger")

    SCHEMA = f"blob string, hits {SPAN}, rule_version string"

    def seen(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", versions=tuple(RULES)) -> DataFrame:
        """Appends what is unseen; returns (id_col, blob, hits) of every row, hits over the given rule versions in order."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).alias("q_id"), text.alias("q_text")).withColumn("blob", F.sha2("q_text", 256))
        paths_at = new_path(self.spark, "blob-paths")
        rows.select("q_id", "blob").write.parquet(paths_at)
        paths = self.spark.read.parquet(paths_at)
        known, todo = self.seen(), None
        blobs = paths.groupBy("blob").agg(F.min("q_id").alias("q_first"))
        for v in versions:
            missing = blobs.join(known.filter(F.col("rule_version") == v).select("blob"), "blob", "left_anti").withColumn("v", F.lit(v))
            todo = missing if todo is None else todo.unionByName(missing)
        todo = todo.groupBy("blob", "q_first").agg(F.collect_set("v").alias("todo"))
        firsts = todo.select(F.col("blob").alias("t_blob"), "q_first", "todo")
        texts = rows.join(firsts, (F.col("blob") == F.col("t_blob")) & F.col("q_id").eqNullSafe(F.col("q_first")))
        for v in versions:
            found = [spans(F.col("q_text"), r, ORDER.index(r.kind)) for r in RULES[v]]
            every = F.array_sort(F.concat(*found)) if len(found) > 1 else found[0]
            texts = texts.withColumn(f"h_{v}", F.when(F.array_contains("todo", v), every))
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("rule_version"), F.col(f"h_{v}").alias("hits")) for v in versions]))
        texts.select("blob", pairs.alias("p")).select("blob", "p.hits", "p.rule_version").filter("hits is not null").dropDuplicates(["blob", "rule_version"]).write.mode("append").parquet(self.path)
        every = F.array_sort(F.flatten(F.collect_set("hits")))
        by_blob = self.seen().filter(F.col("rule_version").isin(list(versions))).groupBy("blob").agg(every.alias("hits"))
        return paths.join(stage(by_blob, "blob-hits"), "blob").select(F.col("q_id").alias(id_col), "blob", "hits")


def joined(hits: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(hits, lambda x: F.concat_ws(":", names[x["rank"]], x["begin"].cast("string"), x["finish"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of its base spans, and all spans as text."""
    found = (ledger or BlobLedger(docs.sparkSession)).scan(docs, id_col, text_col)
    hits = F.col("hits")
    count = lambda rank: F.size(F.filter(hits, lambda x: x["rank"] == rank)).cast("long")
    base = F.filter(hits, lambda x: x["rank"] < len(BASE))
    return found.select(id_col, *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(hits).alias("spans"))
