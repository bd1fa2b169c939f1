"""Censuses, rollups and set operations as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def census(rows: DataFrame, by: list[str]) -> DataFrame:
    """n of every distinct combination."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def multiset_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, lost, gained): how often a value is in a more often than in b, and the other way."""
    x, y = census(a, on).withColumnRenamed("n", "na"), census(b, on).withColumnRenamed("n", "nb")
    both = x.unionByName(y, allowMissingColumns=True).groupBy(*on).agg(F.coalesce(F.sum("na"), F.lit(0)).alias("na"), F.coalesce(F.sum("nb"), F.lit(0)).alias("nb"))
    return both.filter("na <> nb").select(*on, F.greatest(F.col("na") - F.col("nb"), F.lit(0)).alias("lost"), F.greatest(F.col("nb") - F.col("na"), F.lit(0)).alias("gained"))


def first_mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first."""
    each = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    return each.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias(value), F.max("n").alias("n"))


def duplicates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Combinations that occur more than once."""
    return census(rows, by).filter("n > 1")


def unbalanced(marks: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Ids whose start and end marks aren't exactly one each."""
    each = marks.groupBy(*by).agg(F.count_if(F.col(kind) == "start").alias("n_start"), F.count_if(F.col(kind) == "end").alias("n_end"))
    return each.filter("n_start <> 1 or n_end <> 1")


def required(uses: DataFrame, requirements: DataFrame, by: list[str], allowed: list[str]) -> DataFrame:
    """Sorted names that what a group uses (feature) requires (package), within the allowed ones."""
    names = F.sort_array(F.collect_set(F.when(F.col("package").isin(allowed), F.col("package"))))
    return uses.join(requirements, "feature", "left").groupBy(*by).agg(names.alias("packages"))


def timing_rollup(rows: DataFrame, leg: str, seconds: str) -> DataFrame:
    """total, average and worst of every leg."""
    return rows.groupBy(leg).agg(*[F.coalesce(f(seconds), F.lit(0.0)).alias(n) for n, f in (("total", F.sum), ("average", F.avg), ("worst", F.max))])


def rises(before: DataFrame, now: DataFrame, metric: str, value: str, digits: int = 2) -> DataFrame:
    """Metrics that are higher now, both sides rounded."""
    old = before.select(metric, F.round(value, digits).alias("before"))
    return now.select(metric, F.round(value, digits).alias("now")).join(old, metric).filter(F.col("now") > F.col("before"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; rank: 1 to k."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def head_and_rest(rows: DataFrame, value: str, n: str, k: int) -> DataFrame:
    """The k most frequent values, and one row that sums up the rest (value null)."""
    top = rows.orderBy(F.desc(n), value).limit(k)
    rest = rows.join(top.select(value), value, "left_anti").agg(F.sum(n).alias(n), F.count(F.lit(1)).alias("kinds")).filter("kinds > 0")
    return top.select(value, n, F.lit(1).cast("long").alias("kinds")).unionByName(rest.select(F.lit(None).cast("string").alias(value), n, "kinds"))


def coverage(uses: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """Occurrences by bucket: handled, deferred, or unknown to the vocabulary (name, bucket). Buckets are disjoint."""
    bucket = F.coalesce(F.col("bucket"), F.lit("unknown"))
    return uses.join(vocabulary, name, "left").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(name).alias("kinds"))


# The verdicts, best first.
VERDICTS = ("identical", "neutral", "improvement", "degradation", "deferred", "noise")


def verdict(*rules: tuple[Column, str], default: str = "degradation") -> Column:
    """The verdict of the first rule that holds."""
    out = None
    for holds, name in rules:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(default)


def verdict_rollup(findings: DataFrame, by: list[str], verdict_col: str = "verdict") -> DataFrame:
    """A column for each verdict with its number."""
    return findings.groupBy(*by).pivot(verdict_col, list(VERDICTS)).count().na.fill(0, list(VERDICTS))


def edge_signature(cells: DataFrame, table: list[str], span: str, merge: str, fill: str) -> DataFrame:
    """What a table's cells have in common: max_span, n_merged, fills (sorted, each once), n_cells."""
    return cells.groupBy(*table).agg(F.max(F.greatest(F.col(span), F.lit(1))).alias("max_span"), F.count_if(F.col(merge) == "restart").alias("n_merged"), F.array_sort(F.collect_set(fill)).alias("fills"), F.count(F.lit(1)).alias("n_cells"))


# Run properties that word processors write by themselves.
NOISE = ("bCs", "iCs", "szCs", "lang", "noProof")


def noise_count(tags: DataFrame, by: list[str], tag: str) -> DataFrame:
    """n_noise: bookkeeping properties of every document, 0 too."""
    return tags.groupBy(*by).agg(F.count_if(F.col(tag).isin(*NOISE)).alias("n_noise"))


def free_suffix(names: DataFrame, base: str, suffix: str) -> DataFrame:
    """The least suffix from 0 that no name of a base has: where the first gap in its suffixes is."""
    held = names.select(base, suffix).distinct().filter(F.col(suffix) >= 0)
    w = Window.partitionBy(base).orderBy(suffix)
    first = held.withColumn("q_gap", F.col(suffix) - (F.row_number().over(w) - 1)).filter("q_gap = 0").groupBy(base).agg(F.count(F.lit(1)).alias("free"))
    return names.select(base).distinct().join(first, base, "left").select(base, F.coalesce("free", F.lit(0)).alias("free"))


def layer_issues(edges: DataFrame, forbidden: DataFrame, owners: DataFrame) -> DataFrame:
    """(code, subject) of a module graph: edges (source, target) between layers that are forbidden (source, target), modules that reach themselves, names with several owners (name, owner)."""
    from .joins import closure

    bad = edges.join(forbidden, ["source", "target"]).select(F.lit("forbidden-edge").alias("code"), F.concat_ws(">", "source", "target").alias("subject")).distinct()
    steps = edges.select("source", "target").distinct()
    reached = closure(steps, steps.select(F.col("source").alias("root")).distinct())
    cycles = reached.join(steps.select(F.col("source").alias("node"), F.col("target").alias("root")), ["node", "root"]).select(F.lit("cycle").alias("code"), F.col("root").cast("string").alias("subject")).distinct()
    twice = owners.groupBy("name").agg(F.count_distinct("owner").alias("n")).filter("n > 1").select(F.lit("several-owners").alias("code"), F.col("name").cast("string").alias("subject"))
    return bad.unionByName(cycles).unionByName(twice)
