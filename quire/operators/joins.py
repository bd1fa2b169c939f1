"""Resolving references, diffing and matching as joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(references: DataFrame, definitions: DataFrame, on: list[str]) -> DataFrame:
    """References without a definition."""
    return references.join(definitions.select(*on).distinct(), on, "left_anti")


def unreferenced(definitions: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Definitions that nothing refers to."""
    return definitions.join(references.select(*on).distinct(), on, "left_anti")


def resolve(rows: DataFrame, *tables: tuple[DataFrame, list[str]], order: dict[str, list[str]]) -> DataFrame:
    """Left joins of lookup tables; each name in order is the first of its columns that isn't null."""
    for table, on in tables:
        rows = rows.join(table, on, "left")
    return rows.withColumns({name: F.coalesce(*columns) for name, columns in order.items()})


def overlaps(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], bucket: int | None = None) -> DataFrame:
    """Pairs of spans with a common point, begin inclusive and end exclusive; on is never empty.

    With bucket, both sides also meet in buckets of that width, so a key with very many spans is
    spread; a pair is kept in the bucket where the later of the two begins."""
    meet = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0]))
    if bucket is None:
        return a.join(b, on).filter(meet)
    cells = lambda s: F.explode(F.sequence(F.floor(F.col(s[0]) / bucket), F.floor((F.col(s[1]) - 1) / bucket)))
    real = lambda t, s: t.filter(F.col(s[1]) > F.col(s[0]))
    a, b = real(a, a_span).withColumn("q_cell", cells(a_span)), real(b, b_span).withColumn("q_cell", cells(b_span))
    home = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / bucket) == F.col("q_cell")
    return a.join(b, [*on, "q_cell"]).filter(meet & home).drop("q_cell")


def block_actions(block_map: DataFrame, edited: DataFrame, doc: list[str]) -> DataFrame:
    """Reconciles the blocks of a map (label, latex, source_order) with an edited text (seq, label, latex).

    Gives (seq_key, part, action, label, before_label, after_label): reuse, replace, delete and
    insert; a moved block is a delete and an insert. Labels are unique on each side and edited
    labels known: see label_errors."""
    w = Window.partitionBy(*doc).orderBy("seq")
    edited = edited.withColumn("before_label", F.last("label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    edited = edited.withColumn("after_label", F.first("label", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    both = block_map.select(*doc, "label", F.col("latex").alias("old_latex"), "source_order").join(edited.filter("label is not null"), [*doc, "label"])
    old, new = Window.partitionBy(*doc).orderBy("source_order"), Window.partitionBy(*doc).orderBy("seq")
    both = both.withColumns({"old_pos": F.row_number().over(old), "new_pos": F.row_number().over(new)})
    moved, same = F.col("old_pos") != F.col("new_pos"), F.col("latex").eqNullSafe(F.col("old_latex"))
    kept = F.when(same, "reuse").otherwise("replace")
    steps = F.when(moved, F.array(F.struct(F.lit(0).alias("part"), F.lit("delete").alias("action")), F.struct(F.lit(1).alias("part"), F.lit("insert").alias("action")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), kept.alias("action"))))
    survivors = both.withColumn("s", F.explode(steps)).select(*doc, F.col("seq").cast("long").alias("seq_key"), "s.part", "s.action", "label", _at("s.action", "before_label"), _at("s.action", "after_label"))
    new_rows = edited.filter("label is null").select(*doc, F.col("seq").cast("long").alias("seq_key"), F.lit(1).alias("part"), F.lit("insert").alias("action"), "label", "before_label", "after_label")
    gone = block_map.join(edited.filter("label is not null").select(*doc, "label"), [*doc, "label"], "left_anti")
    nothing = F.lit(None).cast(edited.schema["label"].dataType)
    gone = gone.select(*doc, (F.lit(1 << 40) + F.col("source_order")).alias("seq_key"), F.lit(0).alias("part"), F.lit("delete").alias("action"), "label", nothing.alias("before_label"), nothing.alias("after_label"))
    return survivors.unionByName(new_rows).unionByName(gone)


def _at(action: str, column: str) -> Column:
    return F.when(F.col(action) == "insert", F.col(column)).alias(column)


def label_errors(block_map: DataFrame, edited: DataFrame, doc: list[str]) -> DataFrame:
    """Labels that occur twice in the edited text, and labels that the map doesn't have."""
    named = edited.filter("label is not null")
    twice = named.groupBy(*doc, "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*doc, "label", F.lit("duplicate").alias("error"))
    invented = named.select(*doc, "label").distinct().join(block_map.select(*doc, "label"), [*doc, "label"], "left_anti").withColumn("error", F.lit("invented"))
    return twice.unionByName(invented)


#: Width of the ranges of ordinals within which neighbours are found by one task.
RANGE = 4096


def neighbours(points: DataFrame, marks: DataFrame, on: list[str], at: str) -> DataFrame:
    """Distinct points (on, at) with prev and next: the nearest marks (on, at) not after and not before. Ranges of RANGE are looked through on their own; the marks beyond come from the ranges' ends."""
    cell = F.floor(F.col(at) / RANGE).alias("q_cell")
    both = points.select(*on, at, F.lit(1).alias("p"), F.lit(0).alias("m")).unionByName(marks.select(*on, at, F.lit(0).alias("p"), F.lit(1).alias("m")))
    both = both.groupBy(*on, cell, at).agg(F.max("p").alias("p"), F.max("m").alias("m")).withColumn("mark", F.when(F.col("m") == 1, F.col(at)))
    near = Window.partitionBy(*on, "q_cell").orderBy(at)
    both = both.withColumns({"prev": F.last("mark", True).over(near.rowsBetween(Window.unboundedPreceding, 0)), "next": F.first("mark", True).over(near.rowsBetween(0, Window.unboundedFollowing))})
    cells, far = both.groupBy(*on, "q_cell").agg(F.min("mark").alias("low"), F.max("mark").alias("high")), Window.partitionBy(*on).orderBy("q_cell")
    cells = cells.select(*on, "q_cell", F.last("high", True).over(far.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("low", True).over(far.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    out = both.filter("p = 1").join(cells, [*on, "q_cell"])
    return out.select(*on, at, F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def nearest(rows: DataFrame, attachments: DataFrame, on: list[str], ordinal: str, owner: str, payload: str, within: int | None = None) -> DataFrame:
    """Every row with the nearest attachment of its key: that of the row's own owner, else the least distance of ordinals. Rows without any are left out.

    attachments have a_owner, a_ordinal and payload. Ties of one payload are one match; of several
    payloads none: n_payloads says how many were nearest. Neighbours are found in sorted order, so
    pairs are made only with what is nearest."""
    found = neighbours(rows.select(*on, ordinal), attachments.select(*on, F.col("a_ordinal").alias(ordinal)), on, ordinal)
    found = found.withColumn("q_distance", F.least(F.col(ordinal) - F.col("prev"), F.col("next") - F.col(ordinal)))
    if within is not None:
        found = found.filter(F.col("q_distance") <= within)
    sides = F.array_distinct(F.array(*[F.when(F.abs(F.col(ordinal) - F.col(c)) == F.col("q_distance"), F.col(c)) for c in ("prev", "next")]))
    found = found.select(*on, ordinal, "q_distance", F.explode(F.array_compact(sides)).alias("a_ordinal"))
    payloads = attachments.groupBy(*on, "a_ordinal", payload).agg(F.count(F.lit(1)).alias("q_n"))
    near = found.join(payloads, [*on, "a_ordinal"]).groupBy(*on, ordinal, "q_distance").agg(F.min(payload).alias("q_least"), F.count_distinct(payload).alias("q_kinds"))
    own = attachments.groupBy(*on, F.col("a_owner").alias(owner)).agg(F.min(payload).alias("q_own_least"), F.count_distinct(payload).alias("q_own_kinds"))
    out = rows.distinct().join(near, [*on, ordinal], "left").join(own, [*on, owner], "left").filter("q_kinds is not null or q_own_kinds is not null")
    mine = F.col("q_own_kinds").isNotNull()
    pick = lambda a, b: F.when(mine, a).otherwise(b)
    kinds = pick(F.col("q_own_kinds"), F.col("q_kinds"))
    return out.select(*rows.columns, pick(F.lit(-1).cast("long"), F.col("q_distance").cast("long")).alias("distance"), F.when(kinds == 1, pick(F.col("q_own_least"), F.col("q_least"))).alias(payload), kinds.alias("n_payloads"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, hops) of all nodes that the edges (source, target) reach from the roots (root), themselves included.

    Rounds add only nodes not seen before, until there are none: cycles end, and no depth is too much. Every round's result is checkpointed."""
    edges = edges.select("source", "target").distinct()
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct()
    last, k = seen, 0
    while True:
        k += 1
        found = last.join(edges, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct()
        last = checkpointed(found.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)
        if k % 8 == 0:
            seen = checkpointed(seen)


def _reach(group: list[str], source, target, root):
    def work(frame):
        import pandas as pd

        after: dict = {}
        for a, b in frame.loc[frame[root].isna(), [source, target]].itertuples(index=False):
            after.setdefault(a, []).append(b)
        out = []
        for r in dict.fromkeys(frame.loc[frame[root].notna(), root]):
            hops, todo = {r: 0}, [r]
            for node in todo:
                for b in after.get(node, ()):
                    if b not in hops:
                        hops[b] = hops[node] + 1
                        todo.append(b)
            out += [(r, node, n) for node, n in hops.items()]
        keys = {g: [frame[g].iloc[0]] * len(out) for g in group}
        return pd.DataFrame(keys | {"root": [x[0] for x in out], "node": [x[1] for x in out], "hops": [x[2] for x in out]})

    return work


def closure_within(edges: DataFrame, roots: DataFrame, group: list[str]) -> DataFrame:
    """(group, root, node, hops): the closure in graphs that are small each, as a package's parts are: one shuffle, whatever the depth. edges: (group, source, target), roots: (group, root)."""
    kind = roots.schema["root"].dataType.simpleString()
    both = edges.select(*group, "source", "target", F.lit(None).cast(kind).alias("root")).unionByName(roots.select(*group, "root"), allowMissingColumns=True)
    keys = ", ".join(f"`{g}` {both.schema[g].dataType.simpleString()}" for g in group)
    return both.groupBy(*group).applyInPandas(_reach(group, "source", "target", "root"), f"{keys}, root {kind}, node {kind}, hops int")


def inherited(nodes: DataFrame, id_col: str, parent: str, value: str) -> DataFrame:
    """The value of each node, or of the nearest ancestor that has one; null where none has, in cycles too.

    Every round doubles the ancestors looked at, so rounds grow with the logarithm of the nodes."""
    at = checkpointed(nodes.select(F.col(id_col).alias("start"), F.col(parent).alias("up"), F.col(value).alias("got")))
    for _ in range(max(1, at.count()).bit_length()):
        if at.filter("got is null and up is not null").isEmpty():
            break
        step = at.select(F.col("start").alias("s_id"), F.col("up").alias("s_up"), F.col("got").alias("s_got"))
        open_ = F.col("got").isNull()
        at = checkpointed(at.join(step, open_ & (F.col("up") == F.col("s_id")), "left").select("start", F.when(open_, F.col("s_up")).alias("up"), F.coalesce("got", "s_got").alias("got")))
    return at.select(F.col("start").alias(id_col), F.col("got").alias(value))


_folders: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in spark.checkpoint.dir; local sessions without one (tests) get a temporary folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _folders:
            _folders[key] = tempfile.mkdtemp(prefix="quire-")
            spark.sparkContext.setCheckpointDir(_folders[key])
    return df.checkpoint()
