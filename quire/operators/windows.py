"""Order-dependent scans as window functions. Order is always a column, never implicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(group: list[str], *order: str):
    return Window.partitionBy(*group).orderBy(*order)


def neighbour_labels(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """The nearest label that isn't null before (before_label) and after (after_label) every row."""
    w = _order(group, *order)
    before = F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(label, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"before_label": before, "after_label": after})


def runs(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """run: the number, from 1, of the run of equal neighbouring values (null equals null)."""
    w = _order(group, *order)
    new = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("q_new", new.cast("int")).withColumn("run", F.sum("q_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("q_new")


def coalesced(rows: DataFrame, group: list[str], order: list[str], value: str, text: str) -> DataFrame:
    """Neighbours with equal value become one row: run, value, text (joined in order), n_parts."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return runs(rows, group, order, value).groupBy(*group, "run", value).agg(F.array_join(ordered, "").alias(text), F.count(F.lit(1)).alias("n_parts"))


def next_value(rows: DataFrame, group: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """The first value that isn't null at this row or after it: a mark governs what stands before it."""
    w = _order(group, *order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(into, F.first(value, ignorenulls=True).over(w))


def grid_column(cells: DataFrame, row: list[str], order: list[str], span: str) -> DataFrame:
    """grid_col: where a cell starts, from 0, given the spans before it; a bad span counts as 1."""
    w = _order(row, *order).rowsBetween(Window.unboundedPreceding, -1)
    width = F.greatest(F.coalesce(F.col(span).cast("long"), F.lit(1)), F.lit(1))
    return cells.withColumn("q_w", width).withColumn("grid_col", F.coalesce(F.sum("q_w").over(w), F.lit(0))).drop("q_w")


def merge_lengths(cells: DataFrame, column: list[str], order: list[str], merge: str) -> DataFrame:
    """Rows that begin a vertical merge (restart), with row_span: themselves and the continue rows right below."""
    w = _order(column, *order)
    block = F.sum(F.when(F.col(merge).eqNullSafe("continue"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    span = F.count(F.lit(1)).over(Window.partitionBy(*column, "q_block"))
    return cells.withColumn("q_block", block).withColumn("row_span", span).filter(F.col(merge) == "restart").drop("q_block")


def first_seen(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Distinct values of each group with the order of their first row."""
    return rows.groupBy(*group, value).agg(F.min(order).alias("first_at"))


def ordinal(rows: DataFrame, group: list[str], order: list[str]) -> Column:
    """Number of a row among its like, from 0."""
    return F.row_number().over(_order(group, *order)) - 1


def labels(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """label: 1 to n in order."""
    return rows.withColumn("label", F.row_number().over(_order(group, *order)))


def within_fields(rows: DataFrame, group: list[str], order: list[str], mark: str) -> DataFrame:
    """state of every row between begin, separate and end marks: outside, instruction or result; depth of nested fields."""
    w = _order(group, *order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(mark) == "begin", 1).when(F.col(mark) == "end", -1).otherwise(0)
    last = F.last(F.when(F.col(mark).isin("begin", "separate"), F.col(mark)), ignorenulls=True).over(w)
    depth = F.sum(step).over(w)
    return rows.withColumn("depth", depth).withColumn("state", F.when(F.col("depth") <= 0, "outside").when(last == "begin", "instruction").otherwise("result"))


def lookahead_pairs(rows: DataFrame, group: list[str], order: list[str], first: Column, second: Column) -> DataFrame:
    """merged: the row meets first and its successor second (a figure and its caption); absorbed: the successor itself."""
    w = _order(group, *order)
    pair = first & F.coalesce(F.lead(second).over(w), F.lit(False))
    return rows.withColumn("merged", pair).withColumn("absorbed", F.coalesce(F.lag("merged").over(w), F.lit(False)))


def field_depth(rows: DataFrame, group: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """depth after each row of marks that open and close, never under 0; a close without an open counts for nothing."""
    w = _order(group, *order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w)
    out = rows.withColumn("q_total", total)
    return out.withColumn("depth", F.col("q_total") - F.least(F.lit(0), F.min("q_total").over(w))).drop("q_total")


def without_contents(rows: DataFrame, group: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Rows outside a generated table of contents, and of each table the row that opens it (is_toc)."""
    w = _order(group, *order)
    deep = field_depth(rows, group, order, opens, closes).withColumn("q_before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    return deep.withColumn("is_toc", (F.col("depth") > 0) & (F.col("q_before") == 0)).filter("q_before = 0").drop("q_before", "depth")


def grouped_lists(rows: DataFrame, group: list[str], order: list[str], is_item: Column) -> DataFrame:
    """block: rows numbered from 1, neighbouring list rows with one number."""
    w = _order(group, *order)
    out = rows.withColumn("q_item", is_item)
    new = ~(F.col("q_item") & F.coalesce(F.lag("q_item").over(w), F.lit(False)))
    return out.withColumn("q_new", new.cast("int")).withColumn("block", F.sum("q_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("q_new", "q_item")


def changes(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of each run of equal neighbouring values, numbered from 1 (position)."""
    first = F.row_number().over(Window.partitionBy(*group, "run").orderBy(*order))
    out = runs(rows, group, order, value).withColumn("q_first", first).filter("q_first = 1")
    return out.withColumn("position", F.col("run")).drop("q_first", "run")
