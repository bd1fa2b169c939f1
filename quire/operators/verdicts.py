"""Comparing two renditions of mathematics: censuses, then one verdict for each zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import space_runs, squeeze

from .aggregates import multiset_difference, verdict
from .windows import coalesced

#: Node properties that only place or size what is there.
LAYOUT = ("limits", "cols", "pos", "type")


def scope_census(nodes: DataFrame, key: str) -> DataFrame:
    """(key, type, span): the text that each node covers."""
    return nodes.select(key, "type", "span")


def layout_census(nodes: DataFrame, key: str) -> DataFrame:
    """(key, prop): name=value of every layout property."""
    return nodes.select(key, F.explode("props").alias("name", "value")).filter(F.col("name").isin(*LAYOUT)).select(key, F.concat_ws("=", "name", "value").alias("prop"))


def space_census(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.filter("type = 'space'").select(key, F.hex(F.encode("value", "UTF-8")).alias("width"))


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, verdict): what became of every zone of old in new. Both are node tables."""
    texts = lambda n: n.filter("value <> '' and type <> 'space'").select(key, "value")
    censuses = {"text": [texts(n) for n in (old, new)], "object": [n.select(key, "type") for n in (old, new)], "layout": [layout_census(n, key) for n in (old, new)], "scope": [scope_census(n, key) for n in (old, new)], "space": [space_census(n, key) for n in (old, new)]}
    out = old.select(key).unionByName(new.select(key)).distinct()
    out = out.join(old.select(key).distinct().withColumn("in_old", F.lit(True)), key, "left").join(new.select(key).distinct().withColumn("in_new", F.lit(True)), key, "left")
    for name, (a, b) in censuses.items():
        diff = multiset_difference(a, b, a.columns).groupBy(key).agg(F.sum("lost").alias(f"{name}_lost"), F.sum("gained").alias(f"{name}_gained"))
        out = out.join(diff, key, "left")
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    lost, changed = lambda n: c(f"{n}_lost") > 0, lambda n: c(f"{n}_lost") + c(f"{n}_gained") > 0
    rule = verdict(
        (F.col("in_new").isNull(), "degradation"), (F.col("in_old").isNull(), "improvement"), (lost("text"), "degradation"), (lost("object"), "degradation"), (changed("text") | changed("object"), "improvement"),
        (changed("layout"), "degradation"), (changed("scope"), "degradation"), (changed("space"), "neutral"), default="identical",
    )
    return out.select(key, rule.alias("verdict"))


# --- paragraphs, tables, documents ----------------------------------------------------------


def run_census(runs: DataFrame, key: list[str], order: str, form: str, text: str) -> DataFrame:
    """(key, form, span, n): how often a text has a format, neighbours of one format being one; blank texts don't count."""
    whole = coalesced(runs, key, [order], form, text)
    span = squeeze(F.col(text))
    return whole.select(*key, form, span.alias("span")).filter("span <> ''").groupBy(*key, form, "span").agg(F.count(F.lit(1)).alias("n"))


def _differ(name: str) -> Column:
    return ~F.col(f"o_{name}").eqNullSafe(F.col(f"n_{name}"))


def paragraph_verdicts(pairs: DataFrame) -> DataFrame:
    """verdict and reason of paragraph pairs (o_ and n_ of: text, heading, list, align, page_break, columns, bookmarks, fields, images, links, math, style, deferred, breaks; formats_lost, formats_gained): content first, then what a reader sees, then what is carried, then what is not."""
    text = squeeze(F.col("o_text")) != squeeze(F.col("n_text"))
    spacing = ~space_runs(F.col("o_text")).eqNullSafe(space_runs(F.col("n_text")))
    gained = F.col("o_heading").isNull() & F.col("n_heading").isNotNull()
    lost_links = F.size(F.array_except(F.coalesce("o_links", F.array().cast("array<string>")), F.coalesce("n_links", F.array().cast("array<string>")))) > 0
    rules = [(text, "degradation", "text"), (spacing, "degradation", "spacing"), (gained, "improvement", "heading from outline"), (_differ("heading"), "degradation", "heading")]
    rules += [(_differ(n), "degradation", n) for n in ("list", "align", "page_break", "columns", "bookmarks", "fields")]
    rules += [(F.col("formats_lost") > 0, "degradation", "formatting"), (_differ("images"), "degradation", "images"), (lost_links, "degradation", "links"), (_differ("math"), "degradation", "math"), (_differ("style"), "degradation", "style"), (_differ("deferred"), "deferred", "not carried")]
    rules += [((F.col("formats_gained") > 0) | _differ("breaks"), "neutral", "breaks")]
    return pairs.withColumns({"verdict": verdict(*[(r, v) for r, v, _ in rules], default="identical"), "reason": verdict(*[(r, x) for r, _, x in rules], default="")})


def table_verdicts(pairs: DataFrame) -> DataFrame:
    """verdict and reason of table pairs (o_ and n_ of: rows, cols, cells, max_span, n_merged, style, fills, borders, widths, heights, valigns): structure is compared, sizes are not carried."""
    rules = [(_differ("rows") | _differ("cols"), "degradation", "size"), (_differ("cells"), "degradation", "cells"), (_differ("max_span") | _differ("n_merged"), "degradation", "merges")]
    rules += [(_differ(n), "degradation", n) for n in ("style", "fills", "borders")]
    rules += [(_differ("widths") | _differ("heights") | _differ("valigns"), "deferred", "sizes")]
    return pairs.withColumns({"verdict": verdict(*[(r, v) for r, v, _ in rules], default="identical"), "reason": verdict(*[(r, x) for r, _, x in rules], default="")})


def document_verdicts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, kind, verdict): what became of notes, comments, headers and the like. old, new: (key, kind, id, text) of kind footnote, endnote, comment, header, footer, property or noise; definitions are compared by id."""
    a, b = (t.select(key, "kind", "id", F.col("text").alias(n)) for t, n in ((old, "o_text"), (new, "n_text")))
    both = a.withColumn("in_old", F.lit(1)).join(b.withColumn("in_new", F.lit(1)), [key, "kind", "id"], "full_outer")
    differs = F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("o_text").eqNullSafe(F.col("n_text"))
    each = both.groupBy(key, "kind").agg(F.bool_or(differs).alias("changed")).filter("changed")
    kind = verdict((F.col("kind").isin("footnote", "endnote", "comment"), "degradation"), (F.col("kind") == "noise", "noise"), default="deferred")
    return each.select(key, "kind", kind.alias("verdict"))
