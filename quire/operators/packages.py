"""Integrity of document packages: every rule counts what the facts of a package say about a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import closure_within


def part_types(parts: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    """parts with content_type: the override, else the default of the extension, else null."""
    one = lambda kind: types.filter(F.col("kind") == kind).groupBy(*keys, "name").agg(F.min_by("content_type", "ord").alias(kind))
    rows = parts.withColumn("extension", F.when(F.col("part").contains("."), F.lower(F.substring_index("part", ".", -1))).otherwise(""))
    rows = rows.join(one("override").withColumnRenamed("name", "part"), [*keys, "part"], "left").join(one("default").withColumnRenamed("name", "extension"), [*keys, "extension"], "left")
    return rows.withColumn("content_type", F.coalesce("override", "default")).drop("override", "default")


#: Kinds of marks that are defined once in a part and referred to.
_DEFINED = ("style", "abstract", "num", "footnote", "endnote", "comment")
_TYPED = "[Content_Types].xml"


def _claims(facts: DataFrame, keys: list[str]) -> DataFrame:
    """What every fact says about a name: (space, at, name) is what it is about, role what it says, (of, code, detail) the issue that comes of it if that isn't so."""
    c, none = F.col, F.lit(None).cast("string")
    part, type_, rel, mark = (c("fact") == x for x in ("part", "type", "rel", "mark"))
    whole = part & c("error").isNull()
    default, override, bookmark = c("kind") == "default", c("kind") == "override", c("kind").startswith("bookmark-")
    defined, kind, inner = c("kind").isin(*_DEFINED), F.regexp_replace("kind", "-ref$", ""), rel & ~c("external")
    refers = c("kind").isin(*[f"{k}-ref" for k in _DEFINED]) & ~((c("kind") == "num-ref") & F.coalesce(c("id") == "0", F.lit(True)))
    extension = F.when(c("part").contains("."), F.lower(F.substring_index("part", ".", -1))).otherwise("")

    def claim(when, role, space, name, code=none, detail=none, of=c("part"), at=none):
        columns = {"role": role, "space": space, "at": at, "name": name, "of": of, "code": code, "detail": detail}
        return F.when(when, F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(k) for k, x in columns.items()]))

    made = [
        claim(part & c("error").isNotNull(), "wrong", none, none, "broken", c("error")),
        claim(part, "types", none, none, "missing", F.lit("content types"), F.lit(_TYPED)),
        claim(whole, "is", "part", c("part")),
        claim(whole & (c("part") != _TYPED), "typed", "override", c("part"), "missing-content-type", extension),
        claim(type_ & override, "referred", "part", c("name"), "missing-part", c("name"), F.lit(_TYPED)),
        claim(type_ & override, "is", "override", c("name"), detail=c("content_type")),
        claim(type_ & default, "default", none, none, detail=c("name")),
        claim(type_ & (default | override), "once", F.concat(F.lit("one "), c("kind")), c("name"), F.concat(F.lit("duplicate-"), c("kind")), c("name"), F.lit(_TYPED)),
        claim(rel & (c("source") != ""), "referred", "part", c("source"), "missing-source", c("source")),
        claim(rel & (c("rid") == ""), "wrong", none, none, "relationship-id", F.lit("empty")),
        claim(rel & (c("rid") != ""), "once", "one relationship", c("rid"), "duplicate-relationship-id", c("rid"), at=c("part")),
        claim(inner & c("resolved").isNull(), "wrong", none, none, "invalid-target", c("target")),
        claim(inner & c("resolved").isNotNull(), "referred", "part", c("resolved"), "missing-target", c("resolved")),
        claim(rel, "is", "relationship", c("rid"), at=c("source")),
        claim(mark & (c("kind") == "rel-ref"), "referred", "relationship", c("id"), "missing-relationship-reference", F.concat_ws("=", "detail", "id"), at=c("part")),
        claim(mark & refers, "referred", kind, c("id"), F.concat(F.lit("missing-"), kind), c("id")),
        claim(mark & defined, "is", kind, c("id")),
        claim(mark & defined, "once", F.concat(F.lit("one "), kind), c("id"), F.concat(F.lit("duplicate-"), kind, F.lit("-id")), c("id"), at=c("part")),
        claim(mark & bookmark, F.substring_index("kind", "-", -1), "bookmark", c("id"), "unbalanced-bookmark", c("id"), at=c("part")),
        claim(mark & (c("kind") == "invalid-xml"), "wrong", none, none, "invalid-xml", c("id")),
    ]
    return facts.select(*keys, F.inline(F.array_compact(F.array(*made))))


def package_issues(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, code, detail) of everything wrong with packages, from all facts about them: they are read once and shuffled once, by package; the rules are counts over a name's claims."""
    claims = _claims(facts, keys).repartition(*keys)
    name, role = Window.partitionBy(*keys, "space", "at", "name"), F.col("role")
    count = lambda r, over: F.count_if(role == r).over(over)
    rows = claims.withColumns({f"n_{r}": count(r, name) for r in ("is", "once", "start", "end")})
    rows = rows.withColumn("n_types", F.count_if((role == "default") | ((role == "is") & (F.col("space") == "override"))).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("extension", F.when(role.isin("default", "typed"), F.col("detail")))
    rows = rows.withColumn("n_default", count("default", Window.partitionBy(*keys, "extension")))
    wrong = (
        F.when(role == "wrong", True).when(role == "types", F.col("n_types") == 0)
        .when(role == "referred", F.col("name").isNull() | (F.col("n_is") == 0))
        .when(role == "typed", (F.col("n_is") == 0) & (F.col("n_default") == 0) & (F.col("n_types") > 0))
        .when(role == "once", F.col("n_once") > 1).when(role.isin("start", "end"), (F.col("n_start") != 1) | (F.col("n_end") != 1))
    )
    single = role.isin("types", "once", "start", "end") | (F.col("code") == "missing-source")
    found = rows.filter(wrong).select(*keys, F.col("of").alias("part"), "code", "detail", F.when(~single, F.monotonically_increasing_id()).alias("row"))
    return found.dropDuplicates([*keys, "part", "code", "detail", "row"]).drop("row")


def issues(parts: DataFrame, types: DataFrame, rels: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """The issues of packages whose facts are in tables of their own; from the parts alone, package_issues of files.facts reads each part once."""
    tables = (("part", parts, ["part", "error"]), ("type", types, ["kind", "name", "content_type"]), ("rel", rels, ["part", "source", "rid", "target", "external", "resolved"]), ("mark", marks, ["part", "kind", "id", "detail"]))
    every = None
    for fact, table, columns in tables:
        rows = table.select(*keys, F.lit(fact).alias("fact"), *columns)
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    return package_issues(every, keys)


def note_texts(marks: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """References of a kind with defined: whether their definition is there and real (without a type)."""
    have = marks.filter((F.col("kind") == kind) & F.col("detail").isNull()).select(*keys, "id").distinct().withColumn("defined", F.lit(True))
    return marks.filter(F.col("kind") == f"{kind}-ref").select(*keys, "part", "id").join(have, [*keys, "id"], "left").na.fill(False, ["defined"])


def reachable_parts(rels: DataFrame, key: str, part: str) -> DataFrame:
    """(key, node) of all parts that a part reaches over internal relationships, in every package."""
    edges = rels.filter("not external and resolved is not null").select(key, "source", F.col("resolved").alias("target"))
    roots = rels.select(key).distinct().withColumn("root", F.lit(part))
    return closure_within(edges, roots, [key]).select(key, F.col("node").alias("part"), "hops")
