"""Queries of structure, sidecar and verdict operators over tables derived from the star schema, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import aggregates as A
from quire.operators import sidecar as S
from quire.operators import verdicts as V
from quire.operators import windows as W
from quire.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SWITCH = "CASE p_size % 6 WHEN 0 THEN ' On ' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' WHEN 3 THEN 'off' WHEN 4 THEN ' 1 ' ELSE p_type END AS value, CASE WHEN p_partkey % 3 = 0 THEN 'count' ELSE 'grow' END AS prop"


@query(f"""WITH s AS (SELECT p_partkey, {_SWITCH} FROM part)
SELECT p_partkey, CASE WHEN prop = 'count' THEN trim(value) WHEN lower(trim(value)) IN ('1', 'on', 'true') THEN 'on' WHEN lower(trim(value)) IN ('0', 'off', 'false') THEN 'off' ELSE value END AS value FROM s""")
def value_normalise(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").selectExpr("p_partkey", *_SWITCH.replace(" AS value, ", " AS value\0").split("\0"))
    return rows.select("p_partkey", T.switch_value(F.col("value"), F.col("prop")).alias("value"))


@query("SELECT doc_id, md5(regexp_replace(translate(text, '-·’'||chr(39), '−⋅′′'), '\\s+', '', 'g')) AS digest FROM documents")
def math_text_normalise(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.math_text(F.col("text"))).alias("digest"))


def _spread(sign: str, spelled: str) -> str:
    """In SQL: signs after a sign spelled otherwise, by the empty pieces between them."""
    return f"array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = 1 THEN p[i] WHEN i > 2 AND p[i - 1] = '' THEN '{spelled}' || p[i] ELSE '{sign}' || p[i] END), '')"


@query(f"WITH s AS (SELECT conv_id, turn, string_split(replace(text, 'e', '  '), ' ') AS p FROM conversations) SELECT conv_id, turn, {_spread(' ', chr(92) + ' ')} AS text FROM s WHERE p IS NOT NULL")
def space_masks(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", T.spelled_spaces(F.replace("text", F.lit("e"), F.lit("  "))).alias("text"))


@query(f"WITH s AS (SELECT conv_id, turn, string_split(replace(text, 'e', '--'), '-') AS p FROM conversations) SELECT conv_id, turn, {_spread('-', '{}-')} AS text FROM s WHERE p IS NOT NULL")
def hyphen_masks(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", T.spelled_hyphens(F.replace("text", F.lit("e"), F.lit("--"))).alias("text"))


#: Labels with their number format, Word template at level 2, and what a template of that format at the first place spells.
_LABELS = [("\\arabic*.", "decimal", "%3.", "\\arabic{enumi}."), ("(\\alph*)", "lowerLetter", "(%3)", "(\\alph{enumi})"), ("\\Roman{enumi}.\\roman{enumii}", "lowerRoman", "%1.%2", "\\roman{enumi}.\\roman{enumii}"), ("--", "bullet", "--", "--"), ("", None, "", ""), ("\\Alph{enumii}", "upperLetter", "%2", "\\Alph{enumii}")]


@query("WITH v(k, label, format, word, latex) AS (VALUES " + ", ".join(f"({k}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for k, r in enumerate(_LABELS)) + f") SELECT p_partkey, label, format, word, latex FROM part JOIN v ON k = p_partkey % {len(_LABELS)}")
def list_labels(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(r[0]) for r in _LABELS]), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    template = F.element_at(F.array(*[F.lit(t) for t in ("%1.", "(%1)", "%1.%2", "--", "", "%2")]), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", label.alias("label"), template.alias("template")).withColumn("format", T.label_format(F.col("label")))
    return rows.select("p_partkey", "label", "format", T.word_label(F.col("label"), F.lit(2)).alias("word"), T.latex_label(F.coalesce("format", F.lit("decimal")), F.col("template")).alias("latex"))


#: Field codes with what they say.
_FIELDS = [(" REF sec1 \\h ", "REF", "sec1"), ("PAGEREF fig2", "PAGEREF", "fig2"), (' HYPERLINK "http://a/""b""" ', "HYPERLINK", 'http://a/"b"'), ("SEQ Figure", "SEQ", "Figure"), ("TOC \\o", None, None), ("REFERENCE x", None, None)]


@query("WITH v(k, code, kind, target) AS (VALUES " + ", ".join(f"({k}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for k, r in enumerate(_FIELDS)) + f") SELECT p_partkey, kind, target FROM part JOIN v ON k = p_partkey % {len(_FIELDS)}")
def field_codes(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(r[0]) for r in _FIELDS]), (F.col("p_partkey") % len(_FIELDS) + 1).cast("int"))
    kind, target = T.field_parts(code)
    return _t(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), target.alias("target"))


_BOOKMARK = "CASE event_id % 5 WHEN 0 THEN '_Toc' || event_id WHEN 1 THEN '_GoBack' WHEN 2 THEN 'sec' || event_id WHEN 3 THEN '_Hlk' ELSE 'X' || substr(md5('' || event_id), 1, 20) END"


@query(f"SELECT event_id, {_BOOKMARK} AS name FROM events WHERE event_id % 5 IN (2, 3)")
def authored_bookmarks(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("event_id", f"{_BOOKMARK} AS name")
    return rows.filter(T.authored_bookmark(F.col("name")))


@query("SELECT c_custkey, lower(trim(c_mktsegment)) IN ('normal', 'body text', 'default paragraph style', 'no spacing') AS plain FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' Body Text' ELSE c_mktsegment END AS c_mktsegment FROM customer)")
def plain_styles(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, " Body Text").otherwise(F.col("c_mktsegment"))
    return _t(spark, sf_dir, "customer").select("c_custkey", T.plain_style(name).alias("plain"))


_REL = "SELECT o_orderkey AS ord, o_orderkey % 3 = 0 AS external, CASE WHEN o_orderkey % 2 = 0 THEN 'word/media/' || o_custkey || '.png' ELSE 'word/mediator/' || o_custkey END AS resolved FROM orders"


def _rels(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("quire_orders")
    return spark.sql(_REL.replace("FROM orders", "FROM quire_orders"))


@query(f"SELECT ord, resolved FROM ({_REL}) WHERE NOT external AND ord % 2 = 0")
def media_relationships(spark, sf_dir):
    return files.media_relationships(_rels(spark, sf_dir)).select("ord", "resolved")


@query(f"SELECT ord, resolved FROM ({_REL}) WHERE external")
def external_relationships(spark, sf_dir):
    return files.external_relationships(_rels(spark, sf_dir)).select("ord", "resolved")


@query("""WITH s AS (SELECT event_id, user_id, event_type, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS depth FROM s), b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM d)
SELECT event_id, depth > 0 AS is_toc FROM b WHERE before = 0""")
def toc_rows(spark, sf_dir):
    """What stands outside generated tables of contents."""
    kind = F.col("event_type")
    return W.without_contents(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], kind == "signup", kind == "error").select("event_id", "is_toc")


@query("""WITH s AS (SELECT event_id, user_id, event_type IN ('view', 'click') AS item FROM events), n AS (SELECT *, CASE WHEN item AND coalesce(lag(item) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 0 ELSE 1 END AS fresh FROM s)
SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM n""")
def list_groups(spark, sf_dir):
    return W.grouped_lists(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type").isin("view", "click")).select("event_id", F.col("block").cast("long").alias("block"))


@query("""WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM s WHERE n = 1 OR event_type IS DISTINCT FROM b""")
def section_changes(spark, sf_dir):
    """Signatures of sections that differ from the one before."""
    return W.changes(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "event_type", F.col("position").cast("long").alias("position"))


@query("""WITH s AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT *, sum(CASE WHEN n = 1 OR role IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM s),
c AS (SELECT conv_id, run, role, trim(regexp_replace(string_agg(text, '' ORDER BY turn), '\\s+', ' ', 'g')) AS span FROM r GROUP BY ALL)
SELECT conv_id, role AS form, span, count(*) AS n FROM c WHERE span <> '' GROUP BY ALL""")
def run_census(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumnRenamed("role", "form")
    return V.run_census(rows, ["conv_id"], "turn", "form", "text")


@query("SELECT o_custkey, count(*) FILTER (tag IN ('bCs', 'iCs', 'szCs', 'lang', 'noProof')) AS n_noise FROM (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'bCs' WHEN 1 THEN 'b' WHEN 2 THEN 'lang' ELSE 'i' END AS tag FROM orders) GROUP BY 1")
def noise_counts(spark, sf_dir):
    tags = _t(spark, sf_dir, "orders").selectExpr("o_custkey", "CASE o_orderkey % 4 WHEN 0 THEN 'bCs' WHEN 1 THEN 'b' WHEN 2 THEN 'lang' ELSE 'i' END AS tag")
    return A.noise_count(tags, ["o_custkey"], "tag")


@query("""SELECT l_orderkey, CAST(max(greatest(span, 1)) AS BIGINT) AS max_span, count(*) FILTER (merge = 'restart') AS n_merged, array_to_string(list_sort(list(DISTINCT fill) FILTER (fill IS NOT NULL)), ',') AS fills, count(*) AS n_cells
FROM (SELECT l_orderkey, l_linenumber % 4 - 1 AS span, CASE WHEN l_linenumber % 5 = 0 THEN 'restart' END AS merge, CASE WHEN l_discount > 0.05 THEN l_returnflag END AS fill FROM lineitem) GROUP BY 1""")
def edge_signatures(spark, sf_dir):
    cells = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber % 4 - 1 AS span", "CASE WHEN l_linenumber % 5 = 0 THEN 'restart' END AS merge", "CASE WHEN l_discount > 0.05 THEN l_returnflag END AS fill")
    out = A.edge_signature(cells, ["l_orderkey"], "span", "merge", "fill")
    return out.select("l_orderkey", F.col("max_span").cast("long").alias("max_span"), "n_merged", F.when(F.size("fills") > 0, F.array_join("fills", ",")).alias("fills"), "n_cells")


@query("SELECT page_id, array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: list_position(t, t[i]) = i), lambda i: t[i]), ',') AS tags FROM (SELECT page_id, regexp_extract_all(html, '<([a-z0-9]+)', 1) AS t FROM pages) WHERE t IS NOT NULL")
def border_dedupe(spark, sf_dir):
    """Distinct names in the order of their first use."""
    return _t(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))), ",").alias("tags"))


@query("""WITH v(tag, bucket) AS (VALUES ('p', 'handled'), ('a', 'handled'), ('div', 'handled'), ('script', 'deferred'), ('style', 'deferred'))
SELECT coalesce(bucket, 'unknown') AS bucket, count(*) AS n, count(DISTINCT u.tag) AS kinds FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) u LEFT JOIN v ON v.tag = u.tag GROUP BY 1""")
def element_coverage(spark, sf_dir):
    """Elements of documents by whether they are carried."""
    uses = _t(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag"))
    known = spark.createDataFrame([("p", "handled"), ("a", "handled"), ("div", "handled"), ("script", "deferred"), ("style", "deferred")], "tag string, bucket string")
    return A.coverage(uses, known, "tag")


@query("""WITH u AS (SELECT DISTINCT c_nationkey AS base, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 11 ELSE c_custkey % 5 END AS suffix FROM customer)
SELECT base, (SELECT min(s) FROM range(0, 100) r(s) WHERE s NOT IN (SELECT suffix FROM u x WHERE x.base = b.base)) AS free FROM (SELECT DISTINCT base FROM u) b""")
def free_suffixes(spark, sf_dir):
    names = _t(spark, sf_dir, "customer").selectExpr("c_nationkey AS base", "CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 11 ELSE c_custkey % 5 END AS suffix")
    return A.free_suffix(names, "base", "suffix").select("base", F.col("free").cast("long").alias("free"))


_WANTED = "SELECT o_custkey % 50 AS g, o_orderkey AS ordinal FROM orders"
_USED = "SELECT DISTINCT c_custkey % 50 AS g, (c_custkey * 7) % 23 AS number FROM customer"


@query(f"""WITH u AS ({_USED}), n AS (SELECT g, x AS number FROM (SELECT DISTINCT g FROM ({_WANTED})), range(1, (SELECT max(c) FROM (SELECT count(*) AS c FROM ({_WANTED}) GROUP BY g)) + 25) r(x)),
f AS (SELECT n.g, n.number, row_number() OVER (PARTITION BY n.g ORDER BY n.number) AS k FROM n ANTI JOIN u USING (g, number)), w AS (SELECT g, ordinal, row_number() OVER (PARTITION BY g ORDER BY ordinal) AS k FROM ({_WANTED}))
SELECT w.g, w.ordinal, f.number FROM w JOIN f USING (g, k)""")
def free_numbers(spark, sf_dir):
    """Identifiers for new relationships: the least that are free, in order."""
    wanted = _t(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS g", "o_orderkey AS ordinal")
    used = _t(spark, sf_dir, "customer").selectExpr("c_custkey % 50 AS g", "(c_custkey * 7) % 23 AS number")
    return S.free_numbers(wanted, used, ["g"]).select("g", "ordinal", F.col("number").cast("long").alias("number"))


@query("""WITH a AS (SELECT o_custkey AS doc, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
b AS (SELECT l_suppkey AS doc, l_orderkey AS ord, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS n, count(*) OVER (PARTITION BY l_suppkey) AS size FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_quantity = 1))
SELECT a.doc, a.ord, b.ord AS b_ord FROM a JOIN b USING (doc, n, size)""")
def positional_zip(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS ord")
    b = _t(spark, sf_dir, "lineitem").filter("l_quantity = 1").selectExpr("l_suppkey AS doc", "l_orderkey AS ord").distinct()
    return S.zipped(a, b, ["doc"], "ord")


@query("""WITH a AS (SELECT o_custkey % 25 AS doc, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT c_nationkey AS doc, c_name AS style, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT a.doc, a.ord, b.style FROM a LEFT JOIN b USING (doc, n)""")
def table_slots(spark, sf_dir):
    """The n-th table with the style of the n-th slot."""
    rows = _t(spark, sf_dir, "orders").selectExpr("o_custkey % 25 AS doc", "o_orderkey AS ord")
    slots = _t(spark, sf_dir, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS doc", "c_custkey AS ord", "c_name AS style")
    return S.slots_by_number(rows, slots, ["doc"], "ord", "style")


_ROWS = "SELECT event_id % 20 AS doc, event_id // 20 AS ordinal, event_type AS text FROM events"
_SLOTS = "SELECT c_custkey % 20 AS doc, c_custkey AS ordinal, CASE c_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END AS text, c_mktsegment AS style FROM customer"


@query(f"""WITH r AS ({_ROWS}), s AS ({_SLOTS}), p AS (SELECT r.doc, r.ordinal, r.text, CASE WHEN r.ordinal = s.ordinal THEN -1 ELSE abs(r.ordinal - s.ordinal) END AS d, style FROM r JOIN s ON r.doc = s.doc AND r.text = s.text AND abs(r.ordinal - s.ordinal) <= 10),
b AS (SELECT doc, ordinal, text, CASE WHEN count(DISTINCT style) = 1 THEN min(style) END AS style FROM (SELECT *, min(d) OVER (PARTITION BY doc, ordinal, text) AS m FROM p) WHERE d = m GROUP BY ALL)
SELECT r.doc, r.ordinal, r.text, b.style FROM r LEFT JOIN b ON r.doc = b.doc AND r.ordinal = b.ordinal AND r.text = b.text""")
def style_matches(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("event_id % 20 AS doc", "CAST(floor(event_id / 20) AS BIGINT) AS ordinal", "event_type AS text")
    _t(spark, sf_dir, "customer").createOrReplaceTempView("quire_customer")
    slots = spark.sql(_SLOTS.replace("FROM customer", "FROM quire_customer"))
    return S.styles_by_text(rows, slots, ["doc"]).select("doc", "ordinal", "text", "style")


@query("""WITH o AS (SELECT l_orderkey AS doc, l_linenumber AS ordinal, sha256(l_returnflag) AS semantic_sha256, l_partkey AS object_id FROM lineitem), a AS (SELECT l_orderkey AS doc_a, l_linenumber AS ordinal, sha256(l_returnflag) AS semantic_sha256, l_partkey AS object_id, l_quantity AS payload FROM lineitem WHERE l_discount > 0.03)
SELECT doc, doc_a, ordinal, object_id, payload FROM o JOIN a USING (ordinal, semantic_sha256, object_id)""")
def opaque_matches(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    o = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ordinal"), F.sha2("l_returnflag", 256).alias("semantic_sha256"), F.col("l_partkey").alias("object_id"))
    a = li.filter("l_discount > 0.03").select(F.col("l_orderkey").alias("doc_a"), F.col("l_linenumber").alias("ordinal"), F.sha2("l_returnflag", 256).alias("semantic_sha256"), F.col("l_partkey").alias("object_id"), F.col("l_quantity").alias("payload"))
    return S.opaque_matches(o, a).select("doc", "doc_a", "ordinal", "object_id", "payload")


@query("""WITH t AS (SELECT conv_id, turn, text, substr(text, 3, 2) AS piece, length(text) // 2 AS hint FROM conversations WHERE length(text) >= 4),
h AS (SELECT conv_id, turn, piece, hint, unnest(list_filter(range(1, length(text) - length(piece) + 2), lambda k: substr(text, k, length(piece)) = piece)) - 1 AS at_ FROM t)
SELECT conv_id, turn, arg_min(at_, {'d': abs(at_ - hint), 'a': at_}) AS begin FROM h GROUP BY ALL""")
def occurrence_hints(spark, sf_dir):
    texts = _t(spark, sf_dir, "conversations").filter("length(text) >= 4").select("conv_id", "turn", "text")
    wanted = texts.select("conv_id", "turn", F.substring("text", 3, 2).alias("piece"), F.floor(F.length("text") / 2).alias("hint"))
    return S.occurrences(texts, wanted, ["conv_id", "turn"]).select("conv_id", "turn", F.col("begin").cast("long").alias("begin"))


@query("""WITH r AS (SELECT conv_id, turn AS run_no, 5 AS begin, text FROM conversations WHERE length(text) > 0), c AS (SELECT conv_id, 5 + turn * 9 AS cut FROM conversations),
e AS (SELECT conv_id, run_no, begin AS a FROM r UNION SELECT r.conv_id, run_no, cut FROM r JOIN c ON r.conv_id = c.conv_id AND cut > begin AND cut < begin + length(text)),
n AS (SELECT e.*, row_number() OVER (PARTITION BY conv_id, run_no ORDER BY a) - 1 AS piece_no, lead(a) OVER (PARTITION BY conv_id, run_no ORDER BY a) AS b FROM e)
SELECT n.conv_id, n.run_no, piece_no, CAST(a AS BIGINT) AS begin, CASE WHEN b IS NULL THEN substr(text, a - begin + 1) ELSE substr(text, a - begin + 1, b - a) END AS text FROM n JOIN r ON n.conv_id = r.conv_id AND n.run_no = r.run_no""")
def run_splits(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    runs = rows.filter("length(text) > 0").select("conv_id", F.col("turn").alias("run_no"), F.lit(5).alias("begin"), "text")
    return S.split_runs(runs, rows.select("conv_id", (F.lit(5) + F.col("turn") * 9).alias("cut")), ["conv_id"]).withColumn("piece_no", F.col("piece_no").cast("long"))


@query("SELECT c_custkey AS doc, c_name AS source_sha256, o_orderkey AS ordinal, o_orderstatus AS kind, sha256(o_orderpriority) AS sha256 FROM customer JOIN orders ON o_custkey = c_custkey")
def manifest_round_trip(spark, sf_dir):
    """Attachments written as manifests and read again."""
    a = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = a.select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("source"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("kind"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return S.load_manifest(S.manifest(a, ["doc"], "source"), ["doc"], "ordinal: bigint, kind: string, sha256: string")


@query("""WITH a AS (SELECT DISTINCT sha256(o_orderpriority) AS sha FROM orders), p AS (SELECT sha256(v) AS sha, v FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('none')) t(v) UNION ALL SELECT sha256('5-LOW'), 'damaged')
SELECT sha AS sha256, 'missing-payload' AS code FROM a ANTI JOIN p USING (sha) UNION ALL SELECT sha, 'unused-payload' FROM p ANTI JOIN a USING (sha) UNION ALL SELECT sha, 'other-bytes' FROM p WHERE sha256(v) <> sha""")
def sidecar_issues(spark, sf_dir):
    """References against a store with a payload too few, one too many and one damaged."""
    a = _t(spark, sf_dir, "orders").select(F.sha2("o_orderpriority", 256).alias("sha256"))
    p = spark.createDataFrame([("1-URGENT", "1-URGENT"), ("2-HIGH", "2-HIGH"), ("none", "none"), ("5-LOW", "damaged")], "v string, payload string").select(F.sha2("v", 256).alias("sha256"), F.encode("payload", "utf-8").alias("payload"))
    return S.manifest_issues(a, p)


@query("SELECT sha256(l_returnflag || l_linestatus) AS sha256, octet_length(encode(any_value(l_returnflag || l_linestatus))) AS size FROM lineitem GROUP BY 1")
def payload_store(spark, sf_dir):
    payload = F.encode(F.concat("l_returnflag", "l_linestatus"), "utf-8")
    objects = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.sha2(payload, 256).alias("sha256"), payload.alias("payload"))
    return S.store(objects)[0].select("sha256", F.col("size").cast("long").alias("size"))


@query("""SELECT o_orderkey, '{"ok":' || CASE WHEN o_orderstatus = 'F' THEN 'false' ELSE 'true' END || ',"command":"check","result":{"document":' || o_custkey || ',"priority":"' || o_orderpriority || '"}}' AS envelope FROM orders""")
def json_envelope(spark, sf_dir):
    result = F.struct(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("priority"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct((F.col("o_orderstatus") != "F").alias("ok"), F.lit("check").alias("command"), result.alias("result"))).alias("envelope"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey % 12 AS source, l_partkey % 12 AS target FROM lineitem WHERE l_suppkey % 12 < l_partkey % 12 OR (l_suppkey % 12 = 9 AND l_partkey % 12 = 7)), f AS (SELECT * FROM (VALUES (1, 5), (2, 3), (3, 2)) t(source, target)),
c AS (SELECT DISTINCT x.source AS s FROM e x JOIN e y ON x.target = y.source WHERE y.target = x.source UNION SELECT a.source FROM e a JOIN e b ON a.target = b.source JOIN e c ON b.target = c.source WHERE c.target = a.source)
SELECT 'forbidden-edge' AS code, source || '>' || target AS subject FROM e JOIN f USING (source, target) UNION ALL SELECT 'cycle', CAST(s AS VARCHAR) FROM c UNION ALL SELECT 'several-owners', CAST(name AS VARCHAR) FROM (SELECT s_nationkey AS name FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 3) > 1)""")
def layer_issues(spark, sf_dir):
    """Rules of a module graph: forbidden edges, cycles, names with several owners."""
    edges = _t(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 12 AS source", "l_partkey % 12 AS target").filter("source < target or (source = 9 and target = 7)")
    forbidden = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "source long, target long")
    return A.layer_issues(edges, forbidden, _t(spark, sf_dir, "supplier").selectExpr("s_nationkey AS name", "s_suppkey % 3 AS owner"))


# --- verdicts -------------------------------------------------------------------------------

#: Two renditions of a paragraph: the second differs in one thing, by the row's number.
_TEXT = "'Order ' || o_orderkey || ' of  ' || o_orderpriority"
_FIELDS_OF = {
    "text": (_TEXT, {1: f"{_TEXT} || '!'", 2: f"replace({_TEXT}, '  ', ' ')"}), "heading": ("CASE WHEN o_orderkey % 16 IN (4, 20) THEN 2 END", {3: "1", 4: "3"}), "list": ("'bullet'", {5: "'decimal'"}), "align": ("CAST(NULL AS STRING)", {6: "'center'"}), "page_break": ("false", {7: "true"}),
    "columns": ("1", {8: "2"}), "bookmarks": ("'b'", {9: "''"}), "fields": ("true", {10: "false"}), "images": ("'a.png'", {}), "math": ("1", {13: "0"}), "style": ("'Body'", {14: "'Quote'"}), "deferred": ("'10pt'", {15: "'12pt'"}), "breaks": ("0", {12: "1"}),
}
_REASONS = {0: ("identical", ""), 1: ("degradation", "text"), 2: ("degradation", "spacing"), 3: ("improvement", "heading from outline"), 4: ("degradation", "heading"), 5: ("degradation", "list"), 6: ("degradation", "align"), 7: ("degradation", "page_break"), 8: ("degradation", "columns"), 9: ("degradation", "bookmarks"), 10: ("degradation", "fields"), 11: ("degradation", "formatting"), 12: ("neutral", "breaks"), 13: ("degradation", "math"), 14: ("degradation", "style"), 15: ("deferred", "not carried")}


@query("WITH v(k, verdict, reason) AS (VALUES " + ", ".join(f"({k}, '{v}', '{r}')" for k, (v, r) in _REASONS.items()) + ") SELECT o_orderkey, verdict, reason FROM orders JOIN v ON k = o_orderkey % 16")
def paragraph_verdicts(spark, sf_dir):
    exprs = []
    for name, (old, new) in _FIELDS_OF.items():
        cases = " ".join(f"WHEN {k} THEN {x}" for k, x in new.items())
        exprs += [f"{old} AS o_{name}", f"CASE o_orderkey % 16 {cases} ELSE {old} END AS n_{name}" if cases else f"{old} AS n_{name}"]
    pairs = _t(spark, sf_dir, "orders").selectExpr("o_orderkey", *exprs, "array('http://x') AS o_links", "array('http://x', 'http://y') AS n_links", "CASE WHEN o_orderkey % 16 = 11 THEN 1 ELSE 0 END AS formats_lost", "0 AS formats_gained")
    return V.paragraph_verdicts(pairs).select("o_orderkey", "verdict", "reason")


_TABLE = {"rows": ("2", {1: "3"}), "cols": ("2", {}), "cells": ("'a|b'", {2: "'a|c'"}), "max_span": ("1", {3: "2"}), "n_merged": ("0", {}), "style": ("'Grid'", {4: "'Plain'"}), "fills": ("'FF0000'", {5: "''"}), "borders": ("true", {6: "false"}), "widths": ("100", {7: "90"}), "heights": ("10", {}), "valigns": ("'top'", {})}


@query("WITH v(k, verdict, reason) AS (VALUES (0, 'identical', ''), (1, 'degradation', 'size'), (2, 'degradation', 'cells'), (3, 'degradation', 'merges'), (4, 'degradation', 'style'), (5, 'degradation', 'fills'), (6, 'degradation', 'borders'), (7, 'deferred', 'sizes')) SELECT p_partkey, verdict, reason FROM part JOIN v ON k = p_partkey % 8")
def table_verdicts(spark, sf_dir):
    exprs = []
    for name, (old, new) in _TABLE.items():
        cases = " ".join(f"WHEN {k} THEN {x}" for k, x in new.items())
        exprs += [f"{old} AS o_{name}", f"CASE p_partkey % 8 {cases} ELSE {old} END AS n_{name}" if cases else f"{old} AS n_{name}"]
    return V.table_verdicts(_t(spark, sf_dir, "part").selectExpr("p_partkey", *exprs)).select("p_partkey", "verdict", "reason")


_NOTE = "CASE o_orderkey % 5 WHEN 0 THEN 'footnote' WHEN 1 THEN 'comment' WHEN 2 THEN 'header' WHEN 3 THEN 'noise' ELSE 'endnote' END"


@query(f"""WITH o AS (SELECT o_custkey AS doc, {_NOTE} AS kind, o_orderkey AS id, o_orderpriority AS t, o_orderkey % 11 AS r FROM orders)
SELECT doc, kind, CASE WHEN kind IN ('footnote', 'endnote', 'comment') THEN 'degradation' WHEN kind = 'noise' THEN 'noise' ELSE 'deferred' END AS verdict FROM o WHERE r IN (3, 7) GROUP BY doc, kind""")
def document_verdicts(spark, sf_dir):
    """Notes and the like against a version with some gone and some rewritten."""
    old = _t(spark, sf_dir, "orders").selectExpr("o_custkey AS doc", f"{_NOTE} AS kind", "o_orderkey AS id", "o_orderpriority AS text")
    new = old.filter("id % 11 <> 3").withColumn("text", F.when(F.col("id") % 11 == 7, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return V.document_verdicts(old, new, "doc")
