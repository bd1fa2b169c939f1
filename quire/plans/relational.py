"""Queries of the relational operators and text functions, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import aggregates as A
from quire.operators import joins as J
from quire.operators import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _esc(x: str) -> str:
    """The escape in SQL: braces are set aside first, so those that a replacement brings in stay."""
    step = f"replace(replace(replace({x}, chr(92), chr(57345)), '{{', chr(57346)), '}}', chr(57347))"
    for a, b in (("'$'", "chr(92)||'$'"), ("'&'", "chr(92)||'&'"), ("'#'", "chr(92)||'#'"), ("'_'", "chr(92)||'_'"), ("'%'", "chr(92)||'%'"), ("'~'", "chr(92)||'textasciitilde'||chr(57348)"), ("'^'", "chr(92)||'textasciicircum'||chr(57348)"), ("chr(57345)", "chr(92)||'textbackslash'||chr(57348)"), ("chr(57346)", "chr(92)||'{'"), ("chr(57347)", "chr(92)||'}'"), ("chr(57348)", "'{}'")):
        step = f"replace({step}, {a}, {b})"
    return step



@query(f"SELECT doc_id, {_esc('text')} AS escaped, md5({_esc('text')}) AS digest FROM documents")
def prose_escape_chars(spark, sf_dir):
    e = T.url_escape(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", e.alias("escaped"), F.md5(e).alias("digest"))


_PROSE = f"replace(replace(replace(replace(replace(replace({_esc('text')}, chr(8230), chr(92)||'ldots{{}}'), chr(8212), '---'), chr(8211), '--'), chr(8220), '``'), chr(8221), chr(39)||chr(39)), chr(160), '~')"


@query(f"SELECT doc_id, {_PROSE} AS escaped FROM documents")
def prose_escape(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.prose_escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '---', chr(8212)), '--', chr(8211)), '``', chr(8220)), chr(39)||chr(39), chr(8221)), '~', chr(160)) AS plain FROM documents")
def prose_unescape(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.prose_unescape(F.col("text")).alias("plain"))


@query("SELECT doc_id, text AS back FROM documents")
def url_round_trip(spark, sf_dir):
    """Unescape after escape is the text itself."""
    return _t(spark, sf_dir, "documents").select("doc_id", T.url_unescape(T.url_escape(F.col("text"))).alias("back"))


@query("""SELECT doc_id, list_aggregate(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '(^|[^\\\\])%.*$', '\\1')), 'string_agg', chr(10)) AS plain FROM documents""")
def comment_strip(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.strip_comments(F.col("text")).alias("plain"))


_STYLE = "CASE (c_custkey % 8) WHEN 0 THEN 'Title' WHEN 1 THEN 'My-Subsection' WHEN 2 THEN 'Sub Sub Section' WHEN 3 THEN 'Heading ' || (1 + c_custkey % 9) WHEN 4 THEN 'heading10' WHEN 5 THEN '' WHEN 6 THEN c_name || ' Section' END"


@query(f"""WITH s AS (SELECT c_custkey, {_STYLE} AS style FROM customer), p AS (SELECT *, regexp_replace(lower(style), '[^a-z0-9]', '', 'g') AS x FROM s)
SELECT c_custkey, style, CAST(CASE WHEN style IS NULL OR style = '' THEN NULL WHEN x LIKE '%title' THEN 0 WHEN x LIKE '%subsubsection' THEN 3 WHEN x LIKE '%subsection' THEN 2 WHEN x LIKE '%section' THEN 1
 WHEN regexp_full_match(x, 'heading[1-9]') THEN CAST(right(x, 1) AS INT) END AS INT) AS level FROM p""")
def heading_level(spark, sf_dir):
    styles = _t(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_STYLE} AS style")
    return styles.withColumn("level", T.heading_level(F.col("style")))


#: The colours as stated, apart from the engine's own table.
_COLOURS = """WHEN 'red' THEN 'FF0000' WHEN 'green' THEN '00FF00' WHEN 'blue' THEN '0000FF' WHEN 'cyan' THEN '00FFFF' WHEN 'magenta' THEN 'FF00FF' WHEN 'yellow' THEN 'FFFF00' WHEN 'black' THEN '000000' WHEN 'white' THEN 'FFFFFF'
 WHEN 'gray' THEN '808080' WHEN 'darkgray' THEN 'A9A9A9' WHEN 'lightgray' THEN 'D3D3D3' WHEN 'brown' THEN 'BF8040' WHEN 'lime' THEN 'BFFF00' WHEN 'olive' THEN '808000' WHEN 'orange' THEN 'FF8000' WHEN 'pink' THEN 'FFBFBF'
 WHEN 'purple' THEN 'BF0040' WHEN 'teal' THEN '008080' WHEN 'violet' THEN '800080'"""
_NAMES = "red green blue cyan magenta yellow black white gray darkgray lightgray brown lime olive orange pink purple teal violet".split()
_COLOUR_OF = "CASE p_partkey % 23 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES)) + " WHEN 19 THEN ' ab12Cd ' WHEN 20 THEN 'Teal' WHEN 21 THEN 'nope' ELSE '12345' END"


@query(f"""WITH c AS (SELECT p_partkey, {_COLOUR_OF} AS value, CASE WHEN p_size % 2 = 0 THEN 'html' END AS model FROM part)
SELECT p_partkey, CASE WHEN upper(trim(model)) = 'HTML' THEN CASE WHEN regexp_full_match(trim(value), '[0-9A-Fa-f]{{6}}') THEN upper(trim(value)) END
 ELSE coalesce(CASE WHEN regexp_full_match(trim(value), '[0-9A-Fa-f]{{6}}') THEN upper(trim(value)) END, CASE lower(trim(value)) {_COLOURS} END) END AS rgb FROM c""")
def colour_resolve(spark, sf_dir):
    c = _t(spark, sf_dir, "part").selectExpr("p_partkey", f"{_COLOUR_OF} AS value", "CASE WHEN p_size % 2 = 0 THEN 'html' END AS model")
    return c.select("p_partkey", T.colour(F.col("value"), F.col("model")).alias("rgb"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS present, CASE l_linenumber % 4 WHEN 0 THEN 'Off' WHEN 1 THEN '1' WHEN 2 THEN '0' END AS value FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT present THEN false WHEN value IS NULL THEN true ELSE lower(value) NOT IN ('0', 'false', 'off', 'none') END AS flag FROM s""")
def toggle_flag(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag <> 'N' AS present", "CASE l_linenumber % 4 WHEN 0 THEN 'Off' WHEN 1 THEN '1' WHEN 2 THEN '0' END AS value")
    return s.select("l_orderkey", "l_linenumber", T.toggle(F.col("present"), F.col("value")).alias("flag"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS plain, array_to_string(list_transform(regexp_extract_all(text, ' +'), lambda x: length(x)), ',') AS runs FROM documents")
def whitespace_signature(spark, sf_dir):
    runs = F.array_join(F.transform(T.space_runs(F.col("text")), lambda x: x.cast("string")), ",")
    return _t(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("plain"), runs.alias("runs"))


@query("""SELECT doc_id, length(b) - length(replace(b, chr(10), '')) + 1 AS line, length(b) - CASE WHEN contains(b, chr(10)) THEN length(b) - instr(reverse(b), chr(10)) + 1 ELSE 0 END + 1 AS col
FROM (SELECT doc_id, left(text, CAST((doc_id * 37) % (length(text) + 5) AS INT)) AS b FROM documents)""")
def offset_line_col(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("at", F.expr("(doc_id * 37) % (length(text) + 5)").cast("int"))
    line, col = T.line_column(F.col("text"), F.col("at"))
    return docs.select("doc_id", line.alias("line"), col.alias("col"))


@query("SELECT l_orderkey, l_linenumber, printf('width=%.5fbp', l_quantity * 100 / 12700.0) || ',' || printf('height=%.5fbp', l_linenumber * 1000 / 12700.0) AS options FROM lineitem")
def size_opts_format(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.size_options(F.col("l_quantity") * 100, F.col("l_linenumber") * 1000).alias("options"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_quantity AS INT) / 4.0 * CASE l_linenumber % 3 WHEN 0 THEN 360000.0 WHEN 1 THEN 12700.0 ELSE 914400.0 END, 0) AS BIGINT) AS emu FROM lineitem""")
def length_emu(spark, sf_dir):
    q = F.col("l_quantity").cast("int") / 4.0
    options = F.concat(F.lit("scale=2, width = "), F.format_string("%.2f", q), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'cm' WHEN 1 THEN 'pt' ELSE 'in' END"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.length_emu(options, "width").alias("emu"))


@query("SELECT o_orderkey, 'n' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS node FROM orders")
def node_ids(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.node_id(F.col("o_orderkey")).alias("node"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def content_digest(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang)")
def semantic_groups(spark, sf_dir):
    """Rows with an equal semantic key are equal in the columns that count."""
    keys = A.census(_t(spark, sf_dir, "documents").select(T.content_key(F.col("text"), F.col("lang")).alias("k")), ["k"])
    return keys.agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


@query("""SELECT event_id, user_id, max(before_) AS before_label, max(after_) AS after_label FROM (
SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_,
 first_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_ FROM events) GROUP BY event_id, user_id""")
def neighbour_labels(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("label", F.expr("CASE WHEN event_type <> 'view' THEN event_id END"))
    return W.neighbour_labels(rows, ["user_id"], ["ts", "event_id"], "label").select("event_id", "user_id", "before_label", "after_label")


_RUN_SQL = """SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"SELECT user_id, CAST(run AS BIGINT) AS run, event_type, string_agg(CAST(event_id AS VARCHAR), '' ORDER BY ts, event_id) AS text, count(*) AS n_parts FROM ({_RUN_SQL}) GROUP BY user_id, run, event_type")
def run_coalesce(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("text", F.col("event_id").cast("string"))
    return W.coalesced(rows, ["user_id"], ["ts", "event_id"], "event_type", "text")


@query("""SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS section FROM events""")
def backward_fill_sections(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("mark", F.expr("CASE WHEN event_type = 'purchase' THEN event_id END"))
    return W.next_value(rows, ["user_id"], ["ts", "event_id"], "mark", "section").select("event_id", "section")


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(greatest(CAST(floor(l_quantity) AS BIGINT) % 4, 1)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grid_col FROM lineitem")
def grid_columns(spark, sf_dir):
    cells = _t(spark, sf_dir, "lineitem").withColumn("span", F.floor("l_quantity") % 4)
    return W.grid_column(cells, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "span").select("l_orderkey", "l_linenumber", F.col("grid_col").cast("long").alias("grid_col"))


_MERGE = "CASE l_linestatus WHEN 'O' THEN CASE WHEN l_linenumber % 3 = 1 THEN 'restart' ELSE 'continue' END END"


@query(f"""WITH c AS (SELECT *, {_MERGE} AS merge FROM lineitem),
b AS (SELECT *, sum(CASE WHEN merge = 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS block FROM c)
SELECT l_orderkey, l_linenumber, row_span FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, block) AS row_span FROM b) WHERE merge = 'restart'""")
def merge_run_length(spark, sf_dir):
    cells = _t(spark, sf_dir, "lineitem").withColumn("merge", F.expr(_MERGE))
    return W.merge_lengths(cells, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "merge").select("l_orderkey", "l_linenumber", "row_span")


@query("SELECT lang, line, min(doc_id * 100000 + pos) AS first_at FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY lang, line")
def first_seen_dedupe(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return W.first_seen(lines.withColumn("at", F.expr("doc_id * 100000 + pos + 1")), ["lang"], "at", "line")


@query("""WITH m AS (SELECT *, CASE event_type WHEN 'click' THEN 'begin' WHEN 'purchase' THEN 'end' WHEN 'view' THEN 'separate' END AS mark FROM events),
d AS (SELECT *, sum(CASE mark WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER w AS depth, last_value(CASE WHEN mark IN ('begin', 'separate') THEN mark END IGNORE NULLS) OVER w AS lst FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(depth AS BIGINT) AS depth, CASE WHEN depth <= 0 THEN 'outside' WHEN lst = 'begin' THEN 'instruction' ELSE 'result' END AS state FROM d""")
def field_state_scan(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("mark", F.expr("CASE event_type WHEN 'click' THEN 'begin' WHEN 'purchase' THEN 'end' WHEN 'view' THEN 'separate' END"))
    return W.within_fields(rows, ["user_id"], ["ts", "event_id"], "mark").select("event_id", "depth", "state")


@query("""SELECT event_id, merged, coalesce(lag(merged) OVER w, false) AS absorbed FROM (SELECT *, event_type = 'view' AND coalesce(lead(event_type = 'click') OVER w, false) AS merged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def figure_caption_pairs(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    return W.lookahead_pairs(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click").select("event_id", "merged", "absorbed")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS label FROM orders")
def label_allocation(spark, sf_dir):
    return W.labels(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("label").cast("long").alias("label"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem")
def path_ordinals(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", W.ordinal(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).cast("long").alias("ordinal"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def dangling_refs(spark, sf_dir):
    refs = _t(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return J.dangling(refs, _t(spark, sf_dir, "customer").filter("c_acctbal > 0"), ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderpriority = '1-URGENT')")
def unreferenced_definitions(spark, sf_dir):
    refs = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").withColumn("c_custkey", F.col("o_custkey"))
    return J.unreferenced(_t(spark, sf_dir, "customer"), refs, ["c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, coalesce(n_name, c_mktsegment) AS list_format, r_name AS fallback FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def list_info_resolve(spark, sf_dir):
    """A chain of lookups with a fallback."""
    t = lambda n: _t(spark, sf_dir, n)
    orders = t("orders").withColumn("c_custkey", F.col("o_custkey"))
    nation = t("nation").filter("n_nationkey % 2 = 0").withColumn("c_nationkey", F.col("n_nationkey")).withColumn("r_regionkey", F.col("n_regionkey"))
    out = J.resolve(orders, (t("customer"), ["c_custkey"]), (nation, ["c_nationkey"]), (t("region"), ["r_regionkey"]), order={"list_format": ["n_name", "c_mktsegment"], "fallback": ["r_name"]})
    return out.select("o_orderkey", "list_format", "fallback")


@query("""WITH s AS (SELECT event_id, user_id, CAST(event_id % 500 AS BIGINT) AS b, CAST(event_id % 500 + 1 + event_id % 7 AS BIGINT) AS e, event_type FROM events)
SELECT x.event_id AS left_id, y.event_id AS right_id, greatest(x.b, y.b) AS begin_at, least(x.e, y.e) AS end_at FROM s x JOIN s y ON x.user_id = y.user_id AND x.b < y.e AND x.e > y.b WHERE x.event_type = 'click' AND y.event_type = 'view'""")
def span_overlap(spark, sf_dir):
    s = _t(spark, sf_dir, "events").selectExpr("event_id", "user_id", "CAST(event_id % 500 AS BIGINT) AS b", "CAST(event_id % 500 + 1 + event_id % 7 AS BIGINT) AS e", "event_type")
    x = s.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("left_id"), F.col("b").alias("b1"), F.col("e").alias("e1"))
    y = s.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("right_id"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    return J.overlaps(x, y, ["user_id"], ("b1", "e1"), ("b2", "e2"), bucket=16).select("left_id", "right_id", F.greatest("b1", "b2").alias("begin_at"), F.least("e1", "e2").alias("end_at"))


_MAP = "SELECT c_nationkey AS doc_id, c_custkey AS label, c_name AS latex, c_custkey AS source_order FROM customer"
#: The edited text: some blocks are gone, some moved, some rewritten, some without a label.
_EDIT = """SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 7 = 3 THEN 10000000 + c_custkey WHEN c_custkey % 5 = 1 THEN 5000000 - c_custkey ELSE c_custkey * 2 END AS seq,
 CASE WHEN c_custkey % 11 = 4 THEN NULL ELSE c_custkey END AS label, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' edited' ELSE c_name END AS latex FROM customer WHERE c_custkey % 6 <> 5"""


@query(f"""WITH m AS ({_MAP}), e0 AS ({_EDIT}),
e AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bl, first_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS al FROM e0),
s AS (SELECT e.*, m.latex AS old, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.source_order) AS op, row_number() OVER (PARTITION BY m.doc_id ORDER BY e.seq) AS np FROM m JOIN e ON m.doc_id = e.doc_id AND m.label = e.label)
SELECT doc_id, CAST(seq AS BIGINT) AS seq_key, 0 AS part, CASE WHEN latex = old THEN 'reuse' ELSE 'replace' END AS action, label, NULL AS before_label, NULL AS after_label FROM s WHERE op = np
UNION ALL SELECT doc_id, seq, 0, 'delete', label, NULL, NULL FROM s WHERE op <> np
UNION ALL SELECT doc_id, seq, 1, 'insert', label, bl, al FROM s WHERE op <> np
UNION ALL SELECT doc_id, seq, 1, 'insert', label, bl, al FROM e WHERE label IS NULL
UNION ALL SELECT doc_id, 1099511627776 + source_order, 0, 'delete', label, NULL, NULL FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = m.doc_id AND e.label = m.label)""")
def block_diff(spark, sf_dir):
    _t(spark, sf_dir, "customer").createOrReplaceTempView("quire_customer")
    block_map, edited = (spark.sql(s.replace("FROM customer", "FROM quire_customer")) for s in (_MAP, _EDIT))
    return J.block_actions(block_map, edited, ["doc_id"])


@query("""WITH e AS (SELECT o_custkey % 25 AS doc_id, o_custkey AS label FROM orders), m AS (SELECT c_nationkey AS doc_id, c_custkey AS label FROM customer)
SELECT doc_id, label, 'duplicate' AS error FROM e GROUP BY doc_id, label HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, label, 'invented' FROM e ANTI JOIN m USING (doc_id, label)""")
def label_set_checks(spark, sf_dir):
    edited = _t(spark, sf_dir, "orders").selectExpr("o_custkey % 25 AS doc_id", "o_custkey AS label")
    return J.label_errors(_t(spark, sf_dir, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS doc_id", "c_custkey AS label"), edited, ["doc_id"])


_KINDS = "CASE c_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END"


@query(f"""WITH r AS (SELECT event_id, event_type, event_id AS ord, user_id AS owner FROM events), a AS (SELECT {_KINDS} AS event_type, c_custkey * 13 AS a_ord, c_custkey AS a_owner, c_nationkey AS payload FROM customer),
p AS (SELECT event_id, CASE WHEN a_owner = owner THEN -1 ELSE abs(ord - a_ord) END AS distance, payload FROM r JOIN a USING (event_type)), q AS (SELECT *, min(distance) OVER (PARTITION BY event_id) AS d FROM p WHERE distance <= 40)
SELECT event_id, CAST(d AS BIGINT) AS distance, CASE WHEN count(DISTINCT payload) = 1 THEN min(payload) END AS payload, count(DISTINCT payload) AS n_payloads FROM q WHERE distance = d GROUP BY event_id, d""")
def nearest_attachment(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("event_id", "event_type", "event_id AS ord", "user_id AS owner")
    some = _t(spark, sf_dir, "customer").selectExpr(f"{_KINDS} AS event_type", "c_custkey * 13 AS a_ordinal", "c_custkey AS a_owner", "c_nationkey AS payload")
    return J.nearest(rows, some, ["event_type"], "ord", "owner", "payload", within=40).select("event_id", "distance", "payload", "n_payloads")


#: Chains of 200 parts; every 50th part also leads back, so there are cycles.
_EDGES = "SELECT p_partkey % 10 AS g, p_partkey AS source, p_partkey + 10 AS target FROM part WHERE p_partkey % 2000 < 1990 UNION ALL SELECT p_partkey % 10, p_partkey, p_partkey - 100 FROM part WHERE p_partkey % 500 >= 490 AND p_partkey > 500"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT p_partkey % 10 AS g, p_partkey AS root, p_partkey AS node FROM part WHERE p_partkey % 2000 BETWEEN 1 AND 10 UNION SELECT c.g, c.root, e.target FROM c JOIN e ON c.node = e.source)
SELECT g, root, node FROM c""")
def relationship_closure(spark, sf_dir):
    """Within groups, as a package's parts are."""
    _t(spark, sf_dir, "part").createOrReplaceTempView("quire_part")
    edges = spark.sql(_EDGES.replace("FROM part", "FROM quire_part"))
    roots = spark.sql("SELECT p_partkey % 10 AS g, p_partkey AS root FROM quire_part WHERE p_partkey % 2000 BETWEEN 1 AND 10")
    return J.closure_within(edges, roots, ["g"]).select("g", "root", "node")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS source, (c_nationkey * 7 + c_custkey % 3) % 25 AS target FROM customer), c AS (SELECT r_regionkey AS root, r_regionkey AS node FROM region UNION SELECT c.root, e.target FROM c JOIN e ON c.node = e.source)
SELECT root, node FROM c""")
def graph_closure(spark, sf_dir):
    """Over one graph, with cycles, by rounds."""
    edges = _t(spark, sf_dir, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS source", "CAST((c_nationkey * 7 + c_custkey % 3) % 25 AS BIGINT) AS target")
    return J.closure(edges, _t(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS root")).select("root", "node")


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 200 <> 1 THEN p_partkey - 1 END AS parent, CASE WHEN p_partkey % 400 IN (2, 170) THEN p_name END AS v FROM part),
w AS (SELECT id AS start, parent, v FROM s UNION ALL SELECT w.start, s.parent, s.v FROM w JOIN s ON w.parent = s.id WHERE w.v IS NULL)
SELECT start AS id, max(v) AS numbering FROM w GROUP BY start""")
def style_inheritance(spark, sf_dir):
    """Chains of 200 styles, of which some have no value at all."""
    s = _t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 200 <> 1 THEN p_partkey - 1 END AS parent", "CASE WHEN p_partkey % 400 IN (2, 170) THEN p_name END AS numbering")
    return J.inherited(s, "id", "parent", "numbering")


@query("SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def tag_census(spark, sf_dir):
    tags = _t(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return A.census(tags.select(F.lower("tag").alias("tag")), ["tag"])


@query("""WITH a AS (SELECT event_type, user_id % 20 AS u, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT event_type, user_id % 20 AS u, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.u, b.u) AS u, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS gained
FROM a FULL JOIN b ON a.event_type = b.event_type AND a.u = b.u WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_difference(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 20)
    return A.multiset_difference(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["event_type", "u"])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS at_ FROM events GROUP BY user_id, event_type)
SELECT user_id, arg_max(event_type, {'n': n, 'a': -at_}) AS event_type, max(n) AS n FROM c GROUP BY user_id""")
def mode_first_seen(spark, sf_dir):
    return A.first_mode(_t(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return A.duplicates(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<(/?[a-z]+)', 1)) AS t FROM pages), k AS (SELECT page_id, ltrim(t, '/') AS tag, CASE WHEN t LIKE '/%' THEN 'end' ELSE 'start' END AS kind FROM m)
SELECT page_id, tag, count(*) FILTER (kind = 'start') AS n_start, count(*) FILTER (kind = 'end') AS n_end FROM k GROUP BY ALL HAVING n_start <> 1 OR n_end <> 1""")
def balanced_pairs(spark, sf_dir):
    m = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(/?[a-z]+)"), F.lit(1))).alias("t"))
    m = m.select("page_id", F.regexp_replace("t", "^/", "").alias("tag"), F.when(F.col("t").startswith("/"), "end").otherwise("start").alias("kind"))
    return A.unbalanced(m, ["page_id", "tag"], "kind")


@query("""WITH r(feature, package) AS (VALUES ('en', 'babel'), ('de', 'babel'), ('de', 'ngerman'), ('fr', 'xspace'), ('es', 'secret'))
SELECT source, array_to_string(list_sort(coalesce(list(DISTINCT package) FILTER (package IN ('babel', 'ngerman', 'xspace')), [])), ',') AS packages FROM documents LEFT JOIN r ON lang = feature GROUP BY source""")
def required_packages_set(spark, sf_dir):
    needs = spark.createDataFrame([("en", "babel"), ("de", "babel"), ("de", "ngerman"), ("fr", "xspace"), ("es", "secret")], "feature string, package string")
    uses = _t(spark, sf_dir, "documents").withColumn("feature", F.col("lang"))
    return A.required(uses, needs, ["source"], ["babel", "ngerman", "xspace"]).select("source", F.array_join("packages", ",").alias("packages"))


@query("SELECT event_type, coalesce(sum(round_even(value, 0)), 0) AS total, sum(round_even(value, 0)) / count(value) AS average, max(round_even(value, 0)) AS worst FROM events GROUP BY event_type")
def timing_rollup(spark, sf_dir):
    """Whole seconds, so that sums don't depend on their order."""
    rows = _t(spark, sf_dir, "events").withColumn("s", F.bround(F.col("value"), 0))
    return A.timing_rollup(rows, "event_type", "s").select("event_type", "total", "average", "worst")


@query("""WITH a AS (SELECT user_id, count(*) / 8.0 AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) / 8.0 AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, round(b.v, 2) AS now, round(a.v, 2) AS before FROM a JOIN b USING (user_id) WHERE round(b.v, 2) > round(a.v, 2)""")
def regression_compare(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    side = lambda k: e.filter(f"event_id % 2 = {k}").groupBy("user_id").agg((F.count(F.lit(1)) / 8.0).alias("v"))
    return A.rises(side(0), side(1), "user_id", "v")


@query("SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def topk_per_leg(spark, sf_dir):
    top = A.top_k(_t(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.asc("event_id")], 5)
    return top.select("event_type", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 6")
def largest_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(6)


@query("""WITH c AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 5)
SELECT value, CAST(n AS BIGINT) AS n, 1 AS kinds FROM t UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), count(*) FROM c WHERE value NOT IN (SELECT value FROM t) HAVING count(*) > 0""")
def backlog_top(spark, sf_dir):
    c = A.census(_t(spark, sf_dir, "documents").select(F.col("source").alias("value")), ["value"])
    return A.head_and_rest(c, "value", "n", 5)


@query("""WITH v(event_type, bucket) AS (VALUES ('click', 'handled'), ('view', 'handled'), ('purchase', 'deferred'))
SELECT coalesce(bucket, 'unknown') AS bucket, count(*) AS n, count(DISTINCT e.event_type) AS kinds FROM events e LEFT JOIN v ON e.event_type = v.event_type GROUP BY 1""")
def coverage_buckets(spark, sf_dir):
    v = spark.createDataFrame([("click", "handled"), ("view", "handled"), ("purchase", "deferred")], "event_type string, bucket string")
    return A.coverage(_t(spark, sf_dir, "events"), v, "event_type")


_PAIR = "SELECT o_orderkey, o_custkey % 10 AS kind, o_orderkey % 7 = 0 AS same, o_orderkey % 5 = 0 AS text_same, o_orderkey % 3 = 0 AS style_same, o_orderstatus = 'P' AS improved FROM orders"
_VERDICT = "CASE WHEN same THEN 'identical' WHEN NOT text_same AND improved THEN 'improvement' WHEN NOT text_same THEN 'degradation' WHEN NOT style_same THEN 'deferred' ELSE 'neutral' END"


@query(f"SELECT kind, " + ", ".join(f"count(*) FILTER (v = '{v}') AS {v}" for v in A.VERDICTS) + f" FROM (SELECT kind, {_VERDICT} AS v FROM ({_PAIR})) GROUP BY kind")
def verdict_rollup(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("quire_orders")
    pairs = spark.sql(_PAIR.replace("FROM orders", "FROM quire_orders"))
    c = F.col
    v = A.verdict((c("same"), "identical"), (~c("text_same") & c("improved"), "improvement"), (~c("text_same"), "degradation"), (~c("style_same"), "deferred"), default="neutral")
    return A.verdict_rollup(pairs.withColumn("verdict", v), ["kind"])


@query("SELECT c_nationkey AS doc_id, string_agg(chr(92) || CASE WHEN c_custkey % 2 = 0 THEN 'section{' ELSE 'subsection{' END || c_name || '}', chr(10) ORDER BY c_custkey) AS latex FROM customer GROUP BY c_nationkey")
def derive_headings(spark, sf_dir):
    head = F.concat(F.lit("\\"), F.when(F.col("c_custkey") % 2 == 0, "section{").otherwise("subsection{"), "c_name", F.lit("}"))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.struct("c_custkey", head.alias("t")).alias("s"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n").alias("latex"))


@query("SELECT part_, code, detail FROM (SELECT o_orderstatus AS part_, o_orderpriority AS code, CAST(o_custkey % 3 AS VARCHAR) AS detail FROM orders) GROUP BY ALL ORDER BY ALL")
def issue_order(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("part_"), F.col("o_orderpriority").alias("code"), (F.col("o_custkey") % 3).cast("string").alias("detail"))
    return rows.distinct().orderBy("part_", "code", "detail")


#: Column specs with number of columns, bars at both edges, bars within.
_SPECS = [("| l c r |", 3, True, False), ("l|c", 2, False, True), ("rr", 2, False, False), ("|c|c|", 2, True, True), ("|l", 1, False, False), ("", 0, False, False), ("l || r", 2, False, True)]


@query("WITH v(k, n, e, i) AS (VALUES " + ", ".join(f"({k}, {n}, {e}, {i})" for k, (_, n, e, i) in enumerate(_SPECS)) + f") SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS n_columns, bool_or(e) AS edges, bool_or(i) AS inner_bars FROM lineitem JOIN v ON k = l_partkey % {len(_SPECS)} GROUP BY l_orderkey")
def table_rules(spark, sf_dir):
    spec = F.element_at(F.array(*[F.lit(x[0]) for x in _SPECS]), (F.col("l_partkey") % len(_SPECS) + 1).cast("int"))
    n, edge, inner = T.column_spec(spec)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), edge.alias("e"), inner.alias("i")).groupBy("l_orderkey").agg(F.sum("n").alias("n_columns"), F.bool_or("e").alias("edges"), F.bool_or("i").alias("inner_bars"))
