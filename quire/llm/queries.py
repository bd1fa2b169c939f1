"""The registered queries of the pipeline operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, bpe_encode, decontaminate, exact_dedup, langid, minhash_forest, quality_rules, secrets, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(_table(spark, sf_dir, "documents")).withColumnRenamed("text_digest", "text_sha256")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode.digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("log_odds")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.withColumn("held_out", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _spans_sql() -> str:
    """Spans of every rule: begin, rank and finish from the texts between matches and the matches' lengths."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rank, rule in enumerate((*secrets.BASE, *secrets.EXTRA)):
        p = quoted(rule.pattern)
        parts.append(f"""SELECT doc_id, {rank} AS rank, {quoted(rule.kind)} AS kind, {rule.least} AS least, string_split_regex(t, {p}) AS a, regexp_extract_all(t, {p}, 0) AS b, regexp_extract_all(t, {p}, {rule.group}) AS c FROM d""")
    return " UNION ALL ".join(parts)


def _url_sql() -> str:
    """Rules, then the ratio of the two character models: n-grams of each size with the sums of their contexts, smoothed from the shortest on."""
    order, signs = url_filter.ORDER, url_filter.SIGNS
    fits = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(url_filter.RULES, key=lambda r: -len(r[1])))
    of = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in url_filter.RULES)
    tables, joins, logs = [], [], {1: f"{1 / signs!r}", 0: f"{1 / signs!r}"}
    for size in range(1, order + 2):
        tail, head = (f"substr(gram, {order + 2 - size}, {n})" for n in (size, size - 1))
        tables.append(f"g{size} AS (SELECT {tail} AS g, any_value({head}) AS c, sum(n1) AS n1, sum(n0) AS n0 FROM counts GROUP BY 1)")
        tables.append(f"c{size} AS (SELECT c, sum(n1) AS t1, sum(n0) AS t0, count(*) FILTER (n1 > 0) AS k1, count(*) FILTER (n0 > 0) AS k0 FROM g{size} GROUP BY c)")
        joins.append(f"LEFT JOIN g{size} ON g{size}.g = {tail} LEFT JOIN c{size} ON c{size}.c = {head}")
        for k, p in logs.items():
            n, t, kinds = f"coalesce(g{size}.n{k}, 0)", f"coalesce(c{size}.t{k}, 0)", signs if size == 1 else f"coalesce(c{size}.k{k}, 0)"
            logs[k] = f"CASE WHEN {t} + {kinds} > 0 THEN ({n} + {kinds} * {p}) / CAST({t} + {kinds} AS DOUBLE) ELSE {p} END"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS after FROM pages),
h AS (SELECT page_id, u, translate(regexp_extract(after, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE {fits} END AS rule FROM h),
d AS (SELECT u, any_value(rule) AS rule, count(*) AS n, '{'^' * order}' || regexp_replace(regexp_replace(lower(u), '[0-9]', '0', 'g'), '[^a-z0./\\-_?=&%#:~+@]', '*', 'g') AS s FROM r GROUP BY u),
x AS (SELECT u, n, CASE rule {of} END AS v, unnest(list_transform(range(1, length(s) - {order - 1}), lambda k: substr(s, k, {order + 1}))) AS gram FROM d),
counts AS (SELECT gram, CAST(sum(CASE WHEN v = 'allow' THEN n ELSE 0 END) AS DOUBLE) AS n1, CAST(sum(CASE WHEN v = 'block' THEN n ELSE 0 END) AS DOUBLE) AS n0 FROM x WHERE v IS NOT NULL GROUP BY gram),
{", ".join(tables)},
w AS (SELECT DISTINCT gram FROM x), ratio AS (SELECT gram, ln({logs[1]}) - ln({logs[0]}) AS d FROM w {" ".join(joins)}),
scores AS (SELECT u, any_value(v) AS v, any_value(n) AS n, avg(d) AS score FROM x JOIN ratio USING (gram) GROUP BY u),
m AS (SELECT v, sum(n) AS w, sum(n * score) / sum(n) AS m, sum(n * score * score) / sum(n) AS q FROM scores WHERE v IS NOT NULL GROUP BY v),
f AS (SELECT a.m AS am, b.m AS bm, greatest((a.w * greatest(0, a.q - a.m * a.m) + b.w * greatest(0, b.q - b.m * b.m)) / (a.w + b.w), 1e-9) AS pooled FROM m a, m b WHERE a.v = 'allow' AND b.v = 'block')
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {of} END WHEN (am - bm) / pooled * (score - (am + bm) / 2) < 0 THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN scores ON r.u = scores.u LEFT JOIN f ON true"""


SQL = {
    "op3_url_filter": _url_sql(),
    "op2_minhash_forest": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, link.b FROM c JOIN link ON c.b = link.a),
r AS (SELECT a, min(b) AS root FROM c GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN r ON doc_id = a""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS head FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - k % 4 * 5 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM f""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op9_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_spans_sql()}),
k AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM m WHERE len(b) > 0),
e AS (SELECT doc_id, rank, kind, least, length(b[i]) AS size, length(c[i]) AS inner_size, CAST(list_sum(list_transform(a[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(b[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS begin_at FROM k),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
 string_agg(kind || ':' || begin_at || ':' || (begin_at + size), ',' ORDER BY begin_at, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || begin_at || ':' || (begin_at + size), ',' ORDER BY begin_at, rank) AS every
 FROM e WHERE inner_size >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (doc_id)""",
}
