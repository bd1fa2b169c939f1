"""URL filters: host rules, and a character language-model ratio for what no rule decides.

URLs that a rule allows and URLs that a rule blocks train two variable-order Markov models over
characters: contexts of up to ORDER characters, every order smoothed with the next shorter one
by the number of kinds that followed it (Witten-Bell), the shortest with one count for each sign
of the alphabet. A URL's score is the difference of the two log-likelihoods, divided by its
length; scores of the training URLs give the line between the classes, in log-odds: the two
class means and their pooled variance. Only DataFrame and SQL operations are used.

Characters outside a fixed alphabet are one sign, digits another, so there are at most
SIGNS ** (ORDER + 1) distinct n-grams, whatever the corpus; their table is sent to all tasks only
while it has at most SENT rows, else joined.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule, and is
scored on what text it has. A rule fits its host and subdomains where the path starts with the
rule's; the longest rule wins. If no URL is allowed by rule, or none blocked, the models decide
nothing and the verdict is allow; log-odds of 0 are allowed. Repeated rows each get a row, null
ids too; an empty table gives an empty result; other columns are not looked at. A long URL is
scored whole: it has one row for each of its characters while it is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stage

ORDER, SENT = 3, 200_000
#: Letters, one sign for digits, the punctuation below, one for the rest, and the start.
PUNCTUATION = "./-_?=&%#:~+@"
SIGNS = 26 + 1 + len(PUNCTUATION) + 2
#: (verdict, rule): the host up to the first slash, then the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    text = F.coalesce(url, F.lit(""))
    after = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(raw), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct (verdict, rule), or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, _, under = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{under}")
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def signs(url: Column) -> Column:
    """The URL over the model's alphabet, with ORDER start signs."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[0-9]", "0"), r"(?s)[^a-z0./\-_?=&%#:~+@]", "*")
    return F.concat(F.lit("^" * ORDER), text)


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of column s: gram, the character with its ORDER predecessors."""
    at = F.sequence(F.lit(1), F.length("s") - ORDER)
    return urls.filter(F.length("s") > ORDER).select(*keep, F.explode(F.transform(at, lambda k: F.substring(F.col("s"), k, F.lit(ORDER + 1)))).alias("gram"))


def log_ratio(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """counts: (gram, n1, n0) of accepted and rejected URLs; wanted: (gram). Gives (gram, d): log-probability of the gram's last character under the first model less that under the second."""
    out = wanted
    for size in range(1, ORDER + 2):
        tail, head = F.substring("gram", ORDER + 2 - size, size), F.substring("gram", ORDER + 2 - size, size - 1)
        sums = counts.groupBy(tail.alias(f"g{size}"), head.alias(f"c{size}")).agg(*[F.sum(f"n{c}").alias(f"n{c}_{size}") for c in (1, 0)])
        each = [f(c) for c in (1, 0) for f in (lambda c: F.sum(f"n{c}_{size}").alias(f"t{c}_{size}"), lambda c: F.count_if(F.col(f"n{c}_{size}") > 0).alias(f"k{c}_{size}"))]
        context = sums.groupBy(f"c{size}").agg(*each)
        out = out.withColumns({f"g{size}": tail, f"c{size}": head})
        out = out.join(sums.drop(f"c{size}"), f"g{size}", "left").join(context, f"c{size}", "left")
    logs = []
    for c in (1, 0):
        p = F.lit(1 / SIGNS)
        for size in range(1, ORDER + 2):
            n, total, kinds = (F.coalesce(F.col(f"{x}{c}_{size}"), F.lit(0)) for x in "ntk")
            kinds = F.lit(SIGNS) if size == 1 else kinds
            p = F.when(total + kinds > 0, (n + kinds * p) / (total + kinds)).otherwise(p)
        logs.append(F.ln(p))
    return out.select("gram", (logs[0] - logs[1]).alias("d"))


def scored(urls: DataFrame) -> DataFrame:
    """urls: distinct (q_url, n, verdict); verdict is the rule's or null. Gives (q_url, log_odds), null without training URLs of both kinds."""
    urls = urls.withColumn("s", signs(F.col("q_url")))
    known = _grams(urls.filter("verdict is not null"), "verdict", "n")
    counts = stage(known.groupBy("gram").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(f"n{c}") for c, v in ((1, "allow"), (0, "block"))]), "url-counts")
    ratio = stage(log_ratio(counts, _grams(urls).distinct()), "url-ratio")
    ratio = F.broadcast(ratio) if ratio.count() <= SENT else ratio
    scores = stage(_grams(urls, "q_url", "verdict", "n").join(ratio, "gram").groupBy("q_url", "verdict", "n").agg(F.avg("d").alias("score")), "url-scores")
    found = {r["verdict"]: r for r in scores.filter("verdict is not null").groupBy("verdict").agg(F.sum("n").alias("w"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("m"), (F.sum(F.col("n") * F.col("score") ** 2) / F.sum("n")).alias("q")).collect()}
    if len(found) < 2:
        return scores.select("q_url", F.lit(None).cast("double").alias("log_odds"))
    a, b = found["allow"], found["block"]
    pooled = sum(x["w"] * max(0.0, x["q"] - x["m"] ** 2) for x in (a, b)) / (a["w"] + b["w"])
    slope = (a["m"] - b["m"]) / max(pooled, 1e-9)
    return scores.select("q_url", (F.lit(slope) * (F.col("score") - (a["m"] + b["m"]) / 2)).alias("log_odds"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, log_odds (null where a rule decides)."""
    rows = pages.select(F.col(id_col).alias("q_id"), F.coalesce(F.col(url_col), F.lit("")).alias("q_url"))
    host, path = host_path(F.col("q_url"))
    urls = rows.groupBy("q_url").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", rule_of(host, path, rules)["verdict"])
    odds = scored(stage(urls, "url-distinct"))
    # URLs without a character have no score: they get keys that meet nothing, so that they don't all go to one task
    key = F.when(F.col("q_url") == "", F.concat(F.lit("\0"), F.pmod(F.xxhash64("q_id"), F.lit(4096)).cast("string"))).otherwise(F.col("q_url"))
    rows = rows.withColumn("q_key", key).join(odds.withColumnRenamed("q_url", "q_key"), "q_key", "left").withColumns({"host": host, "path": path})
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("log_odds") < 0, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(F.col("q_id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("hit").isNull(), F.col("log_odds")).alias("log_odds"))
