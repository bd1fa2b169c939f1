"""Quality classifier: a sparse ensemble of rules.

Statistics of every whole text (one pass, vectorised per task) become columns. Gradient-boosted
trees of depth 3 on labelled rows propose rules: every path from a root is a conjunction of
bounds on statistics. A lasso-penalised logistic regression weighs the rules and drops most.
What remains is compiled into Spark column expressions over the statistics, so scoring runs
inside generated code and the model can be read.

Documented bound: the model is fitted on at most SAMPLE labelled rows, those of the lowest
hashes of their id.

Defined results: null text has the statistics of the empty text and is scored as such. Rows
with a null label aren't learned from; several labels of one document count one by one. Without
labelled rows, or with one class only, every score is that class's share (0.5 without any).
Repeated rows are scored row by row; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, blocks, spread, stage, text_bytes
from .texthash import words

SAMPLE, ROUNDS, DEPTH, BINS, LEAST_ROWS = 20_000, 30, 3, 32, 10
PENALTY, STEPS, SHRINK = 5e-4, 400, 0.3
STATS = ["n_bytes", "n_words", "word_bytes", "word_spread", "upper", "digit", "blank", "sign", "odd_sign", "sentence_sign", "bar", "high", "distinct_words", "top_word", "repeat_next", "distinct_pairs", "n_lines", "line_words", "distinct_lines", "short_lines", "ended_lines", "signed_words", "upper_words"]
_KIND = {
    "upper": [range(65, 91)], "digit": [range(48, 58)], "blank": [(9, 10, 11, 12, 13, 32)],
    "sign": [range(33, 48), range(58, 65), range(91, 97), range(123, 127)], "odd_sign": [b"#$%&*@^~+=<>\\_{}"],
    "sentence_sign": [b".,;:?"], "bar": [b"|"], "high": [range(128, 256)],
}


def _table(name: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for some in _KIND[name]:
        out[list(some)] = True
    return out


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all rows start and end."""
    inside = ~_table("blank")[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATS)))
    col = {s: out[:, k] for k, s in enumerate(STATS)}
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    size = np.diff(offsets)
    per = np.maximum(1, size)
    col["n_bytes"][:] = size
    for name in _KIND:
        s = sums(_table(name)[data])
        col[name][:] = (s[offsets[1:]] - s[offsets[:-1]]) / per
    (hashes, _), rows = words(data, offsets)
    starts, ends = _bounds(data, offsets)
    count = np.diff(rows)
    many = np.maximum(1, count)
    col["n_words"][:] = count
    length = sums(ends - starts).astype(float)
    square = sums((ends - starts).astype(float) ** 2)
    mean = (length[rows[1:]] - length[rows[:-1]]) / many
    col["word_bytes"][:] = mean
    col["word_spread"][:] = np.sqrt(np.maximum(0, (square[rows[1:]] - square[rows[:-1]]) / many - mean**2))
    last = data[np.maximum(0, ends - 1)] if len(data) else data
    odd = sums((_table("odd_sign") | (np.arange(256) == 33))[last] if len(ends) else [])
    col["signed_words"][:] = (odd[rows[1:]] - odd[rows[:-1]]) / many
    big = sums(_table("upper")[data])
    loud = sums(big[ends] - big[starts] >= np.maximum(2, (ends - starts + 1) // 2)) if len(ends) else np.zeros(1)
    col["upper_words"][:] = (loud[rows[1:]] - loud[rows[:-1]]) / many
    breaks = np.flatnonzero(data == 10)
    for k in range(n):
        w = hashes[rows[k] : rows[k + 1]]
        if len(w):
            _, each = np.unique(w, return_counts=True)
            col["distinct_words"][k] = len(each) / len(w)
            col["top_word"][k] = each.max() / len(w)
            col["repeat_next"][k] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
            pairs = w[1:] * np.uint64(3) + w[:-1]
            col["distinct_pairs"][k] = len(np.unique(pairs)) / max(1, len(pairs)) if len(w) > 1 else 1
        a, b = offsets[k], offsets[k + 1]
        cut = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)]
        edges = np.concatenate([[a - 1], cut, [b]])
        w0 = np.searchsorted(starts, edges)
        each = np.diff(w0)
        full = np.flatnonzero(each)
        if len(full):
            col["n_lines"][k], col["line_words"][k] = len(full), each[full].mean()
            col["short_lines"][k] = (each[full] < 3).mean()
            ends_at = last[w0[full + 1] - 1]
            col["ended_lines"][k] = np.isin(ends_at, [46, 33, 63, 58, 34]).mean()
            raw = data[a:b].tobytes().split(b"\n")
            col["distinct_lines"][k] = len(set(raw)) / len(raw)
    return out


def _stats(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
        every = np.concatenate([*parts, np.zeros((0, len(STATS)))])
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(every[:, k].astype(np.float32)) for k in range(len(STATS))]], names=["q_id", *STATS])


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(q_id, STATS) of every row."""
    arrow_session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text")))
    return rows.mapInArrow(_stats, f"q_id {kind}, " + ", ".join(f"{s} float" for s in STATS))


#: A rule: (statistic, above, bound) conditions that all hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self) -> Column:
        """The probability as an expression over the columns STATS."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            hold = F.lit(True)
            for name, above, bound in rule:
                value = F.col(name)
                hold = hold & ((value > bound) if above else (value <= bound))
            total = total + F.when(hold, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def values(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, bound in rule:
        value = x[:, STATS.index(name)]
        out &= (value > bound) if above else (value <= bound)
    return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> list[tuple[Rule, np.ndarray, float]]:
    """Nodes of one tree grown by second-order gain: (path, rows, value)."""
    out, todo = [], [((), np.arange(len(binned)))]
    while todo:
        path, rows = todo.pop()
        g, h = gradient[rows], hessian[rows]
        out.append((path, rows, -g.sum() / (h.sum() + 1)))
        if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
            continue
        best = (1e-3, -1, -1)
        for k in range(binned.shape[1]):
            b = binned[rows, k]
            gs, hs, n = (np.cumsum(np.bincount(b, w, BINS))[:-1] for w in (g, h, None))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = -1
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), -k, at))
        if best[1] == -1 and best[2] == -1:
            continue
        k, at = -best[1], best[2]
        left = binned[rows, k] <= at
        for side, above in ((left, False), (~left, True)):
            todo.append(((*path, (STATS[k], above, float(edges[k][at]))), rows[side]))
    return out


def _merged(path: Rule) -> Rule:
    """Of conditions on the same side of a statistic only the tightest."""
    held: dict[tuple[str, bool], float] = {}
    for name, above, bound in path:
        old = held.get((name, above))
        held[name, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return tuple(sorted((n, a, b) for (n, a), b in held.items()))


def fit(x: np.ndarray, y: np.ndarray) -> RuleSet:
    """x: rows of STATS, y: labels 0 and 1."""
    x = x.astype(np.float32)
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        p = min(1 - 1e-6, max(1e-6, share))
        return RuleSet((), float(np.log(p / (1 - p))))
    edges = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        edges.append(np.concatenate([q, np.full(BINS - 1 - len(q), np.inf)]).astype(np.float32))
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    margin, found = np.full(len(y), np.log(share / (1 - share))), set()
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        nodes = _tree(binned, edges, p - y, p * (1 - p))
        inner = {path[:-1] for path, _, _ in nodes if path}
        for path, rows, value in nodes:
            if path and all(np.isfinite(b) for _, _, b in path):
                found.add(_merged(path))
            if path not in inner:
                margin[rows] += SHRINK * value
    rules = sorted(found)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    weight, bias = lasso(z, y)
    return RuleSet(tuple((r, float(w)) for r, w in zip(rules, weight, strict=True) if w), float(bias))


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights under an absolute penalty, by accelerated proximal steps; the bias is free."""
    n = len(y)
    full = np.concatenate([z, np.ones((n, 1), np.float32)], axis=1)
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (full @ v)
        norm = np.linalg.norm(v)
        v = v / norm
    step = 4 * n / norm
    w = np.zeros(full.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(full @ ahead)))
        new = ahead - step * (full.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * PENALTY)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    return w[:-1], w[-1]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> RuleSet:
    """table: what stats() gives. Learns from labelled rows that are not held out."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("q_lid"), F.col(label_col).cast("double").alias("q_y"))
    sample = known.withColumn("q_h", F.xxhash64("q_lid")).orderBy("q_h", "q_lid", "q_y").limit(SAMPLE)
    rows = table.join(sample, F.col("q_id") == F.col("q_lid"))  # more than the sample where ids of documents repeat
    got = rows.orderBy("q_h", "q_lid", "q_y", *STATS).limit(SAMPLE).select("q_lid", "q_y", *STATS).toArrow()
    x = np.stack([got.column(s).to_numpy() for s in STATS], axis=1)
    y, ids = got.column("q_y").to_numpy(), got.column("q_lid").to_numpy()
    order = np.lexsort((*x.T, y, ids))
    return fit(x[order], (y[order] > 0).astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row."""
    table = stage(stats(docs, id_col, text_col), "quality-stats")
    rules = train(table, labels, id_col, label_col)
    out = table.select(F.col("q_id").alias(id_col), F.coalesce(held_out(F.col("q_id")), F.lit(False)).alias("held_out"), rules.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
