"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

The benchmark is the stated query set. Its different texts are taken in blocks of bounded bytes,
each small enough to go to every task; repeats of a text cost a row of a join with the results.
All word n-grams of an item are its seeds, however often they occur (seeds that are rare in the
corpus only, as the method has it, lose a passage whose own n-grams are all frequent: a leak into
very many documents hides itself), so what is found in a document doesn't depend on the others.
One pass over the documents for each block finds the seeds, joins the passage around them to the
item, and aligns the two locally: a match counts 1, a mismatch or gap -1, and the score is the
best alignment's sum over the item's words. A passage with fewer words of the item than the least
sum can't reach it and isn't aligned. No corpus row is shuffled or collected.

A passage is contaminated from a score of LEAST and a sum of LEAST_WORDS on (all words of a
shorter item), or from a sum of ENOUGH_WORDS on, whatever the item's length.

Words are runs of letters and digits, lower-cased, so changed case and signs don't matter.

Defined results: null or empty texts and items without words match nothing; an item of fewer
words than an n-gram has its whole sequence as its only seed; repeated items and rows each give
their own result rows; items of fewer than LEAST_WORDS words are reported by ``find``, but no
document is dropped for them by ``clean``, as so few words are no evidence; of several passages
of one item in a document the best is reported, by score, then seeds, then the earlier; a null id
is carried as it is; empty tables give no rows; other columns are not looked at. An alignment
costs the item's words times those of its passage, whatever the
document's length; its memory follows the passage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, blocks, spread, stage, text_bytes
from .texthash import SIGNLESS, grams, words

GRAM = 3
#: Least score of a contaminated passage (an item's own text scores 1), and least sum, unless the item is shorter.
LEAST, LEAST_WORDS = 0.4, 6
#: A sum that is evidence enough for an item of any length.
ENOUGH_WORDS = 50
#: Bytes of benchmark text in a block; a task holds about four times as much.
BLOCK = 8 << 20


@dataclass
class Items:
    """A block of benchmark items: keys of the texts, word hashes of each, and its n-grams (sorted hash, item, place)."""

    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Items:
        own, keys, item, place = [], [], [], []
        for k, (_, text) in enumerate(rows):
            hashes = _words(pa.array([text], pa.string()))[0]
            own.append(hashes)
            g = grams(hashes, min(GRAM, len(hashes))) if len(hashes) else hashes
            keys.append(g)
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        keys, item, place = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, item, place))
        order = np.argsort(keys, kind="stable")
        return cls([r[0] for r in rows], own, keys[order], item[order].astype(np.int32), place[order].astype(np.int32))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the n+1 offsets of the rows in them."""
    data, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    (hashes, _), rows = words(data, offsets, SIGNLESS)
    return hashes, rows


def _sizes(items: Items) -> list[int]:
    """Sizes that n-grams have: GRAM, and those of shorter items."""
    return sorted({min(GRAM, len(w)) for w in items.words if len(w)})


def _grams(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that lie in one row, and their places."""
    every = grams(hashes, size)
    row = np.searchsorted(rows, np.arange(len(every)), side="right")
    good = np.arange(len(every)) + size <= rows[np.minimum(row, len(rows) - 1)]
    at = np.flatnonzero(good)
    return every[at], at


def _found(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of some are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(some), bool)
    return keys[np.minimum(np.searchsorted(keys, some), len(keys) - 1)] == some


def _parts(column: pa.Array):
    _, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        yield column.slice(a, b - a)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment sum of each item with its window of words, and the window place where it ends: all pairs at once, row by row.

    A gap in the window is a running maximum: H[j] = max over k <= j of (H'[k] - (j - k))."""
    n, w = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), n), np.uint64), np.zeros((len(items), w), np.uint64)
    real = np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)], real[k, : len(y)] = x, y, True
    sizes, step = np.array([len(x) for x in items]), np.arange(w, dtype=np.int32)
    last, best, end = np.zeros((len(items), w), np.int32), np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(n):
        now = np.where((b == a[:, i, None]) & real, np.int32(1), np.int32(-1))
        now[:, 1:] += last[:, :-1]
        np.maximum(now, last - 1, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + step, axis=1) - step
        now[sizes <= i] = 0
        top = now.argmax(axis=1)
        value = now[np.arange(len(items)), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        last = now
    return best, end


def _passages(hashes: np.ndarray, rows: np.ndarray, seeds: Items):
    """(text number, item, first and end word of the passage, seeds in it): seed hits of a text and item whose diagonals lie together."""
    text, item, diagonal = [], [], []
    for size in _sizes(seeds):
        g, at = _grams(hashes, rows, size)
        hit = np.flatnonzero(_found(seeds.keys, g))
        low, high = np.searchsorted(seeds.keys, g[hit]), np.searchsorted(seeds.keys, g[hit], side="right")
        k = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        place = np.repeat(at[hit], high - low)
        fits = np.array([min(GRAM, len(w)) for w in seeds.words], np.int64)[seeds.item[k]] == size
        k, place = k[fits], place[fits]
        text.append(np.searchsorted(rows, place, side="right") - 1)
        item.append(seeds.item[k].astype(np.int64))
        diagonal.append(place - seeds.place[k])
    if not text:
        return
    text, item, diagonal = (np.concatenate(x) for x in (text, item, diagonal))
    if not len(text):
        return
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal = text[order], item[order], diagonal[order]
    length = np.array([len(w) for w in seeds.words], np.int64)
    slack = np.maximum(4, length[item] // 2)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(text)), strict=True):
        t, i = int(text[a]), int(item[a])
        first = max(int(rows[t]), int(diagonal[a] - slack[a]))
        yield t, i, first, min(int(rows[t + 1]), int(diagonal[b - 1] + length[i] + slack[a])), b - a


def _enough(passage: tuple, hashes: np.ndarray, items: Items, least: float) -> bool:
    """Whether the passage has as many words of its item as the least sum: an alignment's sum is at most its matches."""
    own, window = items.words[passage[1]], hashes[passage[2] : passage[3]]
    return _reaches(min(len(own), int(np.isin(window, own).sum())), len(own), least)


def _reaches(total: int, size: int, least: float) -> bool:
    """Whether an alignment's sum is evidence for an item of so many words."""
    return (total / size >= least and total >= min(LEAST_WORDS, size)) or total >= ENOUGH_WORDS


def _hits(column: pa.Array, seeds: Items, least: float):
    """(row, item, score, seeds, first word, end word) of the contaminated rows: the best passage of each row and item."""
    start = 0
    for part in _parts(column):
        hashes, rows = _words(part)
        found = [x for x in _passages(hashes, rows, seeds) if _enough(x, hashes, seeds, least)]
        found.sort(key=lambda x: (len(seeds.words[x[1]]), x[3] - x[2]))
        best: dict[tuple[int, int], tuple] = {}
        for at in range(0, len(found), 128):
            some = found[at : at + 128]
            for one in ([some] if max(x[3] - x[2] for x in some) < 4096 else [[x] for x in some]):
                score, end = align([seeds.words[x[1]] for x in one], [hashes[x[2] : x[3]] for x in one])
                for x, s, e in zip(one, score.tolist(), end.tolist(), strict=True):
                    size = len(seeds.words[x[1]])
                    if _reaches(s, size, least):
                        best[x[:2]] = max(best.get(x[:2], (0,)), (s / size, int(x[4]), -x[2], x[2] + e + 1))
        for (t, i), (share, n, first, end) in sorted(best.items()):
            yield start + t, i, share, n, -first - int(rows[t]), end - int(rows[t])
        start += len(part)


REPORT = "q_item string, score double, n_seeds long, window_start long, match_end long"


def _report(batches, seeds: Items, least: float):
    for batch in batches:
        found = list(_hits(batch.column(1), seeds, least))
        ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
        column = lambda k, kind: pa.array([x[k] for x in found], kind)
        yield pa.RecordBatch.from_arrays([ids, pa.array([seeds.names[x[1]] for x in found], pa.string()), column(2, pa.float64()), column(3, pa.int64()), column(4, pa.int64()), column(5, pa.int64())], names=["q_id", "q_item", "score", "n_seeds", "window_start", "match_end"])


def _clean(batches, seeds: Items, least: float, text: int):
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        keep[[x[0] for x in _hits(batch.column(text), seeds, least) if len(seeds.words[x[1]]) >= LEAST_WORDS]] = False
        yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame, item_text: str):
    """Blocks of the benchmark's different texts."""
    arrow_session(benchmark.sparkSession)
    texts = benchmark.filter(F.col(item_text).isNotNull()).groupBy(F.sha2(item_text, 256).alias("k")).agg(F.first(item_text).alias("t"))
    texts = stage(texts, "bench-texts")
    n = max(1, -(-(texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK))
    for k in range(n):
        yield Items.of([tuple(r) for r in texts.filter(F.pmod(F.xxhash64("k"), F.lit(n)) == k).sort("k").collect()])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """A row for each document and item that it holds: id_col, item_id, score, n_seeds, window_start, match_end (words)."""
    rows = spread(docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text")))
    schema, out = f"q_id {docs.schema[id_col].dataType.simpleString()}, {REPORT}", None
    for seeds in _blocks(benchmark, item_text):
        part = rows.mapInArrow(partial(_report, seeds=seeds, least=least), schema)
        out = part if out is None else out.unionByName(part)
    items = benchmark.select(F.col(item_id).alias("item_id"), F.sha2(item_text, 256).alias("q_item"))
    out = out.join(items, "q_item").withColumnRenamed("q_id", id_col)
    return out.select(id_col, "item_id", "score", "n_seeds", "window_start", "match_end")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The documents without a contaminated passage, all columns as they are."""
    at = docs.columns.index(text_col)
    out = docs
    for seeds in _blocks(benchmark, item_text):
        out = out.mapInArrow(partial(_clean, seeds=seeds, least=least, text=at), out.schema)
    return out
