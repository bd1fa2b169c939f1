"""Language identification with interpolated Kneser-Ney character models.

Each language has counts of character 4-grams over all its training rows (letters lower-cased,
all else a blank). Continuation counts of the 4-grams give the lower orders, and every order is
interpolated with the next. A language's n-grams stand in a sorted array of 64-bit keys per
order, with their log-probabilities and the back-off weights of the contexts beside them. A block
of texts looks up each of its different 4-grams once per language, and looks further only where
one is new. The language with the lowest cross-entropy per character is chosen, and
it is rejected where that entropy is beyond what the language's own texts show.

The model has all languages and all 4-grams of the rows it is counted from, so its memory grows
with the number of different 4-grams by language; letters beyond U+FFFF share 8,448 numbers that
no other letter has.

Rejection and score are calibrated on training rows that are left out of the counts: one in
SHARE by a hash of the id, however many there are. A language of few rows learns from and is
calibrated on all of its rows. What is gathered is added up by language and length class: own
entropies, and those under the best *other* language, which show what foreign text looks like. A
text of n characters is rejected where its entropy is over a line between the two means (LINE), and
over DEVIATIONS deviations of own texts of that length, whose variance is fitted as a + b / n.
The score's sharpness is the one of SHARPNESS that gives the true languages the highest
likelihood.

Defined results: null text or text without a letter: ``und``, score 0, rejected. Without any
training row all is ``und``. Ties go to the first language by name. Repeated rows are judged row
by row; empty tables give empty results; other columns are not looked at. Long texts are judged
whole, in memory that follows the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, blocks, spread, stage, text_bytes
from .pretokens import LETTER, char_classes

ORDER = 4
#: Counted 4-grams that are brought to the driver at once.
COLLECTED = 4_000_000
#: One training row in SHARE calibrates; a language of fewer than FEW training rows learns from and is calibrated on all.
SHARE, FEW = 8, 240
#: Rows of a length class that show its variance.
EACH = 8
#: A character's log-probability deviates by half a nat to two nats; what few rows seem to show beyond that is chance.
LEAST_B, MOST_B = 0.25, 4.0
#: Where the line lies between the means of own and foreign entropies: nearer to foreign, as a lost document can't be had again.
LINE = 0.75
#: Own texts lie within so many deviations; where only one language is known, nothing tells what foreign text looks like, and the line is drawn farther out.
DEVIATIONS, ALONE = 6.0, 20.0
#: Entropy difference per character to log-odds: the values that are tried.
SHARPNESS = tuple(2.0**k for k in range(7))
BLANK, START = 0x20, 0x1
_LOW = np.uint64(0xFFFF)


@lru_cache(1)
def _letters() -> np.ndarray:
    return char_classes() == LETTER


def symbols(column: pa.Array):
    """For blocks of rows: (first row, 4-gram keys at every character, n+1 offsets of the rows in these, which rows have a letter).

    A row's symbols are its letters, lower-cased, with single blanks for all between; START stands before it."""
    data, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    for a, b in blocks(offsets, 1 << 19):
        part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        codes = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
        rows = chars[cuts]
        letter = _letters()[codes]
        blank = ~letter
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[rows[:-1][rows[:-1] < len(codes)]] = True
        value = np.where(blank, BLANK, np.where(codes > 0xFFFF, 0xD800 + codes % 8448, codes)).astype(np.uint64)[keep]
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        at = kept[rows]
        seen = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(letter, out=seen[1:])
        place = np.arange(len(value)) - np.repeat(at[:-1], np.diff(at))
        key = value.copy()
        for k in range(1, ORDER):
            before = np.full(len(value), START, np.uint64)
            before[k:] = value[:-k]
            before[place < k] = START
            key |= before << np.uint64(16 * k)
        yield a, key, at, seen[rows[1:]] > seen[rows[:-1]]


def _count(batches):
    """(lang, 4-gram, n) of this task's training rows, merged as it goes."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (keys, n) in held.items():
            for at in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[at : at + 50_000]), pa.string()), pa.array(keys[at : at + 50_000].view(np.int64)), pa.array(n[at : at + 50_000])], names=["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            for _, key, _, _ in symbols(batch.column(1).filter(pc.equal(langs, lang))):
                keys, n = np.unique(key, return_counts=True)
                if lang in held:
                    keys, where = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = keys, n
        if sum(len(k) for k, _ in held.values()) > 2_000_000:
            yield from out()
            held.clear()
    yield from out()


def _find(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Places in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(some), -1)
    at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
    return np.where(keys[at] == some, at, -1)


@dataclass
class Model:
    """Of each language: keys[k], logs[k]: its sorted (k+1)-grams and their log-probabilities; contexts[k], weights[k]: back-off weights of its contexts by order; floor: log-probability of a new sign."""

    langs: list[str]
    keys: list[list[np.ndarray]]
    logs: list[list[np.ndarray]]
    contexts: list[list[np.ndarray]]
    weights: list[list[np.ndarray]]
    floor: np.ndarray
    sharpness: float = SHARPNESS[-1]
    #: By language: mean, a and b of own entropies' variance a + b / n, least entropy of foreign texts (-inf: unknown).
    own: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: sorted 4-grams and their numbers, by language."""
        langs = sorted(counts)
        alphabet = len(np.unique(np.concatenate([np.unique(k & _LOW) for k, _ in counts.values()]))) + 1 if langs else 1
        model = cls(langs, [], [], [], [], np.zeros(len(langs), np.float32))
        for lang in langs:
            keys, n = counts[lang]
            orders = [(keys, n.astype(np.float64))]
            for k in range(ORDER - 1, 0, -1):
                mask = np.uint64((1 << (16 * k)) - 1)
                orders.append(tuple(x if i == 0 else x.astype(np.float64) for i, x in enumerate(np.unique(orders[-1][0] & mask, return_counts=True))))
            orders, probs, contexts, weights = orders[::-1], [], [], []
            for k, (grams, n) in enumerate(orders):
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                ctx, where = np.unique(grams >> np.uint64(16), return_inverse=True)
                total, kinds = np.bincount(where, n), np.bincount(where)
                weight = discount * kinds / total
                lower = probs[k - 1][np.searchsorted(orders[k - 1][0], grams & np.uint64((1 << (16 * k)) - 1))] if k else 1 / alphabet
                probs.append(weight[where] * lower + np.maximum(n - discount, 0) / total[where])
                contexts.append(ctx)
                weights.append(weight)
            model.floor[len(model.keys)] = np.log(weights[0][0] / alphabet)
            model.keys.append([g for g, _ in orders])
            model.logs.append([np.log(p).astype(np.float32) for p in probs])
            model.contexts.append(contexts)
            model.weights.append([np.log(w).astype(np.float32) for w in weights])
        return model

    def _log(self, key: np.ndarray, lang: int, k: int = ORDER - 1) -> np.ndarray:
        """Log-probabilities of the last symbol after the k before it, in one language."""
        at = _find(self.keys[lang][k], key)
        out = self.logs[lang][k][at]
        new = np.flatnonzero(at < 0)
        if len(new):
            if k:
                shorter = self._log(key[new] & np.uint64((1 << (16 * k)) - 1), lang, k - 1)
                ctx = _find(self.contexts[lang][k], key[new] >> np.uint64(16))
                out[new] = shorter + np.where(ctx >= 0, self.weights[lang][k][ctx], np.float32(0))
            else:
                out[new] = self.floor[lang]
        return out

    def _logs(self, key: np.ndarray) -> np.ndarray:
        """Log-probabilities of the last symbol after the ones before it, by language."""
        return np.stack([self._log(key, lang) for lang in range(len(self.langs))], axis=1)

    def entropies(self, column: pa.Array, langs: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every text: cross-entropy per character by language (all, or those of langs), number of characters, whether it has a letter."""
        langs = list(range(len(self.langs))) if langs is None else langs
        h, n, ok = np.zeros((len(column), len(langs))), np.zeros(len(column), np.int64), np.zeros(len(column), bool)
        for a, key, at, has in symbols(column):
            b = a + len(at) - 1
            n[a:b], ok[a:b] = np.diff(at), has
            some, where = np.unique(key, return_inverse=True)
            sums = np.zeros(len(key) + 1)
            for j, lang in enumerate(langs):
                np.cumsum(self._log(some, lang)[where], dtype=np.float64, out=sums[1:])
                h[a:b, j] = (sums[at[:-1]] - sums[at[1:]]) / np.maximum(1, np.diff(at))
        return h, n, ok

    def predict(self, column: pa.Array):
        """(language or und, score, entropy, rejected) of every text."""
        h, n, ok = self.entropies(column)
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column)), np.ones(len(column), bool)
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp(np.minimum(50, -self.sharpness * (h - least[:, None]) + 0.0)).sum(axis=1)
        rejected = ~ok if self.own is None else ~ok | (least > self.limit(best, n))
        return [self.langs[k] if o else "und" for k, o in zip(best, ok, strict=True)], np.where(ok, score, 0.0), least, rejected

    def limit(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The entropy over which a text of n characters isn't of that language."""
        mean, a, b, foreign = self.own[:, lang]
        deviation = np.sqrt(a + b / np.maximum(1, n))
        return np.where(np.isfinite(foreign), np.maximum(mean + LINE * (foreign - mean), mean + DEVIATIONS * deviation), mean + ALONE * deviation)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows that have a language and are not held out; rows without an id are not learned from."""
    arrow_session(docs.sparkSession)
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = (F.pmod(F.xxhash64(id_col), F.lit(SHARE)) == 0).alias("q_share")
    rows = rows.select(F.col(lang_col).cast("string").alias("q_lang"), F.col(text_col).alias("q_text"), share)
    few = [r[0] for r in rows.groupBy("q_lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < FEW).collect()]
    rare = F.col("q_lang").isin(few) if few else F.lit(False)
    counted = spread(rows.filter(~F.col("q_share") | rare)).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = Model.fit(_counts(stage(counted, "langid-counts")))
    if model.langs:
        moments = spread(rows.filter(F.col("q_share") | rare)).mapInArrow(partial(_moments, model=model), MOMENTS)
        calibrate(model, moments.groupBy("kind", "lang", "size").agg(*[F.sum(x).alias(x) for x in ("w", "wh", "whh")]).collect())
    return model


def _counts(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """All counted 4-grams, sorted, and their numbers, by language; no more than about COLLECTED rows come to the driver at once."""
    parts, held = -(-counted.count() // COLLECTED), {}
    for k in range(parts):
        got = counted.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).toArrow()
        lang = got.column(0).combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        code, gram, n = lang.indices.to_numpy(), got.column(1).to_numpy().view(np.uint64), got.column(2).to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(lang.dictionary) + 1))
        for name, a, b in zip(lang.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True):
            held.setdefault(name, []).append((gram[order[a:b]], n[order[a:b]]))
    out = {}
    for name in list(held):
        gram, n = (np.concatenate(x) for x in zip(*held.pop(name), strict=True))
        order = np.argsort(gram)
        out[name] = gram[order], n[order]
    return out


MOMENTS = "kind string, lang string, size int, w double, wh double, whh double"


def _moments(batches, model: Model):
    """Sums over this task's calibration rows with a letter: number, h and h * h of kind own (rows found to be of their language: h under it) and foreign (h under the best other language, which is lang), by floor(log2(n)); and the log-likelihood of the true languages (as wh) for each SHARPNESS (by size)."""
    held: dict[tuple[str, str, int], np.ndarray] = {}

    def add(kind: str, lang: str, sizes: np.ndarray, h: np.ndarray) -> None:
        for c in np.unique(sizes):
            x = h[sizes == c]
            key = kind, lang, int(c)
            held[key] = held.get(key, 0) + np.array([len(x), x.sum(), (x * x).sum()])

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            if lang not in model.langs:
                continue
            k = model.langs.index(lang)
            h, n, ok = model.entropies(batch.column(1).filter(pc.equal(langs, lang)))
            h, size = h[ok], np.log2(np.maximum(1, n[ok])).astype(int)
            best = h.argmin(axis=1)
            add("own", lang, size[best == k], h[best == k, k])
            for i, sharp in enumerate(SHARPNESS):
                ratio = np.exp(np.minimum(50, -sharp * (h - h[:, k, None]))).sum(axis=1)
                add("sharpness", "", np.full(len(h), i), -np.log(ratio))
            h[:, k] = np.inf
            other = h.argmin(axis=1)
            for j in np.unique(other) if len(model.langs) > 1 else ():
                add("foreign", model.langs[j], size[other == j], h[other == j, j])
    sums = np.array(list(held.values())).reshape(-1, 3)
    kinds = (pa.string(), pa.string(), pa.int32())
    yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in held], kind) for i, kind in enumerate(kinds)), *(pa.array(sums[:, i]) for i in range(3))], names=["kind", "lang", "size", "w", "wh", "whh"])


def _variance(sizes: np.ndarray, w: np.ndarray, wh: np.ndarray, whh: np.ndarray) -> tuple[float, float, float]:
    """Mean, and a and b of the variance a + b / n by least squares over the length classes of EACH rows and more; b is 1, a character's variance in round numbers, where fewer than two classes show it."""
    mean = wh.sum() / w.sum()
    square = (whh - 2 * mean * wh + mean * mean * w) / w
    x = np.stack([np.ones(len(w)), 1 / (1.5 * 2.0**sizes)], axis=1)
    some = w >= EACH
    if some.sum() < 2:
        return mean, max(0.0, float((square * w).sum() / w.sum() - (w * x[:, 1]).sum() / w.sum())), 1.0
    x, y, w = x[some], square[some], w[some]
    a, b = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    if a < 0:
        a, b = 0.0, (w * y * x[:, 1]).sum() / (w * x[:, 1] ** 2).sum()
    return mean, max(float(a), 1e-6), min(max(float(b), LEAST_B), MOST_B)


def calibrate(model: Model, rows: list) -> None:
    """Sets what rejection and score need from the sums of _moments; a language without own rows rejects nothing."""
    sums = {(kind, lang): [] for kind in ("own", "foreign") for lang in model.langs}
    likely = np.full(len(SHARPNESS), -np.inf)
    for kind, lang, size, *x in rows:
        if kind == "sharpness":
            likely[size] = x[1]
        else:
            sums[kind, lang].append((size, *x))
    model.sharpness = SHARPNESS[int(likely.argmax())]
    model.own = np.zeros((4, len(model.langs)))
    every = np.array([x for lang in model.langs for x in sums["foreign", lang]], float).reshape(-1, 4)
    for k, lang in enumerate(model.langs):
        own = np.array(sorted(sums["own", lang]), float)
        model.own[:3, k] = _variance(own[:, 0], *own[:, 1:].T) if len(own) else (np.inf, 0, 0)
        foreign = np.array(sums["foreign", lang], float).reshape(-1, 4)
        foreign = foreign if foreign[:, 1].sum() >= FEW / SHARE else every
        model.own[3, k] = foreign[:, 2].sum() / foreign[:, 1].sum() if len(foreign) else -np.inf


def _predict(batches, model: Model):
    for batch in batches:
        lang, score, h, rejected = model.predict(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(rejected)], names=["q_id", "lang_pred", "score", "entropy", "rejected"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, entropy, rejected) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text")))
    return rows.mapInArrow(partial(_predict, model=model), f"q_id {kind}, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("q_id", id_col)


def _accepted(batches, model: Model, text: int):
    for batch in batches:
        yield batch.filter(pa.array(~model.predict(batch.column(text))[3]))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns as they are."""
    return docs.mapInArrow(partial(_accepted, model=model, text=docs.columns.index(text_col)), docs.schema)
