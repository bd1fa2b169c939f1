"""Byte-level BPE encoding and decoding on padded numpy matrices.

The distinct pre-tokens of a block of texts are put in buckets by length and padded. In every
round each row of a bucket merges its leftmost pair of least rank; pair ranks come from an
open-addressing hash table, only the two pairs beside a merge are looked up again, and rows
without a pair left are taken out of the matrix. A round costs a row's width, so n bytes cost
n * n: a pre-token of over LONG bytes (few texts have one) is a matrix of its own instead, its
places dealt over rows of sqrt(n) whose least ranks are kept, and every round merges the
leftmost pair of least rank in n * sqrt(n) altogether. Long texts are encoded in parts cut
where no match is cut, so memory follows a block and the ids of one text. Results of
earlier blocks are kept per worker, up to HELD words; that saves time only.

Defined results: null text encodes as the empty text (no ids, empty bytes). Special strings in
a text are ordinary text. Repeated rows and ids are encoded row by row; an empty table gives an
empty result; other columns are not looked at. Decoding gives the text's UTF-8 bytes again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, spread
from .pretokens import text_blocks
from .texthash import mix

LONG = 256
HELD = 100_000
_NONE = np.int32(0x7FFFFFFF)
_EMPTY = np.int64(-1)


class PairTable:
    """(left id, right id) to merged id, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.keys, self.values = np.full(1 << self.bits, _EMPTY), np.full(1 << self.bits, _NONE)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            some = todo[free]
            taken, first = np.unique(slot[some], return_index=True)
            won = some[first]
            self.keys[taken], self.values[taken] = keys[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            again = self.keys[slot[todo]] != _EMPTY
            slot[todo[again]] = (slot[todo[again]] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id, which is the rank, or _NONE; ids under 0 are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, out = self._slot(keys), np.full(len(keys), _NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at != _EMPTY)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    """Ranks of a tiktoken file; words to ids and ids to bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        pairs = [(x, y, r) for t, r in self.ranks.items() for k in range(1, len(t)) if (x := self.ranks.get(t[:k])) is not None and (y := self.ranks.get(t[k:])) is not None]
        self.pairs = PairTable(*(np.array([p[k] for p in pairs], np.int32) for k in range(3)))
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        parts = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            parts[r] = t
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets, self.n_ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def _add(self, words: list[str], ids: list[np.ndarray]) -> None:
        n, more = len(self.known), sum(map(len, ids))
        while self.n_ids + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.ids[self.n_ids : self.n_ids + more] = np.concatenate(ids)
        self.offsets[n + 1 : n + 1 + len(words)] = self.n_ids + np.cumsum([len(x) for x in ids])
        self.n_ids += more
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def rounds(self, table: np.ndarray) -> list[np.ndarray]:
        """Rows of byte ids, padded with -1 on the right, to rows of merged ids."""
        out: list[np.ndarray] = [table[:0]] * len(table)
        own = np.arange(len(table))
        rank = self.pairs.find(table[:, :-1].reshape(-1), table[:, 1:].reshape(-1)).reshape(len(table), -1)
        while len(own):
            if table.shape[1] > 1:
                at = rank.argmin(axis=1)
                least = rank[np.arange(len(own)), at]
                done = least == _NONE
            else:
                done = np.ones(len(own), bool)
            if done.any():
                for k, row in zip(own[done], table[done], strict=True):
                    out[k] = row[row >= 0]
                own, table, rank, at, least = own[~done], table[~done], rank[~done], (at[~done] if table.shape[1] > 1 else own[:0]), (least[~done] if table.shape[1] > 1 else own[:0])
                if not len(own):
                    break
            rows, width = np.arange(len(own)), table.shape[1]
            columns = np.arange(width - 1)
            table = np.take_along_axis(table, columns + (columns > at[:, None]), axis=1)
            table[rows, at] = least
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1) if width > 2 else rank[:, :0]
            right = np.flatnonzero(at < width - 2)
            rank[right, at[right]] = self.pairs.find(table[right, at[right]], table[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.find(table[left, at[left] - 1], table[left, at[left]])
        return out

    def long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long row, on linked places; ranks lie in blocks with their least values."""
        n = len(ids)
        width = int(np.sqrt(n)) + 1
        value, rank = ids.copy(), np.full(width * width, _NONE)
        rank[: n - 1] = self.pairs.find(ids[:-1], ids[1:])
        square = rank.reshape(width, width)
        least = square.min(axis=1)
        after, before, live = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        while True:
            row = int(least.argmin())
            if least[row] == _NONE:
                return value[live]
            p = row * width + int(square[row].argmin())
            q = int(after[p])
            value[p], live[q], rank[q] = rank[p], False, _NONE
            after[p] = r = int(after[q])
            if r < n:
                before[r] = p
            rank[p] = self.pairs.find(value[p : p + 1], value[r : r + 1])[0] if r < n else _NONE
            if (b := int(before[p])) >= 0:
                rank[b] = self.pairs.find(value[b : b + 1], value[p : p + 1])[0]
            for x in {row, q // width, max(b, 0) // width}:
                least[x] = square[x].min()

    def learn(self, words: list[str]) -> None:
        """Adds words that are not held yet."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(x) for x in coded])
        out: list[np.ndarray] = [self.bytes[:0]] * len(words)
        for low in (0, 4, 8, 12, 16, 24, 32, 64, 128):
            high = {0: 4, 4: 8, 8: 12, 12: 16, 16: 24, 24: 32, 32: 64, 64: 128, 128: LONG}[low]
            every = np.flatnonzero((sizes > low) & (sizes <= high))
            step = max(1, (1 << 20) // high)
            for k in range(0, len(every), step):
                some = every[k : k + step]
                table = np.full((len(some), high), -1, np.int32)
                flat = np.frombuffer(b"".join([coded[i] for i in some]), np.uint8)
                table[np.arange(high) < sizes[some, None]] = self.bytes[flat]
                for i, ids in zip(some, self.rounds(table), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self.long(self.bytes[np.frombuffer(coded[i], np.uint8)])
        self._add(words, out)

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.known) > HELD:
            self.clear()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, words: list[str], inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a sequence of words, and the n+1 offsets of the words in it."""
        at = self.lookup(words)[inverse]
        return gather(self.ids, self.offsets[at], self.offsets[at + 1])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of a sequence of ids, and the n+1 offsets of the ids in it."""
        return gather(self.flat, self.at[ids], self.at[ids + 1])


def gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start:end] of every span, one after the other."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return flat[at], offsets


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(column: pa.Array, path: str):
    """(row, ids, decoded bytes) of every text, in order."""
    bpe, held = encoder(path), []
    for rows, (words, inverse, texts) in text_blocks(column):
        ids, words_at = bpe.encode(words, inverse)
        raw, ids_at = bpe.decode(ids)
        for k, row in enumerate(rows.tolist()):
            a, b = words_at[texts[k]], words_at[texts[k + 1]]
            if held and held[0][0] != row:
                yield _whole(held)
                held = []
            held.append((row, ids[a:b], raw[ids_at[a] : ids_at[b]]))
    if held:
        yield _whole(held)


def _whole(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """The parts of one row as one."""
    return parts[0] if len(parts) == 1 else (parts[0][0], *(np.concatenate(x) for x in list(zip(*parts, strict=True))[1:]))


def _encode(batches, path: str):
    for batch in batches:
        ids = [x.astype("<u4") for _, x, _ in encode_column(batch.column(1), path)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))], names=["q_id", "ids"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row."""
    arrow_session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text")))
    return rows.mapInArrow(partial(_encode, path=path), f"q_id {kind}, ids array<int>").withColumnRenamed("q_id", id_col)


def _decode(batches, path: str):
    bpe = encoder(path)
    for batch in batches:
        column = batch.column(1).fill_null([])
        ids = column.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        raw, raw_at = bpe.decode(ids)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[raw_at[a] : raw_at[b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["q_id", "bytes"])


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes) of every row of ids; null ids count as none."""
    arrow_session(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("q_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(partial(_decode, path=path), f"q_id {kind}, bytes binary").withColumnRenamed("q_id", id_col)


def _digest(batches, path: str):
    for batch in batches:
        n, ids_sha, raw_sha = [], [], []
        for _, ids, raw in encode_column(batch.column(1), path):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            raw_sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=["q_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so ids needn't be stored."""
    arrow_session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text")))
    return rows.mapInArrow(partial(_digest, path=path), f"q_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("q_id", id_col)


def _tokenised(batches, path: str, text: int, keep: list[int]):
    for batch in batches:
        ids, back = [], []
        for _, x, raw in encode_column(batch.column(text), path):
            ids.append(x.astype(np.int32))
            back.append(hashlib.sha256(raw.tobytes()).hexdigest())
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([len(x) for x in ids], pa.int64()), lists, pa.array(back, pa.string())], names=[*[batch.schema.names[k] for k in keep], "n_tokens", "ids", "decoded_sha256"])


def tokenised(docs: DataFrame, path: str, text_col: str = "text", keep=("doc_id", "lang", "source")) -> DataFrame:
    """The columns in keep that docs has, with n_tokens, ids and the digest of the bytes that the ids decode to, for every row."""
    arrow_session(docs.sparkSession)
    keep = [c for c in keep if c in docs.columns]
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    places = [docs.columns.index(c) for c in keep]
    work = partial(_tokenised, path=path, text=docs.columns.index(text_col), keep=places)
    return docs.mapInArrow(work, ", ".join([*kinds, "n_tokens long", "ids array<int>", "decoded_sha256 string"]))
