"""Token counts by heap-and-linked-list pair merging; no token identifiers are made.

The symbols of a pre-token stand in a doubly linked list, its adjacent pairs in a heap by rank
and place. The lowest pair is popped again and again; a pair whose symbols have changed since
is skipped, a merge links its neighbours and pushes the two new pairs. The count is the number
of first symbols less the merges: n log n for n symbols, whatever the text. Counts of words met
before are kept per worker, up to HELD words; that saves time only.

Defined results: null text counts as empty: 0 bytes, 0 tokens, not over the limit. A special
string inside a text counts as one token, as the library does by default. Repeated rows are
counted row by row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, spread, text_bytes
from .pretokens import text_blocks

HELD = 300_000


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Merge ranks of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        raw = lambda x: bytes(signs[c] for c in x)
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[raw(a), raw(b)] = k
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.single = [bytes([b]) for b in range(256)]
        self.held: dict[str, int] = {}

    def merges(self, word: bytes) -> int:
        """How many pairs get merged."""
        n = len(word)
        if n < 2:
            return 0
        ranks = self.ranks
        part: list[bytes | None] = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := ranks.get((part[k], part[k + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, p, x, y = heapq.heappop(heap)
            q = after[p]
            if part[p] != x or q >= n or part[q] != y:
                continue
            done += 1
            part[p], part[q] = x + y, None
            after[p] = r = after[q]
            if r < n:
                before[r] = p
                if (k := ranks.get((part[p], part[r]))) is not None:
                    heapq.heappush(heap, (k, p, part[p], part[r]))
            if (b := before[p]) >= 0 and (k := ranks.get((part[b], part[p]))) is not None:
                heapq.heappush(heap, (k, b, part[b], part[p]))
        return done

    def counts(self, words: list[str]) -> np.ndarray:
        if len(self.held) > HELD:
            self.held.clear()
        held = self.held
        for w in words:
            if w not in held:
                raw = w.encode()
                held[w] = len(raw) - self.merges(raw)
        return np.fromiter(map(held.__getitem__, words), np.int64, len(words))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_column(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of every text."""
    bpe, out = counter(path), np.zeros(len(column), np.int64)
    if len(bpe.special) > 1:
        raise ValueError("only one special string is supported")
    for rows, found in text_blocks(column, bpe.special[0] if bpe.special else None):
        if found is None:
            out += rows
            continue
        words, inverse, texts = found
        sums = np.zeros(len(inverse) + 1, np.int64)
        np.cumsum(bpe.counts(words)[inverse], out=sums[1:])
        np.add.at(out, rows, np.diff(sums[texts]))
    return out


def _count(batches, path: str, limit: int):
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        n = count_column(batch.column(1), path)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["q_id", "n_bytes", "n_tokens", "over_limit"])


def counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row."""
    arrow_session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("q_text")))
    return rows.mapInArrow(partial(_count, path=path, limit=limit), f"q_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("q_id", id_col)
