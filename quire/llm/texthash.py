"""Words of many texts at once, their digests, and sets of word shingles.

A word is known by a 128-bit cryptographic digest, whose halves serve as two hashes that don't
depend on each other; no pair of different words is known to share them. Where a link is
confirmed, numbers given to the words themselves are used and no hash at all.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(separates) -> bytes:
    """A byte table that lower-cases A-Z and makes separators blanks."""
    return bytes(32 if separates(b) else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Words end at blanks and 0x09-0x0D.
BLANKS = _table(lambda b: b in (0x20, *range(0x09, 0x0E)))
#: ASCII signs and controls separate words too: letters and digits are left.
SIGNLESS = _table(lambda b: b < 128 and not chr(b).isalnum())


#: Bytes and words that are held as Python objects at once; a longer row is taken in pieces.
PIECE, WORDS = 1 << 20, 200_000


def _pieces(raw: bytes, offsets: np.ndarray):
    """(row, some of its words) of all rows in order; separators are blanks."""
    for row, (a, b) in enumerate(pairwise(offsets.tolist())):
        while b - a > PIECE and (cut := raw.find(b" ", a + PIECE, b)) >= 0:
            yield row, raw[a:cut].split()
            a = cut
        yield row, raw[a:b].split()


def _by_words(data: np.ndarray, offsets: np.ndarray, table: bytes, value, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """value(words) of all words, joined along the last axis, and the n+1 offsets of the rows in them."""
    parts, held, rows = [empty], [], np.zeros(len(offsets), np.int64)
    for row, found in _pieces(data.tobytes().translate(table), offsets):
        rows[row + 1] += len(found)
        held += found
        if len(held) > WORDS:
            parts.append(value(held))
            held = []
    parts.append(value(held))
    return np.concatenate(parts, axis=-1), np.cumsum(rows)


class _Digests(dict):
    """A word's digest; those of long words aren't kept."""

    def __missing__(self, word: bytes) -> bytes:
        found = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            self[word] = found
        return found


#: Digests that a worker keeps; that saves time only.
HELD = 200_000
_digests = _Digests()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Both halves of each word's digest: shape (2, n)."""
    if len(_digests) > HELD:
        _digests.clear()
    halves = np.frombuffer(b"".join(map(_digests.__getitem__, words)), "<u8")
    return np.ascontiguousarray(halves.reshape(-1, 2).T)


def words(data: np.ndarray, offsets: np.ndarray, table: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of all words, A-Z lower-cased, and the n+1 offsets of the rows in them."""
    return _by_words(data, offsets, table, word_hashes, np.zeros((2, 0), np.uint64))


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words; run i covers hashes[i:i+size], rows are not looked at."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = hashes[:n].copy()
    for k in range(1, size):
        x = x * _STEP + hashes[k : k + n]
    return mix(x)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """For each row the sorted hashes of its distinct shingles, and a second hash of the set; a row of fewer words has its whole sequence as one, a row without words none."""
    (one, two), rows = words(data, offsets)
    every, other = grams(one, size), grams(two, size)
    for a, b in pairwise(rows.tolist()):
        if b - a >= size:
            s, at = np.unique(every[a : b - size + 1], return_index=True)
            yield s, int(other[a + at].sum(dtype=np.uint64))
        elif b > a:
            mark = np.uint64(b - a)
            yield grams(one[a:b], b - a) ^ mark, int(grams(two[a:b], b - a)[0] ^ mark)
        else:
            yield every[:0], 0


def numbered_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingles as numbers that are equal within this call exactly where the words are: words are numbered by what they are, runs by the numbers of a shorter run and the next word."""
    names: dict[bytes, int] = {}
    number = lambda some: np.fromiter((names.setdefault(w, len(names)) for w in some), np.uint64, len(some))
    word, rows = _by_words(data, offsets, BLANKS, number, np.zeros(0, np.uint64))
    run = word
    for k in range(1, size):
        n = max(0, len(word) - k)
        run = np.unique((run[:n] << np.uint64(32)) | word[k:], return_inverse=True)[1].astype(np.uint64)
    short: dict[bytes, int] = {}
    out = []
    for a, b in pairwise(rows.tolist()):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            number = short.setdefault(word[a:b].tobytes(), len(short))
            out.append(np.array([(1 << 40) + number], np.uint64))
        else:
            out.append(run[:0])
    return out
