"""The pre-tokens of byte-level BPE, found for many texts at once on arrays of code points.

The result equals the matches of the public pattern (contractions, letters, numbers and other
signs with one leading space, white space). As matches cover a text without gaps, only their
starts are needed, and these follow from where the character class changes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import blocks, text_bytes
from .texthash import mix

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
_EDGE = 0x110000


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point; the last entry stands for the edge of a text."""
    import regex

    out = np.full(_EDGE + 1, OTHER, np.uint8)
    points = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    every, at = "".join(map(chr, points)), np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = kind
    out[_EDGE] = EDGE
    return out


def token_starts(codes: np.ndarray) -> np.ndarray:
    """codes: code points with an edge before, between and after the texts. True where a match, or an edge, begins."""
    kind = char_classes()[codes]
    change = np.ones(len(codes), bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= kind == EDGE
    after_blank = np.zeros(len(codes), bool)
    after_blank[1:] = codes[:-1] == 0x20
    starts = change & ((kind == SPACE) | (kind == EDGE) | ~after_blank)
    last = np.zeros(len(codes), bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE)
    starts |= last
    marks = np.flatnonzero((codes == 0x27) & starts & ~after_blank & (np.append(kind[1:], EDGE) == LETTER))
    if len(marks):
        padded = np.append(codes, [_EDGE, _EDGE])
        one, two = padded[marks + 1], padded[marks + 2]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        size = np.where(is_(one, "stmd"), 2, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))] = 3
        size[(one == ord("l")) & (two == ord("l"))] = 3
        marks, size = marks[size > 0], size[size > 0]
        starts[marks + 1] = False
        rest = marks + size
        starts[rest] |= (kind[rest] == LETTER)
    return starts


_BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of _BASE modulo 2**64, and their inverses."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def span_buckets(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each values[start:end], equal for equal spans: a polynomial from prefix sums. Different spans may share one, so it only makes buckets."""
    up, down = _up_down(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def distinct_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct span codes[start:end], and for every span its number among these.

    Spans are put in buckets by a hash, then each is compared with the first of its bucket, sign by sign; where one differs, the spans themselves are the keys."""
    _, first, inverse = np.unique(span_buckets(mix(codes.astype(np.uint64)), starts, ends), return_index=True, return_inverse=True)
    size, own = ends - starts, first[inverse]
    if (size == size[own]).all():
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (codes[np.repeat(starts, size) + step] == codes[np.repeat(starts[own], size) + step]).all():
            return first, inverse
    raw, names = codes.tobytes(), {}
    at = [names.setdefault(raw[4 * a : 4 * b], k) for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
    return np.unique(np.array(at, np.int64), return_inverse=True)


def pretokens(data: np.ndarray, offsets: np.ndarray):
    """Distinct pre-tokens of the texts, as strings; for each occurrence its number among them; and the n+1 offsets of the texts in these."""
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    cuts = chars[offsets]
    codes = np.append(np.insert(codes, cuts[:-1], _EDGE), np.uint32(_EDGE)).astype(np.uint32)
    starts = np.flatnonzero(token_starts(codes))
    ends = np.append(starts[1:], len(codes))
    real = codes[starts] != _EDGE
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(real, out=before[1:])
    edges = np.flatnonzero(~real)
    starts, ends = starts[real], ends[real]
    first, inverse = distinct_spans(codes, starts, ends)
    flat = codes.tobytes()
    words = [flat[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return words, inverse, before[edges]


def _cut(text: str, size: int) -> list[str]:
    """A text in parts of about size characters, cut before a blank between two letters, where a match always begins."""
    out, at = [], 0
    blank = _word_break()
    while len(text) - at > 2 * size and (m := blank.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


@lru_cache(1)
def _word_break():
    import regex

    return regex.compile(r"(?<=\p{L}) (?=\p{L})")


def text_blocks(column: pa.Array, split: str | None = None, limit: int = 1 << 19):
    """For blocks of text parts: (row of each part, pretokens of the parts); a row's parts follow each other.

    With split, texts are first divided at that string, as a library divides at a special token;
    the numbers of divisions come last, as (numbers by row, None). Long texts are cut where that
    changes no match, so a block holds about limit bytes."""
    rows = np.arange(len(column))
    extra = np.zeros(len(column), np.int64)
    has = pc.match_substring(column.fill_null(""), split) if split else None
    long = pc.greater(pc.binary_length(column.fill_null("")), 4 * limit)
    if pc.any(long).as_py() or (split and pc.any(has).as_py()):
        parts, owner = [], []
        for k, text in enumerate(column.to_pylist()):
            own = (text or "").split(split) if split else [text or ""]
            extra[k] = len(own) - 1
            own = [y for x in own for y in (_cut(x, limit) if len(x) > 2 * limit else [x])]
            parts += own
            owner += [k] * len(own)
        column, rows = pa.array(parts, pa.large_string()), np.array(owner)
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets, limit):
        yield rows[a:b], pretokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    if extra.any():
        yield extra, None
