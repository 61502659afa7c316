"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a run of bytes of a class in one text. Its 64-bit hash is a polynomial over random byte values,
computed for all words of a batch by prefix sums, then mixed; no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = int(0x9E3779B97F4A7C15)
ODD_INVERSE = pow(ODD, -1, 2**64)
SEGMENT = 1 << 18

#: By byte: whether it belongs to a word. SPACED: all but \x20 and \x09-\x0D. PLAIN: digits, ASCII letters, and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(9, 14)]] = False
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS = PLAIN.copy()
LETTERS[0x30:0x3A] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    have = kept.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 1), base, np.uint64)
        steps[0] = 1
        have = kept[base] = np.cumprod(steps, dtype=np.uint64)
    return have


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about `limit` bytes of whole texts: (first row, end row, bytes, offsets); null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: the words' text index, start, end (bytes in data) and hash, A-Z lower-cased."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), np.uint64)
    w = 0
    while w < len(start):
        base = start[w]
        stop = max(w + 1, int(np.searchsorted(end, base + SEGMENT, "right")))
        part = LOWER[data[base : end[stop - 1]]]
        size = len(part)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * _powers(size, ODD)[:size], out=sums[1:])
        s, e = start[w:stop] - base, end[w:stop] - base
        hashes[w:stop] = (sums[e] - sums[s]) * _powers(size, ODD_INVERSE)[s] + (e - s).astype(np.uint64)
        w = stop
    text = np.searchsorted(offsets, start, "right") - 1
    return text, start, end, mixed(hashes)


def shingles_of(text: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each run of k words; a text of 1 to k - 1 words has its whole sequence as one."""
    n = len(hashes)
    if not n:
        return text, hashes
    m = max(0, n - k + 1)
    value = np.zeros(m, np.uint64)
    for j in range(k):
        value = value * np.uint64(ODD) + hashes[j : j + m]
    whole = text[:m] == text[k - 1 :] if m else np.zeros(0, bool)
    owner, value = text[:m][whole], mixed(value[whole])
    counts = np.bincount(text)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.searchsorted(text, short)
        extra = []
        for t, b in zip(short, begin, strict=True):
            x = int(counts[t]) * 1_000_003
            for h in hashes[b : b + counts[t]].tolist():
                x = (x * ODD + h) % 2**64
            extra.append(x)
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, mixed(np.array(extra, np.uint64))])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    return owner, value


def distinct_by_text(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted by text and value."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]
