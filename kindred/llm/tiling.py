"""Benchmark decontamination by greedy string tiling.

Runs of `least` words that a text shares with a benchmark item are seeds; seeds that follow one another on a diagonal are a match, found
by comparing running hashes of all runs of a text at once. For each text and item the longest match whose words are unmarked on both
sides is marked as a tile, again and again. The share of the item's words under tiles is its coverage, whatever the tiles' order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .words import PLAIN, shingles_of, text_chunks, words_of

BLOCK_BYTES = 32 << 20  # of benchmark texts that are broadcast at once; more go block by block
SEEDS = 4 << 20  # most that are held at once


def tiles(text_at: np.ndarray, item_at: np.ndarray, run: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds (runs of `run` equal words at text_at and item_at): (start in text, start in item, words)."""
    order = np.lexsort((text_at, text_at - item_at))
    t, i = text_at[order], item_at[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] - i[1:] != t[:-1] - i[:-1]) | (t[1:] != t[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(t))) + run - 1
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), t[begin].tolist(), i[begin].tolist(), strict=True)]
    heapq.heapify(heap)
    used_t, used_i, out = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        if len(used_i) == 0 or not any(a + k in used_t or b + k in used_i for k in range(n)):
            used_t.update(range(a, a + n))
            used_i.update(range(b, b + n))
            out.append((a, b, n))
            continue
        k = 0
        while k < n:  # what is left of it goes back by its length
            free = k
            while free < n and a + free not in used_t and b + free not in used_i:
                free += 1
            if run <= free - k:
                heapq.heappush(heap, (k - free, a + k, b + k))
            k = free + 1
    return out


def _index(items: pa.Table, least: int) -> tuple:
    """Sorted seeds of all items: hashes, item numbers, places; item ids, words; the hashes of whole items shorter than a seed."""
    hashes, item, place, words, short = [], [], [], [0] * len(items), defaultdict(list)
    for row, end, data, offsets in text_chunks(items.column("text").combine_chunks()):
        text, _, _, h = words_of(data, offsets, PLAIN)
        counts = np.bincount(text, minlength=end - row) if len(text) else np.zeros(end - row, np.int64)
        words[row:end] = counts.tolist()
        owner, value = shingles_of(text, h, least)
        at = np.arange(len(owner)) - np.searchsorted(owner, owner)
        few = counts[owner] < least
        for o in owner[few].tolist():
            whole = h[text == o]
            short[len(whole)].append((int(shingles_of(np.zeros(len(whole), np.int64), whole, len(whole))[1][0]), row + o))
        hashes.append(value[~few])
        item.append(owner[~few] + row)
        place.append(at[~few])
    hashes, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item, place))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], item[order], place[order], items.column("item_id").to_pylist(), words, dict(short)


def _expanded(low: np.ndarray, many: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The seeds low .. low + many of each hit, and the hit of each; nothing if they are too many."""
    total = int(many.sum())
    if total > SEEDS and len(hit) > 1:
        return None, None
    return np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total), np.repeat(hit, many)


def _slices(low: np.ndarray, many: np.ndarray, hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All seeds in slices of at most SEEDS, or of one hit."""
    upto, i = np.cumsum(many), 0
    while i < len(hit):
        end = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SEEDS, "right")))
        yield _expanded(low[i:end], many[i:end], hit[i:end])
        i = end


def _portions(owner: np.ndarray, many: np.ndarray) -> Iterator[slice]:
    """Slices of hits that hold whole texts, of at most SEEDS seeds or of one text."""
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    upto, end, i = np.add.reduceat(many, begin).cumsum(), np.append(begin[1:], len(owner)), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SEEDS, "right")))
        yield slice(int(begin[i]), int(end[j - 1]))
        i = j


def _found(column: pa.Array, index: tuple, least: int, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item number, item's words, covered words, tiles) of each text and item of enough coverage."""
    keys, item, place, _, words, short = index
    for row, _, data, offsets in text_chunks(column):
        text, _, _, h = words_of(data, offsets, PLAIN)
        for n, wanted in short.items():  # items shorter than a seed count where they occur whole
            owner, value = shingles_of(text, h, n)
            for v, number in wanted:
                for o in np.unique(owner[value == np.uint64(v)]).tolist():
                    if np.count_nonzero(text == o) >= n:
                        yield row + o, number, n, n, 1
        m = len(h) - least + 1
        if m < 1 or not len(keys):
            continue
        owner, value = shingles_of(text, h, least)
        low = np.searchsorted(keys, value)
        hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == value)
        if not len(hit):
            continue
        low = low[hit]
        many = np.searchsorted(keys, value[hit], "right") - low
        for part in _portions(owner[hit], many):
            seed, at = _expanded(low[part], many[part], hit[part])
            if seed is None:  # a run of one text is in so many items that its seeds are counted first
                count = np.zeros(len(words), np.int64)
                for seeds, _ in _slices(low[part], many[part], hit[part]):
                    count += np.bincount(item[seeds], minlength=len(words))
                may = (count > 0) & (count * least >= coverage * np.array(words))
                kept = [(s[m], a[m]) for s, a in _slices(low[part], many[part], hit[part]) for m in [may[item[s]]]]
                seed, at = (np.concatenate(x) for x in zip(*kept, strict=True))
            pair = owner[at] * len(words) + item[seed]
            order = np.argsort(pair, kind="stable")
            pair, at, spot = pair[order], at[order], place[seed][order]
            cut = np.flatnonzero(np.diff(pair, prepend=-1))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(pair)).tolist(), strict=True):
                doc, number = divmod(int(pair[a]), len(words))
                # no tiling covers more of the item than all its seeds do
                under = np.unique(np.unique(spot[a:b])[:, None] + np.arange(least))
                if len(under) < coverage * words[number]:
                    continue
                got = tiles(at[a:b], spot[a:b], least)
                covered = sum(n for _, _, n in got)
                if covered >= coverage * words[number]:
                    yield row + doc, number, words[number], covered, len(got)


def _by_block(docs: DataFrame, benchmark: DataFrame, least: int, apply, gather) -> DataFrame:
    """gather(result so far, apply(docs so far, broadcast index)) over blocks of the benchmark, of about BLOCK_BYTES of text each.

    With more than one block each result is written, so that one index at a time is held.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    part, out = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)), None
    for i in range(n):
        index = docs.sparkSession.sparkContext.broadcast(_index(items.where(part == i).orderBy("item_id", "text").toArrow(), least))
        new = apply(docs if out is None else out, index) if gather is None else apply(docs, index)
        if n > 1:
            new = written(new, "tiled")
            index.destroy()
        out = new if out is None or gather is None else gather(out, new)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """One row per document and benchmark item of which tiles cover at least `coverage` of the words: doc_id, item_id, item_words,
    covered_words, coverage, n_tiles.

    Words are runs of letters and digits, A-Z lower-cased. An item shorter than a seed counts only where it occurs whole. Null and empty
    texts and items match nothing; repeated rows give repeated results; an empty table on either side gives an empty result.
    """

    def apply(docs: DataFrame, index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_found(batch.column(1), index.value, least, coverage))
                if rows:
                    at, item, words, covered, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                    ids = [index.value[3][i] for i in item.tolist()]
                    columns = [batch.column(0).take(pa.array(at)), pa.array(ids, pa.int64()), pa.array(words), pa.array(covered), pa.array(covered / words), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, item_words long, covered_words long, coverage double, n_tiles long")

    return _by_block(docs, benchmark, least, apply, DataFrame.unionByName)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """docs without the rows that contaminated() reports, with all their columns; nothing is shuffled."""
    at = docs.columns.index("text")

    def apply(docs: DataFrame, index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[x[0] for x in _found(batch.column(at), index.value, least, coverage)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    return _by_block(docs, benchmark, least, apply, None)
