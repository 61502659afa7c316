"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts are taken over all training texts; a count c is kept as the level 1 + floor(log2 c), and a gram of level q is
put into the filter with each of the marks 1 to q. A lookup probes marks 1, 2, ... until one is absent, which gives the level back, and
the middle of the counts of that level, 1.5 * 2 ** (level - 1) - 0.5. At 8 bits a mark and 3 probes a mark that isn't there reads as there
with probability (1 - exp(-3 / 8)) ** 3 = 0.03. The filter's segments, each filled by one group of a shuffle, grow in number with the training text,
and its bits with the marks. At most `most_bits` are broadcast at a time: a larger filter is looked up by one part of its segments
after another, for the distinct grams of each chunk of texts, and the levels found meet their chunk again.

Word counts that the exact base score needs aren't broadcast as a whole: the `heavy` most frequent words are, the rest meet the texts in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import SPACED, mixed, text_chunks, words_of

SEGMENTS = 256  # at least; a power of two
SEGMENT_TEXT = 8 << 20  # bytes of training text by segment, beyond the least number
PROBES = 3
END = np.uint64(0x243F6A8885A308D3)  # stands for a text's end; it begins the first pair as well
PAIR = np.uint64(0xD6E8FEB86659FD93)
FLUSH = 1 << 21


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each text's words and its end."""
    text, _, _, h = words_of(data, offsets, SPACED)
    n = len(offsets) - 1
    text, h = np.concatenate([text, np.arange(n)]), np.concatenate([h, np.full(n, END)])
    order = np.argsort(text, kind="stable")
    return text[order], h[order]


def pairs_of(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its text (the end mark before the first)."""
    before = np.concatenate([[END], h[:-1]])
    before[np.flatnonzero(np.diff(text, prepend=-1))] = END
    return mixed(before * PAIR + h)


def _counted(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted grams as differences, and counts, compressed."""
    raw = np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zlib.compress(raw, 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    steps, counts = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel() for x in np.split(raw, 2))
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def segments_for(size: int) -> int:
    """Number of segments for so many bytes of training text."""
    n = SEGMENTS
    while n * SEGMENT_TEXT < size:
        n *= 2
    return n


def _segment(grams: np.ndarray, segments: int) -> np.ndarray:
    return grams >> np.uint64(65 - segments.bit_length())


def gram_counts(docs: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """seg, kind (1 words, 2 pairs), blob: partial counts of the grams of docs' column text, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {1: [], 2: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if not parts:
                    continue
                grams, counts = _counted(*map(np.concatenate, zip(*parts, strict=True)))
                parts.clear()
                cut = np.searchsorted(_segment(grams, segments), np.arange(segments + 1).astype(np.uint64))
                segs = [s for s in range(segments) if cut[s + 1] > cut[s]]
                blobs = [_packed(grams[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]) for s in segs]
                yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int32()), pa.array([kind] * len(segs), pa.int32()), pa.array(blobs, pa.binary())], ["seg", "kind", "blob"])

        waiting = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                text, h = tokens_of(data, offsets)
                for kind, grams in ((1, h), (2, pairs_of(text, h))):
                    held[kind].append(_counted(grams, np.ones(len(grams), np.int64)))
                waiting += len(h)
                if waiting > FLUSH:
                    yield from flush()
                    waiting = 0
        yield from flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "seg int, kind int, blob binary")


def merged_counts(partial: DataFrame) -> DataFrame:
    """seg, kind, blob, grams, total, top, marks: whole counts by segment; marks is the number that the filter gets."""

    def run(table: pa.Table) -> pa.Table:
        grams, counts = _counted(*map(np.concatenate, zip(*map(_unpacked, table.column("blob").to_pylist()), strict=True)))
        level = _level(counts)
        return pa.table({"seg": table.column("seg")[:1], "kind": table.column("kind")[:1], "blob": pa.array([_packed(grams, counts)], pa.binary()), "grams": [len(grams)], "total": [int(counts.sum())], "marks": [int(level.sum())]})

    return partial.groupBy("seg", "kind").applyInArrow(run, "seg int, kind int, blob binary, grams long, total long, marks long")


def _places(grams: np.ndarray, mark: int, bits: int) -> list[np.ndarray]:
    one = mixed(grams + np.uint64(mark * 0x9E3779B97F4A7C15 % 2**64))
    two = (one >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(i) * two) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def filter_bits(counts: DataFrame, segments: int = SEGMENTS, bits_per_mark: int = 8) -> int:
    """Bits of each segment: in proportion to the marks, whatever their number."""
    marks = counts.agg(F.coalesce(F.sum("marks"), F.lit(0))).first()[0]
    return max(64, marks * bits_per_mark // segments) // 8 * 8


def filters(counts: DataFrame, bits: int) -> DataFrame:
    """seg, filter: the packed bits of each segment that has grams."""

    def run(table: pa.Table) -> pa.Table:
        out = np.zeros(bits, bool)
        for blob in table.column("blob").to_pylist():
            grams, n = _unpacked(blob)
            level = _level(n)
            for mark in range(1, int(level.max()) + 1):
                for at in _places(grams[level >= mark], mark, bits):
                    out[at] = True
        return pa.table({"seg": table.column("seg")[:1], "filter": pa.array([np.packbits(out).tobytes()], pa.binary())})

    return counts.groupBy("seg").applyInArrow(run, "seg int, filter binary")


def gathered(rows: DataFrame, bits: int, begin: int, end: int) -> np.ndarray:
    """The segments begin to end (exclusive) of filters' result, one row of bytes by segment."""
    whole = np.zeros((end - begin, bits // 8), np.uint8)
    for r in rows.where(F.col("seg").between(begin, end - 1)).toLocalIterator():
        whole[r["seg"] - begin] = np.frombuffer(r["filter"], np.uint8)
    return whole


def bloom(counts: DataFrame, bits_per_mark: int = 8, segments: int = SEGMENTS) -> np.ndarray:
    """The whole filter, one row of bytes by segment."""
    bits = filter_bits(counts, segments, bits_per_mark)
    return gathered(filters(counts, bits), bits, 0, segments)


def levels_of(whole: np.ndarray, grams: np.ndarray, segments: int | None = None, begin: int = 0) -> np.ndarray:
    """Levels of grams; 0 if absent. whole has the segments from begin on, of so many as there are (all, if not told)."""
    bits = whole.shape[1] * 8
    flat, base = whole.ravel(), (_segment(grams, segments or len(whole)).astype(np.int64) - begin) * whole.shape[1]
    level = np.zeros(len(grams), np.int64)
    live, mark = np.arange(len(grams)), 1
    while len(live) and mark < 60:
        there = np.ones(len(live), bool)
        for at in _places(grams[live], mark, bits):
            there &= flat[base[live] + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
        live = live[there]
        level[live] = mark
        mark += 1
    return level


def _count_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1.0) - 0.5, 0.0)


def looked_up(whole: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Counts of grams as their levels in the filter tell; 0 if absent."""
    return _count_of(levels_of(whole, grams))


def _scored(text: np.ndarray, m: int, count: np.ndarray, end: float, pairs: np.ndarray, weight: float, n: int, v: int) -> np.ndarray:
    """Score of each of m texts by the counts of its tokens, of their pairs, and of the end mark."""
    before = np.concatenate([[0], count[:-1]])
    before[np.flatnonzero(np.diff(text, prepend=-1))] = end
    q = (count + 1) / (n + v + 1)
    return np.bincount(text, np.log10(np.minimum(1.0, (pairs + weight * q) / (before + weight))), m)


def _chunk(text: np.ndarray, m: int, h: np.ndarray, cuts: np.ndarray) -> tuple[bytes, list[bytes]]:
    """A chunk's tokens and pairs as places among its distinct grams, and these, sorted, by part of the filter."""
    grams, at = np.unique(np.concatenate([h, pairs_of(text, h), [END]]), return_inverse=True)
    frame = zlib.compress(np.concatenate([[m], np.bincount(text, minlength=m), at.ravel()]).astype(np.int32).tobytes(), 1)
    edge = [*np.searchsorted(grams, cuts).tolist(), len(grams)]
    return frame, [zlib.compress(grams[a:b].tobytes(), 1) for a, b in zip([0, *edge], edge, strict=False)]


def scores_by_part(parts: DataFrame, rows: DataFrame, bits: int, segments: int, step: int, weight: float, n: int, v: int) -> DataFrame:
    """row, score of the chunks in parts(chunk, frame, pieces); `step` segments of the filter (rows) are broadcast at a time."""
    chunks = parts.where("frame is not null")
    told = chunks.select("chunk", F.lit(-1).alias("part"), F.col("frame").alias("blob"))
    for i, begin in enumerate(range(0, segments, step)):
        shared = parts.sparkSession.sparkContext.broadcast(gathered(rows, bits, begin, min(segments, begin + step)))

        def look(batches: Iterator[pa.RecordBatch], shared=shared, begin=begin, i=i) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    level = levels_of(shared.value, np.frombuffer(zlib.decompress(piece), np.uint64), segments, begin)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([i], pa.int32()), pa.array([zlib.compress(level.astype(np.uint8).tobytes(), 1)], pa.binary())], ["chunk", "part", "blob"])

        told = told.unionByName(written(chunks.select("chunk", F.get("pieces", F.lit(i))).mapInArrow(look, "chunk long, part int, blob binary"), "levels"))
        shared.destroy()

    def join(table: pa.Table) -> pa.Table:
        blobs = [zlib.decompress(b) for _, b in sorted(zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True))]
        frame, count = np.frombuffer(blobs[0], np.int32), _count_of(np.frombuffer(b"".join(blobs[1:]), np.uint8).astype(np.int64))
        m = int(frame[0])
        text, count = np.repeat(np.arange(m), frame[1 : m + 1]), count[frame[m + 1 :]]
        k = len(text)
        first = table.column("chunk")[0].as_py()
        return pa.table({"row": np.arange(first, first + m), "score": _scored(text, m, count[:k], count[-1], count[k : 2 * k], weight, n, v)})

    return told.groupBy("chunk").applyInArrow(join, "row long, score double")


def scores(docs: DataFrame, heavy: int = 100_000, weight: float = 4.0, most_bits: int = 1 << 29, bits_per_mark: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is an empty one: its only token is its end. A null doc_id is not held out. Repeated rows train repeatedly. score is
    the sum of log10 p, p = (pair count + weight * q) / (count of the word before + weight), with q = (count + 1) / (N + V + 1) and
    counts as the filter gives them, p at most 1. Without training texts, all counts are 0. Other columns aren't looked at. At most
    most_bits of the filter are broadcast at a time (a segment at least); scores don't depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = docs.where(~F.col("held_out"))
    segments = segments_for(train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    counts = written(merged_counts(gram_counts(train, segments)), "grams")
    bits = filter_bits(counts, segments, bits_per_mark)
    step = max(1, most_bits // bits)
    inline = step >= segments
    filled = filters(counts, bits)
    filled = filled if inline else written(filled, "filter")
    whole = gathered(filled, bits, 0, segments) if inline else None
    cuts = np.array([s << (65 - segments.bit_length()) for s in range(step, segments, step)], np.uint64)
    n, v = counts.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("grams"), F.lit(0))).first()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                grams, c = _unpacked(blob)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(c)], ["h", "c"])

    words = written(counts.where("kind = 1").select("blob").mapInArrow(spread, "h long, c long"), "words")
    top = words.orderBy(F.desc("c"), "h").limit(heavy).toArrow()
    key = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    shared = spark.sparkContext.broadcast((whole, key[order], top.column("c").to_numpy()[order], n, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, keys, c, n, v = shared.value
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(2)):
                m = end - row
                text, h = tokens_of(data, offsets)
                unique, back = np.unique(h, return_inverse=True)
                back = back.ravel()
                at = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
                found = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
                exact = np.where(found, c[at], 0) if len(keys) else np.zeros(len(unique), np.int64)
                if inline:
                    end_count = looked_up(whole, np.array([END]))[0]
                    score = _scored(text, m, looked_up(whole, unique)[back], end_count, looked_up(whole, pairs_of(text, h)), weight, n, v)
                    frame, pieces = None, None
                else:
                    score = np.zeros(m)
                    frame, pieces = _chunk(text, m, h, cuts)
                known = exact[back] > 0
                light = ~found[back]
                tell = lambda x, m=m, text=text: np.bincount(text, x, m)
                light_text, light_h = text[light], h[light].view(np.int64)
                cut = np.concatenate([[0], np.cumsum(np.bincount(light_text, minlength=m))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cut), pa.array(light_h))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, m), batch.column(1).slice(row, m), batch.column(3).slice(row, m), pa.array(np.bincount(text, minlength=m)), pa.array(tell(known).astype(np.int64)), pa.array(tell(np.log10(exact + 1.0)[back])), pa.array(score), rare, pa.array([batch.column(3)[row].as_py()] * m, pa.int64()), pa.array([frame] + [None] * (m - 1), pa.binary()), pa.array([pieces] + [None] * (m - 1), pa.list_(pa.binary()))],
                    ["doc_id", "held_out", "row", "n_tokens", "known", "logs", "score", "rare", "chunk", "frame", "pieces"],
                )

    parts = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, known long, logs double, score double, rare array<long>, chunk long, frame binary, pieces array<binary>")
    parts = written(parts, "scored")
    by_part = None if inline else scores_by_part(parts.select("chunk", "frame", "pieces"), filled, bits, segments, step, weight, n, v)
    parts = parts.drop("chunk", "frame", "pieces")
    rare = parts.select("row", F.explode("rare").alias("h")).join(words, "h")
    rare = rare.groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1.0)).alias("l"))
    parts = parts.drop("rare") if inline else parts.drop("rare", "score").join(by_part, "row")
    zero = F.lit(0)
    whole_log = F.lit(float(np.log10(n + v + 1)))
    return parts.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", zero)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("l", F.lit(0.0)) - F.col("n_tokens") * whole_log).alias("base_score"), "score",
    )
