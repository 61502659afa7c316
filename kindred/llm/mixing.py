"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each document has a fixed 60-bit hash. Words are summed by source and leading hash bits; the bucket in which a source's budget ends
is split again by its next bits, until it holds one hash; documents below the threshold found so are taken once more.
No sort of documents, and no row but counts of levels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import dropped, running, unused, written

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
HASH_BITS = 60
SMALL = 10_000  # most sources whose thresholds are broadcast


def document_hash() -> Column:
    """The 60 bits that the first 15 hex digits of the MD5 of doc_id spell (of the empty text where it is null)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), h of each row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), document_hash().alias("h"))


def targets(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. Sources in order of code points, null last, weigh `weights` in turn; `share` times all sizes are
    shared by weight, no source gets over `most` times its size, and what is cut off goes to the others by weight."""
    # rank is over source names, kept under another name; a null source is last
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = running(sums, [F.col("source").asc_nulls_last()], []).withColumnRenamed("rank", "number")
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    t = running(t, [F.col("ratio"), F.col("number")], ["cap", "w"])
    size, weight = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    rate = (share * F.lit(size) - F.col("before_cap")) / (F.lit(weight) - F.col("before_w"))
    # the first source, from the smallest ratio on, whose cap isn't reached sets the rate for itself and all after it
    final = t.withColumn("rate", rate).agg(F.min_by("rate", F.when(F.col("cap") > F.col("rate") * F.col("w"), F.col("rank")))).first()[0]
    target = F.col("cap") if final is None else F.least("cap", F.lit(final) * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, times (how often every document is taken), below (documents of a lower hash are taken once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.withColumn("times", whole).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    state = written(state.withColumns({"prefix": F.lit(0).cast("long"), "done": F.lit(0).cast("long"), "one": F.lit(False)}), "budget")
    sources = state.count()
    shift = HASH_BITS
    small = (lambda df: F.broadcast(df)) if sources <= SMALL else (lambda df: df)
    while shift > 0:
        last, shift = shift, shift - LEVEL_BITS
        # documents of each source's open bucket, by the next bits
        open_ = state.where("not one").select(F.col("source").alias("s"), "prefix")
        inside = rows.join(small(open_), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", last) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("z"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        order = W.partitionBy("source").orderBy("b")
        hist = hist.withColumn("upto", F.sum("z").over(order))
        found = hist.join(small(state.select(F.col("source").alias("s"), "need", "done")), F.col("source").eqNullSafe(F.col("s")))
        ends = found.where(F.col("done") + F.col("upto") >= F.col("need")).groupBy("s").agg(F.min_by(F.struct("b", (F.col("done") + F.col("upto") - F.col("z")).alias("d"), "z", "lo", "hi"), "b").alias("e"))
        before, new = state, state.join(small(ends), F.col("source").eqNullSafe(F.col("s")), "left")
        e = F.col("e")
        single = (e["lo"] == e["hi"]) | F.lit(shift == 0)
        # at a single hash, the nearer side of it; no such bucket: nothing more fits or is needed
        nearer = F.when(F.col("need") - e["d"] > e["d"] + e["z"] - F.col("need"), e["hi"] + 1).otherwise(e["lo"])
        keep = F.col("one")
        state = new.select(
            "source", "source_size", "target", "times", "need",
            F.when(keep, F.col("prefix")).when(e.isNull(), F.lit(1 << HASH_BITS)).when(single, nearer).otherwise(e["b"]).alias("prefix"),
            F.when(keep | e.isNull(), F.col("done")).otherwise(e["d"]).alias("done"),
            (keep | e.isNull() | single).alias("one"),
        )
        old, state = before, written(state, "budget")
        dropped(old)
        if state.where("not one").isEmpty():
            break
    return state.select("source", "source_size", "target", "times", F.col("prefix").alias("below"))


def mix(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows with source_size, target, times and copies of thresholds(): how often the mix takes each row."""
    limits = thresholds(rows, goal).withColumnRenamed("source", "s")
    limits = F.broadcast(limits) if limits.count() <= SMALL else limits
    return rows.join(limits, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", F.col("times") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).drop("s")


def mixed_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    A null text has no words. Null is a source of its own. Rows with one doc_id are taken or left together. A source without
    words has target 0. An empty table gives an empty result.
    """
    rows = written(sized(docs), "sizes")
    return mix(rows, targets(rows, weights, share, most)).select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with the columns of docs. Texts aren't shuffled."""
    rows = written(sized(docs), "sizes")
    s, times, below, n, h = unused(docs.columns, "s", "times", "below", "n", "h")
    limits = thresholds(rows, targets(rows, weights, share, most)).select(F.col("source").alias(s), F.col("times").alias(times), F.col("below").alias(below))
    limits = F.broadcast(limits) if limits.count() <= SMALL else limits
    taken = docs.withColumn(h, document_hash()).join(limits, F.col("source").eqNullSafe(F.col(s)))
    copies = F.col(times) + F.when(F.col(h) < F.col(below), 1).otherwise(0)
    return taken.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
