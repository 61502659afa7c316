"""Comparison joins: for one variable, the pairs of rows that agree in part or whole, as (id_a, id_b, gamma) with gamma 1 or 2.

Absent pairs are 0, or 3 where either value is null. Values are compared once each: distinct values are joined, and what
agrees is joined back to the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.scalar import MATCH, PARTIAL
from kindred.functions.similarity import Fuzzy, Many
from kindred.plans.config import Variable

BLOCK_VALUES = 10_000  # distinct values of a side that a group holds


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """The dictionary of a column, without null."""
    return df.select(F.col(name).alias("v")).where("v is not null").distinct()


def exact_values(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    both = distinct_values(a, name).intersect(distinct_values(b, name))
    return both.select(F.col("v").alias("va"), F.col("v").alias("vb"), F.lit(MATCH).cast("byte").alias("gamma"))


def number_width(v: Variable) -> float:
    return float(v.cut_b if v.partial else v.cut_a)


def number_bucket(v: Variable, x: Column) -> Column:
    """Numbers that agree lie in the same bucket or in neighbours; infinities agree with nothing."""
    return F.floor(x.cast("double") / number_width(v))


def number_level(v: Variable, x: Column, y: Column) -> Column:
    d = F.abs(x - y)
    return (F.when(d <= v.cut_a, MATCH).when(d <= v.cut_b, PARTIAL) if v.partial else F.when(d < v.cut_a, MATCH)).cast("byte")


def number_values(a: DataFrame, b: DataFrame, v: Variable) -> DataFrame:
    """Band join on buckets as wide as the band: each value of b meets those of a in its bucket and its neighbours."""
    left, right = (distinct_values(x, v.name).where(~F.isnan(F.col("v").cast("double"))).withColumnRenamed("v", n) for x, n in ((a, "va"), (b, "vb")))
    if number_width(v) <= 0:
        pairs = left.join(right, F.col("va") == F.col("vb"))
    else:
        near = F.explode(F.array(*(number_bucket(v, F.col("vb")) + F.lit(i) for i in (-1, 0, 1))))
        pairs = left.withColumn("k", number_bucket(v, F.col("va"))).join(right.withColumn("k", near), "k")
    return pairs.select("va", "vb", number_level(v, F.col("va"), F.col("vb")).alias("gamma")).where("gamma is not null")


def string_values(a: DataFrame, b: DataFrame, v: Variable) -> DataFrame:
    """Every distinct value of a against every one of b, in numpy; only agreeing pairs leave the workers.

    Both sides are dealt to blocks by hash, and each block of a meets each of b in a group of its own, so nothing passes the driver and no
    task holds more than two blocks. There are at least four groups a core.
    """
    spark = a.sparkSession
    sides = [distinct_values(a, v.name), distinct_values(b, v.name)]
    sizes = [x.count() for x in sides]
    cores = spark.sparkContext.defaultParallelism
    j = max(1, -(-sizes[1] // BLOCK_VALUES))
    i = max(1, -(-sizes[0] // BLOCK_VALUES), min(sizes[0], -(-4 * cores // j)))
    own = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sides[0].select("v", own(i).alias("i"), F.lit(True).alias("asks")).withColumn("j", each(j))
    right = sides[1].select("v", own(j).alias("j"), F.lit(False).alias("asks")).withColumn("i", each(i))
    cut = v.cut_b if v.partial else v.cut_a

    def run(table: pa.Table) -> pa.Table:
        values, asks = table.column("v"), table.column("asks").combine_chunks()
        words, others = values.filter(asks).to_pylist(), values.filter(pc.invert(asks)).to_pylist()
        va, vb, gamma = [], [], []
        if others:
            scorer = Fuzzy(others, v.upper) if v.kind == "fuzzy" else Many(others)
            for x in words:
                s = scorer.score(x, v.w) if v.kind == "fuzzy" else np.round(scorer.score(v.distance, x, v.w, cut), 4)
                hit = np.flatnonzero(s >= cut)
                va += [x] * len(hit)
                vb += [others[k] for k in hit.tolist()]
                gamma += np.where(s[hit] >= v.cut_a, MATCH, PARTIAL).tolist()
        return pa.table({"va": pa.array(va, pa.string()), "vb": pa.array(vb, pa.string()), "gamma": pa.array(gamma, pa.int8())})

    both = left.unionByName(right).repartition(min(i * j, 10_000), "i", "j")
    return both.groupBy("i", "j").applyInArrow(run, "va string, vb string, gamma byte")


def agreeing_values(a: DataFrame, b: DataFrame, v: Variable) -> DataFrame:
    """(va, vb, gamma) of a variable; the registry of comparison methods."""
    if v.kind == "exact":
        return exact_values(a, b, v.name)
    if v.kind == "numeric":
        return number_values(a, b, v)
    return string_values(a, b, v)


def agreeing_pairs(a: DataFrame, b: DataFrame, v: Variable, keep_a: tuple[str, ...] = (), keep_b: tuple[str, ...] = ()) -> DataFrame:
    """(id_a, id_b, gamma) with further columns of a and b. a has id_a and the variable, b has id_b and the variable."""
    left = a.where(F.col(v.name).isNotNull()).select("id_a", F.col(v.name).alias("va"), *keep_a)
    right = b.where(F.col(v.name).isNotNull()).select("id_b", F.col(v.name).alias("vb"), *keep_b)
    if v.kind == "exact":
        nan = ~F.isnan("va") if dict(left.dtypes)["va"] in ("double", "float") else F.lit(True)
        return left.where(nan).join(right.hint("merge"), F.col("va") == F.col("vb")).select("id_a", "id_b", F.lit(MATCH).cast("byte").alias("gamma"), *keep_a, *keep_b)
    return agreeing_values(a, b, v).join(left.hint("merge"), "va").join(right.hint("merge"), "vb").select("id_a", "id_b", "gamma", *keep_a, *keep_b)


def agreeing_totals(a: DataFrame, b: DataFrame, v: Variable) -> DataFrame:
    """gamma, pairs, mark: of the pairs that agree, their number and the sum of the products of both sides' column `mark`.

    Each value is a row with its count and its sum of marks, so that no pair of rows becomes a row. Both are decimals: products outgrow a long.
    """
    total = "decimal(38,0)"
    left, right = (
        x.where(F.col(v.name).isNotNull()).groupBy(F.col(v.name).alias(f"v{s}")).agg(F.count("*").cast(total).alias(f"n_{s}"), F.sum(F.col("mark").cast(total)).cast(total).alias(f"m_{s}"))
        for x, s in ((a, "a"), (b, "b"))
    )
    if v.kind == "exact":
        nan = ~F.isnan("va") if dict(left.dtypes)["va"] in ("double", "float") else F.lit(True)
        met = left.where(nan).join(right, F.col("va") == F.col("vb")).withColumn("gamma", F.lit(MATCH).cast("byte"))
    else:
        met = agreeing_values(a, b, v).join(left, "va").join(right, "vb")
    return met.groupBy("gamma").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"), F.sum(F.col("m_a") * F.col("m_b")).alias("mark"))


def term_frequencies(df: DataFrame, v: Variable, rows: int | None = None) -> DataFrame:
    """(v, tf): each value's share of all rows (counted unless told), nulls among them, at least the floor."""
    n = df.count() if rows is None else rows
    return df.where(F.col(v.name).isNotNull()).groupBy(F.col(v.name).alias("v")).agg(F.greatest(F.count("*") / F.lit(n), F.lit(v.tf_minimum_u_value)).alias("tf"))
