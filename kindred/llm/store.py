"""Tables written to the folder that all executors share, and graph components built on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where it is unset and Spark runs in this process alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets texts reach Python at most so many rows at a time: JVM and Python hold a batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until none is one of the columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with rank, its rows' places from 1 in the order, and before_<c>, the sum of each column c over the rows before.

    Rows are dealt by ranges of the order and numbered within each; only the ranges' totals are put in order in one task. The order must
    tell all rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.count("*").alias("rows"), *(F.sum(c).alias(f"sum_{c}") for c in sums))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = totals.select("part", zero("rows", earlier).alias("rows"), *(zero(f"sum_{c}", earlier).alias(f"sum_{c}") for c in sums))
    within = W.partitionBy("part").orderBy(*order)
    above = within.rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "part")  # at most `parts` rows
    return placed.select(*df.columns, (F.col("rows") + F.row_number().over(within)).alias("rank"), *((F.col(f"sum_{c}") + zero(c, above)).alias(f"before_{c}") for c in sums))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), by alternating large-star and small-star rounds.

    Returns (v, root), root being the smallest vertex of v's component; vertices without an edge to another one are absent.
    The edge list is replaced by a written table after each round; nothing but a count and a checksum reaches the driver.
    Self-loops, repeated edges and nulls are ignored. An empty edge list gives an empty result.
    """
    now = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(old)
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before:
            roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
