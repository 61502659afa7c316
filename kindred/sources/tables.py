"""Reading and writing tables, with the null tokens and row ids that linking expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_TOKENS = ("", "NA")
MORE_NULL_TOKENS = ("", "NA", "NaN", "NULL", "Null")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one where Spark runs in this process alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="kindred-")


def with_nulls(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """String columns with null in place of the tokens."""
    text = {n for n, t in df.dtypes if t == "string"}
    return df.select(*(F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns))


#: Types that a column of text is tried for, narrowest first, and what its values must look like besides being castable.
TRIED = {"bigint": "^[-+]?[0-9]+$", "double": "[0-9]", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp": "^[0-9]{4}-", "boolean": "(?i)^(true|false)$"}


def inferred(df: DataFrame) -> DataFrame:
    """df with each string column cast to the first of TRIED that takes all its values; one without a value stays as it is. One pass."""
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    fits = lambda c, t: F.col(c).rlike(TRIED[t]) & F.col(c).try_cast(t).isNotNull()
    tests = [F.count_if(F.col(c).isNotNull() & ~fits(c, t)).alias(f"{i}_{t}") for i, c in enumerate(text) for t in TRIED]
    odd = df.agg(*tests, *(F.count(c).alias(f"{i}_n") for i, c in enumerate(text))).first()
    kinds = {c: next((t for t in TRIED if odd[f"{i}_n"] and not odd[f"{i}_{t}"]), "string") for i, c in enumerate(text)}
    return df.select(*(F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in df.dtypes))


def read_csv(spark: SparkSession, path: str, tokens: tuple[str, ...] = NULL_TOKENS, schema: str | None = None, limit: int | None = None) -> DataFrame:
    """A CSV file with a header. The tokens are null; types are those of the schema, or inferred without one. Lines without any text are
    passed over; of the rest the first `limit` count, or all."""
    df = with_nulls(spark.read.option("header", True).csv(path), tokens)
    df = df.limit(limit) if limit is not None else df
    return df.select(*(F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema).schema)) if schema else inferred(df)


def write_csv(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def with_row_hash(df: DataFrame, name: str) -> DataFrame:
    """df with a 64-bit hash of all its columns; equal rows have equal hashes."""
    return df.withColumn(name, F.xxhash64(*df.columns))


def upper(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns in capitals, as comparisons of strings expect them."""
    return df.withColumns({c: F.upper(c) for c in columns})


def cardinalities(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of distinct values of each column."""
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns or df.columns))
