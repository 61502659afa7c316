"""Scoring of a stream of records against a fixed table with the parameters of an earlier link (an extension)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.link import Link, gamma_pairs
from kindred.plans import config as cfg


def score_batch(trained: Link, batch: DataFrame, table: DataFrame, config: dict[str, Any], threshold: float | None = None) -> DataFrame:
    """id_a, id_b, weight, zeta of batch's rows (side A) that match the table (side B), by the trained probabilities of each level.

    Comparisons must be flat. A level that training didn't meet adds nothing.
    """
    (comparison,) = cfg.parse(config)
    ida, idb = cfg.ids(config)
    names = [v.name for v in comparison.variables]
    pairs = gamma_pairs(batch.select(F.col(ida).alias("id_a"), *names), table.select(F.col(idb).alias("id_b"), *names), comparison, {})
    f, weight = trained.fit, F.lit(float(np.log(trained.fit.p_m / trained.fit.p_u)))
    for i, (levels, m, u) in enumerate(zip(f.levels, f.pgamma_km, f.pgamma_ku, strict=True), 1):
        for level, x, y in zip(levels.tolist(), m, u, strict=True):
            if x > 0 and y > 0:
                weight = weight + F.when(F.col(f"gamma_{i}") == level, F.lit(float(np.log(x / y)))).otherwise(0.0)
    t = f.threshold if threshold is None else threshold
    zeta = 1 / (1 + F.exp(-weight))
    return pairs.select("id_a", "id_b", weight.alias("weight"), zeta.alias("zeta")).where(F.col("zeta") >= t)


def score_stream(trained: Link, stream: DataFrame, table: DataFrame, config: dict[str, Any], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Scores each micro-batch and hands the matches to sink(matches, batch_id)."""
    run = lambda batch, n: sink(score_batch(trained, batch, table, config), n)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
