"""Near-duplicates of embeddings: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Equal vectors of a label are one weighted vertex. A vector is a target in the cell of its nearest centroid, and a query there and in
every other cell that a partner may be nearest to: a partner lies within r = sqrt(2 - 2 * threshold) of the unit vector, so only
cells that reach within r of it are visited. So no link is lost, however the cells were fitted. Within a cell, blocks of
targets meet blocks of queries as matrix products; a product gives counts of links and a spanning forest, never a list of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_text import forest
from .store import components, written


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_cells(vectors: DataFrame, sample_rows: int = 20_000, rows_per_cell: int = 16_000, max_cells: int = 1024, rounds: int = 6) -> dict[int, np.ndarray]:
    """Unit centroids by dimension, by spherical k-means on at most sample_rows vectors (those of the smallest key hashes).

    Vectors of different labels never meet, so cells are only as many as the label that a vector is likely to have needs.
    """
    labels = vectors.groupBy("dim", "label").agg(F.count("*").alias("n"))
    typical = {r["dim"]: r["n"] for r in labels.groupBy("dim").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).collect()}
    sample = vectors.select("dim", "embedding", F.xxhash64("key").alias("h")).orderBy("h").limit(sample_rows).toArrow()
    out, dims = {}, sample.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        x = _matrix(sample.filter(pa.array(dims == dim)).column("embedding").combine_chunks())
        k = int(np.clip(typical[dim] // rows_per_cell, 1, min(max_cells, len(x))))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        out[dim] = c
    return out


def visited(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's nearest centroid, and [n, k] which cells may hold a vector within `reach` of it.

    A vector y of cell j is at least as near to centroid j as to any mean of others, so y = x + d, |d| <= reach, needs
    x (mean - j) <= reach * |mean - j|. That is asked for the means of the 1, 2, 4 and 8 centroids nearest to x.
    """
    sims, between = x @ c.T, c @ c.T
    order = np.argsort(-sims, axis=1, kind="stable")[:, :8]
    ok = np.ones(sims.shape, bool)
    at, cross, inner = np.zeros(len(x)), np.zeros(sims.shape), np.zeros(len(x))
    rows = np.arange(len(x))
    for m in range(1, order.shape[1] + 1):
        new = order[:, m - 1]
        at += sims[rows, new]
        inner += 2 * cross[rows, new] + 1  # squared length of the sum so far
        cross += between[new]
        if m & (m - 1) == 0:
            gap = np.sqrt(np.maximum(0, 1 - 2 * cross / m + (inner / m**2)[:, None]))
            ok &= (at / m)[:, None] - sims <= reach * gap + 1e-9
    ok[rows, order[:, 0]] = True
    return order[:, 0], ok


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        key, target = np.array(table.column("key").to_pylist(), object), table.column("target").to_numpy()
        x, weight = _matrix(table.column("embedding").combine_chunks()), table.column("n").to_numpy()
        t, q = np.flatnonzero(target), np.flatnonzero(~target)
        out_a, out_b, out_n = [], [], []
        names = {}
        number = np.array([names.setdefault(s, len(names)) for s in key.tolist()], np.int64)
        ones, twos = [], []
        step = max(1, 2_000_000 // max(1, len(t)))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            near = x[part] @ x[t].T >= threshold
            count = near @ weight[t]
            some = np.flatnonzero(count)
            out_a += key[part[some]].tolist()
            out_b += [None] * len(some)
            out_n += count[some].tolist()
            r, c = np.nonzero(near)
            a, b = number[part[r]], number[t[c]]
            keep = a != b
            a, b = a[keep], b[keep]
            take = forest(a, b, len(names))
            ones += a[take].tolist()
            twos += b[take].tolist()
        label = list(names)
        take = forest(np.array(ones, np.int64), np.array(twos, np.int64), len(names))
        out_a += [label[ones[j]] for j in take]
        out_b += [label[twos[j]] for j in take]
        out_n += [0] * len(take)
        return pa.table({"a": pa.array(out_a, pa.string()), "b": pa.array(out_b, pa.string()), "n": pa.array(out_n, pa.int64())})

    return run


def near_vectors(table: DataFrame, threshold: float = 0.98, block: int = 8000, **fit) -> DataFrame:
    """One row per row of table(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least threshold.
    Vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing: no links, own id, kept.
    Repeated rows are vectors of their own. A row with a null vec_id counts as a link of others; its component is the
    smallest id that is not null, if there is one. Other columns are not looked at; an empty table gives an empty result.
    """
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    flat = F.transform(e, lambda v: v + F.lit(0.0))  # -0.0 is 0.0
    rows = table.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("embedding", flat).withColumn("key", F.when(F.col("fine"), F.concat(F.hex(F.xxhash64("label", "embedding")), F.lit("-"), F.hex(F.xxhash64("embedding", "label", F.lit(1))))))
    rows = written(rows, "vectors")
    unique = rows.where("fine").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    unique = written(unique.withColumn("dim", F.size("embedding")), "vertices")
    centres = unique.sparkSession.sparkContext.broadcast(fit_cells(unique, **fit))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x, c = _matrix(part.column(2)), centres.value.get(dim, np.eye(1, dim))
                home, visit = visited(x, c, reach)
                r, cell = np.nonzero(visit)
                at = np.concatenate([r, np.arange(len(x))])
                where = np.concatenate([cell, home])
                target = np.concatenate([np.zeros(len(r), bool), np.ones(len(x), bool)])
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where.astype(np.int32)), pa.array(target)], names)

    names = ["dim", "label", "embedding", "key", "n", "cell", "target"]
    dealt = unique.select("dim", "label", "embedding", "key", "n").mapInArrow(deal, unique.select("dim", "label", "embedding", "key", "n").schema.add("cell", "integer").add("target", "boolean"))
    dealt = written(dealt, "cells")
    group = ["dim", "label", "cell"]
    sizes = dealt.groupBy(*group).agg(*(F.ceil(F.greatest(F.lit(1), F.count_if(F.col("target") == t)) / block).cast("int").alias(name) for t, name in ((True, "bt"), (False, "bq"))))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("target"), F.col("bt")).otherwise(F.col("bq"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("target"), F.col("bq")).otherwise(F.col("bt")) - 1))
    blocks = dealt.join(sizes, group).withColumn("own", own).withColumn("other", other)
    blocks = blocks.withColumns({"i": F.when(F.col("target"), F.col("own")).otherwise(F.col("other")), "j": F.when(F.col("target"), F.col("other")).otherwise(F.col("own"))})
    found = written(blocks.select(*group, "i", "j", "key", "embedding", "n", "target").groupBy(*group, "i", "j").applyInArrow(_compare(threshold), "a string, b string, n long"), "compared")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("v", "key").join(unique.select("key", "least"), "key")
    names_ = roots.groupBy("root").agg(F.min("least").alias("root_id"))
    roots = roots.join(names_, "root").select("key", "root_id")
    named = unique.select("key", "least").join(roots, "key", "left").join(counts, "key", "left")
    named = named.select("key", (F.col("n") - 1).alias("n_links"), F.coalesce("root_id", "least").alias("component_id"))
    out = rows.select("vec_id", "key").join(named, "key", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
