"""Linking two tables: comparison, pattern counting, EM, term-frequency adjustment, nesting, and extraction of matches.

Pairs are counted by pattern without becoming rows. Where one side has few distinct rows, they are broadcast, and each distinct row of the
other side finds those that agree with it somewhere; else values are joined, not rows, and inclusion and exclusion over the subsets of
variables gives the count of each pattern. Pairs become rows only where their pattern is listed; all pairs do only where a pattern without
any agreement is.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.scalar import probability, tf_denominator, tf_weight
from kindred.operators.compare import agreeing_pairs, agreeing_values, number_bucket, number_level, number_width, term_frequencies
from kindred.plans import config as cfg
from kindred.plans import em


def null_mask(variables: tuple[cfg.Variable, ...]):
    bits = [F.when(F.col(v.name).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(variables) if v.kind != "nested"]
    return reduce(lambda x, y: x + y, bits, F.lit(0)).cast("int")


def gamma_pairs(a: DataFrame, b: DataFrame, comparison: cfg.Comparison, nested: dict[str, DataFrame]) -> DataFrame:
    """id_a, id_b, gamma_1 .. gamma_k of all pairs that agree somewhere: one union and one aggregation, not a chain of joins."""
    variables = comparison.variables
    a, b = a.withColumn("mask_a", null_mask(variables)), b.withColumn("mask_b", null_mask(variables))
    parts = []
    for i, v in enumerate(variables):
        if v.kind == "nested":
            part = nested[v.name].join(a.select("id_a", "mask_a").hint(ROWS), "id_a").join(b.select("id_b", "mask_b").hint(ROWS), "id_b").withColumn("gamma", F.lit(2).cast("byte"))
        else:
            part = agreeing_pairs(a, b, v, ("mask_a",), ("mask_b",))
        parts.append(part.select("id_a", "id_b", "mask_a", "mask_b", F.lit(i).alias("i"), "gamma"))
    long = reduce(DataFrame.unionByName, parts)
    wide = long.groupBy("id_a", "id_b", "mask_a", "mask_b").agg(*(F.max(F.when(F.col("i") == i, F.col("gamma"))).alias(f"g{i}") for i in range(len(variables))))
    missing = lambda i: F.col("mask_a").bitwiseOR(F.col("mask_b")).bitwiseAND(1 << i) > 0
    return wide.select("id_a", "id_b", *(F.coalesce(f"g{i}", F.when(missing(i), F.lit(3)).otherwise(0)).cast("byte").alias(f"gamma_{i + 1}") for i in range(len(variables))))


def dense_pairs(a: DataFrame, b: DataFrame, comparison: cfg.Comparison, sparse: DataFrame) -> DataFrame:
    """All pairs of both tables with their levels; only for when a pattern without any agreement must be listed."""
    k = range(1, len(comparison.variables) + 1)
    every = a.select("id_a", null_mask(comparison.variables).alias("mask_a")).crossJoin(b.select("id_b", null_mask(comparison.variables).alias("mask_b")))
    missing = lambda i: F.col("mask_a").bitwiseOR(F.col("mask_b")).bitwiseAND(1 << (i - 1)) > 0
    return every.join(sparse.hint(ROWS), ["id_a", "id_b"], "left").select("id_a", "id_b", *(F.coalesce(f"gamma_{i}", F.when(missing(i), F.lit(3)).otherwise(0)).cast("byte").alias(f"gamma_{i}") for i in k))


#: Joins with rows of a side: Spark takes a side for as large as its compressed files, and would broadcast millions of rows through the driver.
ROWS = "merge"
TUPLES = 200_000  # most distinct rows of side b that are broadcast,
TUPLE_BYTES = 64 << 20  # most bytes of their strings,
VALUE_PAIRS = 5_000_000  # most agreeing pairs of values of a variable
TUPLE_PAIRS = 1_000_000_000  # and most pairs of distinct rows of both sides, as meeting them grows with these
LOOKUP = 200_000  # most agreeing pairs of values of a variable that are numbered, to be broadcast where pairs become rows


@dataclass
class Space:
    """The pairs of two tables under one comparison, counted and listed without making rows of those that don't matter.

    values has (va, vb, gamma) of each variable compared by more than equality; nested has (id_a, id_b) of each nested comparison's matches.
    Inside, variable i is column a<i> of the one side and b<i> of the other.
    """

    a: DataFrame
    b: DataFrame
    comparison: cfg.Comparison
    nested: dict[str, DataFrame]
    values: dict[int, DataFrame] = field(default_factory=dict)
    tuples: int = TUPLES
    sizes: dict[str, int] = field(default_factory=dict)
    twins: dict[int, int] | None = None
    missing: tuple[dict[int, int], dict[int, int]] | None = None
    codes: dict[int, tuple[DataFrame, DataFrame, DataFrame] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, v in enumerate(self.comparison.variables):
            if v.kind not in ("exact", "nested"):
                self.values[i] = agreeing_values(self.a, self.b, v).persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def flat(self) -> list[int]:
        return [i for i, v in enumerate(self.comparison.variables) if v.kind != "nested"]

    def first_of(self) -> dict[int, int]:
        """By variable, the first that is compared in the same way and has the same values in every row of both sides: both agree alike."""
        if self.twins is None:
            variables, flat = self.comparison.variables, self.flat
            plain = [replace(v, name="", tf_adjust=False, tf_adjustment_weight=1.0, tf_minimum_u_value=0.0) for v in variables]
            may = [(i, j) for i, j in combinations(flat, 2) if plain[i] == plain[j] and all(dict(x.dtypes)[variables[i].name] == dict(x.dtypes)[variables[j].name] for x in (self.a, self.b))]
            differ = [F.count_if(~F.col(variables[i].name).eqNullSafe(F.col(variables[j].name))) for i, j in may]
            apart = [x.agg(*differ).first() for x in (self.a, self.b)] if may else []
            self.twins = {i: i for i in range(len(variables))}
            for (i, j), n, m in zip(may, *apart, strict=True) if may else ():
                if not n and not m:
                    self.twins[j] = min(self.twins[j], self.twins[i])
        return self.twins

    def masks(self) -> tuple[dict[int, int], dict[int, int]]:
        """By side, the number of rows of each null mask."""
        if self.missing is None:
            self.missing = tuple(dict(map(tuple, self.side(w).groupBy(f"mask_{w}").count().collect())) for w in "ab")
        return self.missing

    def numbers(self, i: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """Numbers of the values of variable i that agree with any: (a<i>, x<i>), (b<i>, y<i>), and values as (x<i>, y<i>, gamma); None if there are
        more than LOOKUP agreeing pairs. Pairs of rows are told apart by them faster than by strings."""
        if i not in self.codes:
            self.codes[i], values = None, self.values[i]
            if self.comparison.variables[i].kind != "numeric" and values.count() <= LOOKUP:
                own = [values.select(F.col(f"v{w}").alias(f"{w}{i}")).distinct().withColumn(f"{c}{i}", F.row_number().over(Window.orderBy(f"{w}{i}"))) for w, c in ("ax", "by")]
                told = values.select(F.col("va").alias(f"a{i}"), F.col("vb").alias(f"b{i}"), "gamma").join(own[0], f"a{i}").join(own[1], f"b{i}").select(f"x{i}", f"y{i}", "gamma")
                self.codes[i] = tuple(x.persist(StorageLevel.MEMORY_AND_DISK) for x in (*own, told))
        return self.codes[i]

    def numbered(self, which: str) -> DataFrame:
        """side() with the numbers of its values, if they have any."""
        out, first_of = self.side(which), self.first_of()
        for i in self.values:
            if first_of[i] == i and (codes := self.numbers(i)):
                out = out.join(F.broadcast(codes[which == "b"]), f"{which}{i}", "left")
        return out

    def side(self, which: str) -> DataFrame:
        df, variables = getattr(self, which), self.comparison.variables
        return df.select(f"id_{which}", *(F.col(variables[i].name).alias(f"{which}{i}") for i in self.flat), null_mask(variables).alias(f"mask_{which}"))

    @staticmethod
    def _usable(df: DataFrame, columns: list[str]) -> DataFrame:
        """Rows without a null or NaN in the columns: only they can agree."""
        kinds = dict(df.dtypes)
        for c in columns:
            df = df.where(F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)))
        return df

    def _missing(self, wanted: list[int], left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides with part_a and part_b, which are equal in one row only of pairs whose null mask is wanted, and of no others: rows of the left
        whose masks need the same masks of the right are a part, and those of the right are in each part that needs them."""
        own, other = self.masks()
        parts: dict[frozenset[int], list[int]] = {}
        for x in own:
            if needs := frozenset(y for y in other if x | y in wanted):
                parts.setdefault(needs, []).append(x)
        of = F.coalesce(*(F.when(F.col("mask_a").isin(xs), F.lit(n)) for n, xs in enumerate(parts.values())), F.lit(None).cast("int"))
        for_ = F.array_compact(F.array(*(F.when(F.col("mask_b").isin(list(needs)), F.lit(n)) for n, needs in enumerate(parts)), F.lit(None).cast("int")))
        return left.withColumn("part_a", of).where("part_a is not null"), right.withColumn("part_b", F.explode(for_))

    def _met(self, left: DataFrame, right: DataFrame, subset: tuple[int, ...]) -> DataFrame:
        """Joins both sides where all variables of the subset agree; g<i> has the levels. Numbers meet by buckets. For similar strings, rows are
        repeated for each value: those of the left for every second variable and those of the right for the others, less than one side for all."""
        variables, keys, level = self.comparison.variables, [], {}
        banded = [i for i in subset if variables[i].kind == "numeric" and number_width(variables[i]) > 0]
        similar = [i for i in subset if i in self.values and i not in banded]
        coded = [i for i in similar if f"x{i}" in left.columns and f"y{i}" in right.columns]
        for i in subset:
            x, y = f"a{i}", f"b{i}"
            if i in banded:
                x, y, v = f"k{i}", f"l{i}", variables[i]
                left = left.withColumn(x, number_bucket(v, F.col(f"a{i}")))
                right = right.withColumn(y, F.explode(F.array(*(number_bucket(v, F.col(f"b{i}")) + F.lit(n) for n in (-1, 0, 1)))))
                level[f"g{i}"] = number_level(v, F.col(f"a{i}"), F.col(f"b{i}"))
            elif i in coded:
                value, x, y = F.broadcast(self.codes[i][2]).withColumnRenamed("gamma", f"g{i}"), f"k{i}", f"y{i}"
                if i in similar[::2]:
                    left = left.join(value.withColumnRenamed(f"y{i}", x), f"x{i}")
                else:
                    x, y = f"x{i}", f"l{i}"
                    right = right.join(value.withColumnRenamed(f"x{i}", y), f"y{i}")
            elif i in similar[::2]:
                x = f"k{i}"
                left = left.join(self.values[i].select(F.col("va").alias(f"a{i}"), F.col("vb").alias(x), F.col("gamma").alias(f"g{i}")), f"a{i}")
            elif i in similar:
                y = f"k{i}"
                right = right.join(self.values[i].select(F.col("va").alias(y), F.col("vb").alias(f"b{i}"), F.col("gamma").alias(f"g{i}")), f"b{i}")
            else:
                left = left.withColumn(f"g{i}", F.lit(2).cast("byte"))
            keys.append(F.col(x) == F.col(y))
        if "part_a" in left.columns:
            keys.append(F.col("part_a") == F.col("part_b"))
        close = [g.isNotNull() for g in level.values()]
        met = left.join(right.hint(ROWS), reduce(lambda x, y: x & y, keys + close))
        return met.drop(*(f"{x}{i}" for i in subset for x in "kl")).withColumns(level)

    def agreeing(self, subset: tuple[int, ...]) -> DataFrame:
        """code, mask, n: the numbers of pairs that agree on the subset, whatever the other variables do, by the subset's levels (base-4 code)
        and null masks. Both sides are histograms of the subset's values, so hot values are one row each and no pair becomes a row."""
        hist = []
        for which in "ab":
            columns = [f"{which}{i}" for i in subset]
            hist.append(self._usable(self.side(which), columns).groupBy(f"mask_{which}", *columns).agg(F.count("*").alias(f"n_{which}")))
        met = self._met(*hist, subset)
        code = reduce(lambda x, y: x + y, (F.col(f"g{i}").cast("long") * 4**i for i in subset))
        return met.groupBy(code.alias("code"), F.col("mask_a").bitwiseOR(F.col("mask_b")).alias("mask")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))

    def size(self, which: str) -> int:
        if which not in self.sizes:
            self.sizes[which] = getattr(self, which).count()
        return self.sizes[which]

    def release(self) -> None:
        """Gives back what is kept of the values and nested comparisons; it would be made again."""
        for x in (*self.values.values(), *self.nested.values(), *(x for xs in self.codes.values() for x in xs or ())):
            x.unpersist()

    def _histogram(self, which: str) -> DataFrame:
        return self.side(which).groupBy(f"mask_{which}", *(f"{which}{i}" for i in self.flat)).agg(F.count("*").alias("n"))

    def _few(self) -> pa.Table | None:
        """The distinct rows of side b, if they, all agreeing pairs of values, and the pairs with distinct rows of side a are few enough."""
        if not self.flat or not self.tuples:
            return None
        hist = self._histogram("b").persist(StorageLevel.MEMORY_AND_DISK)
        text = [F.octet_length(c) for c, kind in hist.dtypes if kind == "string"]
        n, size = hist.agg(F.count("*"), F.coalesce(F.sum(reduce(lambda x, y: x + y, (F.coalesce(t, F.lit(0)) for t in text), F.lit(0))), F.lit(0))).first()
        fits = n <= self.tuples and size <= TUPLE_BYTES and all(x.count() <= VALUE_PAIRS for x in self.values.values()) and n * self._histogram("a").count() <= TUPLE_PAIRS
        out = hist.toArrow() if fits else None
        hist.unpersist()
        return out

    def _met_rows(self, few: pa.Table) -> dict[tuple[int, int], int]:
        """(code of levels 1 and 2, null mask): number of pairs that agree just so; pairs that agree nowhere are left out."""
        flat, k = self.flat, len(self.comparison.variables)
        spots: dict[int, dict[Any, np.ndarray]] = {}  # by variable and value of b, the places of its rows
        for i in flat:
            by: dict[Any, list[int]] = {}
            for at, x in enumerate(few.column(f"b{i}").to_pylist()):
                if x is not None and x == x:
                    by.setdefault(x, []).append(at)
            spots[i] = {x: np.array(at, np.int64) for x, at in by.items()}
        near: dict[int, dict[Any, list[tuple[Any, int]]]] = {}
        for i, df in self.values.items():
            by = near[i] = {}
            for va, vb, g in zip(*(c.to_pylist() for c in df.select("va", "vb", "gamma").toArrow().columns), strict=True):
                by.setdefault(va, []).append((vb, g))
        shared = self.a.sparkSession.sparkContext.broadcast((spots, near, few.column("mask_b").to_numpy().astype(np.int64), few.column("n").to_numpy().astype(float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spots, near, mask_b, n_b = shared.value
            code, none = np.zeros(len(mask_b), np.int64), np.zeros(0, np.int64)
            found: dict[tuple[int, Any], tuple[np.ndarray, np.ndarray]] = {}

            def meet(i: int, x: Any) -> tuple[np.ndarray, np.ndarray]:
                """Places of the rows whose variable i agrees with x, and what they add to the code."""
                if i not in near:
                    at = spots[i].get(x, none)
                    return at, np.full(len(at), 2 << 2 * i)
                hits = [(spots[i][y], g << 2 * i) for y, g in near[i].get(x, ()) if y in spots[i]]
                if not hits:
                    return none, none
                return np.concatenate([at for at, _ in hits]), np.repeat([g for _, g in hits], [len(at) for at, _ in hits])

            keys, weights, held = [], [], 0

            def told() -> pa.RecordBatch:
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(back.ravel(), np.concatenate(weights), len(key))
                return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for mask, n, *row in zip(*columns, strict=True):
                    for i, x in zip(flat, row, strict=True):
                        if x is not None and x == x:
                            if (i, x) not in found:
                                if len(found) > 20_000:
                                    found.clear()
                                found[i, x] = meet(i, x)
                            at, add = found[i, x]
                            code[at] += add
                    t = np.flatnonzero(code)
                    keys.append(code[t] << k | mask_b[t] | mask)
                    weights.append(n_b[t] * n)
                    code[t] = 0
                    held += len(t)
                    if held > 1 << 20:
                        yield told()
                        keys, weights, held = [], [], 0
            if keys:
                yield told()

        rows = self._histogram("a").select("mask_a", "n", *(f"a{i}" for i in flat))
        spread = rows.repartition(4 * self.a.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "key long, n long")
        out = {(key >> k, key & (1 << k) - 1): n for key, n in spread.groupBy("key").agg(F.sum("n")).collect()}
        shared.destroy()
        return out

    def _by_subset(self, least: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        """(code, mask): number of pairs that agree just so, from least, which has those of code 0: all pairs by mask."""
        first = self.first_of()
        flat = [i for i in self.flat if first[i] == i]
        subsets = [s for r in range(1, len(flat) + 1) for s in combinations(flat, r)]
        for at in range(0, len(subsets), 4):
            for code, mask, n in reduce(DataFrame.unionByName, map(self.agreeing, subsets[at : at + 4])).collect():
                least[code, mask] = least.get((code, mask), 0) + n
        exact = dict(least)
        for i in flat:  # of pairs that agree on at least a set without i, those that agree on i as well are taken off
            shift = 4**i
            for (code, mask), n in list(exact.items()):
                if g := code // shift % 4:
                    exact[code - g * shift, mask] -= n
        return {(sum((code // 4 ** first[i] % 4) * 4**i for i in self.flat), mask): n for (code, mask), n in exact.items()}

    def counts(self) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        """Patterns [n, k], their counts over all pairs, and the sizes of both tables.

        Where side b has few distinct rows (TUPLES, TUPLE_BYTES, VALUE_PAIRS, TUPLE_PAIRS) they are broadcast and met by the distinct rows of side a. Else pairs
        that agree on at least a subset are counted for every subset of variables, and inclusion and exclusion leave those that agree on just the
        subset; that work is in proportion to the rows, not to the pairs. Either way at most 8 ** k rows reach the driver.
        """
        k, flat = len(self.comparison.variables), self.flat
        masks = self.masks()
        self.sizes |= {w: sum(x.values()) for w, x in zip("ab", masks, strict=True)}
        least: dict[tuple[int, int], int] = {}  # (code of levels 1 and 2, null mask): pairs
        for ma, na in masks[0].items():
            for mb, nb in masks[1].items():
                least[0, ma | mb] = least.get((0, ma | mb), 0) + na * nb
        if (few := self._few()) is not None:
            exact = self._met_rows(few)
            for (_, mask), n in list(exact.items()):
                least[0, mask] -= n
            exact |= least
        else:
            exact = self._by_subset(least)
        digits = lambda code: [code // 4**i % 4 for i in range(k)]
        counts: dict[tuple[int, ...], int] = {}
        for (code, mask), n in exact.items():
            p = tuple(g or 3 * (mask >> i & 1) for i, g in enumerate(digits(code)))
            counts[p] = counts.get(p, 0) + n
        if self.nested:
            some = reduce(DataFrame.union, (x.select("id_a", "id_b") for x in self.nested.values())).distinct()
            names = [f"gamma_{i + 1}" for i in range(k)]
            for *levels, n in self.levels(self._beside(some)).groupBy(*names).count().collect():
                plain = tuple(g if i in flat else 0 for i, g in enumerate(levels))
                counts[plain] -= n
                counts[tuple(levels)] = counts.get(tuple(levels), 0) + n
        counts = {p: n for p, n in counts.items() if n}
        order = sorted(counts)
        return np.array(order, np.int64).reshape(len(order), k), np.array([counts[p] for p in order], np.int64), (sum(masks[0].values()), sum(masks[1].values()))

    def _beside(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.side("a").hint(ROWS), "id_a").join(self.side("b").hint(ROWS), "id_b")

    def levels(self, pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """id_a, id_b, gamma_1 .. gamma_k, and the columns to keep, of pairs that carry the values of both sides and may carry levels g<i>."""
        out, kinds, first_of = pairs, dict(pairs.dtypes), self.first_of()
        for i, v in enumerate(self.comparison.variables):
            x, y = F.col(f"a{i}"), F.col(f"b{i}")
            if v.kind == "nested":
                own = self.nested[v.name].select("id_a", "id_b").distinct().withColumn("hit", F.lit(2))
                out = out.join(own.hint(ROWS), ["id_a", "id_b"], "left")
                g = F.coalesce("hit", F.lit(0))
            elif first_of[i] != i:
                g = F.col(f"gamma_{first_of[i] + 1}")
            elif f"g{i}" in kinds:
                g = F.col(f"g{i}")
            elif f"x{i}" in kinds and f"y{i}" in kinds:
                out = out.join(F.broadcast(self.codes[i][2]).withColumnRenamed("gamma", "hit"), [f"x{i}", f"y{i}"], "left")
                g = F.when(F.col("mask_a").bitwiseOR(F.col("mask_b")).bitwiseAND(1 << i) > 0, 3).otherwise(F.coalesce("hit", F.lit(0)))
            elif i in self.values:
                out = out.join(self.values[i].select(F.col("va").alias(f"a{i}"), F.col("vb").alias(f"b{i}"), F.col("gamma").alias("hit")), [f"a{i}", f"b{i}"], "left")
                g = F.when(x.isNull() | y.isNull(), 3).otherwise(F.coalesce("hit", F.lit(0)))
            else:
                same = (x == y) & ~F.isnan(x) if kinds[f"a{i}"] in ("double", "float") else x == y
                g = F.when(x.isNull() | y.isNull(), 3).when(same, 2).otherwise(0)
            out = out.withColumn(f"gamma_{i + 1}", g.cast("byte")).drop("hit")
        return out.select("id_a", "id_b", *(f"gamma_{i + 1}" for i in range(len(self.comparison.variables))), *keep)

    def with_patterns(self, patterns: np.ndarray, values: tuple[int, ...] = ()) -> DataFrame:
        """id_a, id_b, gamma_1 .. gamma_k of the pairs that have one of the patterns, and columns a<i>, b<i> of the variables told.

        Only pairs that agree wherever such a pattern does, and miss what it misses, are made rows; a pattern without any agreement needs all pairs.
        """
        keep = tuple(f"{w}{i}" for i in values for w in "ab")
        first_of = self.first_of()
        agree: dict[int, set[tuple[int, ...]]] = {}  # by null mask, the sets of variables that such patterns agree on
        for p in patterns:
            agree.setdefault(sum(1 << i for i in np.flatnonzero(p == 3).tolist()), set()).add(tuple(sorted({first_of[i] for i in np.flatnonzero((p == 1) | (p == 2)).tolist()})))
        k = len(self.comparison.variables)
        if any(() in sets for sets in agree.values()):
            found = dense_pairs(self.a, self.b, self.comparison, gamma_pairs(self.a, self.b, self.comparison, self.nested))
            for w in "ab" if values else "":
                found = found.join(self.side(w).select(f"id_{w}", *(f"{w}{i}" for i in values)).hint(ROWS), f"id_{w}")
        else:
            covers: dict[tuple[int, ...], list[int]] = {}  # the smallest of these sets, and the masks that need them
            for mask, sets in agree.items():
                for s in sets:
                    if not any(set(t) < set(s) for t in sets):
                        covers.setdefault(s, []).append(mask)
            order = sorted(covers, key=lambda s: (len(s), s))
            both = F.col("mask_a").bitwiseOR(F.col("mask_b"))
            # a pair is listed under the first cover that has it
            on = lambda s: reduce(lambda x, y: x & y, (F.col(f"gamma_{i + 1}").isin(1, 2) for i in s), both.isin(covers[s]))
            parts = []
            for n, cover in enumerate(order):
                inner = [i for i in cover if i not in self.flat]
                if inner:
                    part = self._beside(self.nested[self.comparison.variables[inner[0]].name].select("id_a", "id_b").distinct()).where(both.isin(covers[cover]))
                else:
                    part = self._met(*self._missing(covers[cover], *(self._usable(self.numbered(w), [f"{w}{i}" for i in cover]) for w in "ab")), cover)
                met = self.levels(part, ("mask_a", "mask_b", *keep))
                before = [on(s) for s in order[:n] if set(covers[s]) & set(covers[cover])]
                found = met.where(on(cover) & ~reduce(lambda x, y: x | y, before, F.lit(False)))
                parts.append(found.drop("mask_a", "mask_b"))
            found = reduce(DataFrame.unionByName, parts) if parts else self.levels(self._beside(self.a.select("id_a").limit(0).join(self.b.select("id_b").limit(0))), keep)
        kinds = ", ".join(f"gamma_{i + 1} byte" for i in range(k))
        wanted = self.a.sparkSession.createDataFrame([tuple(map(int, p)) for p in patterns], kinds)
        return found.join(F.broadcast(wanted), [f"gamma_{i + 1}" for i in range(k)], "left_semi")


def pattern_counts(a: DataFrame, b: DataFrame, comparison: cfg.Comparison, nested: dict[str, DataFrame] | None = None) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    return Space(a, b, comparison, nested or {}).counts()


@dataclass
class Link:
    """What linking returns. patterns: one row per pattern; pairs: agreeing pairs with pattern_id; matches(): pairs over a threshold."""

    spark: SparkSession
    comparison: cfg.Comparison
    fit: em.Fit
    idvar: tuple[str, str]
    space: Space
    tf_base: str | None = None
    children: dict[str, Link] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def tf(self) -> DataFrame | None:
        """tf_adjusted() of all pairs that agree somewhere; None without adjusted variables."""
        return tf_adjusted(self, self.pairs(), self.tf_base) if self.tf_base else None

    def release(self) -> None:
        """Gives back what this link and its nested ones keep in memory and on disk."""
        self.space.release()
        for child in self.children.values():
            child.release()

    @property
    def gammas(self) -> list[str]:
        return [f"gamma_{i}" for i in range(1, len(self.comparison.variables) + 1)]

    @property
    def patterns(self) -> DataFrame:
        """pattern_id, gamma_1 .. gamma_k (null: missing), counts, weights, p_gamma_jm, p_gamma_ju, zeta_j, is_match."""
        f = self.fit
        rows = [
            (i, *(None if g == 3 else int(g) for g in p), *map(float, (f.counts[i], f.weights[i], f.p_gamma_jm[i], f.p_gamma_ju[i], f.zeta[i])), bool(f.is_match[i]))
            for i, p in enumerate(f.patterns)
        ]
        kinds = ", ".join(f"{g} byte" for g in self.gammas)
        df = self.spark.createDataFrame(rows, f"pattern_id long, {kinds}, counts double, weights double, p_gamma_jm double, p_gamma_ju double, zeta_j double, is_match boolean")
        return df.withColumn("counts", F.col("counts").cast("long"))

    @property
    def parameters(self) -> DataFrame:
        """variable, level, p_m, p_u: the probabilities of each level among matches and others."""
        f = self.fit
        rows = [(v, int(x), float(m), float(u)) for v, xs, ms, us in zip(f.variables, f.levels, f.pgamma_km, f.pgamma_ku, strict=True) for x, m, u in zip(xs, ms, us, strict=True)]
        return self.spark.createDataFrame(rows, "variable string, level int, p_m double, p_u double")

    @property
    def patterns_b(self) -> list[tuple[int, ...]]:
        """The patterns observed, in the order of their numbers: 0 apart, 1 in part, 2 alike, 3 missing."""
        return [tuple(map(int, p)) for p in self.fit.patterns]

    @property
    def level_shares(self) -> DataFrame:
        """variable (its number), level (3: missing), share of all pairs."""
        f, n = self.fit, self.fit.counts.sum()
        rows = [(i, int(g), float(f.counts[f.patterns[:, i - 1] == g].sum() / n)) for i in range(1, len(f.variables) + 1) for g in np.unique(f.patterns[:, i - 1])]
        return self.spark.createDataFrame(rows, "variable int, level int, share double")

    @property
    def summary(self) -> dict[str, Any]:
        f = self.fit
        return {"obs_a": self.space.size("a"), "obs_b": self.space.size("b"), "p_m": f.p_m, "p_u": f.p_u, "number_of_comparisons": f.comparisons, "number_of_unique_patterns": len(f.counts), "iter_converge": f.iterations, "threshold_match": f.threshold, "varnames": f.variables}

    def _numbered(self, pairs: DataFrame) -> DataFrame:
        """pairs with pattern_id, zeta_j, weights; the pattern table has at most 4 ** k rows."""
        rows = [(i, *map(int, p), float(self.fit.zeta[i]), float(self.fit.weights[i])) for i, p in enumerate(self.fit.patterns)]
        table = self.spark.createDataFrame(rows, f"pattern_id long, {', '.join(f'{g} byte' for g in self.gammas)}, zeta_j double, weights double")
        return pairs.join(F.broadcast(table), self.gammas)

    def pairs(self, every: bool = False) -> DataFrame:
        """id_a, id_b, levels, pattern_id, zeta_j, weights of the pairs that agree somewhere, or of all pairs of both tables."""
        x = self.space
        found = gamma_pairs(x.a, x.b, x.comparison, x.nested)
        return self._numbered(dense_pairs(x.a, x.b, x.comparison, found) if every else found)

    def _hit(self, hit: np.ndarray, values: tuple[int, ...] = ()) -> DataFrame:
        return self._numbered(self.space.with_patterns(self.fit.patterns[hit], values))

    def matches(self, threshold: float | None = None) -> DataFrame:
        """The two id columns, pattern_id and zeta_j of pairs with zeta_j at or above the threshold (the configured one by default)."""
        t = self.fit.threshold if threshold is None else threshold
        return self._hit(self.fit.zeta >= t).select(F.col("id_a").alias(self.idvar[0]), F.col("id_b").alias(self.idvar[1]), "pattern_id", "zeta_j")

    def tf_matches(self) -> DataFrame:
        """tf_adjusted() of the pairs that it makes matches. A frequency is no less than its floor, which bounds what a pattern can gain."""
        f, best = self.fit, self.fit.weights + _odds(self.fit, self.tf_base)
        for i, v in enumerate(self.comparison.variables):
            if v.tf_adjust and v.kind != "nested":
                for g, share in _shares(f, i).items():
                    denominators = (1.0,) if v.kind == "numeric" else (v.tf_minimum_u_value, 1.0)
                    gain = max(v.tf_adjustment_weight * np.log(share / d) for d in denominators) if share else 0.0
                    best = best + np.where(f.patterns[:, i] == g, gain, 0.0)
        with np.errstate(over="ignore"):
            can = 1 / (1 + np.exp(-best)) >= f.threshold - 1e-9
        values = tuple(i for i, v in enumerate(self.comparison.variables) if v.tf_adjust and v.kind in ("exact", "string", "fuzzy"))
        return tf_adjusted(self, self._hit(can, values), self.tf_base).where("is_match")

    def decided(self) -> DataFrame:
        """id_a, id_b of the pairs that a nested comparison passes up: by adjusted weight if there is one, else by weight without prior."""
        if self.tf_base:
            return self.tf_matches().select("id_a", "id_b")
        with np.errstate(over="ignore"):
            hit = 1 / (1 + np.exp(-self.fit.weights)) >= self.fit.threshold
        return self._hit(hit).select("id_a", "id_b")


def _odds(f: em.Fit, prior_base: str) -> float:
    return float(np.log(f.p_m / f.p_u) if prior_base == "e" else np.log2(f.p_m / f.p_u))


def _shares(f: em.Fit, i: int) -> dict[int, float]:
    """Share of all pairs at each level of agreement of variable i."""
    return {g: float(f.counts[f.patterns[:, i] == g].sum() / f.counts.sum()) for g in (1, 2)}


def tf_adjusted(link: Link, pairs: DataFrame, prior_base: str = "2") -> DataFrame:
    """Of pairs as Link.pairs() gives them: id_a, id_b, pattern_id, tf_<variable>, final_weight, final_zeta, is_match, tf_adjusted.

    A variable's denominator is the mean of both sides' frequencies if exact, else the larger; numeric variables have denominator 1. The prior is
    added as a base-2 logarithm to natural weights unless prior_base is 'e'.
    """
    f, c = link.fit, link.comparison
    out = pairs
    total, used, flag = F.lit(_odds(f, prior_base)) + F.col("weights"), [], F.lit(False)
    for i, v in enumerate(c.variables, 1):
        if not v.tf_adjust or v.kind == "nested":
            continue
        shares = _shares(f, i - 1)
        u = F.when(F.col(f"gamma_{i}") == 2, F.lit(shares[2])).otherwise(F.lit(shares[1]))
        if v.kind == "numeric":
            out = out.withColumn(f"tf_{v.name}", F.lit(1.0))
        else:
            for side in "ab":
                value = f"{side}{i - 1}"
                if value not in out.columns:
                    out = out.join(link.space.side(side).select(f"id_{side}", value).hint(ROWS), f"id_{side}", "left")
                tf = term_frequencies(getattr(link.space, side), v, link.space.size(side)).select(F.col("v").alias(value), F.col("tf").alias(f"tf_{side}"))
                out = out.join(tf, value, "left")
            out = out.withColumn(f"tf_{v.name}", tf_denominator(F.col("tf_a"), F.col("tf_b"), v.kind == "exact")).drop("tf_a", "tf_b")
        relevant = F.col(f"gamma_{i}").isin(1, 2)
        total = total + F.when(relevant, tf_weight(u, F.col(f"tf_{v.name}"), v.tf_adjustment_weight)).otherwise(0.0)
        flag = flag | relevant
        used.append(f"tf_{v.name}")
    zeta = probability(F.col("final_weight"))
    return out.withColumn("final_weight", total).select("id_a", "id_b", "pattern_id", *used, "final_weight", zeta.alias("final_zeta"), (zeta >= f.threshold).alias("is_match"), flag.alias("tf_adjusted"))


def link(df_a: DataFrame, df_b: DataFrame, config: dict[str, Any], tf_prior_base: str = "2") -> Link:
    """Links two tables by a configuration. Ids must be unique on each side; the tables stay as they are."""
    levels = cfg.parse(config)
    ida, idb = cfg.ids(config)
    names = [v.name for c in levels for v in c.variables if v.kind != "nested"]
    a = df_a.select(F.col(ida).alias("id_a"), *names)
    b = df_b.select(F.col(idb).alias("id_b"), *names)
    done: dict[str, Link] = {}
    for c in levels:
        began = time.perf_counter()
        children = {v.name: done[v.name] for v in c.variables if v.kind == "nested"}
        space = Space(a, b, c, {n: x.decided().persist(StorageLevel.MEMORY_AND_DISK) for n, x in children.items()})
        patterns, counts, dims = space.counts()
        compared = time.perf_counter()
        known = {k: v for k, v in c.em.items() if k != "threshold_match"}
        found = em.fit(patterns, counts, dims, [v.name for v in c.variables], threshold_match=c.threshold, **known)
        result = Link(df_a.sparkSession, c, found, (ida, idb), space, tf_prior_base if any(v.tf_adjust for v in c.variables) else None, children)
        result.seconds = {"compare": compared - began, "em": time.perf_counter() - compared}
        done[c.name] = result
    return done[levels[-1].name]


def get_matches(result: Link, threshold: float | None = None) -> DataFrame:
    return result.matches(threshold)
