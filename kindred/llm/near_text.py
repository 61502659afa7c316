"""MinHash near-duplicates of texts by a chosen-path set similarity join.

Texts become sets of word shingles. Equal sets are one vertex. Each of `trees` independent trees deals the vertices to nodes by
one minwise token; a node of more than `node_limit` vertices branches on by two further tokens chosen by the node itself, to at
most `depth` levels; in what is then still large, a few hubs are compared with all rows, and rows outside the largest class that the hubs
make with all rows, block by block. Nodes are compared exhaustively on 128-byte signatures; each emits a spanning forest of its likely links, never all pairs.
Likely links form clusters, whose members are then compared on their full shingle sets in the same way: a link counts only if
100 * intersection >= percent * union.

A pair of similarity s meets in one tree's nodes with probability s if no node branches; each level at which its node branches by two
tokens takes a factor of 1 - (1 - s) ** 2 more, 0.96 at 0.8. So it misses all of 10 trees with (1 - 0.8) ** 10 = 1e-7 without
branching, and with (1 - 0.8 * 0.96 ** 2) ** 10 = 2e-6 after two branchings; the signature test misses it with about 2e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from .store import components, dropped, small_batches, unused, written
from .words import SPACED, distinct_by_text, mixed, shingles_of, text_chunks, words_of

BYTES = 128  # of a signature
LIKELY = 0.65  # least estimated similarity of a likely link
HUBS = 8  # of a group of more than one block
BLOCK = 32 << 20  # most bytes of a block
BITMAP = 24  # log2 of the bits of the set of wanted documents


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minwise(value: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n minwise tokens of each set; sets are slices of value that start at begin."""
    out = np.empty((len(begin), n), np.uint32)
    for j, a in enumerate(_multipliers(n)):
        x = value * a
        out[:, j] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), begin)
    return out


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: first and end row, the rows that have shingles, where each one's begin, and the distinct shingles."""
    for row, end, data, offsets in text_chunks(column):
        text, _, _, hashes = words_of(data, offsets, SPACED)
        owner, value = distinct_by_text(*shingles_of(text, hashes, k))
        counts = np.bincount(owner, minlength=end - row) if len(owner) else np.zeros(end - row, np.int64)
        have = np.flatnonzero(counts)
        begin = np.concatenate([[0], np.cumsum(counts[have])])
        yield row, end, have, begin, value


def _set_ids(value: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """16 bytes that stand for a whole set."""
    if not len(begin):
        return []
    one, two = np.add.reduceat(mixed(value), begin), np.add.reduceat(mixed(value ^ np.uint64(0x5851F42D4C957F2D)), begin)
    both = np.column_stack([mixed(one), mixed(two)]).astype(">u8").tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def signatures(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """doc_id, n_shingles, sid (null: no shingles), sig, tokens of each row of docs(doc_id, text)."""
    width = BYTES + trees
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, have, begin, value in _sets(batch.column(1), k):
                n = end - row
                size, sid, sig, tok = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n
                if len(have):
                    least = _minwise(value, begin[:-1], width)
                    size[have] = np.diff(begin)
                    small = (least[:, :BYTES] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()
                    tokens = least[:, BYTES:].astype(np.int64)
                    for i, (at, key) in enumerate(zip(have.tolist(), _set_ids(value, begin[:-1]), strict=True)):
                        sid[at], sig[at], tok[at] = key, small[i * BYTES : (i + 1) * BYTES], tokens[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n).cast(pa.int64()), pa.array(size), pa.array(sid, pa.binary()), pa.array(sig, pa.binary()), pa.array(tok, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "sid", "sig", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, sid binary, sig binary, tokens array<long>")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Indices of the pairs (a, b), taken in order, that join two trees."""
    up, out = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            out.append(i)
    return out


def _told(table: pa.Table, ids: list[bytes], a: list[int], b: list[int]) -> pa.Table:
    """Links (g, a, b)."""
    g = table.column("g")[0].as_py()
    return pa.table({"g": pa.array([g] * len(a), pa.int64()), "a": pa.array([ids[i] for i in a], pa.binary()), "b": pa.array([ids[i] for i in b], pa.binary())})


def _likely(table: pa.Table) -> pa.Table:
    """Spanning forest of the likely links between the rows of a group that ask and all its rows."""
    ids, asks = table.column("sid").to_pylist(), table.column("asks").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, BYTES)
    need = int(np.ceil(BYTES * (LIKELY + (1 - LIKELY) / 256)))
    ones, twos, n, who = [], [], len(ids), np.flatnonzero(asks)
    step = max(1, (1 << 22) // (max(n, 1) * BYTES))
    for i in range(0, len(who), step):
        part = who[i : i + step]
        # where all ask, each pair is looked at once
        low = int(part[0]) if len(who) == n else 0
        x, y = np.nonzero((sig[part, None, :] == sig[None, low:, :]).sum(2, dtype=np.uint8) >= need)
        x, y = part[x], y + low
        take = forest(x, y, n)
        ones.append(x[take])
        twos.append(y[take])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (ones, twos))
    take = forest(a, b, n)
    return _told(table, ids, a[take].tolist(), b[take].tolist())


def _linked(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Spanning forest of the links, by full sets, between the rows of a group that ask and all its rows."""
        ids, asks = table.column("sid").to_pylist(), table.column("asks").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n, size = len(ids), np.array([len(x) for x in sets], np.int64)
        order = np.argsort(size, kind="stable")
        _, word = np.unique(np.concatenate(sets), return_inverse=True)
        word = word.ravel()
        doc = np.repeat(np.arange(n), size)
        by_word = np.argsort(word, kind="stable")
        post, begin = doc[by_word], np.concatenate([[0], np.cumsum(np.bincount(word))])
        at = np.concatenate([[0], np.cumsum(size)])
        up, left, out_a, out_b = list(range(n)), n - 1, [], []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i in order[::-1].tolist():
            if not asks[i]:
                continue
            own = word[at[i] : at[i + 1]]
            length = begin[own + 1] - begin[own]
            total = int(length.sum())
            where = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(total)
            common = np.bincount(post[where], minlength=n)
            near = np.flatnonzero(100 * common >= percent * (size + size[i] - common))
            for j in near.tolist():
                if (x := top(i)) != (y := top(j)):
                    up[x] = y
                    left -= 1
                    out_a.append(i)
                    out_b.append(j)
            if not left:
                break
        return _told(table, ids, out_a, out_b)

    return run


def _largest(table: pa.Table) -> pa.Table:
    """The masks of the class of a group that has most rows; hubs (bits) that a mask has together are in one class."""
    masks, n = table.column("mask").to_pylist(), table.column("n").to_pylist()
    joined = []
    for m in masks:
        for x in [x for x in joined if x & m]:
            joined.remove(x)
            m |= x
        joined.append(m)
    best = max(joined, key=lambda x: (sum(c for m, c in zip(masks, n, strict=True) if m & x), x))
    mine = [m for m in masks if m & best]
    return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(mine), pa.int64()), "mask": pa.array(mine, pa.int32())})


def compared(rows: DataFrame, payload: str, kernel, limit: int) -> DataFrame:
    """Links (a, b) that join the same sets as all links within the groups g of rows(g, sid, payload, blocks) do.

    A group of one block is compared whole. Of a larger one, a few hubs are compared with all its rows, block by block. Rows that the
    hubs join make one class; rows of the group's largest class need no further comparison with each other, and every other row is
    compared with all. Two rows that aren't joined yet are never both of the largest class, so no pair of them is left out. A group of
    near copies of one text costs in proportion to its size.
    """
    shape, columns = "g long, a binary, b binary", ["g", "sid", payload]
    asks = lambda df, yes: df.withColumn("asks", F.lit(yes))
    small = asks(rows.where("blocks = 1").select(*columns), True).groupBy("g").applyInArrow(kernel, shape)
    found = small.select("a", "b")
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return found
    picked = large.groupBy("g").agg(*(F.min_by("sid", F.xxhash64("sid", F.lit(i))).alias(f"h{i}") for i in range(HUBS)))
    picked = picked.select("g", F.posexplode(F.array_distinct(F.array(*(f"h{i}" for i in range(HUBS))))).alias("bit", "sid"))
    picked = written(picked.select("g", "sid", F.expr("shiftleft(1, bit)").alias("mask")), "picked")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    own = lambda c: F.pmod(F.xxhash64("sid"), F.col(c)).cast("int")
    hubs = asks(large.join(picked.select("g", "sid"), ["g", "sid"]).withColumn("j", each("blocks")), True)
    members = asks(large.withColumn("j", own("blocks")), False)
    first = written(hubs.unionByName(members).select(*columns, "asks", "j").groupBy("g", "j").applyInArrow(kernel, shape), "hubs")
    found = found.unionByName(first.select("a", "b"))
    # every link so far begins at a hub, so the hubs that a row meets tell its class
    met = first.join(picked.select("g", F.col("sid").alias("a"), "mask"), ["g", "a"]).select("g", F.col("b").alias("sid"), "mask")
    met = written(met.unionByName(picked).groupBy("g", "sid").agg(F.bit_or("mask").alias("mask")), "met")
    most = written(met.groupBy("g", "mask").agg(F.count("*").alias("n")).groupBy("g").applyInArrow(_largest, "g long, mask int"), "most")
    asking = large.join(met.join(most, ["g", "mask"]).select("g", "sid"), ["g", "sid"], "left_anti")
    parts = written(
        asking.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / limit), F.ceil(F.sum(F.length(payload)) / BLOCK)).alias("parts")), "parts"
    )
    if parts.isEmpty():
        return found
    # a group of two halves, or of texts that have little to do with each other, has many such rows; they still meet every row
    asking = asks(asking.join(parts, "g").withColumn("i", own("parts")).withColumn("j", each("blocks")), True)
    asked = asks(large.join(parts, "g").withColumn("j", own("blocks")).withColumn("i", each("parts")), False)
    rest = asking.unionByName(asked).select(*columns, "asks", "i", "j").groupBy("g", "i", "j").applyInArrow(kernel, shape)
    return found.unionByName(rest.select("a", "b"))


def classes(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 10, node_limit: int = 1000, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes of docs(doc_id, text).

    Returns (rows, roots): rows has doc_id, n_shingles, sid of every row of docs; roots has sid, root, component_id of every set that
    links with another, root being its class's least set. A set that doesn't link has its smallest doc_id as component.
    """
    rows = written(signatures(docs, k, trees), "signed")
    sets = written(
        rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("tokens").alias("tokens")), "sets"
    )
    level = sets.select("sid", "sig", F.posexplode("tokens").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "sid", "sig")
    parts, levels = [], []
    for deep in range(1, depth + 1):
        counts = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        level = written(level.join(counts, "node"), "nodes")
        levels.append(level)
        large = F.col("n") > node_limit
        here = level if deep == depth else level.where(~large)
        parts.append(here.withColumn("blocks", F.ceil(F.col("n") / node_limit)))
        if deep == depth or level.where(large).isEmpty():
            break
        coordinate = F.explode(F.array(*(F.pmod(F.xxhash64("node", F.lit(j)), F.lit(BYTES)).cast("int") for j in (1, 2))))
        level = (
            level.where(large)
            .withColumn("c", coordinate)
            .select(F.xxhash64("node", "c", F.substring(F.col("sig"), F.col("c") + 1, F.lit(1))).alias("node"), "sid", "sig")
            .distinct()
        )
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.union(more)
    likely = compared(nodes.withColumnRenamed("node", "g"), "sig", _likely, node_limit)
    clusters = written(components(likely).withColumnRenamed("v", "sid").join(sets.select("sid", "doc_id"), "sid"), "clusters")
    found = _shingles(docs, clusters, k).join(clusters.select("sid", "root"), "sid")
    found = written(found, "shingles")
    sizes = found.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / node_limit), F.ceil(F.sum(F.length("shingles")) / BLOCK)).alias("blocks"))
    sized = found.join(sizes, "root").select(F.xxhash64("root").alias("g"), "sid", "shingles", "blocks")
    links = compared(sized, "shingles", _linked(percent), node_limit)
    roots = components(links).join(sets.select(F.col("sid").alias("v"), "doc_id"), "v")
    names = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    roots = written(roots.join(names, "root").select(F.col("v").alias("sid"), "root", "component_id"), "roots")
    dropped(sets, clusters, found, *levels)
    return rows.select("doc_id", "n_shingles", "sid"), roots


def bitmap_of(ids: DataFrame) -> bytes:
    """A set of 2 ** BITMAP bits that holds the hashes of ids' column doc_id: of fixed size, whatever the number of rows."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP))
    words = ids.select((bit / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("w"))
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    got = words.groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    out[got.column("at").to_numpy()] = got.column("w").to_numpy()
    return out.tobytes()


def hits(bitmap, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set that bitmap (a broadcast of bitmap_of) holds."""
    words = np.frombuffer(bitmap.value, np.int64)
    bit = hashes % (1 << BITMAP)
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1


def _shingles(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """sid and full set (sorted, 8 bytes each) of the documents that stand for wanted's sets, once each.

    A bitmap of fixed size keeps most other texts from being read again; the join that follows is exact.
    """
    seen = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = hits(seen, batch.column(0).to_numpy())
            if not keep.any():
                continue
            for _, _, have, begin, value in _sets(batch.column(1).filter(pa.array(keep)), k):
                raw = value.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_set_ids(value, begin[:-1]), pa.binary()), pa.array([raw[8 * begin[i] : 8 * begin[i + 1]] for i in range(len(have))], pa.binary())], ["sid", "shingles"]
                )

    hashed = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("text").cast("string"))
    found = hashed.mapInArrow(run, "sid binary, shingles binary")
    return found.join(wanted.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 10, node_limit: int = 1000, depth: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts that are null, empty or without a word have no shingles and link with nothing. Rows that repeat a doc_id or a text are
    one vertex where their sets are equal. A null doc_id takes part, and names a component only if it has no other id, in which case
    all its rows are kept. An empty table gives an empty result; columns other than doc_id and text are not looked at.
    """
    named, _ = _named(docs, k, percent, trees, node_limit, depth)
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _named(docs: DataFrame, k: int, percent: int, trees: int, node_limit: int = 1000, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, sid, component_id of each row of docs, and sid, component_id, first of each set: the least set of the
    component's rows of the least id."""
    rows, roots = classes(docs, k, percent, trees, node_limit, depth)
    least = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    names = least.join(roots, "sid", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    named = rows.join(names.select("sid", "component_id"), "sid", "left").withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    # a class is told by its root set, since one id may name several
    classed = names.withColumn("root", F.coalesce("root", "sid"))
    first = classed.groupBy("root").agg(F.min_by("sid", F.struct(F.col("least").isNull(), F.col("least"), F.col("sid"))).alias("first"))
    return named, classed.join(first, "root").select("sid", "least", "component_id", "first")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 10, node_limit: int = 1000) -> DataFrame:
    """docs with one row of each near-duplicate group, and all rows whose text has no word.

    A group's row is one with its smallest doc_id (null only if it has no other), and among texts of that id one of the least set hash.
    Rows are told apart by id and set, so a repeated doc_id loses no text of its own. Texts move only for rows whose id a bitmap of
    fixed size can't rule out as dropped or repeated. An empty table gives an empty result; further columns may have any names.
    """
    named, sets = _named(docs, k, percent, trees, node_limit)
    named = written(named.where("sid is not null").select("doc_id", "sid"), "named")
    sets = written(sets.select("sid", "least", "first"), "sets")
    # of each set that stays, the rows of its least id do
    keys = named.groupBy("doc_id", "sid").agg(F.count("*").alias("n")).join(sets, "sid")
    stays = (F.col("sid") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("least"))
    keys = written(keys.select("doc_id", "sid", "n", stays.alias("stays")), "keys")
    seen = docs.sparkSession.sparkContext.broadcast(bitmap_of(keys.where("not stays or n > 1").select("doc_id")))
    id_, own_sid, sid, gone = unused(docs.columns, "id", "own_sid", "sid", "may_be_gone")
    at, names = docs.columns.index("text") + 1, [*docs.columns, sid, gone]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = hits(seen, batch.column(0).to_numpy())
            ids, where = [None] * len(batch), np.flatnonzero(found)
            for row, _, have, begin, value in _sets(batch.column(at).cast(pa.string()).filter(pa.array(found)), k):
                for i, key in zip(have.tolist(), _set_ids(value, begin[:-1]), strict=True):
                    ids[int(where[row + i])] = key
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.binary()), pa.array(found)], names)

    schema = StructType([*docs.schema.fields, StructField(sid, BinaryType()), StructField(gone, BooleanType())])
    marked = docs.select(F.xxhash64(F.col("doc_id").cast("long")), *docs.columns).mapInArrow(look, schema)
    clear = marked.where(~F.col(gone) | F.col(sid).isNull()).select(*docs.columns)
    own = keys.where("stays").select(F.col("doc_id").alias(id_), F.col("sid").alias(own_sid))
    rest = marked.where(F.col(gone) & F.col(sid).isNotNull())
    rest = rest.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(sid) == F.col(own_sid)), "left_semi")
    return clear.unionByName(rest.dropDuplicates(["doc_id", sid]).select(*docs.columns))
