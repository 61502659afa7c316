"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in each text by regular expressions. Each candidate's value is hashed, and the owners (sources) and repositories
(documents) that have it are counted over the whole corpus: a value of several owners, or of many repositories, is a copied example; a
value of one owner in few repositories looks live. A looser kind of candidate, `opaque`, is a finding only if it looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: kind: regular expression, group of the value, least length of the value.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A long run of letters and digits with a capital, a small letter and two digits in it.
MORE = {"opaque": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9][A-Za-z_-]*[0-9])(?=[A-Z0-9_-]*[a-z])(?=[a-z0-9_-]*[A-Z])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])", 0, 20)}
# runs that can't be long enough needn't be cut out; longest runs are the same
FASTER = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def candidates(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose value is long enough: kind, start, end (code points), value hash.

    The matches and the pieces of text between them alternate, so lengths add up to places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(whole.alias("m"), values.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"))
    span = "struct<kind:int,start:int,end:int,value:bigint>"

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        new = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.xxhash64(x["v"]).alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.array_append(state["spans"], new)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast(f"array<{span}>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), add)["spans"]
    return F.when(F.regexp(text, F.lit(pattern)), found).otherwise(none)


def secret_scan(docs: DataFrame, most_owners: int = 1, most_repositories: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    Base kinds (assign, access, hex) always count; opaque candidates are spans only where at most `most_owners` sources and at most
    `most_repositories` rows have the value and no base span overlaps them. n_live and n_example tell base and opaque spans by the same two counts. A null source is an owner of its own.
    A null text is empty. Rows are told apart by themselves, so repeated rows and null ids each give a row, and a repeated row is one
    more repository. base_sha256 and spans list kind:start:end by start, then kind. An empty table gives an empty result.
    """
    kinds = [*BASE.items(), *MORE.items()]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", "source", text.alias("text"))
    spans = [candidates(F.col("text"), i, FASTER.get(name, pattern), group, least) for i, (name, (pattern, group, least)) in enumerate(kinds)]
    rows = written(found.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), F.concat(*spans).alias("spans")), "candidates")
    each = rows.select("row", "source", F.explode("spans").alias("s")).select("row", "source", "s.*")
    # a value's spans are summed by row, and its rows by owner, before they meet, so a value that is everywhere costs no more than another
    rows_of = each.select("value", "source", "row").distinct().groupBy("value", "source").agg(F.count("*").alias("n"))
    owners = rows_of.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    told = each.join(owners, "value")
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    mine = told.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", live.alias("live"))).alias("found"))
    last = len(BASE)
    base = F.filter("found", lambda s: s["kind"] < last)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    mine = mine.withColumn("base", base).withColumn("more", F.filter("found", lambda s: (s["kind"] >= last) & s["live"] & free(s)))
    none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end"), F.lit(False).alias("live"))), lambda s: s["kind"] < 0)
    out = rows.select("row", "doc_id").join(mine.drop("found"), "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))
    names = F.array(*(F.lit(name) for name, _ in kinds))
    told_as = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    number = lambda spans, test: F.size(F.filter(spans, test)).cast("long")
    of_kind = lambda i: lambda s: s["kind"] == i  # noqa: E731  (a second parameter would get the index)
    every = F.concat("base", "more")
    return out.select(
        "doc_id", *(number("base", of_kind(i)).alias(f"n_{name}") for i, name in enumerate(BASE)),
        F.sha2(told_as(F.col("base")), 256).alias("base_sha256"), told_as(every).alias("spans"), number(every, lambda s: s["live"]).alias("n_live"), number(every, lambda s: ~s["live"]).alias("n_example"),
    )
