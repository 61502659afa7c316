"""License scans by diagonal voting, in DataFrame functions only.

Every pair of neighbouring words of every text is joined, by hash, to the places of the same pair in the templates. Hits of one
template on one diagonal (place in text minus place in template) vote together, and a diagonal is taken with those up to `slack` above it,
which allows for words put in or left out. Where these have enough of the template's distinct pairs, the span is verified: the pairs
must come in the template's order, and all those of its decisive phrase, which tells it from its like, must be among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A-Z as letters, so that words can be lower-cased after they are cut
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count only word for word.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Longer passages of the licenses' own notices: text, label, decisive phrase.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0", "the apache license"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2.0", "www apache org"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "granted free of charge to any person"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "modify and or distribute"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause", "endorse or promote"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice", "the gnu general public license"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl-notice", "gnu lesser general"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl-notice", "gnu affero general"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "the mozilla public license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "by nc"),
    ("licensed under the creative commons attribution", "cc", "creative commons attribution"),
    ("licensed under the creative commons attribution noncommercial", "cc-by-nc", "attribution noncommercial"),
]


def template_pairs(spark: SparkSession, base: dict[str, str], templates: list[tuple[str, str, str]]) -> DataFrame:
    """tid, label, exact, pairs, decisive, at, t1, t2, key: one row per neighbouring pair of each template's words; decisive has the
    places of the pairs of its decisive phrase."""
    rows = []
    for tid, (exact, text, label, phrase) in enumerate([*((True, text, label, text) for text, label in base.items()), *((False, *x) for x in templates)]):
        words, must = text.split(), phrase.split()
        begin = next((i for i in range(len(words)) if words[i : i + len(must)] == must), None)
        if len(words) < 2 or begin is None:
            raise ValueError(f"a template needs two words or more, and its decisive phrase in it: {text!r}, {phrase!r}")
        decisive = list(range(begin, begin + len(must) - 1))
        rows += [(tid, label, exact, len(words) - 1, decisive, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    table = spark.createDataFrame(rows, "tid int, label string, exact boolean, pairs int, decisive array<int>, at int, t1 string, t2 string")
    return table.withColumn("key", F.xxhash64("t1", "t2"))


def _in_order(hits: Column) -> Column:
    """Of hits (at, pos) sorted so: the places of those that come in order, each taken if it lies after the one taken before; and the first and last pos."""
    none = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("pos"), F.lit(-1).alias("first"), F.array().cast("array<int>").alias("got"))

    def take(state: Column, x: Column) -> Column:
        new = F.struct(x["at"].alias("at"), x["pos"].alias("pos"), F.when(state["first"] < 0, x["pos"]).otherwise(state["first"]).alias("first"), F.array_append(state["got"], x["at"]).alias("got"))
        return F.when((x["at"] > state["at"]) & (x["pos"] > state["pos"]), new).otherwise(state)

    return F.aggregate(hits, none, take)


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str, str]] | None = None, least: float = 0.6, slack: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases count wherever their words stand consecutively, overlaps included; first_word and last_word are the smallest and largest
    start of such a place, null without one. labels adds the templates of which a verified span covers at least `least` of the word pairs;
    score is the largest share that any phrase or template reaches, 0 below `least`. spans lists label:first:last word (comma-joined, by
    start, end, label), overlapping spans of one template once. A null text is empty: no words, no labels ('').
    Rows are told apart by themselves, so repeated rows and null ids each give a row. An empty table gives an empty result.
    """
    pairs = template_pairs(docs.sparkSession, BASE if base is None else base, TEMPLATES if templates is None else templates)
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    each = words.select("doc_id", "row", F.size("w").alias("n_words"), F.posexplode_outer(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("v"))).alias("pos", "p"))
    each = each.select("doc_id", "row", "n_words", "pos", F.lower("p.w").alias("a"), F.lower("p.v").alias("b"))
    # templates are a constant of this module or an argument held in memory, so their broadcast is bounded
    met = each.join(F.broadcast(pairs.select("tid", "at", "t1", "t2", "key")), F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")) == F.col("key"), "left")
    met = met.where(F.col("tid").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    # the words themselves decide, lower-cased in A-Z only
    same = lambda w, t: F.translate(w, UPPER, LOWER) == F.col(t)
    hit = F.col("tid").isNotNull() & same("a", "t1") & same("b", "t2")
    met = met.select("doc_id", "row", "n_words", "pos", *(F.when(hit, F.col(c)).alias(c) for c in ("tid", "at"))).repartition("row")
    votes = met.groupBy("row", "tid", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("at").alias("ats"))
    votes = votes.join(F.broadcast(pairs.select("tid", "label", "exact", "pairs", "decisive").distinct()), "tid", "left")
    near = W.partitionBy("row", "tid").orderBy("diagonal").rangeBetween(0, slack)
    votes = votes.withColumn("near", F.collect_list(F.struct("diagonal", "ats")).over(near))
    near = F.when(F.col("exact"), F.array(F.struct("diagonal", "ats"))).otherwise(F.col("near"))
    enough = lambda ats: F.size(ats) >= F.when(F.col("exact"), F.col("pairs")).otherwise(F.ceil(F.col("pairs") * F.lit(least) - 1e-9))
    hits = F.sort_array(F.flatten(F.transform(near, lambda d: F.transform(d["ats"], lambda at: F.struct(at.alias("at"), (d["diagonal"] + at).alias("pos"))))))
    may = enough(F.array_distinct(F.flatten(F.transform(near, lambda d: d["ats"]))))
    votes = votes.withColumn("chain", F.when(may, _in_order(hits)))
    got = F.col("chain")["got"]
    votes = votes.withColumn("span", F.coalesce(enough(got) & (F.size(F.array_except("decisive", got)) == 0), F.lit(False)))
    votes = votes.select("row", "tid", "doc_id", "n_words", "label", "exact", "span", F.col("chain")["first"].alias("start"), (F.col("chain")["pos"] + 1).alias("last"), (F.size(got) / F.col("pairs")).alias("share"))
    # what overlaps an earlier span of the same template is the same one, found from another diagonal
    before = W.partitionBy("row", "tid").orderBy(F.when(F.col("span"), F.col("start")).asc_nulls_last(), F.col("last")).rowsBetween(W.unboundedPreceding, -1)
    votes = votes.withColumn("own", F.col("span") & (F.col("exact") | F.coalesce(F.col("start") > F.max(F.when(F.col("span"), F.col("last"))).over(before), F.lit(True))))
    is_base = F.col("exact") & F.col("span")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    listed = F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("start", "last", "label"))))
    return votes.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"), joined(F.col("span")).alias("labels"), F.coalesce(F.max(F.when(F.col("span"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["label"], s["start"], s["last"])), ",").alias("spans"),
    ).drop("row")
