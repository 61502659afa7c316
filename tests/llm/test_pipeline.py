"""The pipeline on a small folder of documents, against its stages told plainly."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kindred.llm.language import languages
from kindred.llm.queries import MIX_SQL

from .plain import jaccard_classes, plain_coverage, plain_difference

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {
    "en": "the quick brown fox jumps over lazy dog and runs through green forest all day long with its many friends while birds sing above old trees".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft durch grünen wald mit seinen vielen freunden während vögel über alten bäumen singen".split(),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(31)
    path = tmp_path_factory.mktemp("docs")
    speak = lambda lang, n: list(rng.choice(VOCABULARY[lang], n))
    items = [(i, " ".join(speak("en" if i % 2 else "de", 30))) for i in range(6)]
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(speak(lang, int(rng.integers(20, 60)))), lang, "abcd"[int(rng.integers(0, 4))]))
    for i in range(90, 130):  # exact and near copies
        w = rows[int(rng.integers(0, 40))][1].split()
        if i % 2:
            w[0] = "anders"
        rows.append((i, " ".join(w), "en", "ab"[i % 2]))
    for i in range(130, 145):  # passages of the benchmark, whole or in two turned halves
        w = items[i % 6][1].split()
        rows.append((i, " ".join([*speak("en", 5), *(w if i % 2 else w[15:] + w[:15])]), "en", "d"))
    rows += [(200, None, None, "a"), (201, "", "en", "a"), (202, "12 34 !!", None, None), (203, items[0][1][:40], "de", None), (30, "a second text of an id that is there already, unlike all others in this table", "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    told = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    # language ID: what has a letter and a language of enough weight stays
    good = {(r.doc_id, r.score) for r in languages(docs).collect() if r.lang_pred != "und" and r.score >= 0.35}
    kept = [(i, t, s) for i, t, _, s in rows if any(j == i for j, _ in good) and re.search("[a-z]", t or "")]
    assert len(kept) > 140
    want = [kept]
    # near copies: the smallest id of each class of five-word sets
    classes = jaccard_classes([(i, t) for i, t, _ in kept], 5, 80, by_row=True)
    first = {}
    for (i, *_), c in zip(kept, classes, strict=True):
        first[c] = min(first.get(c, i), i)
    seen, kept2 = set(), []
    for row, c in zip(kept, classes, strict=True):
        if row[0] == first[c] and c not in seen:
            seen.add(c)
            kept2.append(row)
    assert len(kept2) < len(kept) - 20
    want.append(kept2)
    # benchmark passages
    clean = [r for r in kept2 if not any((x := plain_coverage(r[1], item, 5))[0] and x[0] >= 0.5 * x[2] for _, item in items)]
    assert len(clean) < len(kept2)
    want.append(clean)
    # the mix, by SQL
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [list(r) for r in clean])
    text = {(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))): r for r in clean}
    mixed = [text[i, size] for i, size, taken in con.execute(f"select doc_id, size, taken from ({MIX_SQL})").fetchall() for _ in range(taken // size)]
    want.append(mixed)
    for (name, stage), rows_in, rows_out in zip(corpus_pipeline.STAGES, [None, *want], want, strict=False):
        before = docs if rows_in is None else docs_of(spark, rows_in)
        got = stage(spark, before, path)
        assert got.columns == docs.columns, name
        assert told(got) == Counter(rows_out), name
    final = corpus_pipeline.run(spark, path).collect()
    assert Counter(r.doc_id for r in final) == Counter(r[0] for r in mixed)
    # shards: equal texts are one item, and sums are those of plain differencing
    size, shards = Counter(), Counter()
    for _, t, _ in mixed:
        size[t] += len(t.encode()) + 1
    for r in final:
        shards[r.shard] += r["size"]
    assert sorted(shards.get(i, 0) for i in range(16)) == [x + min_sum(size, shards) for x in sorted(plain_difference(list(size.values()), 16))]


def min_sum(size, shards):
    """Differencing tells sums less the smallest one."""
    return (sum(size.values()) - sum(plain_difference(list(size.values()), 16))) // 16


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t)) for i, t, s in rows], COLUMNS)
