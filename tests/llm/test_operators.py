"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm.chats import chat_digest, conversation_nodes, formatted_paths, paths, read_back
from kindred.llm import language, tiling
from kindred.llm.language import in_a_language, language_spans, languages, marginals
from kindred.llm.licenses import TEMPLATES, license_scan
from kindred.llm.lm import looked_up, scores
from kindred.llm.mixing import mixed_documents, mixed_sources
from kindred.llm.near_text import near_duplicates, one_of_each
from kindred.llm.near_vectors import near_vectors
from kindred.llm.secrets import secret_scan
from kindred.llm.sharding import difference, sharded
from kindred.llm.store import components, shared_folder, unused
from kindred.llm.tiling import contaminated, tiles, uncontaminated
from kindred.llm.words import PLAIN, SPACED, text_chunks, words_of

from .plain import jaccard_classes, plain_coverage, plain_difference, words

EXTRA = "h long, row long, s string, size string, node string, __h string, key string, count string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
EN = "the quick brown fox jumps over the lazy dog and runs through the green forest all day long with its many friends"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft durch den grünen wald mit seinen vielen freunden"
TEXTS = [
    (1, EN, "en", "b"), (2, EN, "en", "a"), (2, EN, "en", "a"), (3, EN.replace("lazy", "sleepy"), "en", "a"), (4, None, None, None), (5, "", "en", "b"), (6, " \t\n ", "de", "b"),
    (7, DE, "de", "c"), (8, DE + " heute", "de", "c"), (9, "one two", "en", None), (10, "One  TWO", "en", "a"), (11, LONG, "en", "a"), (12, LONG + " end", "en", "c"), (None, DE, "de", "a"),
    (13, "12345 !!", None, "a"), (14, "É à ü", "de", "Z"), (15, "x y  z\x0b1", "en", "é"),
]


def frame(spark, rows, schema=SCHEMA):
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(*r, None, 7, 7, *["7"] * (n - 2)) for r in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_words_of():
    import pyarrow as pa

    texts = [t for _, t, *_ in TEXTS]
    for member, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (PLAIN, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for limit in (10, 1 << 20):
            seen, back = {}, {}
            for row, end, data, offsets in text_chunks(pa.array(texts), limit):
                text, start, stop, h = words_of(data, offsets, member)
                for i in range(row, end):
                    got = [(data[a:b].tobytes().decode(), x) for t, a, b, x in zip(text, start, stop, h.tolist(), strict=True) if t == i - row]
                    assert [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w, _ in got] == words(texts[i], pattern)
                    for w, x in got:
                        w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
                        assert seen.setdefault(x, w) == w and back.setdefault(w, x) == x


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(500)] + [(7, None), (7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    assert {(r.v, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(x, top(x)) for x in list(up)}


def test_near_text(spark, docs, none):
    rng = np.random.default_rng(3)
    base = [" ".join(f"t{x}" for x in rng.integers(0, 10**6, 120)) for _ in range(6)]
    rows = [r[:2] for r in TEXTS]
    for i in range(240):  # near copies, in a chain of small changes and apart
        w = base[i % 6].split()
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(w)))
    table = frame(spark, [(*r, "en", "a") for r in rows])
    for k, limit in ((4, 1000), (5, 1000), (4, 7)):
        got = near_duplicates(table, k=k, node_limit=limit).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_classes(rows, k, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near_duplicates(none).count() == 0


def test_near_text_bridge(spark):
    # two halves below the threshold, joined by one pair of rows that meets it and the hubs of its own half only
    def run(a, *own):
        return " ".join([*(f"w{i}" for i in range(a, a + 103)), *own])

    rows = [(i, run(0 if i % 2 else 12, f"own{i}")) for i in range(200)] + [(200, run(1)), (201, run(11))]
    table = frame(spark, [(*r, "en", "a") for r in rows])
    want = jaccard_classes(rows, 4, 80)
    assert {c for _, _, c in want} == {0}
    for limit in (1000, 50):
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(table, k=4, node_limit=limit).collect()) == want
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(table.where("doc_id < 201"), k=4, node_limit=50).collect()) == jaccard_classes(rows[:-1], 4, 80)


def test_recall_where_nodes_branch(spark):
    # texts that share a third of their shingles fill the nodes beyond the limit, so that these branch twice; pairs lie just above 0.8
    rng = np.random.default_rng(17)
    common, rows, want = [f"c{i}" for i in range(45)], [], 0
    for i in range(1200):
        own = [f"o{i}x{j}" for j in range(85)]
        other = [*own[:-7], *(f"n{i}x{j}" for j in range(7))] if i % 2 else [f"o{i}y{j}" for j in range(85)]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + other))]
        want += i % 2
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = {i for i in range(0, 2400, 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    assert len(near) == want and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.5
    found = {r.component_id for r in near_duplicates(frame(spark, [(*r, "en", "a") for r in rows]), k=5, node_limit=40).collect() if r.doc_id % 2 and r.component_id < r.doc_id}
    assert found <= near and len(found) >= 0.99 * len(near)


def test_one_of_each(spark, docs, none):
    kept = one_of_each(docs, k=4)
    assert kept.columns == docs.columns
    # 8 and the row without an id are near 7, 2 and 3 near or equal to 1; 4, 5, 6 and 13 to 15 have nothing like them
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t, *_ in TEXTS if i in {1, 3, 4, 5, 6, 7, 9, 11, 13, 14, 15})
    assert one_of_each(none).count() == 0


def test_one_of_each_goes_by_row(spark):
    own = " ".join(f"q{i}" for i in range(30))
    rows = [(1, EN), (2, EN), (2, own), (2, own), (3, DE), (None, DE), (None, "an other text without an id that is like nothing else"), (None, None), (2, None), (2, None)]
    more = "may_be_gone string, sid string, h string, id string, own_sid string"
    table = spark.createDataFrame([(*r, *["7"] * 5) for r in rows], f"doc_id long, text string, {more}")
    kept = one_of_each(table, k=4)
    assert kept.columns == table.columns
    assert Counter(map(tuple, kept.collect())) == Counter((*r, *["7"] * 5) for r in [rows[0], rows[2], rows[4], *rows[6:]])
    found = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(table, k=4).collect()}
    assert (None, 3, False) in found and (None, None, True) in found and (2, 1, False) in found and (2, 2, True) in found


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 8))
    rows = [(i, [float(v) for v in x[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0.2)], i % 2 if i % 17 else None) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [nan] + [1.0] * 7, 1), (204, [inf] + [1.0] * 7, 1), (205, [None] + [1.0] * 7, 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (5, rows[5][1], 1), (300, rows[5][1], 1), (None, rows[5][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as key", "2 as n", "'x' as cell")
    ok = [l is not None and bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, l in rows]
    vec = [np.array(v, np.float32).astype(float) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    group, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] >= 0.98 * np.linalg.norm(vec[a]) * np.linalg.norm(vec[b]):
                links[a] += 1
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], n, least.get(g)) for r, n, g in zip(rows, links, group, strict=True))
    for options in ({"rows_per_cell": 10, "block": 7}, {}):
        got = near_vectors(table, **options).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert near_vectors(table.limit(0)).count() == 0


def test_languages(spark, docs, none):
    rng = np.random.default_rng(2)
    vocabulary = {"en": EN.split(), "de": DE.split()}
    rows = [(i, " ".join(rng.choice(vocabulary["en" if i % 3 else "de"], 40)), "en" if i % 3 else "de", "a") for i in range(300)]
    rows += [(1000 + i, t, None, None) for i, t in enumerate([None, "", "123 !", "×÷", EN + " " + " ".join(DE.split()[:5])])]
    got = {r.doc_id: r for r in languages(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == x for i, _, x, _ in rows if x) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[1000 + i].lang_pred for i in range(5)] == ["und"] * 4 + ["en"]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert languages(docs).count() == len(TEXTS) and languages(none).count() == 0
    assert {r.lang_pred for r in languages(frame(spark, [(1, EN, None, None)])).collect()} == {"und"}
    kept = in_a_language(frame(spark, rows))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(300), 1004]


def test_languages_without_letters(spark):
    for texts in (["123 !", "", None], ["123 !", "4"]):
        got = languages(frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)] + [(9, EN, None, None)])).collect()
        assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    # a language whose texts have no letter is not learned
    rows = [(i, EN, "en", None) for i in range(20)] + [(100 + i, "5 6", "xx", None) for i in range(20)]
    assert {r.lang_pred for r in languages(frame(spark, rows)).collect()} == {"en", "und"}


def test_forward_backward():
    rng = np.random.default_rng(7)
    sizes, k = [1, 4, 3, 6], 3
    emission, trans = rng.normal(size=(sum(sizes), k)) * 3, rng.normal(size=(k, k))
    post, expected = marginals(emission, np.repeat(np.arange(len(sizes)), sizes), trans)
    at, pairs = 0, np.zeros((k, k))
    for n in sizes:  # all labellings
        total, mine, edge = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for way in itertools.product(range(k), repeat=n):
            # a text begins in an even mix, whose transition into the first label counts
            w = sum(math.exp(trans[i, way[0]]) for i in range(k)) * math.exp(sum(emission[at + i, y] for i, y in enumerate(way)) + sum(trans[x, y] for x, y in zip(way, way[1:], strict=False)))
            total += w
            for i, y in enumerate(way):
                mine[i, y] += w
            for x, y in zip(way, way[1:], strict=False):
                edge[x, y] += w
        np.testing.assert_allclose(post[at : at + n], mine / total, atol=1e-9)
        pairs += edge / total
        at += n
    np.testing.assert_allclose(expected, pairs, atol=1e-9)
    long = rng.normal(size=(200, k))  # over several blocks, against the plain recursion
    post, _ = marginals(long, np.zeros(200, np.int64), trans)
    f, b = [np.full(k, 1.0) @ np.exp(trans) * np.exp(long[0])], [np.ones(k)]
    for e in long[1:]:
        f.append(f[-1] / f[-1].sum() @ np.exp(trans) * np.exp(e))
    for e in long[:0:-1]:
        b.append(np.exp(trans) @ (np.exp(e) * b[-1] / b[-1].sum()))
    want = np.array(f) * np.array(b[::-1])
    np.testing.assert_allclose(post, want / want.sum(1, keepdims=True), atol=1e-9)


def test_fit_in_portions(monkeypatch):
    texts = [EN, DE, f"{DE} {EN}", "", None, EN[:40], DE * 3]
    sample = pa.table({"lang": ["en", "de", "en", "de", "en", "en", "de"], "text": texts})
    whole = language.fit(sample)
    monkeypatch.setattr(language, "PORTION", 3)
    parts = language.fit(sample)
    assert whole["langs"] == parts["langs"] == ["de", "en"]
    assert np.allclose(whole["weights"], parts["weights"], atol=1e-4) and np.allclose(whole["trans"], parts["trans"], atol=1e-4)
    text = np.repeat([0, 2, 3], [2, 5, 1])
    assert [(p.start, p.stop) for p in language._whole(text)] == [(0, 2), (2, 7), (7, 8)]


def test_language_spans(spark):
    rng = np.random.default_rng(2)
    vocabulary = {"en": EN.split(), "de": DE.split()}
    rows = [(i, " ".join(rng.choice(vocabulary["en" if i % 2 else "de"], 40)), "en" if i % 2 else "de", "a") for i in range(200)]
    german, english = "schnelle über läuft grünen freunden", "quick brown jumps forest friends"
    rows += [(500, f"{german} – {english}", None, None), (501, None, None, None), (502, "12", None, None)]
    got = sorted((r.start, r.end, r.n_words, r.lang) for r in language_spans(frame(spark, rows)).collect() if r.doc_id >= 500)
    # the dash is beyond ASCII and so a word, of either language
    assert [(x[3]) for x in got] == ["de", "en"] and (got[0][0], got[1][1]) == (0, len(german) + 3 + len(english)) and sum(x[2] for x in got) == 11


def test_tiling(spark, docs, none):
    passage = " ".join(f"p{i}" for i in range(40))
    w = passage.split()
    turned = " ".join(w[20:] + ["and"] + w[:20])
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "Short one"), (5, EN)], "item_id long, text string")
    rows = [(20, f"x y {passage.upper()}, z", None, None), (21, turned, None, None), (22, " ".join(w[:15]), None, None), (23, "a short, one.", None, None), (24, "the " * 5000, None, None), (25, f"{turned} {passage}", None, None)]
    table = frame(spark, TEXTS + rows)
    got = contaminated(table, items).collect()
    assert Counter((r.doc_id, r.item_id, r.n_tiles) for r in got) == Counter([(20, 1, 1), (21, 1, 2), (23, 4, 1), (25, 1, 1), (1, 5, 1), (2, 5, 1), (2, 5, 1), (3, 5, 2)])
    clean = uncontaminated(table, items)
    assert clean.columns == table.columns and not {20, 21, 23, 25, 1, 2, 3} & {r.doc_id for r in clean.collect()} and clean.count() == len(TEXTS) + 6 - 8
    assert contaminated(none, items).count() == 0 and contaminated(table, items.limit(0)).count() == 0 and uncontaminated(table, items.limit(0)).count() == table.count()


def test_tiles_are_greedy():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b, run = rng.integers(0, 3, 30), rng.integers(0, 3, 20), 3
        seeds = [(i, j) for i in range(len(a) - run + 1) for j in range(len(b) - run + 1) if (a[i : i + run] == b[j : j + run]).all()]
        if not seeds:
            continue
        got = tiles(np.array([i for i, _ in seeds]), np.array([j for _, j in seeds]), run)
        used_a, used_b, lengths = set(), set(), []
        while True:  # the plain algorithm
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < run:
                break
            lengths.append(best[0])
            used_a |= set(range(best[1], best[1] + best[0]))
            used_b |= set(range(best[2], best[2] + best[0]))
        assert [n for _, _, n in got] == lengths
        assert sum(n for _, _, n in got) == len({i for x, _, n in got for i in range(x, x + n)}) == len({i for _, y, n in got for i in range(y, y + n)})
        assert all((a[i : i + n] == b[j : j + n]).all() and n >= run for i, j, n in got)


def test_tables_are_tiled_as_plainly(spark, monkeypatch):
    rng = np.random.default_rng(21)
    pick = lambda n: " ".join(rng.choice(list("abcdefg"), n))
    items = [(i, pick(int(rng.integers(1, 25)))) for i in range(15)]
    texts = [(i, pick(int(rng.integers(0, 30)))) for i in range(25)]
    for i in range(25, 50):  # passages in pieces, in any order
        w = items[i % 15][1].split()
        cut = int(rng.integers(0, len(w) + 1))
        texts.append((i, " ".join([pick(2), *w[cut:], pick(1), *w[:cut]])))
    want = {}
    for i, t in texts:
        for j, x in items:
            covered, n, size = plain_coverage(t, x, 4)
            if covered and covered >= 0.5 * size and (size >= 4 or covered == size):
                want[i, j] = (size, covered, n if size >= 4 else 1)
    assert len(want) > 30
    table, bench = frame(spark, [(*t, None, None) for t in texts]), spark.createDataFrame(items, "item_id long, text string")
    for seeds, block in ((4 << 20, 32 << 20), (7, 32 << 20), (4 << 20, 200)):
        monkeypatch.setattr(tiling, "SEEDS", seeds)
        monkeypatch.setattr(tiling, "BLOCK_BYTES", block)
        got = contaminated(table, bench, least=4).collect()
        # items shorter than a seed are found where they are whole, once
        assert {(r.doc_id, r.item_id): (r.item_words, r.covered_words, r.n_tiles if r.item_words >= 4 else 1) for r in got} == {k: v if v[0] >= 4 else (v[0], v[0], 1) for k, v in want.items()}
        assert sorted(r.doc_id for r in uncontaminated(table, bench, least=4).collect()) == [i for i, _ in texts if i not in {k for k, _ in want}]


def test_mixing(spark, docs, none):
    rng = np.random.default_rng(4)
    rows = [(100 + i, "w " * int(rng.integers(1, 40)), "en", "abcdefg"[int(rng.integers(0, 7))] if i % 2 else "a") for i in range(3000)]
    for table, data in ((docs, TEXTS), (frame(spark, TEXTS + rows), TEXTS + rows)):
        size = Counter()
        for _, text, _, source in data:
            size[source] += len(words(text))
        names = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        left, target, open_ = 1.5 * sum(size.values()), {}, set(names)
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] >= 2 * size[s]}
            if not over:
                break
            for s in over:
                target[s] = 2.0 * size[s]
                left -= target[s]
            open_ -= over
        target |= share
        got = mixed_sources(table).collect()
        again = mixed_sources(table.repartition(5)).collect()
        assert Counter(got) == Counter(again) and len(got) == len(data)
        ids = defaultdict(list)
        for i, text, _, s in data:
            ids[i, len(words(text)), size[s]].append(s)
        taken, most = Counter(), Counter()
        for r in got:
            s = ids[r.doc_id, r["size"], r.source_size][0]
            assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r["size"], 2 * r["size"])
            taken[s] += r.taken
            most[s] = max(most[s], r["size"] * len(ids[r.doc_id, r["size"], r.source_size]))
        assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in names)
        out = mixed_documents(table)
        assert out.columns == table.columns and sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixed_sources(none).count() == 0 and mixed_documents(none).count() == 0
    clash = spark.createDataFrame([(1, "a b c", "x", "1", "2", "3", "4", "5")], "doc_id long, text string, source string, times string, below string, h string, n string, s string")
    assert {tuple(r) for r in mixed_documents(clash).collect()} == {(1, "a b c", "x", "1", "2", "3", "4", "5")}


def test_sharding(spark, docs, none):
    assert sorted(Counter(zip(difference([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4], strict=True)).elements())[0] is not None
    assert sorted(sum(z for s, z in zip(difference([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4], strict=True) if s == x) for x in (0, 1)) == [14, 16]
    rng = np.random.default_rng(6)
    for _ in range(100):
        sizes, shards = rng.integers(0, 50, int(rng.integers(0, 40))).tolist(), int(rng.integers(1, 6))
        got, want = [0] * shards, plain_difference(sizes, shards)
        where = difference(sizes, shards)
        assert len(where) == len(sizes)
        for x, z in zip(where, sizes, strict=True):
            got[x] += z
        assert sorted(got) == sorted(want)
    rows = [(100 + i, "y" * int(rng.integers(0, 200)) if i % 3 else "same text", "en", "a") for i in range(4000)]
    for table, data in ((docs, TEXTS), (frame(spark, rows), rows)):
        got = sharded(table).collect()
        assert len(got) == len(data) and Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
        by, groups = defaultdict(list), defaultdict(set)
        total = Counter()
        for r in got:
            by[r.shard].append(r.slot)
            groups[r.text_crc32, r["size"]].add(r.shard)
            total[r.shard] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(len(g) == 1 for g in groups.values()) and all(0 <= s < 16 for s in by)
    heavy = sum(len(t) + 1 for i, t, *_ in rows if t == "same text")
    assert sorted(total.values())[-1] <= max(heavy, sum(total.values()) / 16 + 400)
    assert sharded(none).count() == 0


def test_licenses(spark, docs, none):
    rows = [
        (30, "CC BY cc-by All rights Reserved. all rights all rights reserved", None, None), (31, "General Public License", None, None), (32, "general public, LICENSE général public license", None, None),
        (33, "Permission is hereby granted, free of charge, to any person whatsoever obtaining a copy of this software", None, None), (34, "cc Kby by", None, None), (34, "cc by", None, None),
    ]
    table = frame(spark, TEXTS + rows)
    got = license_scan(table).collect()
    want = []
    for i, text, *_ in TEXTS + rows:
        w, at, labels = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            here = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(want)
    assert [r.labels for r in got if r.doc_id == 33] == ["mit"] and all(0 <= r.score <= 1 for r in got)
    assert license_scan(none).count() == 0


def plain_labels(text, least=0.6, slack=4):
    """Labels and best share by the rule of license_scan, in plain loops."""
    w, labels, best = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set(), 0.0
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels, best = labels | {label}, 1.0
    for template, label, phrase in TEMPLATES:
        t, must = template.split(), phrase.split()
        hits = [(i, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]]
        begin = next(i for i in range(len(t)) if t[i : i + len(must)] == must)
        for low in {i - j for i, j in hits}:
            chain, last = [], -1
            for j, i in sorted((j, i) for i, j in hits if low <= i - j <= low + slack):
                if (not chain or j > chain[-1]) and i > last:
                    chain.append(j)
                    last = i
            share = len(chain) / (len(t) - 1)
            if share >= least - 1e-9 and set(range(begin, begin + len(must) - 1)) <= set(chain):
                labels, best = labels | {label}, max(best, share)
    return ",".join(sorted(labels)), best


def test_license_spans_are_verified(spark):
    rng = np.random.default_rng(5)
    clean = ["licensed under the Mozilla Public License, version 2.0", "licensed under the MIT license version 2.0", "2 0 " * 30, "versions 2.0, 2.0, 2.0, 2.0, 2.0", "licensed under " * 5, "of the " * 40]
    texts = [*clean, "CC BY 4.0", "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0"]
    for template, *_ in TEMPLATES * 6:  # words left out, put in, and turned
        w = template.split()
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = ["of", "the"][: int(rng.integers(0, 3))]
        texts.append(" ".join(w[::-1] if rng.random() < 0.1 else ["of the", *w, "to any person"]))
    got = {r.doc_id: r for r in license_scan(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert all(got[i].labels == "" and got[i].spans == "" for i in range(len(clean)))
    assert (got[6].labels, got[6].spans) == ("cc-by", "cc-by:0:1") and got[7].spans == "apache-2.0:0:7,apache-2.0:8:15"
    for i, t in enumerate(texts):
        labels, share = plain_labels(t)
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(share)), t
    assert len({r.labels for r in got.values()}) > 8


def test_secrets(spark, docs, none):
    key = "Ab3dE9gH1jK5mN7pQ2sT"
    rows = [
        (40, 'password = "hunter22" token:abc secret=token: abcdefgh', None, "s1"), (41, f"AKIA{'A1' * 8} é🙂 {'0af' * 8} {key}", None, "s1"), (42, f"PassWord='x' api-key=zzzzzz APIKEY: {'0af' * 9}", None, "s2"),
        (43, f"copied {'B' * 10}c12345678901234", None, "s1"), (44, f"copied {'B' * 10}c12345678901234", None, "s2"), (45, "ſecret=abcdefgh AKIA" + "A" * 15, None, None),
    ]
    kinds = {"assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    got = secret_scan(frame(spark, TEXTS + rows)).collect()
    want = []
    for i, text, *_ in TEXTS + rows:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, (p, g, least)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if len(m[g]) >= least)
        n = Counter(s[3] for s in spans)
        told = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(told.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == Counter(want)
    spans = {r.doc_id: r.spans for r in got}
    assert "opaque:" in spans[41] and spans[43] == spans[44] == ""
    assert secret_scan(none).count() == 0


def test_secrets_by_repository(spark):
    many, few, often = "Ab3dE9gH1jK5mN7pQ2sT", "Zb3dE9gH1jK5mN7pQ2sZ", "Yb3dE9gH1jK5mN7pQ2sY"
    rows = [(i, f"copy {many} end", None, "s1") for i in range(11)] + [(20 + i, f"copy {few} end", None, "s1") for i in range(10)]
    rows += [(40, f"copy {often} " * 30, None, "s1"), (50, f"password={many}", None, "s1"), (51, "password=single99", None, "s1")]
    got = {r.doc_id: r for r in secret_scan(frame(spark, rows)).collect()}
    # a value of one source: in over ten rows an example, in ten still live, and many places in one row are one repository
    assert all(got[i].spans == "" and (got[i].n_live, got[i].n_example) == (0, 0) for i in range(11))
    assert all(got[20 + i].spans == "opaque:5:25" and got[20 + i].n_live == 1 for i in range(10))
    assert got[40].n_live == 30 and (got[50].n_live, got[50].n_example) == (0, 1) and (got[51].n_live, got[51].n_example) == (1, 0)


def test_chats(spark):
    control = "</s>[INST] ok [/INST] <|im_start|>user\n x <|im_end|>\n &lt; &amp;"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", control), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, None, control), (2, 5, "we\nird", "b"), (3, None, "assistant", "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"), (None, 1, "user", "z")]
    rows += [(4, i, "assistant" if i % 2 else "user", "long " * 3000) for i in range(40)]
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, node long, tree string")
    made = formatted_paths(conversation_nodes(table))
    got = {r.conv_id: r for r in chat_digest(made).collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -9, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    back = {r.tree: [tuple(t) for t in r.t] for r in made.select("tree", read_back(made.formatted).alias("t")).collect()}
    assert back == dict(by)
    assert chat_digest(formatted_paths(conversation_nodes(table.limit(0)))).count() == 0


def test_reply_trees(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 3, 0.0), (2, 6, 99, None)]
    table = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = defaultdict(list)
    for r in paths(table, top=2).collect():
        got[r.tree, r["rank"]].append((r.depth, r.node))
    assert {k: sorted(v) for k, v in got.items()} == {(1, 1): [(0, 1), (1, 3), (2, 4)], (1, 2): [(0, 1), (1, 2)], (2, 1): [(0, 6)]}
    with pytest.raises(ValueError, match="ring"):
        paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], "tree long, node long, parent long, score double"), max_rounds=4)


def test_branching_trees_are_formatted(spark):
    nodes = [(7, 1, None, 0.0, "user", "q <|im_end|>"), (7, 2, 1, 5.0, "assistant", "good"), (7, 3, 1, 1.0, "assistant", "fair"), (7, 4, 3, 9.0, "user", "more"), (7, 5, 4, 9.0, "assistant", "[end]"), (7, 6, 3, -9.0, "user", "bad"), (8, 9, None, 1.0, "user", None)]
    made = formatted_paths(spark.createDataFrame(nodes, "tree long, node long, parent long, score double, role string, text string"), top=2)
    back = {(r.tree, r["rank"]): [tuple(t) for t in r.t] for r in made.select("tree", "rank", read_back(made.formatted).alias("t")).collect()}
    # means of the paths: to 2 is 2.5, to 5 4.75, to 6 -2.67
    assert back == {
        (7, 1): [("user", "q <|im_end|>"), ("assistant", "fair"), ("user", "more"), ("assistant", "[end]")],
        (7, 2): [("user", "q <|im_end|>"), ("assistant", "good")], (8, 1): [("user", "")],
    }
    loss = {(r.tree, r["rank"]): [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] for r in made.collect()}
    assert loss == {(7, 1): ["fair", "&#91;end]"], (7, 2): ["good"], (8, 1): []}


def test_scores(spark, docs, none):
    for heavy in (3, 100_000):
        got = scores(docs, heavy=heavy).collect()
        counts, told = Counter(), []
        for i, text, *_ in TEXTS:
            tokens = [*words(text), None]
            told.append((i, tokens))
            if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
                counts.update(tokens)
        n, v = sum(counts.values()), len(counts)
        want = Counter((i, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in told)
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert scores(none).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = scores(frame(spark, [(only, "a b", None, None)])).first()
    assert (alone.held_out, alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (True, 3, 0, 0, 0.0)


def test_scores_by_part(spark, docs):
    from kindred.llm.lm import filter_bits, gram_counts, merged_counts, segments_for

    # a filter that doesn't fit one broadcast gives the scores of one that does
    want = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in scores(docs).collect())
    got = scores(docs, most_bits=1 << 17).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    marks = spark.createDataFrame([(10**9,), (10**9,)], "marks long")
    assert filter_bits(marks) * 256 >= 2 * 10**9 * 8 - 256 * 8 and segments_for(0) == 256 and segments_for(30 << 30) >= 2048
    counts = merged_counts(gram_counts(docs.select("text"), 512))
    assert counts.agg({"seg": "max"}).first()[0] > 255


def test_scores_are_those_of_the_counts(spark, docs):
    # a filter so wide that nothing is read wrongly, against plain counts, each as the middle of its level
    got = scores(docs, bits_per_mark=4000).collect()
    told = [["", *words(text), ""] for _, text, *_ in TEXTS]
    one, two = Counter(), Counter()
    for (i, *_), t in zip(TEXTS, told, strict=True):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t[1:])
            two.update(zip(t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    middle = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    q = lambda w: (middle(one[w]) + 1) / (n + v + 1)
    want = Counter((i, round(sum(math.log10(min(1, (middle(two[x, y]) + 4 * q(y)) / (middle(one[x]) + 4))) for x, y in zip(t, t[1:], strict=False)), 6)) for (i, *_), t in zip(TEXTS, told, strict=True))
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want


def test_large_counts_are_kept():
    from kindred.llm.lm import _level, _packed, _unpacked

    grams, counts = np.array([3, 2**64 - 1], np.uint64), np.array([2**32 + 7, 1])
    back = _unpacked(_packed(grams, counts))
    assert back[0].tolist() == grams.tolist() and back[1].tolist() == counts.tolist() and _level(counts).tolist() == [33, 1]


def test_shared_folder():
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
    assert unused(["H", "_n"], "h", "n", "x") == ["_h", "n", "x"]


def test_filter_levels(spark):
    from kindred.llm.lm import bloom, gram_counts, merged_counts, tokens_of

    import pyarrow as pa

    texts = [" ".join([f"w{i}"] * (1 << (i % 8))) for i in range(500)]
    counts = merged_counts(gram_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    whole = bloom(counts)
    (_, _, data, offsets), = text_chunks(pa.array([t.split()[0] for t in texts]))
    text, h = tokens_of(data, offsets)
    got = looked_up(whole, h[::2])
    right = np.mean(got == 1.5 * 2.0 ** (np.arange(500) % 8) - 0.5)
    assert right > 0.9 and (got >= 1.5 * 2.0 ** (np.arange(500) % 8) - 0.5).all()
