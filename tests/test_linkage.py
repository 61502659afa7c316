"""Linkage against plain loops over all pairs, golden values, and planted truth."""

import itertools
import json
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from kindred.functions import similarity as sim
from kindred.functions.similarity import Fuzzy, Many
from kindred.operators import compare
from kindred.operators.link import Space, dense_pairs, gamma_pairs, get_matches, link, tf_adjusted
from kindred.plans import config as cfg
from kindred.plans import em
from kindred import queries as registered
from kindred.queries import HOUSEHOLD, ORACLES, QUERIES, sides
from kindred.sources import tables
from kindred.streaming.score import score_batch, score_stream

DIR = "/root/testdata/sf0.001"
VARIABLES = [{"varname": "name", "method": "jarowinkler"}, {"varname": "brand", "method": "exact"}, {"varname": "size", "method": "numeric"}, {"varname": "price", "method": "exact"}]


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(12)
    names = ["ANNA", "ANNE", "HANNAH", "JOHN", "JON", "JOHNSON", "SMITH", "SMYTH", None]
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    rows = lambda first, n: [(first + i, pick(names), pick(["x", "y", "z", None]), pick([1, 2, 3, 5, 8, 40, None]), pick([1.0, 2.5, float("nan"), None])) for i in range(n)]
    shape = "{} long, name string, brand string, size long, price double"
    a, b = rows(0, 70), rows(1000, 50)
    return a, b, spark.createDataFrame(a, shape.format("id_a")), spark.createDataFrame(b, shape.format("id_b"))


def gammas(x, y):
    def of(v, w, test):
        return 3 if v is None or w is None else test(v, w)

    def name(v, w):
        s = round(sim.jaro_winkler(v, w), 4)
        return 2 if s >= 0.92 else 1 if s >= 0.88 else 0

    return of(x[1], y[1], name), of(x[2], y[2], lambda v, w: 2 * (v == w)), of(x[3], y[3], lambda v, w: 2 if abs(v - w) <= 1 else 1 if abs(v - w) <= 2 else 0), of(x[4], y[4], lambda v, w: 2 * (v == w))


def test_counts_are_those_of_all_pairs(people):
    a, b, da, db = people
    c = cfg.parse({"variables": VARIABLES})[0]
    all_pairs = {(x[0], y[0]): gammas(x, y) for x, y in itertools.product(a, b)}
    for tuples in (200_000, 0):  # side b broadcast, and joins by subset
        patterns, counts, dims = Space(da, db, c, {}, tuples=tuples).counts()
        assert dims == (70, 50) and {tuple(p): n for p, n in zip(patterns.tolist(), counts.tolist(), strict=True)} == Counter(all_pairs.values())
    dense = dense_pairs(da, db, c, gamma_pairs(da, db, c, {})).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in dense} == all_pairs and len(dense) == len(all_pairs)
    wanted = [p for p in patterns.tolist() if sum(g in (1, 2) for g in p) >= 2][::2]
    got = Space(da, db, c, {}).with_patterns(np.array(wanted)).collect()
    assert {(r.id_a, r.id_b): (r.gamma_1, r.gamma_2, r.gamma_3, r.gamma_4) for r in got} == {k: g for k, g in all_pairs.items() if list(g) in wanted} and len(got) == len({(r.id_a, r.id_b) for r in got})
    some = Space(da, db, c, {}).with_patterns(np.array([[0, 0, 0, 0], [3, 0, 0, 2]]))
    assert some.count() == sum(g in ((0, 0, 0, 0), (3, 0, 0, 2)) for g in all_pairs.values())


def test_nested_counts(spark, people):
    a, b, da, db = people
    hit = [(x[0], y[0]) for x, y in itertools.product(a, b) if (x[0] * 7 + y[0]) % 11 == 0]
    c = cfg.Comparison("total", (cfg.variable(VARIABLES[0]), cfg.Variable("sub", "nested", partial=False), cfg.variable(VARIABLES[2])))
    space = Space(da, db, c, {"sub": spark.createDataFrame(hit, "id_a long, id_b long")})
    want = {(x[0], y[0]): (gammas(x, y)[0], 2 * ((x[0], y[0]) in set(hit)), gammas(x, y)[2]) for x, y in itertools.product(a, b)}
    patterns, counts, _ = space.counts()
    assert {tuple(p): n for p, n in zip(patterns.tolist(), counts.tolist(), strict=True)} == Counter(want.values())
    got = space.with_patterns(np.array([[2, 2, 2], [0, 2, 0], [3, 2, 3]])).collect()
    assert {(r.id_a, r.id_b) for r in got} == {k for k, g in want.items() if g in ((2, 2, 2), (0, 2, 0), (3, 2, 3))}


def test_rows_are_not_broadcast(spark):
    a, b = sides(spark, DIR)
    space = Space(a, b, cfg.parse({"variables": [VARIABLES[1], {"varname": "type", "method": "exact"}, VARIABLES[3]]})[0], {})
    plan = space.with_patterns(np.array([[2, 2, 0]]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1  # with the patterns


def test_pairs_that_miss_a_value_are_made_alone(spark):
    """Of 5 billion pairs with the same name, those in which one has no brand are listed, without making the others."""
    n = 100_000
    a = spark.range(n).selectExpr("id as id_a", "'ANNA' as name", "if(id < 5, null, 'x') as brand")
    b = spark.range(n).selectExpr("id + 1000000 as id_b", "if(id % 2 = 0, 'ANNA', 'ANNE') as name", "if(id < 6, null, 'y') as brand")
    space = Space(a, b, cfg.parse({"variables": VARIABLES[:2]})[0], {}, tuples=0)
    found = space.with_patterns(np.array([[2, 3]]))
    assert round(sim.jaro_winkler("ANNA", "ANNE"), 4) < 0.92 and found.count() == 5 * n // 2 + 3 * (n - 5)
    assert space.masks() == ({0: n - 5, 2: 5}, {0: n - 6, 2: 6})


def test_many_pairs_of_distinct_rows_are_not_met_one_by_one(spark):
    for n, few in ((2_000, True), (40_000, False)):
        a, b = (spark.range(n).selectExpr(f"id as id_{w}", "cast(id as string) as name", "cast(id % 7 as string) as brand") for w in "ab")
        space = Space(a, b, cfg.parse({"variables": [{"varname": x, "method": "exact"} for x in ("name", "brand")]})[0], {})
        assert (space._few() is not None) == few
        patterns, counts, _ = space.counts()
        least, more = divmod(n, 7)
        agree = more * (least + 1) ** 2 + (7 - more) * least**2
        assert dict(zip(map(tuple, patterns.tolist()), counts.tolist(), strict=True)) == {(0, 0): n * n - agree, (0, 2): agree - n, (2, 2): n}


def test_variables_twice(spark, people):
    a, b, da, db = people
    da, db = (x.selectExpr("*", "name as name1", "brand as brand1", "size as size1") for x in (da, db))
    again = [{**VARIABLES[i], "varname": f"{VARIABLES[i]['varname']}1"} for i in (0, 1, 2)]
    c = cfg.parse({"variables": [*VARIABLES[:3], *again]})[0]
    want = {(x[0], y[0]): gammas(x, y)[:3] * 2 for x, y in itertools.product(a, b)}
    space = Space(da, db, c, {}, tuples=0)
    patterns, counts, _ = space.counts()
    assert space.first_of() == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2}
    assert {tuple(p): n for p, n in zip(patterns.tolist(), counts.tolist(), strict=True)} == Counter(want.values())
    wanted = [p for p in patterns.tolist() if any(g in (1, 2) for g in p)][::2]
    got = space.with_patterns(np.array(wanted)).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == sorted(k for k, g in want.items() if list(g) in wanted)
    other = Space(da.withColumn("name1", da.brand), db, c, {}, tuples=0)
    assert other.first_of()[3] == 3


def test_golden_similarities():
    for a, b, jw in (("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("JOHN", "JON", 0.933333), ("SMITH", "SMYTH", 0.893333), ("JENNIFER", "JENIFER", 0.970833), ("AB", "BA", 0.0)):
        assert sim.jaro_winkler(a, b) == pytest.approx(jw, abs=1e-6)
    for a, b, f in (("MARTHA", "MARHTA", 0.965104), ("DIXON", "DICKSONX", 0.792292), ("JOHN", "JON", 0.941439), ("SMITH", "SMYTH", 0.891667), ("JENNIFER", "JENIFER", 0.946038), ("MARY ANN", "MARYANN", 0.974609), ("O'BRIEN", "OBRIEN", 0.970313), ("AB", "BA", 0.666667), ("ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOP", 0.961667)):
        assert Fuzzy([b]).score(a)[0] == pytest.approx(f, abs=1e-6)
    assert np.isnan(Fuzzy(["JONES"]).score("SMITH")[0])
    assert (sim.osa_distance("CA", "ABC"), sim.dl_distance("CA", "ABC"), sim.osa_distance("CA", "ABC", False)) == (3, 2, 3)
    assert sim.ratcliff_obershelp("WIKIMEDIA", "WIKIMANIA") == pytest.approx(14 / 18)


def test_many_scores_as_one():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("ABCé "), int(rng.integers(0, 80 if rng.random() < 0.1 else 9))))
    words, queries = [word() for _ in range(80)], [word() for _ in range(25)]
    for method, one in sim.SCALAR.items():
        for q in queries:
            np.testing.assert_allclose(Many(words).score(method, q), [one(q, w) for w in words], atol=1e-12, err_msg=method)


def test_em():
    rng = np.random.default_rng(3)
    patterns = np.array(list(itertools.product([0, 1, 2, 3], [0, 2], [0, 1, 2])))
    counts = rng.integers(1, 5000, len(patterns))
    f = em.fit(patterns, counts, (1000, 900), ["x", "y", "z"])
    assert f.p_m + f.p_u == pytest.approx(1) and ((f.zeta >= 0) & (f.zeta <= 1)).all()
    assert all((np.diff(p) >= 0).all() and p.sum() == pytest.approx(1) for p in f.pgamma_km) and all((np.diff(p) <= 0).all() for p in f.pgamma_ku)
    with_prior = em.fit(patterns, counts, (1000, 900), ["x", "y", "z"], prior_lambda=1e-6, w_lambda=0.9)
    assert with_prior.p_m < f.p_m + 1e-9
    for bad in ({"prior_lambda": 2.0, "w_lambda": 0.5}, {"prior_pi": 0.1, "w_pi": 0.5}):
        with pytest.raises(ValueError):
            em.fit(patterns, counts, (10, 10), ["x", "y", "z"], **bad)


def test_link_finds_the_planted_pairs(spark):
    a, b = sides(spark, DIR)
    config = {"idvar": ["id_a", "id_b"], "comparisons": {"name": "total", "variables": [*VARIABLES[:3], {"varname": "type", "method": "exact"}, {"varname": "price", "method": "float"}]}}
    got = link(a, b, config)
    n = a.count()
    assert got.fit.counts.sum() == n * n == got.summary["number_of_comparisons"]
    found = get_matches(got).collect()
    true = sum(r.id_a + 1000000 == r.id_b for r in found)
    assert true >= 0.95 * n and len(found) == got.fit.counts[got.fit.zeta >= 0.85].sum()
    again = {(r.id_a, r.id_b) for r in score_batch(got, a.limit(20), b, config).collect()}
    assert again == {(r.id_a, r.id_b) for r in found if r.id_a in {x.id_a for x in a.limit(20).collect()}}


def test_tf_matches_are_those_of_all_pairs(spark):
    a, b = sides(spark, DIR)
    a, b = a.where("id_a < 60"), b.where("id_b < 1000060")
    variables = [{"varname": "name", "method": "jarowinkler", "tf_adjust": True, "tf_adjustment_weight": 0.5}, {"varname": "brand", "method": "exact", "tf_adjust": True}, {"varname": "size", "method": "numeric", "tf_adjust": True}, {"varname": "type", "method": "exact"}]
    got = link(a, b, {"idvar": ["id_a", "id_b"], "comparisons": {"variables": variables}})
    every = tf_adjusted(got, got.pairs(every=True), "2").where("is_match").collect()
    assert every and sorted(map(tuple, every)) == sorted(map(tuple, got.tf_matches().collect()))


def test_nested_link(spark):
    a, b = sides(spark, DIR)
    inner = {"name": "make", "threshold_match": 0.85, "variables": [{"varname": "brand", "method": "exact"}, {"varname": "type", "method": "exact"}, {"varname": "price", "method": "float"}]}
    config = {"idvar": ["id_a", "id_b"], "comparisons": {"name": "total", "variables": [{"varname": "name", "method": "fuzzy"}, {"varname": "size", "method": "numeric"}, {"comparisons": inner}]}}
    got = link(a, b, config)
    assert [x.name for x in cfg.parse(config)] == ["make", "total"] and got.fit.counts.sum() == a.count() * b.count()
    child = {(r.id_a, r.id_b) for r in got.children["make"].decided().collect()}
    nested = got.space.levels(got.space._beside(a.join(b, a.id_a + 1000000 == b.id_b).select("id_a", "id_b"))).collect()
    assert all((r.gamma_3 == 2) == ((r.id_a, r.id_b) in child) for r in nested)


def test_configuration_errors():
    for bad in ({"variables": [{"varname": "x", "method": "nope"}]}, {"variables": [{"varname": "x"}]}, {"variables": [{"varname": "x", "method": "exact"}] * 2}, {"variables": [], "odd": 1}, {"variables": [{"varname": "x", "method": "exact", "odd": 1}]}):
        with pytest.raises(ValueError):
            cfg.parse(bad)
    assert cfg.retrieve({"a": 1, "b": [{"a": 2}, {"c": {"a": 3}}]}, "a") == [1, 2, 3] and cfg.fetch_parameters({"variables": [{"varname": "q", "method": "exact"}]}, "q")["method"] == "exact"


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,n\n1,NA,5\n2,,7\n3,Bob,NA\n")
    df = tables.read_csv(spark, str(tmp_path / "x.csv"), schema="id long, name string, n int")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, 5), (2, None, 7), (3, "Bob", None)]
    tables.write_csv(df, str(tmp_path / "out"))
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 6
    assert tables.with_row_hash(df, "h").select("h").distinct().count() == 3
    assert compare.term_frequencies(df.withColumnRenamed("id", "id_a"), cfg.variable({"varname": "name", "method": "exact"})).first()["tf"] == pytest.approx(1 / 3)


def test_empty_tables(spark, people):
    _, _, da, db = people
    got = link(da.limit(0), db, {"idvar": ["id_a", "id_b"], "comparisons": {"variables": VARIABLES}})
    assert got.fit.comparisons == 0 and got.matches().count() == 0 and not math.isnan(got.fit.p_m)


@pytest.mark.parametrize("name", ["gamma_exact", "gamma_osa", "gamma_ratcliff", "gamma_fuzzy", "soundex_people", "csv_scan", "link_summary", "link_patterns", "moved_patterns", "household_tf"])
def test_queries_agree_with_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("part", "customer"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    tidy = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert tidy(map(tuple, got.select(*columns).collect())) == tidy(want.fetchall())


@pytest.mark.parametrize("name", ["gamma_exact", "gamma_exact_nulls_left", "gamma_numeric_one_cut", "gamma_float", "gamma_hamming"])
def test_gammas_of_hot_values(spark, tmp_path, name):
    """One part 400,000 times: 160 billion pairs, whose sum of marks outgrows a long."""
    n = 400_000
    part = "id as p_partkey", "'BLUE RING' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "7 as p_size", "900.5D as p_retailprice"
    spark.range(n).selectExpr(*part).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.gamma: (r.pairs, int(r.mark)) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    key, rest = np.arange(n), {"gamma_exact": 3, "gamma_exact_nulls_left": 3, "gamma_numeric_one_cut": 0, "gamma_hamming": 1}
    a = {"gamma_exact_nulls_left": key % 13 != 5}.get(name, key >= 0)
    b = {"gamma_exact": key % 7 != 2, "gamma_numeric_one_cut": (key % 4 != 3) & (key % 9 != 4), "gamma_hamming": key % 5 != 1}.get(name, key >= 0)
    total = lambda x, y: (int(x.sum()) * int(y.sum()), int(key[x].sum()) * int(((key[y] + 1000000) % 1009).sum()))
    every, match = total(key >= 0, key >= 0), total(a, b)
    others = {} if every == match else {rest[name]: (every[0] - match[0], every[1] - match[1])}
    assert got == {2: match, **others} and every[1] > 2**63


def test_household_finds_the_planted_pairs(spark):
    a, b = registered.people(spark, "/root/testdata/sf0.01")
    got = link(a, b, HOUSEHOLD)
    found = {(r.id_a, r.id_b) for r in got.tf_matches().collect()}
    planted = {(r.id_a, r.id_a + 1000000) for r in a.where("id_a % 4 <> 0").collect()}
    assert len(planted & found) >= 0.99 * len(planted)
    # those that agree so well that chance is ruled out are nearly all planted
    sure = {(r.id_a, r.id_b) for r in got.tf_matches().where("final_weight > 12").collect()}
    assert len(sure & planted) >= 0.95 * len(sure) and len(sure) >= 0.5 * len(planted)
    assert got.fit.p_u >= 0.999 and got.children["address"].fit.p_m < 0.01
    got.release()


def test_stream(spark, tmp_path):
    a, b = sides(spark, DIR)
    config = {"idvar": ["id_a", "id_b"], "comparisons": {"variables": [*VARIABLES[:3], {"varname": "type", "method": "exact"}]}}
    trained = link(a, b, config)
    for i, part in enumerate(a.randomSplit([0.5, 0.5], 3)):
        part.write.parquet(str(tmp_path / "in"), mode="append" if i else "error")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))
    query = score_stream(trained, stream, b, config, sink, str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.id_a, r.id_b) for r in found.collect()} == {(r.id_a, r.id_b) for r in trained.matches().collect()}


def test_em_from_a_seed():
    patterns, counts = np.array(list(itertools.product([0, 1, 2], [0, 2]))), np.array([90000, 300, 200, 900, 20, 400])
    mean, one, again, other = (em.fit(patterns, counts, (1000, 100), ["x", "y"], seed=x) for x in (None, 1, 1, 2))
    assert one.p_m == again.p_m and one.iterations == again.iterations and (one.zeta == again.zeta).all()
    assert all(f.p_m == pytest.approx(mean.p_m, rel=0.05) for f in (one, other))


def test_configuration_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(HOUSEHOLD))
    levels = cfg.parse(cfg.load(str(tmp_path / "c.json")))
    assert [c.name for c in levels] == ["address", "total"] and levels[1].em["prior_lambda"] == 1e-6 and levels == cfg.parse(HOUSEHOLD)


def test_inferred_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text("i,f,d,t,s,none,b\n1,1.5,2020-01-02,2020-01-02 03:04:05,x,NA,true\n\n2,NaN,2021-02-03,2021-02-03 00:00:00,NULL,,false\nNull,3,NA,NA,7,NaN,NA\n")
    df = tables.read_csv(spark, str(tmp_path / "x.csv"), tables.MORE_NULL_TOKENS)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "date", "timestamp", "string", "string", "boolean"] and df.count() == 3
    assert [(r.i, r.f, r.s) for r in df.collect()] == [(1, 1.5, "x"), (2, None, None), (None, 3.0, "7")]
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), limit=2).count() == 2
