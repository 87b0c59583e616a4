"""Registered queries on inputs that a budget or a cut would leave part of."""

import random

import pytest

from factloom.operators import flow
from factloom.operators import graph as G
from factloom.plans import registry


#: Suppliers of one nation, in steps of one and three: 40 is more than 33 hops from -120, the only test before it.
CHAIN = [-121, -120, *(k for k in range(-119, 40) if k % 10), *range(40, 46)]
BALANCE = {k: -900.0 if k == CHAIN[-1] else 100.0 * (k % 9) - 200 for k in CHAIN}


@pytest.fixture(scope="module")
def chain_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chain"))
    spark.createDataFrame([(k, 3, BALANCE[k]) for k in CHAIN], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    return path


@pytest.mark.parametrize("name", ["gr5_closure", "gr8_test_map", "gr9_coverage_gap", "gr11_affected_tests", "gr20_effect_summaries", "gr28_lock_order"])
def test_closure_of_long_chain(spark, chain_dir, name):
    # one step leads to the next, so all later ones are reached
    reach = {a: set(CHAIN[k + 1 :]) for k, a in enumerate(CHAIN)}
    tests = {(a, b) for a, to in reach.items() if a % 10 == 0 for b in to}
    want = {
        "gr5_closure": {(a, b) for a, to in reach.items() for b in to},
        "gr8_test_map": {(b, sum(x == b for _, x in tests)) for _, b in tests},
        "gr9_coverage_gap": {(k,) for k in reach if k % 10 and k not in {b for _, b in tests}},
        "gr11_affected_tests": {(a,) for a, b in tests if b in (40, 41, 42)},
        "gr20_effect_summaries": {(a, len({BALANCE[b] > 0 for b in to | {a}}), min(BALANCE[b] for b in to | {a})) for a, to in reach.items()},
        "gr28_lock_order": {(a, b) for a, to in reach.items() if a % 13 == 0 for b in to if b % 13 == 0},
    }[name]
    got = [tuple(r) for r in registry.queries()[name](spark, chain_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def greedy(covers):
    left, picks = {k: set(v) for k, v in covers.items()}, []
    while any(left.values()):
        best = min(left, key=lambda k: (-len(left[k]), k))
        picks.append((len(picks) + 1, best, len(left[best])))
        gone = left[best]
        left = {k: v - gone for k, v in left.items()}
    return picks


def test_cover_of_many_choosers(spark):
    n = 10_050
    got = G.greedy_cover(spark.range(n).selectExpr("id as chooser", "id as item"))
    assert got.count() == n and got.agg({"gain": "sum"}).first()[0] == n


@pytest.mark.parametrize(("seed", "held"), [(1, 30), (2, 60), (3, 9)])
def test_cover_by_parts(spark, monkeypatch, seed, held):
    monkeypatch.setattr(G, "SMALL_COVER", held)
    rng = random.Random(seed)
    covers = {k: {rng.randrange(40) for _ in range(rng.choice([1, 3, 8, 12]))} for k in range(25)}
    rows = [(k, i) for k, v in covers.items() for i in v] + [(None, 1), (3, None)]
    assert [tuple(r) for r in G.greedy_cover(spark.createDataFrame(rows, "chooser long, item long")).collect()] == greedy(covers)


def test_cover_takes_all_lines(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.randrange(60), float(q)) for q in (1, 2, 50) for _ in range(70)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    covers = {}
    for s, p, _ in rows:
        covers.setdefault(s, set()).add(p)
    assert [tuple(r) for r in registry.queries()["gr10_minimum_test_set"](spark, str(tmp_path)).collect()] == greedy(covers)


def test_lattice_of_all_sizes(spark, tmp_path):
    rows = [("a", 3), ("a", 40), ("b", 40), ("b", 50)]
    spark.createDataFrame(rows, "p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(tuple(r.extent), tuple(r.intent)) for r in registry.queries()["gr18_concept_lattice"](spark, str(tmp_path)).collect()}
    assert got == {((), ("s3", "s40", "s50")), (("a",), ("s3", "s40")), (("b",), ("s40", "s50")), (("a", "b"), ("s40",))}


def test_post_dominators_of_all_orders(spark, tmp_path):
    rows = [(o, n, s) for o in (5, 199, 200, 70_000) for n, s in ((1, 3), (1, 4), (2, 3), (3, 5))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.queries()["gr15_post_dominators"](spark, str(tmp_path)).collect()}
    edges = [(o, n % 4, n % 4 + 1 + s % 3) for o, n, s in rows]
    want = {tuple(r) for r in flow.control_dependence(spark.createDataFrame(edges, "function long, source long, target long")).collect()}
    assert got == want and {r[0] for r in got} == {5, 199, 200, 70_000}


def reached(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        todo = [*after[a]]
        while todo:
            b = todo.pop()
            if (a, b) not in out:
                out.add((a, b))
                todo += after.get(b, ())
    return out


@pytest.mark.parametrize(("seed", "held", "kind"), [(1, 1 << 22, int), (2, 1 << 22, str), (3, 3, int)])
def test_reachable_by_blocks(spark, monkeypatch, seed, held, kind):
    monkeypatch.setattr(G, "HELD", held)
    monkeypatch.setattr(G, "BITS", 40)
    monkeypatch.setattr(G, "BLOCK", 3)
    rng = random.Random(seed)
    edges = {(kind(a), kind(a + rng.choice([-9, 1, 2, 5, 60]))) for a in (rng.randrange(100) for _ in range(90))}
    df = spark.createDataFrame(sorted(edges), f"source {'long' if kind is int else 'string'}, target {'long' if kind is int else 'string'}")
    got = [tuple(r) for r in G.reachable(df).collect()]
    assert len(got) == len(set(got)) and set(got) == reached(edges)
    some = [tuple(r) for r in G.reachable(df, "source % 3 = 0", "target % 2 = 0").collect()]
    assert sorted(some) == sorted((a, b) for a, b in got if int(a) % 3 == 0 and int(b) % 2 == 0)


def test_closure_keeps_its_pairs_where_they_are(spark, monkeypatch):
    written = []
    monkeypatch.setattr(G, "cut", lambda df, what="cut", plain=G.cut: written.append(plain(df, what)) or written[-1])
    got, state = G.closure(spark.range(200).selectExpr("id as source", "id + 1 as target"))
    assert got.count() == 201 * 200 // 2 and state == "exact"
    assert max(df.count() for df in written) <= 2 * 200 + 2


def test_extremes_of_cycles(spark):
    nan = float("nan")
    edges = [(1, 2), (2, 3), (3, 2), (3, 4), (5, 6), (8, 8), (9, 1)]
    values = [(1, 5.0), (2, nan), (3, None), (4, -1.0), (5, None), (6, None), (7, 2.0), (8, 3.0), (9, 9.0), (9, -8.0)]
    got = G.extremes(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame(values, "node long, value double"))
    got = {r.node: (r.low, str(r.high)) for r in got.collect()}
    assert got == {1: (-1.0, "nan"), 2: (-1.0, "nan"), 3: (-1.0, "nan"), 4: (-1.0, "-1.0"), 5: (None, "None"), 6: (None, "None"), 7: (2.0, "2.0"), 8: (3.0, "3.0"), 9: (-8.0, "nan")}


@pytest.mark.parametrize("held", [4, 12, 1000])
def test_cover_by_components(spark, monkeypatch, held):
    rng = random.Random(held)
    monkeypatch.setattr(G, "SMALL_COVER", held)
    covers = {k: {100 * (k % 5) + rng.randrange(20) for _ in range(rng.choice([1, 3, 8]))} for k in range(40)}
    rounds = []
    monkeypatch.setattr(G, "_picked_in_rounds", lambda left, plain=G._picked_in_rounds: rounds.append(left) or plain(left))
    got = G.greedy_cover(spark.createDataFrame([(k, i) for k, v in covers.items() for i in v], "chooser long, item long"))
    assert [tuple(r) for r in got.collect()] == greedy(covers) and bool(rounds) == (held < 1000)


def test_control_dependence_by_graph(spark):
    """Functions of one graph share its result: no group of rows goes to Python for each."""
    shapes = [[(1, 2), (1, 3), (2, 4), (3, 4)], [(1, 2), (2, 1), (2, 3)], [(-1, 5), (-1, 6), (5, 7)]]
    edges = spark.createDataFrame([(k, a, b) for k in range(300) for a, b in shapes[k % 3]], "function long, source long, target long")
    out = flow.control_dependence(edges.union(edges))
    got = [tuple(r) for r in out.collect()]
    want = [{(2, 1), (3, 1)}, {(1, 2), (2, 2)}, {(5, -1), (6, -1), (7, -1)}]
    assert len(got) == len(set(got)) and set(got) == {(k, n, b) for k in range(300) for n, b in want[k % 3]}
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
