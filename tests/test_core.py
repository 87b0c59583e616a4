"""Golden and negative tests of the core operators on small inline rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.functions.diff import edit_script
from factloom.operators import flow, joins, metrics, revision, similarity
from factloom.operators import graph as G
from factloom.operators import windows as W
from factloom.plans import algebra as A
from factloom.plans import cube as C
from factloom.plans import outputs, request
from factloom.sources.catalog import Catalog, UnknownName
from factloom.sources.kv import KeyValue
from factloom.sources.revisions import RevisionStore
from factloom.streaming import events as E

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(spark):
    return Catalog(spark, DIR)


@pytest.mark.parametrize(
    "query",
    [
        A.Union((A.Select("part"), A.Select("order"))), A.Union(()), A.Intersect((A.Select("part"), A.Select("nation"))), A.Difference(A.Select("part"), A.Select("order")),
        A.Follow(A.Select("order"), "placed_by", min_depth=0), A.Follow(A.Select("order"), "placed_by", max_depth=9), A.Follow(A.Select("part"), "placed_by"),
        A.Follow(A.Select("order"), "placed_by", max_depth=2), "nothing",
    ],
)
def test_invalid_queries(catalog, query):
    with pytest.raises(A.InvalidQuery):
        A.compile_query(query, catalog)


def test_unknown_names(catalog):
    for bad in (lambda: catalog.entities("widget"), lambda: catalog.entities("part", ["colour"]), lambda: catalog.edges("owns"), lambda: A.compile_query(A.Select("part", A.Test("colour", "eq", 1)), catalog)):
        with pytest.raises(UnknownName):
            bad()
    with pytest.raises(A.InvalidQuery):
        A.compile_query(A.Select("part", A.And(())), catalog)
    with pytest.raises(A.InvalidQuery):
        A.compile_query(A.Select("region", A.Member("order", (1,))), catalog)
    assert A.check_ids(A.Select("nation", A.Ids((1, 99))), catalog) == [99]


def test_algebra_identities(catalog):
    some = A.Select("part", A.Test("size", "lt", 10))
    ids = lambda q: sorted(r.id for r in A.compile_query(q, catalog).collect())
    assert ids(A.Difference(some, some)) == []
    assert ids(A.Union((some, some))) == ids(some) == ids(A.Intersect((some, A.Select("part"))))
    assert ids(A.Select("part", A.Not(A.Not(A.Test("size", "lt", 10))))) == ids(some)


def test_strict_tests_raise_on_null(spark, catalog, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "a", None), (2, "b", 3.0)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    c = Catalog(spark, str(tmp_path))
    ids = lambda p: [r.id for r in A.compile_query(A.Select("supplier", p), c).collect()]
    assert ids(A.Test("balance", "gt", 1)) == [2] and ids(A.Not(A.Test("balance", "gt", 1))) == [1]
    assert ids(A.Test("balance", "eq", None)) == [1] and ids(A.Test("balance", "in", (None, 3.0))) in ([1, 2], [2, 1])
    with pytest.raises(Exception, match="no value"):
        ids(A.Test("balance", "gt", 1, strict=True))


def test_filters_reach_the_scan(catalog):
    plan = request.Request(catalog, {"select": "order", "where": {"field": "status", "op": "eq", "value": "F"}}).explain()
    assert "PushedFilters" in plan and "EqualNullSafe(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_cube_limits_and_boundaries(spark, catalog):
    everyone = A.compile_query(A.Select("part"), catalog)
    with pytest.raises(ValueError):
        C.cells(catalog, "part", everyone, C.Cube({}, (C.Measure("n"),)))
    for bad in ([], [2, 1], [1, 1], [float("nan")], list(range(65))):
        with pytest.raises(ValueError):
            S.bucket_label(F.lit(1), bad)
    rows = spark.createDataFrame([(1.0,), (9.99,), (10.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(S.bucket_label(F.col("x"), [10])).collect()] == ["<10", "<10", ">=10", None]
    cube = C.Cube({"brand": "brand"}, (C.Measure("n"),), having=F.col("n") > 10**6)
    assert C.cells(catalog, "part", everyone, cube).count() == 0
    assert C.grand_totals(catalog, "part", everyone, cube).first().n == everyone.count()


def test_page_tokens():
    token = W.page_token(b"k", "q", [1, "a"], now=1000)
    assert W.read_token(b"k", "q", token, now=1100) == [1, "a"]
    for secret, query, text, now in ((b"x", "q", token, 1100), (b"k", "other", token, 1100), (b"k", "q", "A" + token[1:], 1100), (b"k", "q", token, 1000 + W.TOKEN_SECONDS + 1), (b"k", "q", "none", 1100)):
        with pytest.raises(W.BadToken):
            W.read_token(secret, query, text, now)


def test_pages_cover_all_rows(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(25)], "a int, b int")
    seen, after = [], None
    while part := W.page(rows, ["a", "b"], 7, after).collect():
        seen += [tuple(r) for r in part]
        after = list(part[-1])
    assert seen == sorted((k % 3, k) for k in range(25))
    with pytest.raises(ValueError):
        W.page(rows, ["a"], 501)


def random_edges(seed, n=14, m=25):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_brute_force(spark, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, "source long, target long")
    pairs, state = G.closure(df)
    assert state == "exact" and {tuple(r) for r in pairs.collect()} == {(a, b) for a in {x for x, _ in edges} for b in reach(edges, a)}
    assert G.closure(spark.createDataFrame([(k, k + 1) for k in range(9)], "source long, target long"), max_rounds=2)[1] == "unknown"
    both = edges + [(b, a) for a, b in edges]
    assert {r.node: r.component for r in G.components(df).collect()} == {n: min(reach(both, n) | {n}) for n in {x for e in edges for x in e}}


def test_bfs_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "b"), ("x", "c")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in G.bfs(df, start, 8).collect()} == {("b", 1), ("c", 2)}


@pytest.mark.parametrize("small", [True, False])
def test_greedy_cover(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(G, "SMALL_COVER", 3)
    covers = {1: {1, 2, 3}, 2: {3, 4}, 3: {4, 5}, 4: {1, 2, 3}, 5: {6}}
    got = G.greedy_cover(spark.createDataFrame([(k, i) for k, v in covers.items() for i in v], "chooser long, item long")).collect()
    assert [(r.chooser, r.gain) for r in got] == [(1, 3), (3, 2), (5, 1)]


def test_cycles_are_rejected(spark):
    h = spark.createDataFrame([("root", "a"), ("a", "b")], "parent string, child string")
    assert G.would_cycle(h, "b", "root") and G.would_cycle(h, "a", "a") and not G.would_cycle(h, "b", "c")
    with pytest.raises(ValueError):
        G.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"), 4)


def test_control_dependence(spark):
    # 1 branches to 2 and 3, both lead to 4; 5 loops on itself
    rows = [(7, 1, 2), (7, 1, 3), (7, 2, 4), (7, 3, 4), (8, 5, 5), (8, 5, 6)]
    got = {tuple(r) for r in flow.control_dependence(spark.createDataFrame(rows, "function long, source long, target long")).collect()}
    assert got == {(7, 2, 1), (7, 3, 1), (8, 5, 5)}


def test_concept_lattice(spark):
    rows = [("1", "a"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "b"), ("4", "b")]
    got = {(tuple(r.extent), tuple(r.intent)) for r in flow.concepts(spark.createDataFrame(rows, "object string, attribute string")).collect()}
    assert got == {(("1", "2", "3", "4"), ()), (("1", "2", "3"), ("a",)), (("2", "3", "4"), ("b",)), (("2", "3"), ("a", "b"))}


def test_overlap(spark):
    sets = {"x": {1, 2, 3}, "y": {1, 2, 9}, "z": {7}}
    got = metrics.overlap(spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "owner string, item long"), 2).collect()
    assert [tuple(r) for r in got] == [("x", "y", 2, 1, 1, 0.5)]


@pytest.mark.parametrize("seed", range(4))
def test_compaction_keeps_reads(spark, seed):
    rng = random.Random(seed)
    log = [(rng.randrange(4), rng.randrange(1, 9), rng.choice([1, 1, -1])) for _ in range(40)]
    df = spark.createDataFrame(log, "a long, rev long, diff long")
    small = revision.compact(df, 5, ["a"])
    read = lambda x, r: {t.a: t["count"] for t in revision.facts_at(x, r, ["a"]).collect()}
    for r in range(5, 9):
        assert read(df, r) == read(small, r)
    assert small.filter("rev < 5").count() == 0


def test_random_edits_incremental_equals_clean(spark):
    rng, state = random.Random(3), {}
    before = spark.createDataFrame([], "path string, h string")
    for _ in range(6):
        for path in "abc":
            op = rng.choice(["keep", "set", "drop"])
            if op == "set":
                state[path] = str(rng.randrange(3))
            elif op == "drop":
                state.pop(path, None)
        now = spark.createDataFrame(sorted(state.items()), "path string, h string")
        plan = {r.path: r.action for r in revision.plan_ingest(before, now, "path", ["h"]).collect()}
        kept = {r.path: r.h for r in before.collect() if plan[r.path] == "unchanged"}
        fresh = {p: h for p, h in state.items() if plan[p] in ("added", "changed")}
        assert kept | fresh == state and all(p not in state for p, x in plan.items() if x == "deleted")
        before = now


def test_timeline(spark):
    rows = spark.createDataFrame([("f", 1, "x"), ("f", 2, "y"), ("f", 4, "y"), ("g", 1, "x")], "name string, rev long, contract string")
    revs = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "rev long")
    got = {tuple(r) for r in revision.timeline(rows, revs, "name", "contract").collect()}
    assert got == {("f", 2, "contract_changed"), ("f", 3, "removed"), ("f", 4, "reinstated"), ("g", 2, "removed")}


def test_edit_script_is_shortest():
    for seed in range(60):
        rng = random.Random(seed)
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(7))] for _ in range(2))
        script = edit_script(a, b)
        assert [x for m, x in script if m != "+"] == a and [x for m, x in script if m != "-"] == b
        best = max((len(s) for k in range(len(a) + 1) for s in itertools.combinations(a, k) if is_subsequence(s, b)), default=0)
        assert sum(m == "=" for m, _ in script) == best


def is_subsequence(s, b):
    it = iter(b)
    return all(x in it for x in s)


def test_size_checks(spark):
    texts = spark.createDataFrame([("abc",)], "text string")
    needles = spark.createDataFrame([("a", 1), ("b", 2)], "needle string, ord int")
    with pytest.raises(ValueError):
        joins.contained_first(texts, needles, "text", "needle", "ord", limit=1)
    v = spark.createDataFrame([(k, [1.0 * k]) for k in range(3)], "id long, vector array<double>")
    with pytest.raises(ValueError):
        similarity.nearest(v, v, 1, most_queries=2)
    with pytest.raises(ValueError):
        flow.concepts(spark.createDataFrame([(str(k), "a") for k in range(70)], "object string, attribute string"), most_objects=1)


def test_outputs_and_views():
    with pytest.raises(outputs.CyclicOutputs):
        outputs.run_outputs(None, {"a": (("b",), None, 1), "b": (("a",), None, 1)})
    with pytest.raises(ValueError):
        outputs.run_outputs(None, {"a": (("z",), None, 1)})
    assert request.check_view({"nodes": [{"id": "a"}, {"id": "a"}]}) == ["repeated node a"]
    deep = {"all": []}
    for _ in range(20):
        deep = {"not": deep}
    with pytest.raises(A.InvalidQuery):
        request.query({"select": "part", "where": deep})


def test_revision_store(spark):
    store = RevisionStore.temporary(spark)
    store.publish(spark.range(3), "t", 4)
    assert store.read("t").count() == 3 and store.verify("t", 4) and not store.verify("t", 5)
    with pytest.raises(LookupError):
        store.read("t", 3)


def test_key_value(spark):
    kv = KeyValue(spark.createDataFrame([("a1", "x", 1), ("a2", "y", 1), ("b", "z", 1)], "key string, value string, seq int")).put(spark.createDataFrame([("a1", None, 2), ("b", "w", 2)], "key string, value string, seq int"))
    assert [tuple(r) for r in kv.prefix("a").collect()] == [("a2", "y")] and kv.get("b").first().value == "w" and kv.get("a1").count() == 0
    assert sorted(r.key for r in kv.scan("a", "b").collect()) == ["a2"]


def test_fold_case(spark):
    rows = spark.createDataFrame([("Straße", "STRASSE")], "a string, b string")
    assert rows.filter(S.fold_case(F.col("a")) == S.fold_case(F.col("b"))).count() == 1


def test_watermarked_windows(spark):
    out = E.run_to_end(E.hourly_counts(E.event_stream(spark, f"{DIR}/events.parquet")), "append", spark)
    batch = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    done, all_rows = {tuple(r) for r in out.collect()}, {tuple(r) for r in batch.collect()}
    assert done and done <= all_rows and len(done) >= 0.9 * len(all_rows)


def test_joins_keep_equal_rows(spark):
    texts = spark.createDataFrame([("abc",), ("abc",), (None,), ("z",)], "text string")
    needles = spark.createDataFrame([("c", 1), ("b", 2), (None, 0)], "needle string, ord int")
    assert sorted(map(tuple, joins.contained_first(texts, needles, "text", "needle", "ord").collect()), key=str) == [("abc", "c"), ("abc", "c"), ("z", None), (None, None)]
    points = spark.createDataFrame([("g", 5), ("g", 5), ("g", 99)], "g string, x long")
    spans = spark.createDataFrame([("g", 0, 50), ("g", 4, 8)], "g string, a long, z long")
    assert [tuple(r) for r in joins.point_in_span(points, spans, "g", "x", "a", "z", 16).select("x", "a", "z").collect()] == [(5, 4, 8)] * 2
    left = spark.createDataFrame([(1, "l"), (1, "l")], "k int, v string")
    right = spark.createDataFrame([(1, 1), (2, 1)], "p int, q int")
    assert joins.either_key(left, right, "k", [F.col("p"), F.col("q")]).count() == 4


def test_chain_longer_than_any_budget(spark):
    n = 70
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(n, 0)], "source long, target long")
    start = spark.createDataFrame([(0,)], "node long")
    found = {(r.node, r.depth) for r in G.bfs(chain, start).collect()}
    assert found == {(k, k) for k in range(1, n + 1)}
    pairs, state = G.closure(chain)
    assert state == "exact" and pairs.count() == (n + 1) ** 2
    assert {r.node for r in G.reach(chain.filter("source < 18"), start).collect()} == set(range(1, 19))
