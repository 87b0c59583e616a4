"""Rules over facts, claims, renames, views and fault sets on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import claims, graph, metrics
from factloom.operators import rules as R

SCHEMAS = {
    "functions": "fn string, name string, path string, is_test boolean", "effects": "fn string, effect string", "returns": "fn string, line long, constant string",
    "calls": "fn string, line long, callee string, builtin string", "conditions": "fn string, var string", "assigns": "fn string, line long, var string, rhs string, args array<string>",
    "handlers": "fn string, line long, end long, kind string", "raises": "fn string, line long", "sources": "fn string, var string", "sinks": "fn string, line long, kind string, args array<string>, parameterized boolean",
}


@pytest.fixture
def facts(spark):
    return lambda name, *rows: spark.createDataFrame(list(rows), SCHEMAS[name])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bank(facts):
    """A small bank: each function breaks one rule or stands near one."""
    functions = facts("functions", ("auth", "authorize_pay", "web/pay.py", False), ("ok", "check_access", "web/a.py", False), ("v", "verify_token", "core/t.py", False), ("pay", "pay", "core/p.py", False), ("sure", "decide", "core/d.py", False), ("test", "authorize_x", "api/t.py", True), ("list", "list_users", "api/u.py", False), ("via", "show_users", "api/u.py", False), ("rows", "fetch", "db/u.py", False))
    effects = facts("effects", ("auth", "Print"), ("auth", "Log"), ("ok", "Print"), ("test", "Print"), ("list", "DbRead"), ("list", "Print"), ("via", "DbWrite"), ("sure", "WriteFile"))
    returns = facts("returns", ("auth", 3, "true"), ("auth", 4, None), ("ok", 2, "true"), ("test", 2, "true"), ("sure", 2, "true"), ("sure", 5, "num"), ("pay", 2, "false"), ("list", 2, "str"))
    calls = facts("calls", ("auth", 2, None, "Print"), ("ok", 1, "v", None), ("via", 2, "rows", None), ("pay", 9, "sure", None), ("sure", 30, None, "DbExecute"), ("sure", 40, "pay", None))
    return functions, effects, returns, calls


def test_outcomes_and_layers(facts):
    functions, effects, returns, calls = bank(facts)
    none = facts("raises"), facts("conditions")
    assert rows(R.outcomes(functions, effects, returns, calls, none[1], none[0])) == [("auth", "PR-001"), ("sure", "PR-002")]
    assert rows(R.outcomes(functions, effects, returns, calls, facts("conditions", ("ok", "x"), ("list", "y")), facts("raises", ("sure", 3)))) == [("auth", "PR-001"), ("list", "PR-002"), ("ok", "PR-002")]
    assert rows(R.layering(functions, effects, calls)) == [("list",)]


def test_ignored_rejection(facts):
    functions, _, _, calls = bank(facts)
    assigns = facts("assigns", ("sure", 10, "a", "call", ["verify_user"]), ("sure", 10, "b", "call", ["verify_user"]), ("sure", 35, "c", "call", ["can_pay"]), ("sure", 40, "d", "call", ["can_pay"]), ("sure", 5, "e", "call", ["load"]), ("sure", 5, "_", "call", []), ("sure", 5, "_x", "const", []))
    assert rows(R.ignored_rejections(functions, assigns, facts("conditions", ("sure", "b"), ("pay", "a")), calls)) == [("sure", 10, "a", 2), ("sure", 35, "c", 1)]
    assert rows(R.ignored_values(assigns)) == [("sure", 5, "_")]


def test_handlers(facts):
    handlers = facts("handlers", ("a", 1, 5, None), ("a", 10, 15, "Exception"), ("b", 1, 5, "ValueError"), ("c", 1, 5, ""), ("d", 1, 5, None), ("e", 1, 5, None), ("f", 7, 8, "KeyError"))
    calls = facts("calls", ("a", 2, None, "Print"), ("a", 11, "x", None), ("c", 2, None, "Log"), ("e", 3, "y", None))
    returns = facts("returns", ("c", 5, "true"), ("e", 4, None), ("d", 6, "true"))
    raises = facts("raises", ("d", 2), ("b", 9))
    assert rows(R.handler_outcomes(handlers, calls, returns, raises)) == [("a", 1, "PR-004"), ("c", 1, "PR-005")]
    assert rows(R.bare_handlers(handlers, raises)) == [("a", 1), ("e", 1)]
    functions = facts("functions", *((x, "refund" if x == "a" else x, "p", False) for x in "abcdef"))
    got = rows(R.error_handling(functions, handlers, returns, raises))
    assert got == sorted([("a", 1, "log_and_continue", "safety"), ("a", 10, "swallowed_exception", "safety"), ("b", 1, "swallowed_exception", "liveness"), ("c", 1, "swallowed_exception", "liveness"), ("d", 1, "log_and_continue", "liveness"), ("e", 1, "log_and_continue", "liveness"), ("f", 7, "empty_handler", "liveness"), ("c", None, "misleading_success", "liveness"), ("d", None, "misleading_success", "liveness")], key=repr)


def test_taint_goes_to_the_end(facts):
    chain = [("f", k, f"v{k + 1}", "vars" if k % 2 else "fstring", [f"v{k}", "other"]) for k in range(40)]
    assigns = facts("assigns", *chain, ("g", 1, "x", "input", []), ("f", 99, "w", "input", []), ("f", 3, "safe", "call", ["v1"]), ("h", 1, "v9", "vars", ["v8"]))
    sinks = facts("sinks", ("f", 50, "SqlExecute", ["v40"], False), ("f", 51, "SqlExecute", ["v40"], True), ("f", 52, "CodeEval", ["safe", "w"], True), ("f", 53, "ShellExec", ["safe"], False), ("g", 54, "ShellExec", ["x"], False), ("h", 55, "HtmlRender", ["v9"], False))
    assert rows(R.taint_to_sink(facts("sources", ("f", "v0")), assigns, sinks)) == [("f", 50, "sql_injection"), ("f", 52, "code_injection")]


def test_severity(spark):
    got = spark.createDataFrame([("sql_injection",), ("dead_code",), ("new",), (None,)], "k string").select("k", R.severity(F.col("k")))
    assert dict(rows(got)) == {"sql_injection": "critical", "dead_code": "low", "new": None, None: None}
    assert len(R.SEVERITY) == 18


def test_claims(spark):
    text = "- one\n# Rules #\n\t- The gate must close.\n\n12. It never opens by itself\n## Ünder\n* " + "é" * 600 + "\nplain line without a word of it\nmay be"
    docs = spark.createDataFrame([(1, text, "clash"), (2, None, "x"), (3, "", "x")], "id long, text string, claim string")
    got = claims.extract_claims(docs, "id", "text").orderBy("line_no").collect()
    assert [(r.line_no, r.section, r.claim) for r in got] == [(3, "Rules #", "The gate must close."), (5, "Rules #", "It never opens by itself"), (7, "Ünder", "é" * 500)]


def test_renames(spark):
    chain = spark.createDataFrame([(f"a{k}", f"a{k + 1}") for k in range(100)] + [("x", "y"), ("x", "z")], "old string, new string")
    got = {r.old: r.new for r in metrics.newest_names(chain).collect()}
    assert got == {f"a{k}": "a100" for k in range(100)} | {"x": "z"}
    with pytest.raises(ValueError):
        metrics.newest_names(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "old string, new string"))
    assert metrics.newest_names(chain.limit(0)).count() == 0


def test_depth_limited(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "d"), ("c", "d"), ("c", "e")], "parent string, child string")
    roots = spark.createDataFrame([("r",)], "node string")
    assert rows(graph.depth_limited(edges, roots, 2)) == [("a", 1, 0), ("b", 1, 0), ("c", 2, 2), ("r", 0, 0)]
    assert rows(graph.depth_limited(edges, roots, 0)) == [("r", 0, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_fault_sets(spark, seed):
    rnd = random.Random(seed)
    data = list({(t, rnd.randrange(3), rnd.randrange(5)): rnd.random() < 0.7 for t in range(12) for _ in range(6)}.items())
    by_edge = {}
    for (t, _, e), safe in data:
        by_edge[t, e] = by_edge.get((t, e), True) and safe
    frame = spark.createDataFrame([(t, s, e, safe) for (t, s, e), safe in data], "trace long, step long, edge long, idempotent boolean")
    want = set()
    for t in range(12):
        steps = {}
        for (x, s, e), _ in data:
            if x == t:
                steps.setdefault(s, set()).add(e)
        edges = sorted(set().union(*steps.values()))
        breaks = lambda gone, steps=steps: any(not (s - set(gone)) for s in steps.values())
        want.add((t, "crash", None, None, 1))
        want |= {(t, "duplicate", e, None, 1) for e in edges if not by_edge[t, e]} | {(t, "drop", e, None, 1) for e in edges if breaks([e])}
        want |= {(t, "drop", a, b, 2) for a, b in itertools.combinations(edges, 2) if breaks([a, b]) and not breaks([a]) and not breaks([b])}
    assert {tuple(r) for r in graph.fault_sets(frame).collect()} == want
