"""Rules over fact tables: each gives a row for each finding.

Facts are tables of these columns; other columns are not read.

    functions  fn, name, path, is_test        effects   fn, effect
    returns    fn, line, constant             calls     fn, line, callee, builtin
    conditions fn, var                        assigns   fn, line, var, rhs, args
    handlers   fn, line, end, kind            raises    fn, line (those inside handlers)
    sources    fn, var                        sinks     fn, line, kind, args, parameterized

callee is the fn of a resolved call, builtin the kind of a built-in one, and
rhs one of call, vars, fstring, input, const; args are the names a statement
reads, or the called name first for a call. A null kind of a handler is a bare one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import bfs

# Words, effects and kinds that the rules test for.
SUCCESS = ("true", "num", "str", "empty")
QUIET_EFFECTS = ("Print", "Log", "Time", "Assert")
SECURITY_EFFECTS = ("DbRead", "DbWrite", "Network", "Crypto", "EnvRead", "Eval", "Spawn", "WriteFile", "ReadFile")
AUTH_WORDS = ("auth", "permission", "is_allowed", "has_access", "can_", "check_access", "check_right", "verify_", "grant_", "deny_")
CHECK_WORDS = ("verify", "check", "lookup", "token", "permission", "hash", "secret", "db", "query", "validate")
MONEY_WORDS = ("charge", "pay", "refund", "transfer", "withdraw", "debit", "spend", "invoice", "billing")
DESTRUCTIVE_STARTS, DESTRUCTIVE_WORDS = ("delete", "remove", "drop_", "purge"), ("_delete",)
ENTRY_NAMES, ENTRY_STARTS = ("main", "index", "handler", "app", "serve", "run"), ("handle_",)
SENSITIVE_BUILTINS = ("DbExecute", "FileWrite", "ProcessExec")
QUIET_BUILTINS = ("Print", "Log")
BROAD_KINDS = ("", "Exception", "BaseException")
SURFACE_PATHS = ("ui", "api", "view", "route", "controller", "web", "http", "handler")
STORE_PATHS = ("db", "repo")
SINK_RULES = {"SqlExecute": "sql_injection", "ShellExec": "command_injection", "CodeEval": "code_injection", "FileWrite": "taint_flow", "HtmlRender": "taint_flow"}
SEVERITY = {
    "print_only_authorization": "critical", "unconditional_success": "medium", "ignored_rejection": "high", "swallowed_exception": "medium",
    "exception_to_success": "high", "authz_bypass": "high", "hardcoded_secret": "critical", "sql_injection": "critical",
    "command_injection": "critical", "code_injection": "critical", "taint_flow": "high", "n_plus_one_query": "medium",
    "dead_code": "low", "orphan_code": "low", "layering_violation": "medium", "coverage_gap": "low",
    "unresolved_external": "info", "ignored_error_value": "info",
}


def has_word(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, whatever its case."""
    return F.lower(c).rlike("|".join(words))


def starts_with(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike(f"^({'|'.join(words)})")


def is_auth(name: Column) -> Column:
    return has_word(name, AUTH_WORDS)


def is_money(name: Column) -> Column:
    return has_word(name, MONEY_WORDS)


def is_destructive(name: Column) -> Column:
    return starts_with(name, DESTRUCTIVE_STARTS) | has_word(name, DESTRUCTIVE_WORDS)


def is_entry(name: Column) -> Column:
    return name.isin(*ENTRY_NAMES) | name.rlike(f"^({'|'.join(ENTRY_STARTS)})")


def severity(kind: Column) -> Column:
    """The default severity of a finding's kind, null for one that isn't known."""
    table = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return F.try_element_at(table, kind)


def outcomes(functions: DataFrame, effects: DataFrame, returns: DataFrame, calls: DataFrame, conditions: DataFrame, raises: DataFrame) -> DataFrame:
    """(fn, rule) of functions outside tests: PR-001 print-only authorization, else PR-002 success whatever was decided.

    Both need constant returns that all are success. PR-001: a name like an
    authorization, some effects, all quiet, and no resolved callee that checks
    anything or has an effect of security. PR-002: no raise, and a condition
    or two different constants.
    """
    quiet = effects.groupBy("fn").agg(F.bool_and(F.col("effect").isin(*QUIET_EFFECTS)).alias("quiet"))
    constants = returns.filter("constant is not null").groupBy("fn").agg(F.bool_and(F.col("constant").isin(*SUCCESS)).alias("success"), F.countDistinct("constant").alias("n"))
    risky = effects.filter(F.col("effect").isin(*SECURITY_EFFECTS)).select("fn").union(functions.filter(has_word(F.col("name"), CHECK_WORDS)).select("fn")).distinct()
    checked = calls.join(risky.select(F.col("fn").alias("callee")), "callee", "left_semi").select("fn").distinct().withColumn("checked", F.lit(True))
    flag = lambda rows, name: rows.select("fn").distinct().withColumn(name, F.lit(True))
    rows = functions.filter(~F.col("is_test")).join(constants.filter("success"), "fn").join(quiet, "fn", "left").join(checked, "fn", "left")
    rows = rows.join(flag(conditions, "branches"), "fn", "left").join(flag(raises, "fails"), "fn", "left")
    first = is_auth(F.col("name")) & F.coalesce("quiet", F.lit(False)) & F.col("checked").isNull()
    second = F.col("fails").isNull() & (F.col("branches").isNotNull() | (F.col("n") > 1))
    return rows.select("fn", F.when(first, "PR-001").when(second, "PR-002").alias("rule")).filter("rule is not null")


def ignored_rejections(functions: DataFrame, assigns: DataFrame, conditions: DataFrame, calls: DataFrame) -> DataFrame:
    """(fn, line, var, n_sensitive) of PR-003: what an authorization call gave is in no condition, and n_sensitive calls of consequence follow it."""
    asked = assigns.filter((F.col("rhs") == "call") & is_auth(F.get("args", F.lit(0)))).select("fn", "line", "var").distinct().join(conditions, ["fn", "var"], "left_anti")
    weighty = functions.filter(is_money(F.col("name")) | is_destructive(F.col("name"))).select(F.col("fn").alias("callee"))
    builtin = calls.filter(F.col("builtin").isin(*SENSITIVE_BUILTINS)).select("fn", "line")
    acts = builtin.union(calls.filter("builtin is null").join(weighty, "callee", "left_semi").select("fn", "line"))
    both = asked.select("fn", "line", "var", F.lit(0).alias("act")).union(acts.select("fn", "line", F.lit(None).cast("string"), F.lit(1)))
    later = Window.partitionBy("fn").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, -1)  # no pairs are made
    counted = both.withColumn("n_sensitive", F.coalesce(F.sum("act").over(later), F.lit(0)).cast("long"))
    return counted.filter("act = 0 and n_sensitive > 0").select("fn", "line", "var", "n_sensitive")


def handler_outcomes(handlers: DataFrame, calls: DataFrame, returns: DataFrame, raises: DataFrame) -> DataFrame:
    """(fn, line, rule) of broad handlers without a raise inside: PR-005 returns a success constant, else PR-004 calls nothing but print or log, or nothing at all without a return."""
    broad = handlers.filter(F.col("kind").isNull() | F.col("kind").isin(*BROAD_KINDS)).select("fn", "line", "end").distinct()
    inside = lambda rows, what: rows.select(F.col("fn").alias("_fn"), F.col("line").alias("_at"), what.alias("what"))
    loud = F.when(F.col("builtin").isin(*QUIET_BUILTINS), "quiet").otherwise("loud")
    given = F.when(F.col("constant").isin(*SUCCESS), "success").otherwise("return")
    body = inside(calls, loud).union(inside(returns, given)).union(inside(raises, F.lit("raise")))
    met = broad.join(body, (F.col("fn") == F.col("_fn")) & (F.col("_at") > F.col("line")) & (F.col("_at") <= F.col("end")), "left")
    n = {k: F.count_if(F.col("what") == k).alias(k) for k in ("quiet", "loud", "success", "return", "raise")}
    counts = met.groupBy("fn", "line", "end").agg(*n.values()).filter(F.col("raise") == 0)
    silent = (F.col("loud") == 0) & ((F.col("quiet") > 0) | (F.col("return") == 0))
    return counts.select("fn", "line", F.when(F.col("success") > 0, "PR-005").when(silent, "PR-004").alias("rule")).filter("rule is not null").distinct()


def ignored_values(assigns: DataFrame) -> DataFrame:
    """(fn, line, var): a call's value goes to a name that starts with an underscore."""
    return assigns.filter((F.col("rhs") == "call") & F.col("var").startswith("_")).select("fn", "line", "var").distinct()


def bare_handlers(handlers: DataFrame, raises: DataFrame) -> DataFrame:
    """(fn, line) of bare handlers in functions that raise inside no handler."""
    return handlers.filter("kind is null").join(raises, "fn", "left_anti").select("fn", "line").distinct()


def tainted(sources: DataFrame, assigns: DataFrame) -> DataFrame:
    """(fn, var) that hold input: sources, and in functions with a source what assignments pass on, to the end of each chain."""
    seeds = sources.select("fn", "var").distinct()
    there = assigns.join(seeds.select("fn").distinct(), "fn", "left_semi")
    node = lambda v: F.struct(F.col("fn"), F.col(v).alias("var"))
    seeds = seeds.union(there.filter("rhs = 'input'").select("fn", "var")).distinct().select(node("var").alias("node"))
    edges = there.filter(F.col("rhs").isin("vars", "fstring")).select("fn", "var", F.explode("args").alias("arg")).select(node("arg").alias("source"), node("var").alias("target"))
    return seeds.union(bfs(edges, seeds).select("node")).select("node.fn", "node.var").distinct()


def taint_to_sink(sources: DataFrame, assigns: DataFrame, sinks: DataFrame) -> DataFrame:
    """(fn, line, rule) of sinks that take a tainted name; SQL with parameters is safe."""
    rule = F.create_map(*(F.lit(x) for pair in SINK_RULES.items() for x in pair))
    open_sinks = sinks.filter(~((F.col("kind") == "SqlExecute") & F.col("parameterized"))).select("fn", "line", "kind", F.explode("args").alias("var"))
    return open_sinks.join(tainted(sources, assigns), ["fn", "var"], "left_semi").select("fn", "line", F.try_element_at(rule, "kind").alias("rule")).distinct()


def layering(functions: DataFrame, effects: DataFrame, calls: DataFrame) -> DataFrame:
    """fn of surface functions outside tests that touch the database themselves and call nothing of a storage module."""
    surface = functions.filter(~F.col("is_test") & has_word(F.col("path"), SURFACE_PATHS)).select("fn")
    direct = effects.filter(F.col("effect").isin("DbRead", "DbWrite")).select("fn")
    store = functions.filter(has_word(F.col("path"), STORE_PATHS)).select(F.col("fn").alias("callee"))
    through = calls.join(store, "callee", "left_semi").select("fn")
    return surface.join(direct, "fn", "left_semi").join(through, "fn", "left_anti").distinct()


def error_handling(functions: DataFrame, handlers: DataFrame, returns: DataFrame, raises: DataFrame) -> DataFrame:
    """(fn, line, detector, threat) of handlers and functions whose errors go nowhere.

    A typed handler of at most one line is empty; another without a raise from
    its line to its end swallows; a bare one logs and continues; a function
    with a handler or raise that also returns success misleads (line null).
    The threat is safety where the name speaks of refunds, debits or charges, else liveness.
    """
    named = functions.select("fn", F.when(has_word(F.col("name"), ("refund", "debit", "charge")), "safety").otherwise("liveness").alias("threat"))
    spans = handlers.select("fn", "line", "end", "kind").distinct()
    again = raises.select(F.col("fn").alias("_fn"), F.col("line").alias("_at"))
    raised = spans.join(again, (F.col("fn") == F.col("_fn")) & (F.col("_at") >= F.col("line")) & (F.col("_at") <= F.greatest("end", "line")), "left_semi").select("fn", "line", "end", "kind")
    mark = raised.select("fn", "line", "end", F.coalesce("kind", F.lit("bare")).alias("_kind"), F.lit(True).alias("raised"))
    each = spans.withColumn("_kind", F.coalesce("kind", F.lit("bare"))).join(mark, ["fn", "line", "end", "_kind"], "left")
    empty = F.col("kind").isNotNull() & (F.col("end") > 0) & (F.col("end") <= F.col("line") + 1)
    found = each.select("fn", "line", F.when(F.col("kind").isNull(), "log_and_continue").when(empty, "empty_handler").when(F.col("raised").isNull(), "swallowed_exception").alias("detector")).filter("detector is not null")
    errors = handlers.select("fn").union(raises.select("fn"))
    mislead = returns.filter(F.col("constant").isin(*SUCCESS)).select("fn").distinct().join(errors, "fn", "left_semi")
    rows = found.unionByName(mislead.select("fn", F.lit(None).cast("long").alias("line"), F.lit("misleading_success").alias("detector")))
    return rows.join(named, "fn").select("fn", "line", "detector", "threat").distinct()
