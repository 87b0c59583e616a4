"""Queries of rules over facts about code, derived from parts (functions) and line items (their statements)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import rules as R
from factloom.plans.registry import query

#: Expressions that both engines read, for the facts only; what a rule makes of them is written twice.
FUNCTIONS = """p_partkey as fn,
    case p_partkey % 7 when 0 then 'check_access' when 1 then 'load' when 2 then 'pay' when 3 then 'delete' when 4 then 'render' when 5 then 'verify_token' else 'refund' end || '_' || p_partkey as name,
    case p_size % 4 when 0 then 'ui/' when 1 then 'core/' when 2 then 'db/' else 'api/' end || lower(p_type) as path, p_partkey % 11 = 0 as is_test"""
STATEMENTS = "l_partkey as fn, l_orderkey * 8 + l_linenumber as line, (l_orderkey + l_linenumber + l_suppkey) % 16 as k, l_suppkey as s, l_orderkey as o, l_linenumber as n, cast(l_quantity as bigint) as q"
FACTS = {
    "effects": ("k < 2", "fn, case when fn % 3 = 0 then case s % 2 when 0 then 'Print' else 'Log' end else case s % 4 when 0 then 'DbRead' when 1 then 'Print' when 2 then 'DbWrite' else 'Log' end end as effect"),
    "returns": ("k in (2, 3)", "fn, line, case when fn % 2 = 0 then case s % 4 when 0 then 'true' when 1 then 'num' when 2 then 'str' else 'empty' end else case s % 3 when 0 then 'true' when 1 then 'false' end end as constant"),
    "calls": ("k in (4, 5, 6)", "fn, line, case when s % 4 > 1 then case when fn % 5 = 0 then fn + s else fn - fn % 7 + 2 + 2 * (s % 2) end end as callee, case s % 4 when 0 then 'Print' when 1 then case o % 2 when 0 then 'Log' else 'DbExecute' end end as builtin"),
    "conditions": ("k = 7 and fn % 4 = 0", "fn, 'v' || s % 6 as var"),
    "assigns": ("k between 8 and 11", "fn, line, case when s % 7 = 0 then '_e' else 'v' || o % 6 end as var, case n % 4 when 0 then 'call' when 1 then 'vars' when 2 then 'fstring' else case o % 9 when 0 then 'input' else 'const' end end as rhs, case when n % 4 = 0 then case o % 3 when 0 then 'verify_user' else 'load' end else 'v' || (o + n) % 6 end as arg"),
    "handlers": ("k = 12", "fn, line, line + case s % 5 when 0 then 1 else q * 100 end as ending, case s % 4 when 1 then 'Exception' when 2 then 'ValueError' when 3 then '' end as kind"),
    "raises": ("k = 13 and fn % 3 <> 1", "fn, line"),
    "sources": ("k = 14 and fn % 2 = 0", "fn, 'v' || o % 6 as var"),
    "sinks": ("k = 15", "fn, line, case s % 4 when 0 then 'SqlExecute' when 1 then 'ShellExec' when 2 then 'CodeEval' else 'HtmlRender' end as kind, 'v' || n % 6 as arg, s % 8 = 0 as parameterized"),
}
WITH = f"with recursive functions as (select {FUNCTIONS} from part), stm as (select {STATEMENTS} from lineitem), " + ", ".join(f"{k} as (select {c} from stm where {w})" for k, (w, c) in FACTS.items())
words = "|".join
listed = lambda xs: ", ".join(f"'{x}'" for x in xs)


class Facts:
    """Fact tables of a directory's parts and line items, by attribute."""

    def __init__(self, t):
        self.t = t
        self.functions = self._exprs(t.part, FUNCTIONS)

    @staticmethod
    def _exprs(df, columns: str):
        return df.sparkSession.sql(f"select {columns} from {{rows}}", rows=df)

    def __getattr__(self, name: str):
        where, columns = FACTS[name]
        rows = self._exprs(self._exprs(self.t.lineitem, STATEMENTS).filter(where), columns)
        if "arg" in rows.columns:
            rows = rows.withColumn("args", F.array("arg")).drop("arg")
        return rows.withColumnRenamed("ending", "end")


@query(f"{WITH} select distinct fn, line, var from assigns where rhs = 'call' and var like '\\_%' escape '\\'")
def ru2_ignored_value(t):
    """Results of calls that go to a throwaway name."""
    return R.ignored_values(Facts(t).assigns)


@query(f"{WITH} select distinct fn, line from handlers h where kind is null and not exists (select 1 from raises r where r.fn = h.fn)")
def ru3_bare_except(t):
    f = Facts(t)
    return R.bare_handlers(f.handlers, f.raises)


@query(
    f"""{WITH}, seeds as (select fn, var from sources union select fn, var from assigns where rhs = 'input' and fn in (select fn from sources)),
    t as (select fn, var from seeds union select a.fn, a.var from t join assigns a on a.fn = t.fn and a.arg = t.var where a.rhs in ('vars', 'fstring'))
    select distinct s.fn, s.line, case s.kind when 'SqlExecute' then 'sql_injection' when 'ShellExec' then 'command_injection' when 'CodeEval' then 'code_injection' else 'taint_flow' end as rule
    from sinks s join t on t.fn = s.fn and t.var = s.arg where not (s.kind = 'SqlExecute' and s.parameterized)"""
)
def ru4_taint_to_sink(t):
    """Sinks that take input, through assignments of the same function."""
    f = Facts(t)
    return R.taint_to_sink(f.sources, f.assigns, f.sinks)


@query(
    f"""{WITH}, c as (select fn, bool_and(constant in ({listed(R.SUCCESS)})) as ok, count(distinct constant) as n from returns where constant is not null group by fn),
    e as (select fn, bool_and(effect in ({listed(R.QUIET_EFFECTS)})) as quiet from effects group by fn),
    d as (select k.fn from calls k join functions g on g.fn = k.callee where regexp_matches(g.name, '{words(R.CHECK_WORDS)}') or g.fn in (select fn from effects where effect in ({listed(R.SECURITY_EFFECTS)}))),
    x as (select f.fn, regexp_matches(name, '{words(R.AUTH_WORDS)}') and coalesce(quiet, false) and f.fn not in (select fn from d) as p1, f.fn not in (select fn from raises) and (n > 1 or f.fn in (select fn from conditions)) as p2 from functions f join c using (fn) left join e using (fn) where ok and not is_test)
    select fn, case when p1 then 'PR-001' else 'PR-002' end as rule from x where p1 or p2"""
)
def ru7_conformance(t):
    """Print-only authorization, then unconditional success, in that order of precedence."""
    f = Facts(t)
    return R.outcomes(f.functions, f.effects, f.returns, f.calls, f.conditions, f.raises)


@query(
    f"""{WITH}, a as (select distinct fn, line, var from assigns where rhs = 'call' and regexp_matches(arg, '{words(R.AUTH_WORDS)}') and (fn, var) not in (select (fn, var) from conditions)),
    s as (select fn, line from calls where builtin in ({listed(R.SENSITIVE_BUILTINS)}) union all select k.fn, k.line from calls k join functions g on g.fn = k.callee where builtin is null and regexp_matches(g.name, '{words(R.MONEY_WORDS)}|^({words(R.DESTRUCTIVE_STARTS)})|{words(R.DESTRUCTIVE_WORDS)}'))
    select a.fn, a.line, a.var, count(*) as n_sensitive from a join s on s.fn = a.fn and s.line > a.line group by 1, 2, 3"""
)
def ru7_ignored_rejection(t):
    f = Facts(t)
    return R.ignored_rejections(f.functions, f.assigns, f.conditions, f.calls)


@query(
    f"""{WITH}, h as (select distinct fn, line, ending from handlers where kind is null or kind in ({listed(R.BROAD_KINDS)})),
    x as (select h.*, (select count(*) from calls c where c.fn = h.fn and c.line > h.line and c.line <= ending) as n_calls, (select count(*) from calls c where c.fn = h.fn and c.line > h.line and c.line <= ending and (builtin is null or builtin not in ('Print', 'Log'))) as loud,
      (select count(*) from returns r where r.fn = h.fn and r.line > h.line and r.line <= ending) as n_returns, (select count(*) from returns r where r.fn = h.fn and r.line > h.line and r.line <= ending and constant in ({listed(R.SUCCESS)})) as good from h where not exists (select 1 from raises r where r.fn = h.fn and r.line > h.line and r.line <= ending))
    select distinct fn, line, case when good > 0 then 'PR-005' else 'PR-004' end as rule from x where good > 0 or (n_calls > 0 and loud = 0) or (n_calls = 0 and n_returns = 0)"""
)
def ru7_handlers(t):
    """Broad handlers that swallow an exception or turn it into success."""
    f = Facts(t)
    return R.handler_outcomes(f.handlers, f.calls, f.returns, f.raises)


@query(
    f"""{WITH} select fn from functions f where not is_test and regexp_matches(path, '{words(R.SURFACE_PATHS)}') and exists (select 1 from effects e where e.fn = f.fn and effect in ('DbRead', 'DbWrite'))
    and not exists (select 1 from calls c join functions g on g.fn = c.callee where c.fn = f.fn and regexp_matches(g.path, 'db|repo'))"""
)
def ru8_layering(t):
    f = Facts(t)
    return R.layering(f.functions, f.effects, f.calls)


KINDS = list(R.SEVERITY)


@query("select event_id, kind, s as severity from (select event_id, case event_id % " + str(len(KINDS) + 1) + " " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " else 'unheard_of' end as kind from events) left join (values " + ", ".join(f"('{k}', '{v}')" for k, v in R.SEVERITY.items()) + ") v(k, s) on k = kind")
def ru9_severity(t):
    """Every event as a finding of one of the kinds, or of an unknown one."""
    kind = F.try_element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % (len(KINDS) + 1) + 1).cast("int"))
    rows = t.events.select("event_id", F.coalesce(kind, F.lit("unheard_of")).alias("kind"))
    return rows.withColumn("severity", R.severity(F.col("kind")))


@query(
    f"""{WITH}, h as (select distinct fn, line, ending, kind from handlers),
    x as (select fn, line, case when kind is null then 'log_and_continue' when ending <= line + 1 then 'empty_handler' when not exists (select 1 from raises r where r.fn = h.fn and r.line between h.line and h.ending) then 'swallowed_exception' end as detector from h
      union all select distinct fn, null, 'misleading_success' from returns where constant in ({listed(R.SUCCESS)}) and fn in (select fn from handlers union select fn from raises))
    select distinct fn, line, detector, case when regexp_matches(name, 'refund|debit|charge') then 'safety' else 'liveness' end as threat from x join functions using (fn) where detector is not null"""
)
def ru10_error_handling(t):
    f = Facts(t)
    return R.error_handling(f.functions, f.handlers, f.returns, f.raises)


@query(
    f"""with recursive functions as (select {FUNCTIONS} from part) select fn, is_test, regexp_matches(name, '{words(R.AUTH_WORDS)}') as is_auth, regexp_matches(name, '{words(R.MONEY_WORDS)}') as is_money,
    regexp_matches(name, '^({words(R.DESTRUCTIVE_STARTS)})') or contains(name, '_delete') as is_destructive, name in ({listed(R.ENTRY_NAMES)}) or starts_with(name, 'handle_') as is_entry from functions"""
)
def fn19_name_heuristics(t):
    c = F.col("name")
    return Facts(t).functions.select("fn", "is_test", R.is_auth(c).alias("is_auth"), R.is_money(c).alias("is_money"), R.is_destructive(c).alias("is_destructive"), R.is_entry(c).alias("is_entry"))
