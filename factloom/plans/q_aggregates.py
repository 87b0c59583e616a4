"""Queries of aggregates: history, co-change, overlap, risk, rollups, charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import metrics as M
from factloom.plans.registry import query


@query("select l_suppkey, count(*) as n, count(distinct l_partkey) as parts from lineitem group by 1")
def ag9_count_distinct(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("select user_id, count(*) as hits, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors, round(sum(value), 4) as total, max(value) as slowest from events group by 1")
def ag10_conditional(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("slowest"))


@query("select l_returnflag, count(*) filter (where l_quantity > 25) as many, count(*) as n from lineitem group by 1")
def ag11_count_filter(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("many"), F.count(F.lit(1)).alias("n"))


@query("select o_custkey, count(distinct o_orderstatus) as states from orders group by 1 having count(distinct o_orderstatus) > 1")
def ag12_flaky(t):
    return t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("states")).filter("states > 1")


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as n_done from customer")
def ag13_correlated_counts(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("f", F.lit(0)).alias("n_done"))


TOUCHES = "select distinct l_orderkey as c, l_partkey as p, l_suppkey % 7 as author from lineitem"


@query(
    f"""with t as (select l_orderkey as c, l_partkey as p, l_quantity::bigint as added, (l_discount * 100)::bigint as deleted, l_suppkey as author from lineitem),
    bulk as (select c from t group by c having count(distinct p) > 8)
    select p as path, count(distinct c) as commits, sum(added)::bigint as added, sum(deleted)::bigint as deleted, count(distinct author) as authors from t where c not in (select c from bulk) and author <> 3 group by p"""
)
def ag14_churn(t):
    return M.churn(M.touches(t.lineitem), bulk=8, excluded_authors=(3,))


@query(
    """with t as (select l_orderkey as c, l_partkey as p, l_quantity::bigint as a, (l_discount * 100)::bigint as d from lineitem), k as (select p, count(distinct c) as commits, sum(a) as added, sum(d) as deleted from t group by p),
    w as (select * from (values (0, 1.0, 1.0), (1, 2.0, 1.0), (2, 1.0, 2.0), (3, 1.0, 0.0), (4, 0.0, 1.0)) v(run, wc, wa)),
    r as (select p, run, row_number() over (partition by run order by round(wc * commits * 100 + wa * added, 4) desc, p) as rank from k, w)
    select p as path, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 4) as stability from r group by p having avg(case when rank <= 10 then 1.0 else 0.0 end) > 0"""
)
def ag15_rank_stability(t):
    """Share of five weightings under which a path ranks among the first ten; each run ranks by a top-k, not a full sort."""
    k = M.churn(M.touches(t.lineitem))
    runs = [(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (1.0, 0.0), (0.0, 1.0)]
    out = None
    for wc, wa in runs:
        top = k.select("path", F.round(wc * F.col("commits") * 100 + wa * F.col("added"), 4).alias("score")).orderBy(F.desc("score"), "path").limit(10).select("path")
        out = top if out is None else out.unionByName(top)
    return out.groupBy("path").agg(F.round(F.count(F.lit(1)) / len(runs), 4).alias("stability"))


@query(
    """with t as (select distinct l_orderkey as c, l_partkey as p from lineitem), b as (select c from t group by c having count(*) > 5),
    x as (select p, row_number() over (order by count(*) desc, p) as r from t group by p qualify r <= 10), y as (select p, row_number() over (order by count(*) desc, p) as r from t where c not in (select c from b) group by p qualify r <= 10)
    select coalesce(x.p, y.p) as path, x.r as rank_all, y.r as rank_kept, x.r - y.r as moved from x full join y on x.p = y.p"""
)
def ag16_exclusion_effect(t):
    top = lambda k, n: k.orderBy(F.desc("commits"), "path").limit(10).select("path", F.row_number().over(Window.orderBy(F.desc("commits"), "path")).cast("long").alias(n))
    rows = M.touches(t.lineitem)
    return top(M.churn(rows), "rank_all").join(top(M.churn(rows, bulk=5), "rank_kept"), "path", "full").withColumn("moved", F.col("rank_all") - F.col("rank_kept"))


@query(
    """with s as (select distinct l_orderkey as c, case when l_partkey % 10 > 6 then l_partkey - l_partkey % 10 + 6 else l_partkey end as p from lineitem), k as (select c from s group by c having count(*) <= 6),
    q as (select a.p as a, b.p as b, count(*) as support from s a join s b on a.c = b.c and a.p < b.p where a.c in (select c from k) group by 1, 2), n as (select p, count(*) as n from s where c in (select c from k) group by 1)
    select q.a, q.b, support, round(support / least(x.n, y.n), 4) as confidence from q join n x on x.p = q.a join n y on y.p = q.b where support >= 2"""
)
def ag17_cochange(t):
    """Co-change support after renames (parts ending in 7 to 9 were the one before, so 9 follows three renames), bulk commits excluded."""
    renames = t.part.filter("p_partkey % 10 > 6").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - 1).alias("new"))
    return M.cochange(M.touches(t.lineitem), renames, bulk=6, least=2)


@query(
    """with s as (select distinct l_orderkey as c, l_partkey as p from lineitem), k as (select c from s group by c having count(*) <= 6)
    select a.p as a, b.p as b, count(*) as support, array_to_string(list_slice(list_sort(list(a.c)), 1, 10), ',') as commits, a.p // 100 <> b.p // 100 as crosses from s a join s b on a.c = b.c and a.p < b.p where a.c in (select c from k) group by a.p, b.p having count(*) >= 2"""
)
def ag18_coupling(t):
    pair = Window.partitionBy("a", "b")
    ranked = M.pairs(M.touches(t.lineitem), bulk=6).withColumns({"support": F.count(F.lit(1)).over(pair), "k": F.row_number().over(pair.orderBy("commit"))})
    # ten commits of a pair at most are gathered; windows and groups share one dealing by pair
    out = ranked.filter("support >= 2 and k <= 10").groupBy("a", "b").agg(F.max("support").alias("support"), F.sort_array(F.collect_list("commit")).alias("list"))
    return out.select("a", "b", "support", F.array_join("list", ",").alias("commits"), (F.floor(F.col("a") / 100) != F.floor(F.col("b") / 100)).alias("crosses"))


@query(
    """with s as (select distinct l_suppkey as s, l_partkey as p from lineitem), n as (select s, count(*) as n from s group by s)
    select a.s as a, b.s as b, count(*) as shared, max(x.n) - count(*) as only_a, max(y.n) - count(*) as only_b, round(count(*) / (max(x.n) + max(y.n) - count(*)), 4) as jaccard
    from s a join s b on a.p = b.p and a.s < b.s join n x on x.s = a.s join n y on y.s = b.s group by 1, 2 having count(*) >= 2"""
)
def ag19_overlap_matrix(t):
    sets = t.lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item"))
    out = M.overlap(sets, least=2)
    return out.withColumn("jaccard", F.round("jaccard", 4))


@query("select user_id, event_type, round(sum(value) / (select sum(value) from events), 6) as share from events group by 1, 2")
def ag20_profile_hotspots(t):
    total = t.events.agg(F.sum("value").alias("all"))
    rows = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return rows.crossJoin(F.broadcast(total)).select("user_id", "event_type", F.round(F.col("v") / F.col("all"), 6).alias("share"))


@query("select coalesce(lang, 'missing') as category, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share from documents group by 1")
def ag21_category_breakdown(t):
    total = t.documents.agg(F.count(F.lit(1)).alias("all"))
    rows = t.documents.groupBy(F.coalesce("lang", F.lit("missing")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(
    """with f as (select o_custkey as k, count(*) as n from orders group by 1), l as (select user_id as k, count(*) as n from events where event_type = 'error' group by 1),
    x as (select c_custkey as k, f.n::double / (select max(n) from f) as a, l.n::double / (select max(n) from l) as b, abs(c_acctbal) / (select max(abs(c_acctbal)) from customer) as c from customer left join f on f.k = c_custkey left join l on l.k = c_custkey),
    s as (select k, round(0.35 * coalesce(a, 0.5) + 0.25 * coalesce(b, 0.5) + 0.2 * coalesce(c, 0.5) + 0.2 * 0.5, 6) as risk, a is null or b is null as missing from x)
    select k as c_custkey, risk, missing from s order by risk desc, k limit 50"""
)
def ag22_composite_risk(t):
    """Four factors, each over its maximum, a missing one at 0.5 (the fourth is never measured here); top 50."""
    f = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("f"))
    e = t.events.filter("event_type = 'error'").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("e"))
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.abs("c_acctbal").alias("b")).join(f, "k", "left").join(e, "k", "left")
    out = M.composite(rows, {"f": 0.35, "e": 0.25, "b": 0.2, None: 0.2})
    return out.select(F.col("k").alias("c_custkey"), F.round("risk", 6).alias("risk"), (F.col("f").isNull() | F.col("e").isNull()).alias("missing")).orderBy(F.desc("risk"), "c_custkey").limit(50)


@query(
    """with k as (select l_partkey as p, count(*)::double as n, avg(l_quantity) as q, sum(case when l_returnflag = 'R' then 1 else 0 end)::double as u from lineitem group by 1),
    m as (select max(n) as n, max(q) as q, max(u) as u from k) select k.p as path, round(100 * (0.5 * k.n / m.n + 0.35 * k.q / m.q + 0.15 * k.u / m.u), 1) as risk from k, m"""
)
def ag23_hotspot_risk(t):
    k = t.lineitem.groupBy(F.col("l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("u"))
    top = k.agg(F.max("n").alias("mn"), F.max("q").alias("mq"), F.max("u").alias("mu"))
    risk = 100 * (0.5 * F.col("n") / F.col("mn") + 0.35 * F.col("q") / F.col("mq") + 0.15 * F.col("u") / F.col("mu"))
    return k.crossJoin(F.broadcast(top)).select("path", F.round(risk, 1).alias("risk"))


@query(
    """with q as (select doc_id, quality from labels), d as (select sha256(text) as h, count(*) as n from documents group by 1)
    select x.doc_id, q.quality, case when x.lang in ('en', 'fr') then d.n - 1 end as copies from documents x left join q using (doc_id) join d on d.h = sha256(x.text)"""
)
def ag24_quality_projection(t):
    """Null where a row was not scanned (languages other than two), 0 where it was and is clean."""
    d = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    n = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, "h").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "quality", F.when(F.col("lang").isin("en", "fr"), F.col("n") - 1).alias("copies"))


@query(
    """with h as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
    up as (select 'c' || c_custkey as leaf, 'n' || c_nationkey as node from customer union all select 'c' || c_custkey, 'r' || n_regionkey from customer join nation on n_nationkey = c_nationkey union all select 'c' || c_custkey, 'c' || c_custkey from customer)
    select node, count(distinct c_mktsegment) as segments, min(c_acctbal) as worst, bool_and(c_acctbal > 0) as all_positive from up join customer on leaf = 'c' || c_custkey where node not like 'c%' group by node"""
)
def ag25_hierarchical_rollup(t):
    """Every concept above a customer: union of segments, least balance, conjunction."""
    from factloom.operators.graph import ancestors

    n = F.concat(F.lit("n"), "n_nationkey")
    h = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), n.alias("child")).union(t.customer.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
    up = ancestors(h, 4).filter("distance > 0 and node like 'c%'")
    leaf = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"), "c_mktsegment", "c_acctbal")
    return up.join(leaf, "node").groupBy(F.col("ancestor").alias("node")).agg(F.countDistinct("c_mktsegment").alias("segments"), F.min("c_acctbal").alias("worst"), F.bool_and(F.col("c_acctbal") > 0).alias("all_positive"))


@query(
    """with r as (select o_custkey, max(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end) as w from orders group by 1)
    select c_custkey, case w when 1 then 'ready' when 2 then 'pending' when 3 then 'blocked' else 'not_determined' end as tone from customer left join r on o_custkey = c_custkey"""
)
def ag26_readiness(t):
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    worst = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(rank).alias("w"))
    w = F.col("w")
    return t.customer.select("c_custkey").join(worst, "c_custkey", "left").select("c_custkey", F.when(w == 1, "ready").when(w == 2, "pending").when(w == 3, "blocked").otherwise("not_determined").alias("tone"))


@query(
    """with g as (select l_suppkey as s, l_shipmode_ as m, sum(case when l_returnflag = 'A' then 1 else 0 end) as support, sum(case when l_returnflag = 'R' then 1 else 0 end) as deviant from (select *, l_linestatus as l_shipmode_ from lineitem) group by 1, 2)
    select s as l_suppkey, round(1 / (1 + exp(-sum(0.5 * support / (support + deviant + 1)))), 6) as belief from g group by 1"""
)
def ag27_belief_posterior(t):
    g = t.lineitem.groupBy("l_suppkey", "l_linestatus").agg(F.count_if(F.col("l_returnflag") == "A").alias("support"), F.count_if(F.col("l_returnflag") == "R").alias("deviant"))
    weight = 0.5 * F.col("support") / (F.col("support") + F.col("deviant") + 1)
    return g.groupBy("l_suppkey").agg(F.round(S.sigmoid(F.sum(weight)), 6).alias("belief"))


@query("select l_partkey as claim, count(distinct l_suppkey) as docs, count(distinct l_returnflag) as states from lineitem group by 1 having count(distinct l_suppkey) > 1 and count(distinct l_returnflag) > 1")
def ag28_conflicts(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("claim")).agg(F.countDistinct("l_suppkey").alias("docs"), F.countDistinct("l_returnflag").alias("states")).filter("docs > 1 and states > 1")


@query("select lower(p_type) as label, count(distinct p_brand) as repos, 0.9::double as confidence from part group by 1 having count(distinct p_brand) >= 2")
def ag29_org_merge(t):
    return t.part.groupBy(F.lower("p_type").alias("label")).agg(F.countDistinct("p_brand").alias("repos")).filter("repos >= 2").withColumn("confidence", F.lit(0.9))


@query(
    """with s as (select * from (values ('error', 1), ('click', 2), ('view', 3), ('nothing', 4)) v(severity, pos)), n as (select event_type, count(*) as n from events group by 1)
    select severity, pos, coalesce(n, 0)::bigint as n from s left join n on severity = event_type"""
)
def ag30_severity_chart(t):
    """Fixed order with zeros where nothing was found."""
    order = t.spark.createDataFrame([("error", 1), ("click", 2), ("view", 3), ("nothing", 4)], "severity string, pos int")
    n = t.events.groupBy(F.col("event_type").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return order.join(n, "severity", "left").select("severity", "pos", F.coalesce("n", F.lit(0)).alias("n"))


@query("select sha256(event_type || ':' || (user_id % 10)) as fingerprint, count(*) as n, min(ts)::varchar as first_seen, max(ts)::varchar as last_seen from events group by event_type, user_id % 10")
def ag31_exceptions_inbox(t):
    key = F.sha2(F.concat("event_type", F.lit(":"), F.col("user_id") % 10), 256)
    stamp = lambda c: F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")
    return t.events.groupBy(key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), stamp(F.min("ts")).alias("first_seen"), stamp(F.max("ts")).alias("last_seen"))


@query("select p_brand as file, round(avg(p_size), 4) as mean, max(p_size) as most from part group by 1 union all select 'all', round(avg(p_size), 4), max(p_size) from part")
def ag32_complexity(t):
    out = t.part.rollup("p_brand").agg(F.round(F.avg("p_size"), 4).alias("mean"), F.max("p_size").alias("most"))
    return out.select(F.coalesce("p_brand", F.lit("all")).alias("file"), "mean", "most")


@query("select ts::date::varchar as day, count(*) as n, round(sum(value), 4) as total from events group by 1")
def ag33_daily_series(t):
    return t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """select * from (select 'worst' as chart, l_suppkey::varchar as label, count(*) as n from lineitem where l_returnflag = 'R' group by 2 order by n desc, label limit 8)
    union all select 'clean', 'suppliers', (select count(*) from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R'))"""
)
def ag34_one_tap_charts(t):
    bad = t.lineitem.filter("l_returnflag = 'R'")
    worst = bad.groupBy(F.col("l_suppkey").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(8).select(F.lit("worst").alias("chart"), "label", "n")
    clean = t.supplier.join(bad, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("clean").alias("chart"), F.lit("suppliers").alias("label"), "n")
    return worst.unionByName(clean)


@query("select l_returnflag as scope, round(100.0 * sum(l_quantity * l_tax) / sum(l_quantity), 2) as percent from lineitem group by 1")
def ag35_scoped_percent(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("scope")).agg(F.round(100.0 * F.sum(F.col("l_quantity") * F.col("l_tax")) / F.sum("l_quantity"), 2).alias("percent"))


@query(
    """with c as (select p_brand, p_type, list_sort(list(p_partkey)) as members from part group by 1, 2)
    select p_brand || '/' || p_type as cluster, len(members)::bigint as extent from c where len(members) >= 2 order by extent desc, cluster limit 12"""
)
def ag36_clusters(t):
    c = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("extent")).filter("extent >= 2")
    return c.select(F.concat_ws("/", "p_brand", "p_type").alias("cluster"), "extent").orderBy(F.desc("extent"), "cluster").limit(12)


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def ext_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders group by grouping sets ((y, m), (y), ())")
def ext_grouping_sets(t):
    t.orders.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).createOrReplaceTempView("order_months")
    return t.spark.sql("select y, m, count(*) as n from order_months group by grouping sets ((y, m), (y), ())")


@query()
def ext_approximate(t):
    """Distinct counts and quantiles by sketches: no oracle has the same rows."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", [0.5, 0.99]).alias("quantiles"))
