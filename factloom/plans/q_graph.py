"""Queries of graph and fixpoint operators.

The graph of most of them: suppliers in a ring by nation (each to the next two
by key), which has cycles, and parts of one order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.plans.registry import Tables, query

#: Edges from each supplier to the next one and the third next of its nation, in DuckDB SQL.
EDGES = """e as (select source, unnest([t1, t3]) as target from (select s_suppkey as source, lead(s_suppkey) over w as t1, lead(s_suppkey, 3) over w as t3 from supplier window w as (partition by s_nationkey order by s_suppkey))),
edges as (select distinct source, target from e where target is not null)"""


def supplier_edges(t: Tables) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    e = t.supplier.select(F.col("s_suppkey").alias("source"), F.array(F.lead("s_suppkey").over(w), F.lead("s_suppkey", 3).over(w)).alias("next"))
    e = e.select("source", F.explode("next").alias("target"))
    return e.filter("target is not null").distinct()


def seeds(t: Tables, condition: str) -> DataFrame:
    return t.supplier.filter(condition).select(F.col("s_suppkey").alias("node"))


BFS = f"""with recursive {EDGES}, r as (select s_suppkey as node, 0 as depth from supplier where s_suppkey <= 5 union select target, depth + 1 from r join edges on source = node where depth < 4)"""


@query(f"{BFS} select node, min(depth)::bigint as depth from r where node not in (select node from r where depth = 0) group by 1")
def gr1_bounded_bfs(t):
    return G.bfs(supplier_edges(t), seeds(t, "s_suppkey <= 5"), 4).select("node", F.col("depth").cast("long").alias("depth"))


@query(f"{BFS}, n as (select distinct node from r) select count(*) as n_nodes, (select count(*) from edges where source in (select node from n) and target in (select node from n)) as n_edges, count(*) > 10 as truncated from n")
def gr2_graph_output(t):
    start = seeds(t, "s_suppkey <= 5")
    edges = supplier_edges(t)
    nodes = start.union(G.bfs(edges, start, 4).select("node"))
    inside = G.induced(edges, nodes).agg(F.count(F.lit(1)).alias("n_edges"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.crossJoin(inside).withColumn("truncated", F.col("n_nodes") > 10)


@query(f"with {EDGES} select source, target from edges where source % 2 = 0 and target % 2 = 0")
def gr3_induced_edges(t):
    return G.induced(supplier_edges(t), seeds(t, "s_suppkey % 2 = 0"))


@query(f"{BFS} select depth::bigint as hop, count(distinct node) as n from (select node, min(depth) as depth from r group by node) group by 1")
def gr4_trace_hops(t):
    start = seeds(t, "s_suppkey <= 5")
    found = start.withColumn("depth", F.lit(0)).unionByName(G.bfs(supplier_edges(t), start, 4))
    return found.groupBy(F.col("depth").cast("long").alias("hop")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {EDGES}, c as (select source, target from edges union select c.source, edges.target from c join edges on c.target = edges.source) select source, target from c")
def gr5_closure(t):
    return G.reachable(supplier_edges(t))


UP = f"with recursive {EDGES}, r as (select source as node from edges where target in (40, 41, 42) union select source from r join edges on target = node)"


@query(f"{UP} select node from r where node not in (40, 41, 42)")
def gr6_transitive_callers(t):
    back = supplier_edges(t).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.bfs(back, seeds(t, "s_suppkey in (40, 41, 42)")).select("node")


@query(f"{UP} select node, case when node in (40, 41, 42) then 'changed' else 'caller' end as why from (select node from r union select s_suppkey from supplier where s_suppkey in (40, 41, 42))")
def gr7_dirty_worklist(t):
    changed = seeds(t, "s_suppkey in (40, 41, 42)")
    back = supplier_edges(t).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return changed.select("node", F.lit("changed").alias("why")).unionByName(G.bfs(back, changed).select("node", F.lit("caller").alias("why")))


TESTS = f"with recursive {EDGES}, r as (select s_suppkey as test, s_suppkey as node from supplier where s_suppkey % 10 = 0 union select test, target from r join edges on source = node), m as (select test, node from r where test <> node)"


def test_map(t: Tables) -> DataFrame:
    """(test, node) of what each test (a supplier of a key divisible by 10) reaches."""
    return G.reachable(supplier_edges(t), "source % 10 = 0").filter("source <> target").select(F.col("source").alias("test"), F.col("target").alias("node"))


@query(f"{TESTS} select node, count(*) as tests from m group by 1")
def gr8_test_map(t):
    return test_map(t).groupBy("node").agg(F.count(F.lit(1)).alias("tests"))


@query(f"{TESTS} select s_suppkey as node from supplier where s_suppkey % 10 <> 0 and s_suppkey not in (select node from m)")
def gr9_coverage_gap(t):
    reached = G.bfs(supplier_edges(t), seeds(t, "s_suppkey % 10 = 0")).select("node")
    return seeds(t, "s_suppkey % 10 <> 0").join(reached, "node", "left_anti")


@query()
def gr10_minimum_test_set(t):
    """Greedy set cover of all parts by suppliers: checked against brute force in the tests."""
    return G.greedy_cover(t.lineitem.select(F.col("l_suppkey").alias("chooser"), F.col("l_partkey").alias("item")))


@query(f"{TESTS} select distinct test from m where node in (40, 41, 42)")
def gr11_affected_tests(t):
    back = supplier_edges(t).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.reach(back, seeds(t, "s_suppkey in (40, 41, 42)")).filter("node % 10 = 0 and node <> seed").select(F.col("node").alias("test")).distinct()


@query(f"with {EDGES}, one as (select distinct source as node, 1 as ring from edges where target = 60), two as (select distinct source as node, 2 as ring from edges where target in (select node from one)) select node, min(ring)::bigint as ring from (select * from one union all select * from two) where node <> 60 group by 1")
def gr12_impact_rings(t):
    back = supplier_edges(t).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.bfs(back, seeds(t, "s_suppkey = 60"), 2).select("node", F.col("depth").cast("long").alias("ring"))


@query(f"{UP} select s_nationkey as class, count(*) as n from r join supplier on s_suppkey = node where node not in (40, 41, 42) group by 1")
def gr13_impact_by_class(t):
    return gr6_transitive_callers(t).join(t.supplier, F.col("s_suppkey") == F.col("node")).groupBy(F.col("s_nationkey").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey as node, min(s_suppkey) over (partition by s_nationkey) as component from supplier where s_nationkey in (select s_nationkey from supplier group by 1 having count(*) > 1)")
def gr14_components(t):
    return G.components(supplier_edges(t))


@query()
def gr15_post_dominators(t):
    """Control dependence of a small flow graph per function."""
    from factloom.operators.flow import control_dependence

    edges = t.lineitem.select(F.col("l_orderkey").alias("function"), (F.col("l_linenumber") % 4).alias("source"), (F.col("l_linenumber") % 4 + 1 + F.col("l_suppkey") % 3).alias("target"))
    return control_dependence(edges)


@query(f"{UP} select node from r union select unnest([40, 41, 42]) where 40 in (select s_suppkey from supplier)")
def gr16_backward_slice(t):
    return gr6_transitive_callers(t).union(seeds(t, "s_suppkey in (40, 41, 42)")).distinct()


@query(f"with {EDGES} select source, count(*) as degree, array_to_string(list_sort(list(target)), ',') as targets from edges group by 1")
def gr17_adjacency(t):
    return G.adjacency(supplier_edges(t)).withColumn("targets", F.array_join("targets", ","))


@query()
def gr18_concept_lattice(t):
    """Formal concepts of brands and part types with sizes: closed pairs of extent and intent."""
    from factloom.operators.flow import concepts

    return concepts(t.part.select(F.col("p_type").alias("object"), F.concat(F.lit("s"), "p_size").alias("attribute")))


@query(f"with recursive {EDGES}, r as (select s_suppkey as node, s_nationkey % 3 as fact from supplier where s_acctbal < 0 union select target, case when target % 5 = 0 then 2 else fact end from r join edges on source = node) select node, fact from r")
def gr19_dataflow_facts(t):
    """Tabulation of (node, fact): a fact flows along an edge, some nodes change it."""
    edges = supplier_edges(t)
    known = delta = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 3).cast("int").alias("fact")).distinct()
    for _ in range(200):
        step = delta.join(edges, F.col("source") == F.col("node")).select(F.col("target").alias("node"), F.when(F.col("target") % 5 == 0, 2).otherwise(F.col("fact")).alias("fact")).distinct()
        delta = G.cut(step.join(known, ["node", "fact"], "left_anti"), "facts")
        if delta.isEmpty():
            return known
        known = G.cut(known.unionByName(delta), "facts")
    raise RuntimeError("facts did not settle")


@query(f"with recursive {EDGES}, c as (select source, target from edges union select c.source, edges.target from c join edges on c.target = edges.source), a as (select source, target from c union select s_suppkey, s_suppkey from supplier) select source as node, count(distinct s_acctbal > 0) as effects, min(s_acctbal) as worst from a join supplier on s_suppkey = target group by 1")
def gr20_effect_summaries(t):
    edges = supplier_edges(t)
    found = G.extremes(edges, t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("value")))
    if found is not None:
        # the least and the greatest balance tell which of both signs there are; NaN is the greatest
        good = lambda c: (F.col(c) > 0).cast("int")
        return found.select("node", F.when(F.col("low").isNull(), 0).otherwise(1 + good("high") - good("low")).cast("long").alias("effects"), F.col("low").alias("worst"))
    own = t.supplier.select(F.col("s_suppkey").alias("source"), F.col("s_suppkey").alias("target"))
    all_pairs = G.reachable(edges).unionByName(own).distinct()
    return all_pairs.join(t.supplier, F.col("s_suppkey") == F.col("target")).groupBy(F.col("source").alias("node")).agg(F.countDistinct(F.col("s_acctbal") > 0).alias("effects"), F.min("s_acctbal").alias("worst"))


@query(f"with recursive {EDGES}, r as (select s_suppkey as node, 0 as d from supplier where s_suppkey % 17 = 0 union select target, d + 1 from r join edges on source = node where d < 8) select distinct node from r join supplier on s_suppkey = node where s_acctbal > 5000")
def gr21_taint(t):
    start = seeds(t, "s_suppkey % 17 = 0")
    hit = start.union(G.bfs(supplier_edges(t), start, 8).select("node")).distinct()
    return hit.join(t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("node")), "node", "left_semi")


@query(f"with recursive {EDGES}, r as (select s_suppkey as node, 0 as d, s_suppkey % 7 = 0 as boundary from supplier where s_suppkey <= 3 union select target, d + 1, target % 7 = 0 from r join edges on source = node where d < 24 and not boundary) select node, min(d)::bigint as depth, bool_or(boundary) as boundary from r group by 1")
def gr22_workflow(t):
    """Traversal that keeps boundary nodes but never goes past them."""
    edges = supplier_edges(t).filter("source % 7 <> 0")
    start = seeds(t, "s_suppkey <= 3")
    found = start.withColumn("depth", F.lit(0)).unionByName(G.bfs(edges, start, 24))
    return found.select("node", F.col("depth").cast("long").alias("depth"), (F.col("node") % 7 == 0).alias("boundary"))


@query("select distinct cn.n_regionkey as a, sn.n_regionkey as b from orders join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation sn on s_nationkey = sn.n_nationkey where cn.n_regionkey <> sn.n_regionkey")
def gr23_component_uses(t):
    """Components are regions: which uses which, through orders of customers served by suppliers."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("a"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("b"))
    lines = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("a <> b").select("a", "b").distinct()


@query("select * from (values ('a/b/c.py', 'a/b'), ('a/x.py', 'a'), ('z.py', null), ('ab/x.py', null)) v(path, owner)")
def gr24_longest_prefix_owner(t):
    """The longest owner whose path is a whole-segment prefix: an equi-join on every prefix of a path."""
    from factloom.functions.scalar import directory_chain

    paths = t.spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",), ("ab/x.py",)], "path string")
    owners = t.spark.createDataFrame([("a",), ("a/b",)], "owner string")
    chains = paths.select("path", F.explode_outer(directory_chain(F.col("path"))).alias("owner"))
    best = chains.join(owners, "owner").groupBy("path").agg(F.max_by("owner", F.length("owner")).alias("owner"))
    return paths.join(best, "path", "left")


@query("select n_nationkey as child, n_regionkey = (select n_regionkey from nation where n_nationkey = 3) as rejected from nation where n_nationkey in (3, 4, 5)")
def gr25_cycle_rejection(t):
    """Linking a region below a nation closes a cycle where that nation is below the region."""
    h = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    region = t.nation.filter("n_nationkey = 3").first().n_regionkey
    return t.spark.createDataFrame([(k, G.would_cycle(h, f"n{k}", f"r{region}")) for k in (3, 4, 5)], "child int, rejected boolean")


@query("select distinct node from (select 'n' || c_nationkey as node from customer where c_custkey in (1, 2, 3) union all select 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey where c_custkey in (1, 2, 3))")
def gr26_dirty_ancestors(t):
    h = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    h = h.union(t.customer.filter("c_custkey in (1, 2, 3)").select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
    return G.ancestors(h, 4).filter("node like 'c%' and distance > 0").select(F.col("ancestor").alias("node")).distinct()


@query(
    """select 'r' || r_regionkey as node, 0 as level, 0::bigint as hidden from region union all select 'n' || n_nationkey, 1, 0 from nation
    union all select 'c' || c_custkey, 2, (select count(*) from orders where o_custkey = c_custkey) from customer where c_nationkey in (select n_nationkey from nation)"""
)
def gr27_depth_limited_view(t):
    """Regions, nations and customers, with the orders that a depth of two hides below them."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    levels = [(t.nation, name("r", "n_regionkey"), name("n", "n_nationkey")), (t.customer, name("n", "c_nationkey"), name("c", "c_custkey")), (t.orders, name("c", "o_custkey"), name("o", "o_orderkey"))]
    h = reduce(lambda a, b: a.union(b), [df.select(p.alias("parent"), c.alias("child")) for df, p, c in levels])
    return G.depth_limited(h, t.region.select(name("r", "r_regionkey").alias("node")), 2)



@query(f"with recursive {EDGES}, c as (select source, target from edges union select c.source, edges.target from c join edges on c.target = edges.source) select source, target from c where source % 13 = 0 and target % 13 = 0 and source <> target")
def gr28_lock_order(t):
    """Holders (keys divisible by 13) that reach another holder."""
    return G.reachable(supplier_edges(t), "source % 13 = 0", "target % 13 = 0").filter("source <> target")


@query("select distinct a.l_partkey as variable, a.l_suppkey as writer, b.l_suppkey as other from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_suppkey <> b.l_suppkey where a.l_returnflag = 'R'")
def gr29_interleaving(t):
    a = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("variable"), F.col("l_suppkey").alias("writer")).distinct()
    b = t.lineitem.select(F.col("l_partkey").alias("variable"), F.col("l_suppkey").alias("other")).distinct()
    return a.join(b, "variable").filter("writer <> other")


@query("select r_name, count(distinct n_nationkey) as nations, count(distinct c_custkey) as customers, count(o_orderkey) as orders from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1")
def gr30_hierarchy_projection(t):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("o"))
    c = t.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("o"), F.lit(0)).alias("o"))
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"), F.coalesce(F.sum("o"), F.lit(0)).alias("orders"))


@query("select user_id from events group by 1 having count(*) filter (where event_type = 'view') >= 2 and count(distinct event_type) >= 2 and count(distinct ts::date) >= 2")
def gr31_state_machine_heuristic(t):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.countDistinct("event_type").alias("k"), F.countDistinct(F.to_date("ts")).alias("d"))
    return g.filter("v >= 2 and k >= 2 and d >= 2").select("user_id")


@query("select 'unknown_customer' as violation, count(*) as n from orders where o_custkey not in (select c_custkey from customer) union all select 'negative_total', count(*) from orders where o_totalprice < 0")
def gr32_honesty_audit(t):
    a = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_customer").alias("violation"), "n")
    return a.union(t.orders.agg(F.count_if(F.col("o_totalprice") < 0)).select(F.lit("negative_total"), "*"))


@query("select user_id, row_number() over (partition by user_id order by ts, event_id) as step, event_type from events")
def gr33_transaction_walk(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", F.row_number().over(w).cast("long").alias("step"), "event_type")


@query(
    """with e as (select l_orderkey as trace, l_linenumber as step, l_partkey as edge, bool_and(l_returnflag <> 'R') as idempotent from lineitem group by 1, 2, 3), s as (select trace, step, count(*) as n, min(edge) as a, max(edge) as b from e group by 1, 2)
    select trace, 'crash' as kind, null::bigint as a, null::bigint as b, 1 as size from (select distinct trace from e) union all select trace, 'duplicate', edge, null, 1 from (select distinct trace, edge from e where not idempotent)
    union all select distinct trace, 'drop', a, null, 1 from s where n = 1
    union all select distinct trace, 'drop', a, b, 2 from s where n = 2 and not exists (select 1 from s z where z.trace = s.trace and z.n = 1 and z.a in (s.a, s.b))"""
)
def gr34_fault_hypotheses(t):
    """The least sets of faults that break an order whose lines are steps, each with parts that support it."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("edge"), (F.col("l_returnflag") != "R").alias("idempotent"))
    return G.fault_sets(rows)



@query("select p_brand as container, p_type as component, count(*) as n, min(p_partkey) as first_id from part group by 1, 2")
def gr36_architecture(t):
    return t.part.groupBy(F.col("p_brand").alias("container"), F.col("p_type").alias("component")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


@query("select l.doc_id, 'toxic' as finding, d.source from labels l join documents d using (doc_id) where l.toxic = 1")
def gr37_findings_as_entities(t):
    return t.labels.filter("toxic = 1").join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", F.lit("toxic").alias("finding"), "source")


@query("select n_name as hub, s_name as member from nation join supplier on s_nationkey = n_nationkey where n_regionkey = 1")
def gr38_domain_view(t):
    return t.nation.filter("n_regionkey = 1").join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("hub"), F.col("s_name").alias("member"))
