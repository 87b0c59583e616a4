"""Queries of the retrieval algebra: projections, filters, set operations, traversal, cubes and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.plans import cube as C
from factloom.plans.algebra import All, And, CellContributors, Difference, Follow, Ids, Intersect, Member, Not, Or, Related, Select, Test, Union, compile_query, matching
from factloom.plans.registry import Tables, query
from factloom.sources.catalog import Catalog


def cat(t: Tables) -> Catalog:
    return Catalog(t.spark, t.sf_dir)


def ids(t: Tables, q):
    return compile_query(q, cat(t))


@query("select s_suppkey as id, 'supplier' as entity_kind, s_name as name, s_acctbal as balance from supplier")
def pr1_project_fields(t):
    return cat(t).entities("supplier", ["name", "balance"]).withColumn("entity_kind", F.lit("supplier"))


@query("select n_nationkey as id, 'nation:' || n_nationkey as entity_ref, upper(n_name) as shown from nation")
def pr2_pseudo_fields(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.concat_ws(":", F.lit("nation"), "n_nationkey").alias("entity_ref"), F.upper("n_name").alias("shown"))


@query("select l_orderkey as id, l_linenumber as start_at, l_linenumber + l_quantity as end_at from lineitem where l_quantity >= 49")
def pr3_location_struct(t):
    loc = F.struct(F.col("l_linenumber").alias("start_at"), (F.col("l_linenumber") + F.col("l_quantity")).alias("end_at"))
    return t.lineitem.filter("l_quantity >= 49").select(F.col("l_orderkey").alias("id"), loc.alias("loc")).select("id", "loc.start_at", "loc.end_at")


@query("select o_orderkey as id from orders where o_orderstatus = 'F' and o_totalprice > 300000")
def fi1_select_where(t):
    return ids(t, Select("order", And((Test("status", "eq", "F"), Test("total", "gt", 300000)))))


@query("select r_regionkey::bigint as id from region")
def fi2_select_all(t):
    return ids(t, Select("region", All()))


@query("select c_custkey as id from customer where c_custkey in (1, 5, 9, 77)")
def fi3_select_ids(t):
    return ids(t, Select("customer", Ids((1, 5, 9, 77))))


@query("select p_partkey as id from part where (p_size < 5 or p_brand = 'Brand#11') and not (p_retailprice > 1500)")
def fi4_and_or_not(t):
    return ids(t, Select("part", And((Or((Test("size", "lt", 5), Test("brand", "eq", "Brand#11"))), Not(Test("price", "gt", 1500))))))


@query("select doc_id, lang is null as no_lang from documents where lang is not distinct from 'fr'")
def fi5_null_safe_equality(t):
    return t.documents.filter(F.col("lang").eqNullSafe("fr")).select("doc_id", F.col("lang").isNull().alias("no_lang"))


@query("select c_custkey as id from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def fi6_in(t):
    return ids(t, Select("customer", Test("segment", "in", ("BUILDING", "MACHINERY", None))))


@query("select p_partkey as id from part where p_type like 'S%' or contains(p_name, '7')")
def fi7_prefix_contains(t):
    return ids(t, Select("part", Or((Test("type", "prefix", "S"), Test("name", "contains", "7")))))


@query("select n_nationkey::bigint as id from nation where lower(n_name) like 'nation%' or contains(lower(n_name), 'an')")
def fi8_case_fold(t):
    return ids(t, Select("nation", Or((Test("name", "prefix_fold", "NAtion"), Test("name", "contains_fold", "AN")))))


@query("select s_suppkey as id from supplier where s_acctbal >= 0 and s_acctbal < 5000")
def fi9_numeric_compare(t):
    return ids(t, Select("supplier", And((Test("balance", "ge", 0, strict=True), Test("balance", "lt", 5000, strict=True)))))


@query("select o_orderkey as id from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey in (1, 2)")
def fi10_concept_membership(t):
    return ids(t, Select("order", Member("region", (1, 2), descendants=True)))


@query("select n_nationkey::bigint as id from nation where n_regionkey in (0, 3)")
def fi10_direct_membership(t):
    return ids(t, Select("nation", Member("region", (0, 3))))


@query("select distinct o_orderkey as id from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where p_size = 50")
def fi11_related_any(t):
    return ids(t, Select("order", Related("contains", Select("part", Test("size", "eq", 50)))))


@query("select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def fi12_related_none(t):
    return ids(t, Select("customer", Related("placed_by", Select("order", Test("total", "gt", 200000)), "none", incoming=True)))


@query(
    """with goal as (select n_nationkey from nation where n_nationkey in (1, 2, 3)), e as (select distinct n_regionkey as r, n_nationkey as n from nation)
    select r::bigint as id from e join goal on n = n_nationkey group by r having count(distinct n) = (select count(*) from goal)
    union select s::bigint from (select l_suppkey as s, p from (select distinct l_suppkey, l_partkey as p from lineitem) where p in (1, 2)) group by s having count(distinct p) = 2"""
)
def fi13_related_all(t):
    regions = ids(t, Select("region", Related("in_region", Select("nation", Ids((1, 2, 3))), "all", incoming=True)))
    suppliers = ids(t, Select("supplier", Related("supplies", Select("part", Ids((1, 2))), "all")))
    return regions.union(suppliers).distinct()


@query(
    """select p_partkey, p_size > 25 as big, p_retailprice < 1200 as cheap, p_type = 'STEEL' as steel,
      case when not (p_size > 25) then 'size' when not (p_retailprice < 1200) then 'price' when not p_type = 'STEEL' then 'type' end as first_failing,
      p_size > 25 and p_retailprice < 1200 and p_type <> 'STEEL' as suspected_gap from part"""
)
def fi14_explained_conditions(t):
    """All of three conditions, with the first that fails and rows that only the last excludes."""
    big, cheap, steel = F.col("p_size") > 25, F.col("p_retailprice") < 1200, F.col("p_type") == "STEEL"
    why = F.when(~big, "size").when(~cheap, "price").when(~steel, "type")
    return t.part.select("p_partkey", big.alias("big"), cheap.alias("cheap"), steel.alias("steel"), why.alias("first_failing"), (big & cheap & ~steel).alias("suspected_gap"))


@query(
    """with u as (select count(*) as n from customer), s as (select count(*) as n from customer where c_custkey <= 100), m as (select count(*) as n from customer where c_custkey <= 100 and c_acctbal > 0)
    select m.n as matched, s.n - m.n as unmatched, u.n - m.n as outside, case when s.n = 0 then 'empty selection' end as reason from u, s, m"""
)
def fi15_scoped_answer(t):
    chosen, rich = F.col("c_custkey") <= 100, F.col("c_acctbal") > 0
    n = t.customer.agg(F.count_if(chosen & rich).alias("matched"), F.count_if(chosen).alias("chosen"), F.count(F.lit(1)).alias("universe"))
    return n.select("matched", (F.col("chosen") - F.col("matched")).alias("unmatched"), (F.col("universe") - F.col("matched")).alias("outside"), F.when(F.col("chosen") == 0, F.lit("empty selection")).alias("reason"))


@query(
    r"""select path, case when path like '/%' or contains(path, '\') or list_contains(string_split(path, '/'), '..') then null
      else array_to_string(list_filter(string_split(path, '/'), lambda x: x not in ('', '.')), '/') end as clean
    from (values ('a/b'), ('/etc'), ('a/../b'), ('./x//y'), ('c\d')) v(path)"""
)
def fi16_normalise_path(t):
    rows = t.spark.createDataFrame([(p,) for p in ("a/b", "/etc", "a/../b", "./x//y", "c\\d")], "path string")
    parts = F.split("path", "/")
    bad = F.col("path").startswith("/") | F.col("path").contains("\\") | F.array_contains(parts, "..")
    return rows.select("path", F.when(~bad, F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/")).alias("clean"))


@query("select case when count(*) = 0 then 'none' when count(*) = 1 then 'unique' else 'ambiguous' end as verdict, count(*) as n from nation where n_regionkey = 1 and n_nationkey < 10")
def fi17_focus_chain(t):
    n = t.nation.filter("n_regionkey = 1").filter("n_nationkey < 10").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("verdict"), "n")


@query("select event_type, count(*) as n from events where case when 'event_type' in ('event_type', 'user_id') then user_id < 50 else true end group by event_type")
def fi18_cross_filter(t):
    applies = {"events": ("event_type", "user_id"), "orders": ("o_orderstatus",)}
    rows = t.events.filter("user_id < 50") if "event_type" in applies["events"] else t.events
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) filter (where source <> 'src0') as shown, count(*) filter (where source = 'src0') as hidden from documents")
def fi19_visibility(t):
    return t.documents.agg(F.count_if(F.col("source") != "src0").alias("shown"), F.count_if(F.col("source") == "src0").alias("hidden"))


@query("select page_id, regexp_matches(url, '(^|[/.])(m|www)\\.|\\?|#') as excluded from pages")
def fi20_path_exclusion(t):
    return t.pages.select("page_id", F.col("url").rlike(r"(^|[/.])(m|www)\.|\?|#").alias("excluded"))


@query("select p_partkey as id from part where p_size < 3 union select p_partkey from part where p_retailprice > 1900")
def se1_union(t):
    return ids(t, Union((Select("part", Test("size", "lt", 3)), Select("part", Test("price", "gt", 1900)))))


@query("select p_partkey as id from part where p_size < 20 intersect select p_partkey from part where p_retailprice > 1000")
def se2_intersect(t):
    return ids(t, Intersect((Select("part", Test("size", "lt", 20)), Select("part", Test("price", "gt", 1000)))))


@query("select c_custkey as id from customer where c_acctbal > 0 except select c_custkey from customer where c_mktsegment = 'BUILDING'")
def se3_difference(t):
    return ids(t, Difference(Select("customer", Test("balance", "gt", 0)), Select("customer", Test("segment", "eq", "BUILDING"))))


@query("select name from (select c_name as name from customer where c_nationkey = 3 union select s_name from supplier where s_nationkey = 3) order by name limit 51")
def se5_union_order_limit(t):
    both = t.customer.filter("c_nationkey = 3").select(F.col("c_name").alias("name")).union(t.supplier.filter("s_nationkey = 3").select("s_name"))
    return both.distinct().orderBy("name").limit(51)


@query(
    """with s as (select l_suppkey, list(distinct l_partkey) as parts from lineitem where l_suppkey in (1, 2) group by 1)
    select len(list_intersect(a.parts, b.parts))::bigint as shared, (len(a.parts) - len(list_intersect(a.parts, b.parts)))::bigint as only_a,
      len(list_intersect(a.parts, b.parts)) = len(a.parts) and len(a.parts) = len(b.parts) as duplicate from s a, s b where a.l_suppkey = 1 and b.l_suppkey = 2"""
)
def se6_reuse_verdict(t):
    sets = t.lineitem.filter("l_suppkey in (1, 2)").groupBy().agg(*(F.collect_set(F.when(F.col("l_suppkey") == k, F.col("l_partkey"))).alias(n) for k, n in ((1, "a"), (2, "b"))))
    shared = F.size(F.array_intersect("a", "b"))
    return sets.select(shared.cast("long").alias("shared"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"), ((shared == F.size("a")) & (F.size("a") == F.size("b"))).alias("duplicate"))


@query(
    """with a as (select event_type as flag, count(*) as v from events where user_id = 3 group by 1), b as (select event_type as flag, count(*) as v from events where user_id = 4 group by 1)
    select coalesce(a.flag, b.flag) as flag, a.v as a_value, b.v as b_value, case when a.v is null then 'only_b' when b.v is null then 'only_a' when a.v = b.v then 'same' else 'changed' end as status from a full join b on a.flag = b.flag"""
)
def se7_environment_diff(t):
    side = lambda k, n: t.events.filter(F.col("user_id") == k).groupBy(F.col("event_type").alias("flag")).agg(F.count(F.lit(1)).alias(n))
    both = side(3, "a_value").join(side(4, "b_value"), "flag", "full")
    a, b = F.col("a_value"), F.col("b_value")
    return both.withColumn("status", F.when(a.isNull(), "only_b").when(b.isNull(), "only_a").when(a == b, "same").otherwise("changed"))


@query("select o_orderkey as id from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' and c_mktsegment = 'BUILDING' and o_totalprice > 1000")
def se8_cell_contributors(t):
    population = Select("order", Test("total", "gt", 1000))
    return ids(t, CellContributors(population, (("status", "P"), ("placed_by/segment", "BUILDING"))))


@query("select distinct c_custkey as id from customer join orders on o_custkey = c_custkey where o_totalprice > 400000")
def gr1_follow(t):
    return ids(t, Follow(Select("order", Test("total", "gt", 400000)), "placed_by"))


MEASURES = (C.Measure("n"), C.Measure("total", "sum", "total"), C.Measure("low", "min", "total"), C.Measure("high", "max", "total"))


@query(
    """select c_mktsegment as segment, p_type as part_type, count(*) as n from (select distinct o_orderkey, c_mktsegment, p_type from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey) group by 1, 2"""
)
def ag1_cube_multi_valued(t):
    """Orders by customer segment and by every part type they contain: an order counts once in a cell."""
    return C.cells(cat(t), "order", ids(t, Select("order")), C.Cube({"segment": "placed_by/segment", "part_type": "contains/type"}, (C.Measure("n"),)))


@query("select o_orderstatus as status, count(*) as n, round(sum(o_totalprice), 2) as total, min(o_totalprice) as low, max(o_totalprice) as high, round(avg(o_totalprice), 4) as mean from orders group by 1")
def ag2_measures(t):
    out = C.cells(cat(t), "order", ids(t, Select("order")), C.Cube({"status": "status"}, (*MEASURES, C.Measure("mean", "avg", "total"))))
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("select p_brand as brand, p_type as type, count(*) as n from part group by 1, 2 having count(*) > 3 and not (count(*) = 5)")
def ag3_having(t):
    n = F.col("n")
    return C.cells(cat(t), "part", ids(t, Select("part")), C.Cube({"brand": "brand", "type": "type"}, (C.Measure("n"),), having=(n > 3) & ~(n == 5)))


@query("select 'grand' as scope, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice > 1000 union all select 'page', count(*), round(sum(o_totalprice), 2) from orders where o_totalprice > 1000 and o_orderstatus in ('F', 'O')")
def ag4_totals(t):
    population = ids(t, Select("order", Test("total", "gt", 1000)))
    cube = C.Cube({"status": "status"}, MEASURES[:2], having=F.col("status").isin("F", "O"))
    grand = C.grand_totals(cat(t), "order", population, cube).select(F.lit("grand").alias("scope"), "n", F.round("total", 2).alias("total"))
    page = C.page_totals(cat(t), "order", population, cube).select(F.lit("page").alias("scope"), "n", F.round("total", 2).alias("total"))
    return grand.unionByName(page)


@query("select * from (values ('n', 'non_additive'), ('total', 'additive'), ('low', 'semi_additive'), ('high', 'semi_additive')) v(measure, additivity)")
def ag5_additivity(t):
    return t.spark.createDataFrame([(m.name, m.additivity) for m in MEASURES], "measure string, additivity string")


@query(
    """select 'status' as dimension, true as disjoint, true as complete union all
    select 'part_type', (select count(*) = count(distinct l_orderkey) from (select distinct l_orderkey, p_type from lineitem join part on l_partkey = p_partkey where l_orderkey in (select o_orderkey from orders))),
      (select count(distinct l_orderkey) from lineitem where l_orderkey in (select o_orderkey from orders)) = (select count(*) from orders)"""
)
def ag6_partition_check(t):
    everyone = ids(t, Select("order"))
    check = lambda n, d: C.is_partition(cat(t), "order", everyone, C.Cube({n: d}, (C.Measure("n"),))).withColumn("dimension", F.lit(n))
    return check("status", "status").unionByName(check("part_type", "contains/type"))


@query("select p_type as type, count(*) filter (where p_brand = 'Brand#11') as b11, count(*) filter (where p_brand = 'Brand#12') as b12, count(*) filter (where p_brand = 'Brand#13') as b13 from part group by 1")
def ag7_pivot(t):
    out = t.part.groupBy(F.col("p_type").alias("type")).pivot("p_brand", ["Brand#11", "Brand#12", "Brand#13"]).agg(F.count(F.lit(1)))
    return out.select("type", *(F.coalesce(F.col(f"`Brand#{k}`"), F.lit(0)).alias(f"b{k}") for k in (11, 12, 13)))


@query(
    """select 'brand' as dimension, p_brand as member, count(*) as n from part where p_type = 'STEEL' group by 2
    union all select 'type', p_type, count(*) from part where p_brand = 'Brand#13' group by 2"""
)
def ag8_self_excluding_facets(t):
    by_brand, by_type = Test("brand", "eq", "Brand#13"), Test("type", "eq", "STEEL")
    c = cat(t)
    return C.facets(c, "part", {"brand": matching(by_type, c, "part"), "type": matching(by_brand, c, "part")}, {"brand": "brand", "type": "type"})


@query(
    """select case when p_retailprice < 1000 then '<1000' when p_retailprice < 1500 then '[1000,1500)' else '>=1500' end as price_band, count(*) as n from part group by 1"""
)
def fn2_numeric_buckets(t):
    cube = C.Cube({"price_band": "price"}, (C.Measure("n"),), buckets={"price_band": lambda c: S.bucket_label(c, [1000, 1500])})
    return C.cells(cat(t), "part", ids(t, Select("part")), cube)


@query("select p_brand as brand, p_type as type, count(*) as n, round(sum(p_retailprice), 2) as total from part group by 1, 2 order by n desc, brand, type limit 7")
def or2_cube_order(t):
    cube = C.Cube({"brand": "brand", "type": "type"}, (C.Measure("n"), C.Measure("total", "sum", "price")), order=(F.desc_nulls_first("n"), F.asc("brand"), F.asc("type")), limit=7)
    return C.cells(cat(t), "part", ids(t, Select("part")), cube).withColumn("total", F.round("total", 2))
