"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import joins as J
from factloom.plans.registry import query
from factloom.sources.catalog import Catalog


@query("select o_orderkey, c_name, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_totalprice > 350000")
def jn1_star_join(t):
    out = t.orders.filter("o_totalprice > 350000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("select c_custkey, o_orderkey, l_linenumber from customer left join (select * from orders where o_totalprice > 300000) on o_custkey = c_custkey left join (select * from lineitem where l_linenumber = 1) on l_orderkey = o_orderkey")
def jn2_left_outer_chain(t):
    orders = t.orders.filter("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    lines = t.lineitem.filter("l_linenumber = 1").select("l_orderkey", "l_linenumber")
    out = t.customer.select("c_custkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("c_custkey", "o_orderkey", "l_linenumber")


@query("select d.doc_id, coalesce(l.quality, -1) as quality, l.doc_id is null as unlabelled from documents d left join labels l using (doc_id)")
def jn3_left_lookup(t):
    out = t.documents.select("doc_id").join(t.labels.withColumn("_there", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("_there").isNull().alias("unlabelled"))


@query("select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def jn4_semi(t):
    return t.supplier.join(t.nation.filter("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("select n_nationkey, 'new' as origin from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey) union all select distinct s_nationkey, 'old' from supplier")
def jn5_insert_if_absent(t):
    old = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.lit("old").alias("origin")).distinct()
    return t.nation.select("n_nationkey", F.lit("new").alias("origin")).join(old, "n_nationkey", "left_anti").unionByName(old)


ALLOWED = (("view", "click"), ("click", "purchase"), ("view", "view"), ("signup", "view"))


@query(
    """with e as (select user_id, event_type as child, lag(event_type) over (partition by user_id order by ts, event_id) as parent from events)
    select parent, child, count(*) as n from e where parent is not null and (parent, child) not in (('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('signup', 'view')) group by 1, 2"""
)
def jn6_drift_pairs(t):
    """Observed parent and child events without an allowed transition."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = t.events.select(F.lag("event_type").over(w).alias("parent"), F.col("event_type").alias("child")).filter("parent is not null")
    counts = pairs.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(t.spark.createDataFrame(ALLOWED, "parent string, child string"), ["parent", "child"], "left_anti")


@query("select distinct o_orderkey, s_suppkey from orders join supplier on o_custkey = s_suppkey or o_custkey = s_suppkey + 100 where o_totalprice > 300000")
def jn7_or_equi(t):
    big = t.orders.filter("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return J.either_key(big, t.supplier.select("s_suppkey"), "o_custkey", [F.col("s_suppkey"), F.col("s_suppkey") + 100]).select("o_orderkey", "s_suppkey")


@query("select page_id, (select min(lang) from (values ('/de/'), ('/en/'), ('/es/'), ('/fr/')) v(lang) where contains(url, lang)) as route from pages")
def jn8_containment_first(t):
    routes = t.spark.createDataFrame([(r, r) for r in ("/de/", "/en/", "/es/", "/fr/")], "route string, rank string")
    return J.contained_first(t.pages.select("page_id", "url"), routes, "url", "route", "rank").select("page_id", "route")


@query(
    """with s as (select l_suppkey as g, l_orderkey as a, l_orderkey + (l_quantity * 10)::bigint as z from lineitem where l_linenumber = 1), p as (select distinct l_suppkey as g, l_orderkey + 3 as x from lineitem where l_linenumber = 2),
    m as (select g, x, a, z, row_number() over (partition by g, x order by z - a, a) as k from p join s using (g) where a <= x and x < z)
    select g, x, a, z from m where k = 1"""
)
def jn9_point_in_span(t):
    line = t.lineitem.withColumn("g", F.col("l_suppkey"))
    spans = line.filter("l_linenumber = 1").select("g", F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + (F.col("l_quantity") * 10).cast("long")).alias("z"))
    points = line.filter("l_linenumber = 2").select("g", (F.col("l_orderkey") + 3).alias("x")).distinct()
    return J.point_in_span(points, spans.distinct(), "g", "x", "a", "z", 256)


@query(
    """with a as (select distinct l_suppkey as g, l_orderkey as a_start, l_orderkey + 40 as a_end from lineitem where l_linenumber = 1), b as (select distinct l_suppkey as g, l_orderkey as b_start, l_orderkey + 25 as b_end from lineitem where l_linenumber = 5)
    select g, a_start, b_start from a join b using (g) where a_start < b_end and b_start < a_end"""
)
def jn10_interval_overlap(t):
    side = lambda n, p, size: t.lineitem.filter(F.col("l_linenumber") == n).select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias(f"{p}_start"), (F.col("l_orderkey") + size).alias(f"{p}_end")).distinct()
    return J.overlapping(side(1, "a", 40), side(5, "b", 25), "g", 128).select("g", "a_start", "b_start")


@query("select distinct a.l_orderkey, a.l_partkey, a.l_suppkey from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey where a.l_linenumber < b.l_linenumber or a.l_quantity = 50")
def jn11_composite_identity(t):
    a = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    b = a.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("other"))
    return a.join(b, ["l_orderkey", "l_partkey", "l_suppkey"]).filter("l_linenumber < other or l_quantity = 50").select("l_orderkey", "l_partkey", "l_suppkey").distinct()


@query("with h as (select sha256(text) as h, min(doc_id) as first_id, count(*) as n from documents group by 1 having count(*) > 1) select d.doc_id, first_id, n from documents d join h on sha256(d.text) = h.h where d.doc_id <> first_id")
def jn12_hash_classes(t):
    """Exact duplicates as (copy, class) rather than all pairs: a class of n copies gives n - 1 rows."""
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    classes = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(classes, "h").filter("doc_id <> first_id").select("doc_id", "first_id", "n")


PAIRS = """with s as (select distinct l_orderkey as c, l_partkey as p from lineitem), k as (select c from s group by c having count(*) between 2 and 8)
    select a.p as a, b.p as b, count(*) as support from s a join s b on a.c = b.c and a.p < b.p where a.c in (select c from k) group by 1, 2"""


@query(f"select * from ({PAIRS}) where support > 1")
def jn13_cochange_pairs(t):
    """Pairs of parts in one order, orders of more than 8 parts excluded as bulk, so a group gives at most 28 pairs."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("p")).distinct()
    small = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n between 2 and 8")
    rows = rows.join(small.select("c"), "c", "left_semi")
    pairs = rows.select("c", F.col("p").alias("a")).join(rows.select("c", F.col("p").alias("b")), "c").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).filter("support > 1")


@query("select a.p_type as a, b.p_type as b, count(*) as excluded from part a join part b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey and a.p_type <> b.p_type where a.p_size = b.p_size group by 1, 2")
def jn14_exclusion_counts(t):
    """Counts of pairs by kind from the sizes of groups: no pair is made."""
    n = t.part.groupBy("p_brand", "p_size", "p_type").agg(F.sort_array(F.collect_list("p_partkey")).alias("ids"))
    both = n.select("p_brand", "p_size", F.col("p_type").alias("a"), F.col("ids").alias("x")).join(n.select("p_brand", "p_size", F.col("p_type").alias("b"), F.col("ids").alias("y")), ["p_brand", "p_size"]).filter("a <> b")
    # of each id of x, how many of y are larger
    larger = F.aggregate("x", F.lit(0).cast("long"), lambda s, k: s + F.size(F.filter("y", lambda m: m > k)))
    return both.groupBy("a", "b").agg(F.sum(larger).alias("excluded")).filter("excluded > 0")


@query("select l_orderkey, l_linenumber, n_name from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_quantity > 48")
def jn15_lookup_join(t):
    """Dimension lookups: Catalyst broadcasts a side only where its size allows."""
    out = t.lineitem.filter("l_quantity > 48").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.select("l_orderkey", "l_linenumber", "n_name")


@query(
    """select c_custkey, count(e.event_id) as hits, coalesce(sum(e.value), 0) > 0 as seen,
      case when count(e.event_id) = 0 then 'unknown' when bool_and(e.event_type = 'view') then 'exact' else 'partial' end as label
    from customer left join events e on e.user_id = c_custkey group by c_custkey"""
)
def jn16_structure_with_runtime(t):
    events = t.events.select("user_id", "event_id", "event_type", "value")
    out = t.customer.join(events, F.col("user_id") == F.col("c_custkey"), "left").groupBy("c_custkey")
    label = F.when(F.count("event_id") == 0, "unknown").when(F.bool_and(F.col("event_type") == "view"), "exact").otherwise("partial")
    return out.agg(F.count("event_id").alias("hits"), (F.coalesce(F.sum("value"), F.lit(0)) > 0).alias("seen"), label.alias("label"))


@query("select p_name, min(p_partkey) as first_id from part group by p_name union all select p_brand || p_size, min(p_partkey) from part group by 1 having count(distinct p_partkey) = 1")
def jn17_name_resolution(t):
    first = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("first_id"))
    named = t.part.select(F.concat("p_brand", "p_size").alias("p_name"), F.col("p_partkey").alias("first_id"))
    return first.unionByName(J.unique_names(named, "p_name", "first_id"))


@query(
    """with v as (select brand, unnest([brand, lower(brand), replace(brand, '#', '-')]) as variant from (values ('Brand#11'), ('Brand#23')) x(brand)),
    m as (select 'Brand#11' as used union all select 'brand#23.core' union all select 'Brand-11.x' union all select 'Brand#1')
    select distinct used, brand from m join v on used = variant or starts_with(used, variant || '.')"""
)
def jn18_variant_usage(t):
    """Usages match a name's variants exactly or up to a dot: an equi-join on the part before the dot, then a check."""
    names = t.spark.createDataFrame([("Brand#11",), ("Brand#23",)], "brand string")
    variants = names.select("brand", F.explode(F.array("brand", F.lower("brand"), F.replace("brand", F.lit("#"), F.lit("-")))).alias("variant"))
    used = t.spark.createDataFrame([("Brand#11",), ("brand#23.core",), ("Brand-11.x",), ("Brand#1",)], "used string")
    out = used.withColumn("variant", F.substring_index("used", ".", 1)).join(variants, "variant")
    return out.select("used", "brand").distinct()


@query(
    """with w as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) as w from benchmark), d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) as w from documents),
    n as (select item_id, count(*) as n from w group by 1)
    select item_id, doc_id, count(*) as hits, round(count(*) / max(n), 4) as score from w join d using (w) join n using (item_id) group by 1, 2 having count(*) / max(n) >= 0.28"""
)
def jn19_token_mapping(t):
    """Items mapped to documents by shared words over an inverted index, score at least 0.28."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{6,})"))))
    w = t.benchmark.select("item_id", words("text").alias("w"))
    n = w.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hits = w.join(t.documents.select("doc_id", words("text").alias("w")), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    score = F.col("hits") / F.col("n")
    return hits.join(n, "item_id").filter(score >= 0.28).select("item_id", "doc_id", "hits", F.round(score, 4).alias("score"))


@query(
    """with q as (select o_orderkey, o_custkey as k, o_orderdate as at from orders where o_totalprice > 200000), r as (select o_custkey as k, o_orderdate as rev, max(o_totalprice) as price from orders where o_orderstatus = 'F' group by 1, 2)
    select o_orderkey, price from q asof left join r on q.k = r.k and q.at >= r.rev"""
)
def jn20_as_of(t):
    asked = t.orders.filter("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"))
    known = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("rev"), F.col("o_totalprice").alias("price"))
    return J.as_of(asked, known, "k", "at", "rev", "price").select("o_orderkey", "price")


@query("select distinct r_name, p_brand from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where p_size = 10")
def jn21_relation_path(t):
    c = Catalog(t.spark, t.sf_dir)
    path = c.edges("in_region", True).select(F.col("source").alias("r"), F.col("target").alias("n"))
    path = path.join(c.edges("supplier_in", True).select(F.col("source").alias("n"), F.col("target").alias("s")), "n")
    path = path.join(c.edges("supplies").select(F.col("source").alias("s"), F.col("target").alias("p")), "s")
    path = path.join(c.entities("part", ["brand", "size"]).filter("size = 10"), F.col("p") == F.col("id")).select("r", F.col("brand").alias("p_brand")).distinct()
    return path.join(c.entities("region", ["name"]), F.col("r") == F.col("id")).select(F.col("name").alias("r_name"), "p_brand")


@query("select coalesce(a.n_nationkey, b.s_nationkey) as nation, a.n_name, b.n as suppliers from nation a full join (select s_nationkey, count(*) as n from supplier group by 1) b on a.n_nationkey = b.s_nationkey")
def ext_full_outer(t):
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return t.nation.select(F.col("n_nationkey").alias("nation"), "n_name").join(b, "nation", "full")
