"""Queries of sources, stores, requests, views, extension points and streaming."""

from __future__ import annotations

import json
from pyspark.sql import functions as F

from factloom.functions.diff import line_diff
from factloom.operators import revision as R
from factloom.plans import request as Q
from factloom.plans.algebra import Follow, InvalidQuery, Select, Test, Union, kinds_of
from factloom.plans.cube import Cube, Measure
from factloom.plans.registry import query
from factloom.sources.catalog import KINDS, RELATIONS, Catalog, UnknownName
from factloom.sources.files import walk
from factloom.sources.kv import KeyValue
from factloom.sources.revisions import RevisionStore
from factloom.sources.scratch import cut, scratch_path


def cat(t) -> Catalog:
    return Catalog(t.spark, t.sf_dir)


@query("select * from (values (6, null, 6)) v(files, skipped, readable)")
def sc1_repository_walk(t):
    """Walk of a tree of text files written here: nothing is skipped, and nothing is dropped silently."""
    root = scratch_path(t.spark, "tree")
    for k in range(2):
        t.nation.selectExpr("n_name").repartition(3).write.text(f"{root}/d{k}")
    found = walk(t.spark, root).filter(F.col("path").rlike(r"part-[^/]*\.txt$"))
    return found.agg(F.count(F.lit(1)).cast("int").alias("files"), F.max("skipped").alias("skipped"), F.count("content").cast("int").alias("readable"))


@query("select event_id, case when event_id % 10 = 3 then null else (props->>'k')::bigint end as k, event_id % 10 = 3 as failed from events")
def sc3_parse_with_isolation(t):
    """Parsing in Python by Arrow batches; a row that can't be parsed becomes an error row."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.col("props")).alias("props"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p in pdf["props"]:
                try:
                    out.append((json.loads(p)["k"], False))
                except ValueError:
                    out.append((None, True))
            yield pd.DataFrame({"event_id": pdf["event_id"], "k": pd.array([k for k, _ in out], "Int64"), "failed": [f for _, f in out]})

    return rows.mapInPandas(run, "event_id long, k long, failed boolean")


@query("select doc_id, doc_id % 6 = 0 as recomputed from documents")
def sc4_reuse_by_hash(t):
    """Only rows whose (id, hash) isn't cached are computed again."""
    h = F.sha2("text", 256)
    cache = t.documents.select("doc_id", F.when(F.col("doc_id") % 6 == 0, "stale").otherwise(h).alias("h"), F.lit(True).alias("cached"))
    return t.documents.select("doc_id", h.alias("h")).join(cache, ["doc_id", "h"], "left").select("doc_id", F.col("cached").isNull().alias("recomputed"))


@query("""select '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as json from region order by r_regionkey limit 100000""")
def sc5_table_scan_json(t):
    return t.region.orderBy("r_regionkey").limit(100_000).select(F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))


@query("select doc_id, n_chars from documents where doc_id = 42")
def sc6_point_lookup(t):
    return t.documents.filter("doc_id = 42").select("doc_id", "n_chars")


@query("select p_partkey, p_name from part where p_brand = 'Brand#11' order by p_partkey limit 5 offset 3")
def sc7_parameterised_scan(t):
    t.part.createOrReplaceTempView("part_scan")
    return t.spark.sql("select p_partkey, p_name from part_scan where p_brand = :brand order by p_partkey limit 5 offset 3", args={"brand": "Brand#11"})


@query(
    """select 'entity' as what, 'customer' as name, count(*) as n from customer union all select 'entity', 'nation', count(*) from nation union all select 'entity', 'order', count(*) from orders union all select 'entity', 'part', count(*) from part
    union all select 'entity', 'region', count(*) from region union all select 'entity', 'supplier', count(*) from supplier union all select 'edge', 'in_region', count(*) from nation join region on n_regionkey = r_regionkey
    union all select 'edge', 'placed_by', count(*) from orders join customer on o_custkey = c_custkey"""
)
def sc8_assemble_dataset(t):
    """All entities of every kind and edges of two relations, orphans removed by two semi-joins each."""
    c = cat(t)
    entities = None
    for kind in sorted(KINDS):
        part = c.entities(kind, []).select(F.lit("entity").alias("what"), F.lit(kind).alias("name"))
        entities = part if entities is None else entities.unionByName(part)
    for relation in ("in_region", "placed_by"):
        a, b = RELATIONS[relation][:2]
        e = c.edges(relation).join(c.entities(a, []).withColumnRenamed("id", "source"), "source", "left_semi").join(c.entities(b, []).withColumnRenamed("id", "target"), "target", "left_semi")
        entities = entities.unionByName(e.select(F.lit("edge").alias("what"), F.lit(relation).alias("name")))
    return entities.groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from nation")
def sc9_unused_branches(t):
    """A union of kinds of which one is asked for: the optimiser drops the others before any scan."""
    c = cat(t)
    both = c.entities("nation", []).withColumn("kind", F.lit("nation")).unionByName(c.entities("order", []).withColumn("kind", F.lit("order")))
    return both.filter("kind = 'nation'").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, sum(length(text))::bigint as chars from documents")
def sc10_compressed_cache(t):
    path = scratch_path(t.spark, "cache")
    t.documents.select("doc_id", "text").write.option("compression", "zstd").parquet(path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select c_name as key, case when c_custkey % 5 = 0 then 'new' else c_mktsegment end as value from customer where c_name like 'Customer#00000001%' and c_custkey % 7 <> 0")
def sc12_key_value(t):
    first = t.customer.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(1).alias("seq"))
    patch = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_name").alias("key"), F.lit("new").alias("value"), F.lit(2).alias("seq"))
    gone = t.customer.filter("c_custkey % 7 = 0").select(F.col("c_name").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(3).alias("seq"))
    return KeyValue(first).put(patch).put(gone).prefix("Customer#00000001")


@query("select p_type, count(*) as n, min(p_partkey) as first_id from part group by 1")
def sc13_typed_tables(t):
    """A table by hash and one by id, read back from the shared folder."""
    by_hash = cut(t.part.select("p_type", "p_partkey"), "typed")
    return by_hash.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


@query("select range as id, range % 7 as kind from range(1000)")
def sc18_synthetic_rows(t):
    return t.spark.range(1000).select("id", (F.col("id") % 7).alias("kind"))


@query("select n_name from nation")
def sk3_artifacts(t):
    store = RevisionStore.temporary(t.spark)
    store.publish(t.nation.select("n_name"), "artifact", 7)
    return store.read("artifact", 7)


@query("select count(*) as n from orders where o_orderstatus = 'O'")
def sk6_snapshot_at(t):
    store = RevisionStore.temporary(t.spark)
    for rev, status in ((10, "F"), (20, "O"), (30, "P")):
        store.publish(t.orders.filter(F.col("o_orderstatus") == status).select("o_orderkey"), "orders", rev)
    return store.read("orders", 25).agg(F.count(F.lit(1)).alias("n"))


@query("select * from (values ('union of one kind', 'part'), ('union of two', 'invalid'), ('depth 0', 'invalid'), ('follow', 'customer'), ('no such relation', 'unknown')) v(query, outcome)")
def se4_kind_inference(t):
    cases = {
        "union of one kind": lambda: kinds_of(Union((Select("part"), Select("part", Test("size", "eq", 1))))), "union of two": lambda: kinds_of(Union((Select("part"), Select("order")))),
        "depth 0": lambda: kinds_of(Follow(Select("order"), "placed_by", min_depth=0)), "follow": lambda: kinds_of(Follow(Select("order"), "placed_by")), "no such relation": lambda: kinds_of(Follow(Select("order"), "owns")),
    }
    out = []
    for name, case in cases.items():
        try:
            out.append((name, ",".join(sorted(case()))))
        except UnknownName:
            out.append((name, "unknown"))
        except InvalidQuery:
            out.append((name, "invalid"))
    return t.spark.createDataFrame(out, "query string, outcome string")


@query("select * from (values (1, '=a' || chr(10) || '-b' || chr(10) || '+x' || chr(10) || '=c'), (2, '=same')) v(id, script)")
def fn25_line_diff(t):
    rows = t.spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, "same", "same")], "id int, old string, new string")
    return rows.select("id", line_diff(F.col("old"), F.col("new")).alias("script"))


@query("select n_nationkey::bigint as id, n_name as name from nation where n_regionkey = 2 or n_name like 'A%'")
def ou9_tool_request(t):
    r = Q.Request(cat(t), {"select": "nation", "where": {"or": [{"related": {"relation": "in_region", "target": {"select": "region", "where": {"ids": [2]}}}}, {"field": "name", "op": "prefix", "value": "A"}]}})
    return r.entities(["name"])


SUPPLIERS = {"select": "supplier", "where": {"field": "balance", "op": "gt", "value": 5000}}


@query("select s_suppkey as source, s_nationkey::bigint as target from supplier where s_acctbal > 5000")
def ou1_relationships(t):
    return Q.Request(cat(t), SUPPLIERS).relationships("supplier_in")


@query("select s_suppkey as id, 'supplier' as source_table, 's_suppkey=' || s_suppkey as locator from supplier where s_acctbal > 5000")
def ou2_evidence(t):
    return Q.Request(cat(t), SUPPLIERS).evidence()


@query("select n_name as nation, count(*) as n from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 5000 group by 1")
def ou1_cube(t):
    return Q.Request(cat(t), SUPPLIERS).cube(Cube({"nation": "supplier_in/name"}, (Measure("n"),)))


@query("select 'nation' as dimension, n_name as member, count(*) as n from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 5000 group by 2")
def ou1_facets(t):
    return Q.Request(cat(t), SUPPLIERS).facets({"nation": "supplier_in/name"})


@query("select l_orderkey as function_id, l_linenumber as block, count(*) as instructions, string_agg(l_returnflag, '' order by l_partkey, l_returnflag) as ops from lineitem group by 1, 2")
def ou4_ir_detail(t):
    ops = F.sort_array(F.collect_list(F.struct("l_partkey", "l_returnflag")))
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("block"))
    return g.agg(F.count(F.lit(1)).alias("instructions"), F.array_join(F.transform(ops, lambda o: o["l_returnflag"]), "").alias("ops"))


@query("select * from (values (1, 5), (2, 5)) v(call, n)")
def ou5_get_or_build(t):
    """An artifact is built on the first call and read on the second."""
    store, built, out = RevisionStore.temporary(t.spark), [], []
    for call in (1, 2):
        try:
            found = store.read("overlap")
        except Exception:  # not there yet
            built.append(call)
            store.publish(t.region, "overlap", 1)
            found = store.read("overlap")
        out.append((call, found.count()))
    if built != [1]:
        raise AssertionError("built more than once")
    return t.spark.createDataFrame(out, "call int, n int")


@query("select 'node' as what, 'r' || r_regionkey as a, null as b from region union all select 'edge', 'n' || n_nationkey, 'r' || n_regionkey from nation")
def ou6_view(t):
    nodes = t.region.select(F.lit("node").alias("what"), F.concat(F.lit("r"), "r_regionkey").alias("a"), F.lit(None).cast("string").alias("b"))
    return nodes.unionByName(t.nation.select(F.lit("edge").alias("what"), F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")))


@query("select * from (values ('kind', 6), ('relation', 7)) v(what, n)")
def ou10_describe(t):
    rows = t.spark.createDataFrame(Q.describe(), "what string, name string, description string")
    return rows.groupBy("what").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("select * from (values ('good', '', true), ('dangling', 'edge to nothing: a->z', false)) v(view, faults, same_hash)")
def ou11_view_gate(t):
    good = {"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}]}
    turned = {"edges": good["edges"], "nodes": good["nodes"][::-1]}
    bad = {"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "z"}]}
    rows = [(n, ";".join(Q.check_view(s)), Q.view_hash(s) == Q.view_hash(turned)) for n, s in (("good", good), ("dangling", bad))]
    return t.spark.createDataFrame(rows, "view string, faults string, same_hash boolean")


@query("select doc_id, 'f' || (doc_id % 3) as stage from documents")
def in13_resume_from_checkpoint(t):
    """Stages whose result is published are not run again after a stop."""
    store = RevisionStore.temporary(t.spark)
    for run in range(2):
        done = store.revisions("f") if run else []
        for stage in range(3):
            if stage not in done and (run or stage < 2):
                store.publish(t.documents.filter(F.col("doc_id") % 3 == stage).select("doc_id", F.lit(f"f{stage}").alias("stage")), "f", stage)
    out = store.read("f", 0)
    for stage in (1, 2):
        out = out.unionByName(store.read("f", stage))
    return out


@query("select o_orderkey, o_totalprice from orders where o_orderdate <= timestamp '1996-06-30'")
def in9_pinned_revision(t):
    from datetime import datetime

    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    return R.latest(rows, ["o_orderkey"], "o_orderdate", datetime(1996, 6, 30)).select("o_orderkey", "o_totalprice")


@query("select upper(n_name) as x, lower(n_name) as folded from nation")
def udf_vectorised(t):
    from factloom.functions.udfs import register

    register(t.spark)
    return t.nation.select(F.upper("n_name").alias("x")).selectExpr("x", "full_case_fold(x) as folded")


@query("select n_nationkey, (i - 1)::int as position, w[i] as word from (select n_nationkey, string_split(n_name, ' ') as w, unnest(range(1, len(string_split(n_name, ' ')) + 1)) as i from nation)")
def udtf_lateral(t):
    from factloom.functions.udfs import register

    register(t.spark)
    t.nation.createOrReplaceTempView("nation_names")
    return t.spark.sql("select n_nationkey, position, word from nation_names, lateral split_words(n_name)")


@query(
    """with m as (select p.event_id as purchase, v.event_id as view from events p join events v on p.user_id = v.user_id and v.ts <= p.ts and v.ts > p.ts - interval 1 hour where p.event_type = 'purchase' and v.event_type = 'view')
    select purchase, view from m"""
)
def st1_stream_stream_join(t):
    from factloom.streaming.events import event_stream, late_matches, run_to_end

    return run_to_end(late_matches(event_stream(t.spark, f"{t.sf_dir}/events.parquet")), "append", t.spark)


@query(
    """with g as (select user_id, floor(epoch(ts))::bigint - lag(floor(epoch(ts))::bigint) over (partition by user_id order by ts, event_id) as gap from events) select user_id, coalesce(max(gap), 0)::bigint as longest_gap, count(*) as n from g group by 1"""
)
def st1_custom_state(t):
    from factloom.streaming.events import event_stream, run_to_end, running_gap

    return run_to_end(running_gap(event_stream(t.spark, f"{t.sf_dir}/events.parquet")), "update", t.spark)
