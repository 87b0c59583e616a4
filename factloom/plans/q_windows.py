"""Queries of ranking, sequences, sorting, paging and distinct."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import windows as W
from factloom.plans.registry import query


@query("select s_suppkey, row_number() over (order by s_acctbal desc, s_suppkey) as rank from supplier qualify rank <= 20")
def wn1_rank(t):
    top = t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    return top.select("s_suppkey", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long").alias("rank"))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderdate, o_orderkey) = 1")
def wn2_winner_per_group(t):
    return W.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("select o_custkey as winner from orders group by 1 order by count(*) desc, sum(o_totalprice) desc, o_custkey limit 1")
def wn2_global_winner(t):
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return g.agg(F.max_by("o_custkey", F.struct("n", "s", -F.col("o_custkey"))).alias("winner"))


@query("select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber) - 1 as ordinal, min(l_partkey) over (partition by l_orderkey) as cluster from lineitem")
def wn3_ordinal_in_cluster(t):
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", (F.row_number().over(w.orderBy("l_partkey", "l_linenumber")) - 1).cast("long").alias("ordinal"), F.min("l_partkey").over(w).alias("cluster"))


@query("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as ordinal from events")
def wn4_declaration_ordinal(t):
    return t.events.select("event_id", (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1).cast("long").alias("ordinal"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_quantity, l_extendedprice desc, l_linenumber, l_partkey) as call_order from lineitem")
def wn5_call_order(t):
    w = Window.partitionBy("l_orderkey").orderBy(F.asc("l_quantity"), F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("call_order"))


@query("with e as (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) select a, b, count(*) as n from e where b is not null group by 1, 2")
def wn6_adjacent_pairs(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).filter("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with e as (select event_type as b, list(event_type) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding) as before from events),
    x as (select distinct_a as a, b from (select b, unnest(list_distinct(before)) as distinct_a from e)) select a, b, count(*) as n from x group by 1, 2"""
)
def wn7_window_cooccurrence(t):
    rows = W.within_last(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", 3)
    return rows.select(F.explode(F.array_distinct("before")).alias("a"), F.col("event_type").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with e as (select *, coalesce(max((event_type = 'signup')::int) over w, 0) = 1 as signed, coalesce(max((event_type = 'error')::int) over w, 0) = 1 as failed from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
    select user_id, bool_and(event_type <> 'purchase' or signed) as signup_before_purchase, bool_and(not (event_type = 'purchase' and failed)) as never_after_error from e group by 1"""
)
def wn8_sequence_checks(t):
    order = ["ts", "event_id"]
    e = t.events.select("*", W.seen_before(t.events, "user_id", order, F.col("event_type") == "signup").alias("signed"), W.seen_before(t.events, "user_id", order, F.col("event_type") == "error").alias("failed"))
    buy = F.col("event_type") == "purchase"
    return e.groupBy("user_id").agg(F.bool_and(~buy | F.col("signed")).alias("signup_before_purchase"), F.bool_and(~(buy & F.col("failed"))).alias("never_after_error"))


@query(
    """with m as (select n_nationkey as id, case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then n_nationkey * 1.5 end as num, case when n_nationkey % 3 = 2 then n_name end as txt from nation)
    select id, row_number() over (order by case when num is null and txt is null then 0 when num is not null then 1 else 2 end, num, txt, id) as pos from m"""
)
def or1_mixed_sort(t):
    """A sort of mixed values: null, then numbers, then text, ties by id."""
    k = F.col("n_nationkey") % 3
    m = t.nation.select(F.col("n_nationkey").alias("id"), F.when(k == 1, F.col("n_nationkey") * 1.5).alias("num"), F.when(k == 2, F.col("n_name")).alias("txt"))
    rank = F.when(F.col("num").isNull() & F.col("txt").isNull(), 0).when(F.col("num").isNotNull(), 1).otherwise(2)
    return m.select("id", F.row_number().over(Window.orderBy(rank, "num", "txt", "id")).cast("long").alias("pos"))


@query("select o_orderkey, o_totalprice from orders where (o_totalprice, o_orderkey) > (1000.0, 5) order by o_totalprice, o_orderkey limit 25")
def lm1_keyset_page(t):
    return W.page(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 25, [1000.0, 5])


@query("select doc_id, n_chars from documents order by doc_id limit 20 offset 40")
def lm2_offset_page(t):
    return t.documents.select("doc_id", "n_chars").orderBy("doc_id").offset(40).limit(20)


@query("select user_id, count(*) as hits from events group by 1 order by hits desc, user_id limit 10")
def lm3_hot_paths(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "user_id").limit(10)


@query(
    """with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k, count(*) over (partition by p_brand) as n from part)
    select p_brand, p_partkey, k as pos, greatest(n - 3, 0) as omitted from r where k <= 3"""
)
def lm4_counted_truncation(t):
    top = W.top_per_group(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3, "pos")
    n = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return top.join(n, "p_brand").select("p_brand", "p_partkey", "pos", F.greatest(F.col("n") - 3, F.lit(0)).alias("omitted"))


@query("select distinct strftime(o_orderdate, '%Y-%m') as rev from orders where strftime(o_orderdate, '%Y-%m') > '1997-03' order by rev limit 6")
def lm5_revisions_after(t):
    return t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("rev")).filter("rev > '1997-03'").distinct().orderBy("rev").limit(6)


@query("select distinct l_partkey, l_suppkey from lineitem")
def ds1_distinct(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("select event_id, case when value < 10 then '<10' when value < 50 then '[10,50)' when value is not null then '>=50' end as label from events")
def fn2_bucket_label(t):
    return t.events.select("event_id", S.bucket_label(F.col("value"), [10, 50]).alias("label"))


@query(
    """select event_id, epoch(time_bucket(interval 6 hour, ts))::bigint as six_hours, epoch(date_trunc('month', ts))::bigint as month_start, epoch(time_bucket(interval 1 week, ts, timestamp '1970-01-05'))::bigint as week_start,
    epoch(time_bucket(interval 1 day, ts + interval 330 minute) - interval 330 minute)::bigint as day_in_zone from events"""
)
def fn3_time_bucket(t):
    ts = F.col("ts").cast("timestamp")
    s = lambda *a: F.unix_timestamp(S.time_bucket(ts, *a))
    return t.events.select("event_id", s("hour", 6).alias("six_hours"), s("month").alias("month_start"), s("week").alias("week_start"), s("day", 1, "+05:30").alias("day_in_zone"))


@query("select * from (values ('2024-01-02T03:04:05Z', 1704164645), ('2024-01-02', 1704153600), ('1700000000', 1700000000), ('soon', null)) v(raw, epoch)")
def fn4_parse_timestamp(t):
    rows = t.spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02",), ("1700000000",), ("soon",)], "raw string")
    return rows.select("raw", F.unix_timestamp(S.parse_timestamp(F.col("raw"))).alias("epoch"))


@query("select * from (values ('+05:30', 330), ('-08:00', -480), ('Z', null), ('+5', null)) v(zone, minutes)")
def fn5_zone_offset(t):
    return t.spark.createDataFrame([("+05:30",), ("-08:00",), ("Z",), ("+5",)], "zone string").select("zone", S.zone_offset_minutes(F.col("zone")).alias("minutes"))


@query(
    """with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages), d as (select page_id, unnest(range(1, len(string_split(path, '/')))) as k, string_split(path, '/') as s from p)
    select array_to_string(list_slice(s, 1, k), '/') as dir, count(*) as n from d group by 1 union all select '.', count(*) from pages"""
)
def fn6_directory_rollup(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return t.pages.select(F.explode(S.directory_chain(path, root=True)).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, (props->>'k')::bigint as k, list_filter([event_type, null, (props->>'k')], lambda x: x is not null)[1] as first_value, (props->>'missing') is null as missing from events")
def fn8_fn9_json_path(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", k.cast("long").alias("k"), F.array_compact(F.array("event_type", F.lit(None), k))[0].alias("first_value"), F.get_json_object("props", "$.missing").isNull().alias("missing"))


@query("select event_id, (props->>'$.k')::int as k from events where json_valid(props)")
def fn10_parse_json(t):
    return t.events.select("event_id", F.from_json("props", "struct<k:int>").alias("p")).select("event_id", "p.k")


@query("select doc_id, sha256(text) as content_hash, upper(left(sha256(text), 4)) as head from documents")
def fn11_content_hash(t):
    h = F.sha2("text", 256)
    return t.documents.select("doc_id", h.alias("content_hash"), F.upper(F.substring(h, 1, 4)).alias("head"))


@query("select c_custkey, count(*) over (partition by hash(c_mktsegment)) as same from customer")
def fn12_fast_hash(t):
    """A 64-bit hash for grouping: values differ between engines, equality doesn't."""
    return t.customer.select("c_custkey", F.count(F.lit(1)).over(Window.partitionBy(F.xxhash64("c_mktsegment"))).alias("same"))


@query("select l_orderkey, sha256(string_agg(l_returnflag || l_linestatus, ',' order by l_linenumber, l_partkey, l_returnflag, l_linestatus)) as shape from lineitem group by 1")
def fn13_shape_hash(t):
    ops = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")))
    return t.lineitem.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.transform(ops, lambda o: F.concat(o["l_returnflag"], o["l_linestatus"])), ","), 256).alias("shape"))


@query("select * from (values ('a.b::load_x', 'load_x'), ('p->q', 'q'), ('f()', 'f')) v(name, last)")
def fn14_last_segment(t):
    return t.spark.createDataFrame([("a.b::load_x",), ("p->q",), ("f()",)], "name string").select("name", S.last_segment(F.col("name")).alias("last"))


@query("select * from (values ('parseOrderLines', 'parse order line'), ('load_the_rows', 'load row'), ('HTTPGet', 'httpget')) v(name, words)")
def fn15_tokens(t):
    rows = t.spark.createDataFrame([("parseOrderLines",), ("load_the_rows",), ("HTTPGet",)], "name string")
    return rows.select("name", F.array_join(S.tokens(F.col("name")), " ").alias("words"))


@query("select * from (values ('order_total', 'Order Total'), ('maxPrice', 'Max Price')) v(name, shown)")
def fn16_humanise(t):
    return t.spark.createDataFrame([("order_total",), ("maxPrice",)], "name string").select("name", S.humanise(F.col("name")).alias("shown"))


@query("select doc_id, length(left(text, 400)) - length(replace(left(text, 400), chr(10), '')) + 1 as line from documents")
def fn17_line_of(t):
    return t.documents.select("doc_id", S.line_of(F.col("text"), F.lit(400)).alias("line"))


@query("select * from (values ('src/a/b.py', 'src', 'b.py'), ('x.py', '.', 'x.py')) v(path, top, base)")
def fn18_path_parts(t):
    return t.spark.createDataFrame([("src/a/b.py",), ("x.py",)], "path string").select("path", S.top_directory(F.col("path")).alias("top"), S.base_name(F.col("path")).alias("base"))


@query("select c_custkey, round(case when n is null then 1.0 else 1 / greatest(1.0, ln(1 + n)) end, 6) as gap from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def fn20_test_gap(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.round(S.test_gap(F.coalesce("n", F.lit(0))), 6).alias("gap"))


@query("select s_suppkey, round(1 / (1 + exp(-s_acctbal / 1000)), 6) as p from supplier")
def fn21_sigmoid(t):
    return t.supplier.select("s_suppkey", F.round(S.sigmoid(F.col("s_acctbal") / 1000), 6).alias("p"))


@query("with s as (select user_id, list(distinct event_type) as k from events group by 1) select a.user_id as a, round(len(list_intersect(a.k, b.k))::double / len(list_distinct(list_concat(a.k, b.k))), 6) as j from s a join s b on b.user_id = a.user_id + 1")
def fn22_jaccard(t):
    s = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    b = s.select((F.col("user_id") - 1).alias("user_id"), F.col("k").alias("k2"))
    return s.join(b, "user_id").select(F.col("user_id").alias("a"), F.round(S.jaccard(F.col("k"), F.col("k2")), 6).alias("j"))


@query("select a.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]), 5) as l2, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cos from embeddings a, (select embedding from embeddings where vec_id = 0) b")
def fn23_distances(t):
    b = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(b)).select("vec_id", F.round(S.l2_distance(F.col("embedding"), F.col("q")), 5).alias("l2"), F.round(S.cosine(F.col("embedding"), F.col("q")), 5).alias("cos"))


@query("select page_id, 1 + len(regexp_extract_all(html, '<(a|p|li|div|script)[ >]')) as complexity from pages")
def fn24_keyword_complexity(t):
    return t.pages.select("page_id", (1 + F.regexp_count("html", F.lit("<(a|p|li|div|script)[ >]"))).cast("long").alias("complexity"))


@query("select doc_id, case when regexp_matches(text, '" + S.PLACEHOLDERS + "') then null " + " ".join(f"when regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') then '{k}'" for k, p in S.SECRETS.items()) + " end as kind from documents")
def fn26_secrets(t):
    return t.documents.select("doc_id", S.secret_kind(F.col("text")).alias("kind"))


@query("select * from (values ('You must not pay', 'prohibition'), ('It shall log', 'obligation'), ('We should try', 'recommendation'), ('You may go', 'permission'), ('It rains', 'statement')) v(claim, modality)")
def fn27_classify_claim(t):
    rows = t.spark.createDataFrame([("You must not pay",), ("It shall log",), ("We should try",), ("You may go",), ("It rains",)], "claim string")
    return rows.select("claim", S.classify_claim(F.col("claim")).alias("modality"))


@query("select name, case n when 0 then 'not_found' when 1 then 'found' else 'ambiguous' end as outcome from (select name, count(p_partkey) as n from (values ('STEEL'), ('nothing')) v(name) left join part on p_type = name group by name)")
def fn28_resolve_symbol(t):
    names = t.spark.createDataFrame([("STEEL",), ("nothing",)], "name string")
    n = names.join(t.part, F.col("p_type") == F.col("name"), "left").groupBy("name").agg(F.count("p_partkey").alias("n"))
    return n.select("name", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("outcome"))


@query(
    """with p as (select event_type, avg(value) filter (where user_id < 75) as b, avg(value) filter (where user_id >= 75) as c from events group by 1)
    select event_type, round((b - c) / b, 6) as delta, case when b is null or c is null then 'unknown' when abs((b - c) / b) <= 0.02 then 'equivalent' when c < b then 'improved' else 'regressed' end as verdict from p"""
)
def fn29_profile_compare(t):
    low = F.col("user_id") < 75
    p = t.events.groupBy("event_type").agg(F.avg(F.when(low, F.col("value"))).alias("b"), F.avg(F.when(~low, F.col("value"))).alias("c"))
    d = (F.col("b") - F.col("c")) / F.col("b")
    return p.select("event_type", F.round(d, 6).alias("delta"), F.when(F.col("b").isNull() | F.col("c").isNull(), "unknown").when(F.abs(d) <= 0.02, "equivalent").when(F.col("c") < F.col("b"), "improved").otherwise("regressed").alias("verdict"))


@query("select s_suppkey, round(case when s_acctbal between 0 and 10000 then s_acctbal / 10000 end, 6) as utilisation, round(case when s_acctbal between 0 and 10000 then greatest(0, 10000 - s_acctbal) end, 2) as headroom from supplier")
def fn30_capacity(t):
    inside = F.col("s_acctbal").between(0, 10000)
    return t.supplier.select("s_suppkey", F.round(F.when(inside, F.col("s_acctbal") / 10000), 6).alias("utilisation"), F.round(F.when(inside, F.greatest(F.lit(0.0), 10000 - F.col("s_acctbal"))), 2).alias("headroom"))


@query("""select unnest(['/pay', '/users/{id}']) as path""")
def fn31_spec_paths(t):
    spec = '{"openapi": "3.0.0", "paths": {"/pay": {"post": {}}, "/users/{id}": {"get": {}}}}'
    return t.spark.createDataFrame([(spec,)], "spec string").select(F.explode(F.json_object_keys(F.get_json_object("spec", "$.paths"))).alias("path"))


@query("select * from (values ('/users/{id}/items/:item', 'id,item'), ('/plain', '')) v(route, params)")
def fn32_path_params(t):
    rows = t.spark.createDataFrame([("/users/{id}/items/:item",), ("/plain",)], "route string")
    return rows.select("route", F.array_join(S.path_params(F.col("route")), ",").alias("params"))


@query("select doc_id, sha256(lower(upper(regexp_replace(text, '[\u00df\u1e9e]', 'ss', 'g')))) as folded_sha256 from documents")
def fn1_fold_case(t):
    return t.documents.select("doc_id", F.sha2(S.fold_case(F.col("text")), 256).alias("folded_sha256"))
