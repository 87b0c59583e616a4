"""Queries of similarity, text mining, revisions, rules, sources and outputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import revision as R
from factloom.operators import similarity as D
from factloom.plans.registry import query

LINES = "select doc_id, lang, source, p, line from (select doc_id, lang, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) as p, unnest(string_split(text, chr(10))) as line from documents)"


@query("with h as (select sha256(text) as h, min(doc_id) as class, count(*) as size from documents group by 1 having count(*) > 1) select doc_id, class, size from documents join h on sha256(text) = h.h")
def sm1_exact_duplicates(t):
    return D.exact_classes(t.documents, "doc_id", "text")


@query(f"with l as (select distinct doc_id, lower(trim(line, ' ')) as line from ({LINES}) where length(trim(line, ' ')) >= 20) select line, count(*) as holders, min(doc_id) as first from l group by 1 having count(*) > 1")
def sm2_shared_lines(t):
    return D.shared_lines(t.documents.select("doc_id", "text"), "doc_id", "text", 20)


@query(
    f"""with l as (select distinct doc_id, md5(lower(trim(line, ' '))) as h from ({LINES}) where length(line) >= 20), k as (select h from l group by h having count(*) between 2 and 20), n as (select doc_id, count(*) as n from l group by 1),
    s as (select a.doc_id as a, b.doc_id as b, count(*) as shared from l a join l b on a.h = b.h and a.doc_id < b.doc_id where a.h in (select h from k) group by 1, 2)
    select a, b, shared, case when shared >= 0.85 * least(x.n, y.n) then 'high' when shared >= 0.6 * least(x.n, y.n) then 'medium' else 'low' end as tier from s join n x on x.doc_id = a join n y on y.doc_id = b"""
)
def sm2_clone_tiers(t):
    """Tiers by shared lines over the shorter document; lines of more than 20 holders are classes (sm2_shared_lines), not pairs."""
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 20)
    each = lines.select("doc_id", F.md5(F.lower(F.trim("line"))).alias("h")).distinct()
    n = each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    some = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m between 2 and 20").select("h"), "h", "left_semi")
    pairs = some.select("h", F.col("doc_id").alias("a")).join(some.select("h", F.col("doc_id").alias("b")), "h").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    part = F.col("shared") / F.least("na", "nb")
    return both.select("a", "b", "shared", F.when(part >= 0.85, "high").when(part >= 0.6, "medium").otherwise("low").alias("tier"))


@query("select count(*) filter (where lang <> 'en') as by_kind, count(*) filter (where lang = 'en' and n_chars < 200) as too_short, count(*) filter (where lang = 'en' and n_chars >= 200) as kept from documents")
def sm3_exclusion_ledger(t):
    en, short = F.col("lang") == "en", F.col("n_chars") < 200
    return t.documents.agg(F.count_if(~en).alias("by_kind"), F.count_if(en & short).alias("too_short"), F.count_if(en & ~short).alias("kept"))


@query(
    f"""with l as (select doc_id, p, line, lead(line, 1) over w as l1, lead(line, 2) over w as l2, lead(line, 3) over w as l3 from ({LINES}) window w as (partition by doc_id order by p)),
    b as (select doc_id, md5(concat_ws(chr(10), line, l1, l2, l3)) as h from l where l3 is not null) select h as block, count(distinct doc_id) as docs, count(*) as n from b group by 1 having count(distinct doc_id) > 1"""
)
def sm4_block_duplication(t):
    lines = t.documents.select("doc_id", F.split("text", "\n").alias("l")).filter(F.size("l") >= 4)
    blocks = F.transform(F.sequence(F.lit(1), F.size("l") - 3), lambda k: F.md5(F.array_join(F.slice("l", k, 4), "\n")))
    return lines.select("doc_id", F.explode(blocks).alias("block")).groupBy("block").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n")).filter("docs > 1")


@query("with q as (select vec_id, embedding from embeddings where vec_id in (0, 7, 100)) select q.vec_id as query, e.vec_id as id, row_number() over (partition by q.vec_id order by list_distance(e.embedding::double[], q.embedding::double[]), e.vec_id) as rank from embeddings e, q where e.vec_id <> q.vec_id qualify rank <= 5")
def sm5_nearest(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return D.nearest(v, v.filter("id in (0, 7, 100)"), 5).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("select vec_id, label, case when vec_id % 50 = 0 then 1 else 0 end::bigint as version from embeddings where vec_id % 9 <> 4")
def sm6_upsert_remove(t):
    """Vectors after an upsert of some ids and a removal of others: latest version of each, tombstones out."""
    base = t.embeddings.select("vec_id", "label", F.lit(0).cast("long").alias("version"))
    patch = t.embeddings.filter("vec_id % 50 = 0").select("vec_id", "label", F.lit(1).cast("long").alias("version"))
    gone = t.embeddings.filter("vec_id % 9 = 4").select("vec_id")
    return R.without_tombstones(R.latest(base.union(patch), ["vec_id"], "version"), gone, "vec_id")


@query("select doc_id, case when lang = 'fr' then 'embed' else 'reuse' end as action from documents")
def sm7_refresh_plan(t):
    """What to embed anew after the texts of one language changed."""
    before = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    now = t.documents.select("doc_id", F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return R.plan_ingest(before, now, "doc_id", ["h"]).select("doc_id", F.when(F.col("action") == "unchanged", "reuse").otherwise("embed").alias("action"))


@query(
    """with w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as w from part), h as (select p_partkey, sha256(w) as h from w),
    s as (select p_partkey, ('0x' || substr(h, 1, 2))::int % 64 as slot, 1.0 as v from h union all select p_partkey, ('0x' || substr(h, 3, 2))::int % 64, 0.5 from h), g as (select p_partkey, slot, sum(v) as v from s group by 1, 2)
    select p_partkey, slot, round(v / sqrt(sum(v * v) over (partition by p_partkey)), 6) as value from g"""
)
def sm8_hashed_embedding(t):
    rows = t.part.select("p_partkey", F.split(F.lower("p_name"), " ").alias("words"))
    return D.hashed_embedding(rows, "p_partkey", "words").withColumn("value", F.round("value", 6))


@query("select q.vec_id as query, e.label, count(*) as n from (select e.vec_id, q.vec_id as qid, row_number() over (partition by q.vec_id order by list_distance(e.embedding::double[], q.embedding::double[]), e.vec_id) as rank from embeddings e, (select * from embeddings where vec_id in (3, 4)) q where e.vec_id <> q.vec_id) x join embeddings e on e.vec_id = x.vec_id join embeddings q on q.vec_id = x.qid where rank <= 10 group by 1, 2")
def sm9_search_and_label(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = D.nearest(v, v.filter("id in (3, 4)"), 10)
    return near.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with l as (select doc_id, p, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') as x from ({LINES})),
    h as (select *, last_value(case when starts_with(x, '#') then regexp_replace(regexp_replace(x, '^#+', ''), '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') end ignore nulls) over (partition by doc_id order by p rows unbounded preceding) as section,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[-*> ]+', ''), '^[0-9]+', ''), '^(\\. )+', ''), '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') as body from l),
    c as (select * from h where strlen(body) > 12 and (regexp_matches(lower(body), 'must|shall|should|may|will|never|always') or regexp_matches(x, '^[-*]') or (regexp_matches(x, '^[0-9]') and strlen(x) > 2 and contains(x, '.'))))
    select doc_id, p as line_no, coalesce(section, '') as section, substr(body, 1, 500) as claim from c"""
)
def sm10_claims(t):
    """Claims of documents; their modality is tested by fn27_classify_claim."""
    from factloom.operators.claims import extract_claims

    return extract_claims(t.documents, "doc_id", "text").drop("modality")



@query(
    """with c as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) as w from benchmark), n as (select item_id, count(*) as n from c group by 1), p as (select n_nationkey as k, unnest(regexp_extract_all(lower(n_name), '[a-z]{3,}')) as w from nation), d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) as w from documents),
    s as (select item_id, doc_id, least(1.0, 3.0 * count(*) / max(n)) as score from c join d using (w) join n using (item_id) group by 1, 2)
    select item_id, doc_id, round(score, 4) as score, row_number() over (partition by item_id order by round(score, 4) desc, doc_id) as rank from s where score >= 0.28 qualify rank <= 5"""
)
def sm11_top_mappings(t):
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{5,})"))))
    c = t.benchmark.select("item_id", words("text").alias("w"))
    n = c.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hits = c.join(t.documents.select("doc_id", words("text").alias("w")), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("h"))
    scored = hits.join(n, "item_id").withColumn("raw", F.least(F.lit(1.0), 3.0 * F.col("h") / F.col("n"))).filter("raw >= 0.28").withColumn("score", F.round("raw", 4))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("item_id", "doc_id", "score", "rank")


@query(
    """select coalesce(d.doc_id, l.doc_id) as doc_id, case when d.doc_id % 23 = 0 then 'undocumented' when d.doc_id % 19 = 0 then 'superseded' when d.source is null then 'unknown' when d.n_chars > 20000 or d.n_chars < 40 then 'unverifiable'
      when l.doc_id is null then 'missing' when (d.doc_id % 100) / 100.0 < 0.34 then 'unverifiable' when l.toxic = 1 then 'contradicting' when d.lang = 'de' or l.quality = 1 then 'implemented' when d.doc_id % 2 = 0 then 'drifted' else 'partial' end as status
    from documents d left join labels l using (doc_id)"""
)
def sm12_verification_ladder(t):
    """All nine verdicts, on documents as claims and labels as what was found of them."""
    from factloom.operators.claims import claim_status

    x = t.documents.join(t.labels.withColumn("_l", F.lit(True)), "doc_id", "left")
    k = F.col("doc_id")
    status = claim_status(
        claimed=k % 23 != 0, superseded=k % 19 == 0, timed_out=F.col("source").isNull(), measurable=F.col("n_chars") > 20000, vague=F.col("n_chars") < 40,
        confidence=F.when(F.col("_l"), (k % 100) / 100), broken=F.col("toxic") == 1, prohibition=F.col("lang") == "de", was_implemented=k % 2 == 0, signal=F.col("quality") == 1,
    )
    return x.select("doc_id", status.alias("status"))



@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def sm13_never_mapped(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("with a as (select user_id % 20 as k, max(event_type) as s from events where event_id % 2 = 0 group by 1), b as (select user_id % 20 as k, max(event_type) as s from events where event_id % 2 = 1 and user_id % 20 <> 3 group by 1) select coalesce(a.k, b.k) as k, a.s as before, b.s as after from a full join b on a.k = b.k where a.s is distinct from b.s")
def sm14_report_delta(t):
    side = lambda df, n: df.groupBy((F.col("user_id") % 20).alias("k")).agg(F.max("event_type").alias(n))
    both = side(t.events.filter("event_id % 2 = 0"), "before").join(side(t.events.filter("event_id % 2 = 1 and user_id % 20 <> 3"), "after"), "k", "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


@query("select * from (values ('load_users', 'read', true), ('save_order', 'write', false), ('plain', null, null)) v(name, promised, kept)")
def sm15_naming_promises(t):
    rows = t.spark.createDataFrame([("load_users", "read"), ("save_order", "read"), ("plain", "read")], "name string, effect string")
    verbs = t.spark.createDataFrame([("load", "read"), ("get", "read"), ("save", "write"), ("write", "write")], "verb string, promised string")
    out = rows.withColumn("verb", F.split("name", "_")[0]).join(F.broadcast(verbs), "verb", "left")
    return out.select("name", "promised", (F.col("promised") == F.col("effect")).alias("kept"))


@query(
    """with p as (select distinct event_type as a from events), c as (select x.a, y.a as b from p x, p y where x.a <> y.a), f as (select user_id, event_type as e, min(struct_pack(ts := ts, id := event_id)) as first from events group by 1, 2),
    v as (select c.a, c.b, fb.user_id, fa.first is not null and fa.first < fb.first as ok from c join f fb on fb.e = c.b left join f fa on fa.e = c.a and fa.user_id = fb.user_id)
    select a, b, count(*) as traces, count(*) filter (where not ok) as refuted, min(case when not ok then user_id end) as first_refuting from v group by 1, 2"""
)
def sm16_protocols(t):
    """Candidates "a before b", with the traces of b that refute each."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    kinds = t.events.select(F.col("event_type").alias("a")).distinct()
    c = kinds.join(kinds.withColumnRenamed("a", "b"), F.col("a") != F.col("b"))  # pairs of a few kinds
    b = first.select("user_id", F.col("event_type").alias("b"), F.col("first").alias("fb"))
    a = first.select("user_id", F.col("event_type").alias("a"), F.col("first").alias("fa"))
    v = b.join(F.broadcast(c), "b").join(a, ["user_id", "a"], "left").withColumn("ok", F.coalesce(F.col("fa") < F.col("fb"), F.lit(False)))
    return v.groupBy("a", "b").agg(F.count(F.lit(1)).alias("traces"), F.count_if(~F.col("ok")).alias("refuted"), F.min(F.when(~F.col("ok"), F.col("user_id"))).alias("first_refuting"))


@query("select l_suppkey, l_returnflag = 'A' as honoured, count(*) as n from lineitem where l_suppkey in (select l_suppkey from lineitem group by 1 having count(*) filter (where l_returnflag = 'A') > 0 and count(*) filter (where l_returnflag <> 'A') > 0) group by 1, 2")
def sm17_belief_signals(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("y"), F.count_if(F.col("l_returnflag") != "A").alias("n")).filter("y > 0 and n > 0")
    return g.select("l_suppkey", F.explode(F.array(F.struct(F.lit(True).alias("honoured"), F.col("y").alias("n")), F.struct(F.lit(False).alias("honoured"), F.col("n").alias("n")))).alias("s")).select("l_suppkey", "s.honoured", "s.n")


@query("select event_id, 1 as pos, event_type || '.py' as file, (user_id + 1)::int as line, 'main' as func from events union all select event_id, 2, 'lib/x.py', (event_id % 1000)::int, 'f' || user_id from events")
def sm18_stack_trace(t):
    """Frames of a trace for each event."""
    trace = F.format_string('Traceback:\n  File "%s.py", line %d, in main\n  File "lib/x.py", line %d, in f%d\nError: x', "event_type", F.col("user_id") + 1, F.col("event_id") % 1000, "user_id")
    p = r'File "([^"]+)", line (\d+), in (\w+)'
    part = lambda k: F.regexp_extract_all("trace", F.lit(p), F.lit(k))
    rows = t.events.select("event_id", trace.alias("trace")).select("event_id", F.posexplode(F.arrays_zip(part(1).alias("file"), part(2).alias("line"), part(3).alias("func"))).alias("k", "f"))
    return rows.select("event_id", (F.col("k") + 1).alias("pos"), "f.file", F.col("f.line").cast("int").alias("line"), "f.func")



# revisions: the month of an order is its revision, a returned line takes its fact back

LOG = "select l_suppkey as a, l_partkey as b, (year(o_orderdate) * 12 + month(o_orderdate))::bigint as rev, (case when l_returnflag = 'R' then -1 else 1 end)::bigint as diff from lineitem join orders on l_orderkey = o_orderkey"


def update_log(t):
    rev = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), rev.alias("rev"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("long").alias("diff"))


@query("with a as (select * from documents where doc_id % 10 <> 0), b as (select doc_id, case when doc_id % 7 = 0 then text || '!' else text end as text from documents where doc_id % 11 <> 0) select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'deleted' when sha256(a.text) = sha256(b.text) then 'unchanged' else 'changed' end as action from a full join b on a.doc_id = b.doc_id")
def in1_ingest_plan(t):
    h = lambda df: df.select("doc_id", F.sha2("text", 256).alias("h"))
    changed = t.documents.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.plan_ingest(h(t.documents.filter("doc_id % 10 <> 0")), h(changed), "doc_id", ["h"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def in2_tombstones(t):
    return R.without_tombstones(t.documents.select("doc_id"), t.labels.filter("toxic = 1"), "doc_id")


@query(f"select a, b, sum(diff)::bigint as count from ({LOG}) where rev <= 23970 group by 1, 2 having sum(diff) > 0")
def in3_facts_at(t):
    return R.facts_at(update_log(t), 23970, ["a", "b"])


@query(f"with recursive f as (select distinct a as source, a + 1 + b % 3 as target from ({LOG}) where rev <= 23970), c as (select source, target from f union select c.source, f.target from c join f on c.target = f.source) select source, target from c")
def in4_closure_as_of(t):
    from factloom.operators.graph import reachable

    facts = update_log(t).filter("rev <= 23970").select(F.col("a").alias("source"), (F.col("a") + 1 + F.col("b") % 3).alias("target"))
    return reachable(facts)


@query(f"with l as ({LOG}) select a, b, 23960::bigint as rev, sum(diff)::bigint as diff from l where rev < 23960 group by 1, 2 having sum(diff) <> 0 union all select a, b, rev, diff from l where rev >= 23960")
def in5_compaction(t):
    return R.compact(update_log(t), 23960, ["a", "b"])


@query(f"with l as ({LOG}), n as (select a, b, sum(diff) as s from l group by 1, 2) select a, b from n where s <= 0 and not exists (select 1 from n m where m.s > 0 and m.a = n.a and m.b // 10 = n.b // 10)")
def in6_retraction_audit(t):
    net = update_log(t).groupBy("a", "b").agg(F.sum("diff").alias("s"))
    # a fact of the same owner and neighbourhood that still holds is an alternative
    net = net.withColumn("near", F.floor(F.col("b") / 10))
    return net.filter("s <= 0").join(net.filter("s > 0").select("a", "near"), ["a", "near"], "left_anti").select("a", "b")


@query("select doc_id, doc_id % 5 <> 0 as reusable from documents")
def in7_reuse_by_composite_key(t):
    key = lambda dep: F.sha2(F.concat_ws("|", F.sha2("text", 256), dep), 256)
    old = t.documents.select("doc_id", key(F.lit("v1")).alias("k"))
    now = t.documents.select("doc_id", key(F.when(F.col("doc_id") % 5 == 0, "v2").otherwise("v1")).alias("k2"))
    return old.join(now, "doc_id").select("doc_id", (F.col("k") == F.col("k2")).alias("reusable"))


@query("select o_orderkey from orders where o_orderdate <= timestamp '1997-06-01' and o_orderdate + interval 90 day > timestamp '1997-06-01'")
def in8_valid_at(t):
    from datetime import datetime

    rows = t.orders.select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 90 day")).alias("until"))
    return R.valid_at(rows, "o_orderdate", "until", datetime(1997, 6, 1)).select("o_orderkey")


@query("select o_custkey, max(o_orderkey) filter (where o_orderdate = m) as o_orderkey from (select *, max(o_orderdate) over (partition by o_custkey) as m from orders where o_orderdate <= timestamp '1998-01-01') group by 1")
def in9_latest_revision(t):
    from datetime import datetime

    return R.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", datetime(1998, 1, 1)).select("o_custkey", "o_orderkey")


@query("select 'structural' as kind, s_suppkey as id from supplier where s_nationkey = 3 union all select distinct 'inferred', l_orderkey from lineitem join supplier on l_suppkey = s_suppkey where s_nationkey = 3")
def in10_what_if_removal(t):
    gone = t.supplier.filter("s_nationkey = 3")
    a = gone.select(F.lit("structural").alias("kind"), F.col("s_suppkey").alias("id"))
    hit = t.lineitem.join(gone, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(F.lit("inferred").alias("kind"), F.col("l_orderkey").alias("id")).distinct()
    return a.unionByName(hit)


@query(
    """with r as (select distinct user_id as name, date_part('day', ts)::bigint as rev, max(event_type) over (partition by user_id, date_part('day', ts)) as contract from events), n as (select rev, row_number() over (order by rev) as n from (select distinct rev from r)),
    g as (select name, n.n, n.rev, contract, lag(n.n) over w as b, lag(contract) over w as o, lead(n.n) over w as f from r join n using (rev) window w as (partition by name order by n.n)), m as (select max(n) as m from n)
    select name, rev, 'reinstated' as change from g where b < n - 1 union all select name, rev, 'contract_changed' from g where b = n - 1 and contract <> o
    union all select g.name, n.rev, 'removed' from g, m, n where coalesce(f, m + 1) > g.n + 1 and g.n < m and n.n = g.n + 1"""
)
def in11_interface_timeline(t):
    rev = F.dayofmonth("ts").cast("long")
    rows = t.events.groupBy(F.col("user_id").alias("name"), rev.alias("rev")).agg(F.max("event_type").alias("contract"))
    return R.timeline(rows, rows.select("rev").distinct(), "name", "contract")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'released' when c_mktsegment = 'BUILDING' then 'segment' else 'unattributed' end as cause from orders left join customer on o_custkey = c_custkey")
def in12_attribution(t):
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "released").when(F.col("c_mktsegment") == "BUILDING", "segment").otherwise("unattributed").alias("cause"))


@query("select user_id, max_by(event_type, struct_pack(ts := ts, id := event_id)) as state from events group by 1")
def in14_scope_replay(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("select event_id, coalesce(c_custkey, -1) as mapped, case when c_custkey is null then 'no such customer' end as reason from events left join customer on user_id = c_custkey")
def in15_span_mapping(t):
    x = t.events.select("event_id", "user_id").join(t.customer.select("c_custkey"), F.col("user_id") == F.col("c_custkey"), "left")
    return x.select("event_id", F.coalesce("c_custkey", F.lit(-1)).alias("mapped"), F.when(F.col("c_custkey").isNull(), "no such customer").alias("reason"))


@query("select 'orders' as tbl, count(*) as n from orders where o_custkey % 100 <> 7 union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 100 = 7)")
def in16_cascading_delete(t):
    gone = t.orders.filter("o_custkey % 100 = 7").select("o_orderkey")
    o = t.orders.join(gone, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("tbl"), "n")
    lines = t.lineitem.join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return o.unionByName(lines.select(F.lit("lineitem").alias("tbl"), "n"))


@query("select * from (values ('parse', 'done'), ('divide', 'failed'), ('count', 'done')) v(stage, status)")
def in17_stage_ledger(t):
    """A failing stage is recorded and later stages run."""
    from factloom.operators.stages import run_stages

    stages = {"parse": lambda: t.nation.count(), "divide": lambda: t.nation.select(F.raise_error(F.lit("no"))).collect(), "count": lambda: t.region.count()}
    return run_stages(t.spark, stages).select("stage", "status")


# rules

@query("select * from (select doc_id, case when regexp_matches(text, '" + S.PLACEHOLDERS + "') then null " + " ".join(f"when regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') then '{k}'" for k, p in S.SECRETS.items()) + " end as kind from documents) where kind is not null")
def ru1_hardcoded_secret(t):
    return t.documents.select("doc_id", S.secret_kind(F.col("text")).alias("kind")).filter("kind is not null")



@query("select user_id, count(*) as n from events where event_type = 'view' group by user_id, date_trunc('hour', ts) having count(*) >= 2")
def ru5_n_plus_one(t):
    return t.events.filter("event_type = 'view'").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("user_id", "n")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem) and p_name not like '%test%'")
def ru6_dead_code(t):
    return t.part.filter(~F.col("p_name").contains("test")).join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("select doc_id, coalesce(nullif(regexp_extract(text, '(MIT License|GNU General Public License|Apache License)', 1), ''), 'unknown') as licence from documents")
def ru11_licences(t):
    found = F.regexp_extract("text", "(MIT License|GNU General Public License|Apache License)", 1)
    return t.documents.select("doc_id", F.when(found == "", "unknown").otherwise(found).alias("licence"))


@query("select c_custkey, case when n is null then 'potential' else 'measured' end as claim from customer left join (select user_id, count(*) as n from events group by 1) on user_id = c_custkey")
def ru12_performance_claims(t):
    n = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "potential").otherwise("measured").alias("claim"))


@query("select o_orderstatus as status, case o_orderstatus when 'F' then 'pass' when 'O' then 'pending' else 'fail' end as verdict, count(*) as n from orders group by 1")
def ru13_external_verdicts(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy(s.alias("status"), F.when(s == "F", "pass").when(s == "O", "pending").otherwise("fail").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_type as criterion, round(avg(p_retailprice) filter (where p_brand = 'Brand#11'), 2) as a, round(avg(p_retailprice) filter (where p_brand = 'Brand#12'), 2) as b from part group by 1")
def ru14_alternatives(t):
    side = lambda b: F.round(F.avg(F.when(F.col("p_brand") == b, F.col("p_retailprice"))), 2)
    return t.part.groupBy(F.col("p_type").alias("criterion")).agg(side("Brand#11").alias("a"), side("Brand#12").alias("b"))


@query("select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]+)', 1) as route, count(*) as n from pages group by 1, 2")
def ru15_endpoints(t):
    return t.pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[a-z]+)", 1).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("select * from (values ('/api/users', '/users'), ('/pay', '/pay')) v(literal, route)")
def ru16_client_binding(t):
    from factloom.operators.joins import either_key

    literals = t.spark.createDataFrame([("/api/users",), ("/pay",), ("/x",)], "literal string")
    routes = t.spark.createDataFrame([("/users",), ("/pay",)], "route string")
    return either_key(literals, routes, "literal", [F.col("route"), F.concat(F.lit("/api"), "route")])


# sources, sinks and outputs

@query(
    """with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g') as x from pages),
    b as (select page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as x from a)
    select page_id, trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'), ' ') as text from b"""
)
def sc16_normalise_html(t):
    """Prose of pages: bodies of scripts and styles go, entities are decoded, white space is one space."""
    from factloom.sources.files import html_text

    return t.pages.select("page_id", html_text(F.col("html")).alias("text"))



@query("select 'c' || l_orderkey as commit, case when l_tax = 0 then 'i' else 'p' end || l_partkey as path, case when l_tax > 0 then cast(l_quantity as int) end as added, case when l_tax > 0 then l_linenumber end as deleted, l_tax = 0 as is_binary from lineitem")
def sc14_numstat(t):
    """Line items as a log of one commit each; those without tax are binary."""
    from factloom.sources.history import parse_numstat

    binary = F.col("l_tax") == 0
    path = F.concat(F.when(binary, "i").otherwise("p"), "l_partkey")
    row = F.when(binary, F.concat(F.lit("-\t-\t"), path)).otherwise(F.concat_ws("\t", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), path))
    return parse_numstat(t.lineitem.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("commit c"), "l_orderkey", F.lit("\n"), row).alias("log")))



@query("select * from (values ('t1', 's1', null, 'load', 5), ('t1', 's2', 's1', 'query', 3), ('t2', 's3', null, 'flat', 1)) v(trace, span, parent, name, duration_ns)")
def sc15_spans(t):
    from factloom.sources.spans import parse_spans

    nested = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t1","spanId":"s1","name":"load","startTimeUnixNano":"10","endTimeUnixNano":"15"},{"traceId":"t1","spanId":"s2","parentSpanId":"s1","name":"query","startTimeUnixNano":"11","endTimeUnixNano":"14"}]}]}]}'
    flat = '[{"traceId":"t2","spanId":"s3","name":"flat","startTimeUnixNano":"1","endTimeUnixNano":"2"}]'
    rows = t.spark.createDataFrame([(nested,), (flat,)], "payload string")
    return parse_spans(rows).select("trace", "span", "parent", "name", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))


@query("select * from (values ('a.py', 'python'), ('run', 'shell'), ('x.rs', 'rust'), ('blob', null)) v(path, language)")
def sc2_detect_language(t):
    from factloom.sources.files import detect_language

    rows = t.spark.createDataFrame([("a.py", "import x"), ("run", "#!/bin/sh\nls"), ("x.rs", ""), ("blob", "??")], "path string, head string")
    return detect_language(rows).select("path", "language")


@query("select * from (values ('a.txt', 'package', 'requests', '2.1'), ('Cargo.toml', 'package', 'serde', '1.0')) v(path, kind, name, version)")
def sc17_manifests(t):
    from factloom.sources.files import parse_manifests

    rows = t.spark.createDataFrame([("a.txt", "requests==2.1\n# no\n"), ("Cargo.toml", '[dependencies]\nserde = "1.0"\n')], "path string, text string")
    return parse_manifests(rows)


@query("select doc_id, 'redacted' as source, substr(text, 1, 2000) as text from documents where doc_id >= 10 order by doc_id limit 15")
def sc19_diagnostics(t):
    from factloom.sources.files import diagnostics

    return diagnostics(t.documents.select("doc_id", "source", "text"), "doc_id", 15, first=10, secret=("source",))


@query("select sha256(string_agg(h, '' order by h)) as fingerprint from (select sha256(r_name) as h from region)")
def sc11_fingerprint(t):
    hashes = t.region.select(F.sha2("r_name", 256).alias("h"))
    return hashes.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("fingerprint"))


@query("select count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderstatus = 'F'")
def sk2_publish_and_read_revision(t):
    """Write a revision, publish its pointer last, and read by the pointer."""
    from factloom.sources.revisions import RevisionStore

    store = RevisionStore.temporary(t.spark)
    store.publish(t.orders.filter("o_orderstatus = 'O'"), "orders", 1)
    store.publish(t.orders.filter("o_orderstatus = 'F'"), "orders", 2)
    return store.read("orders").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select count(*) as n, true as verified from customer")
def sk5_archive_restore(t):
    from factloom.sources.revisions import RevisionStore

    store = RevisionStore.temporary(t.spark)
    store.publish(t.customer, "customer", 1)
    return store.read("customer", 1).agg(F.count(F.lit(1)).alias("n")).withColumn("verified", F.lit(store.verify("customer", 1)))


@query("""select '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' as json from nation""")
def sk1_json_rows(t):
    return t.nation.select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("json"))


@query("select 'digraph {' || string_agg('r' || n_regionkey || '->n' || n_nationkey || ';', '' order by n_nationkey) || '}' as dot from nation")
def sk4_dot_renderer(t):
    edge = F.concat(F.lit("r"), "n_regionkey", F.lit("->n"), "n_nationkey", F.lit(";"))
    lines = F.array_sort(F.collect_list(F.struct("n_nationkey", edge.alias("e"))))
    return t.nation.agg(F.concat(F.lit("digraph {"), F.array_join(F.transform(lines, lambda x: x["e"]), ""), F.lit("}")).alias("dot"))


@query("select item_id, substr(text, 11, 40) as detail, length(text) > 50 as more from benchmark")
def ou3_source_detail(t):
    return t.benchmark.select("item_id", F.substring("text", 11, 40).alias("detail"), (F.length("text") > 50).alias("more"))


@query("select * from (values ('cube', 'ready', 3), ('rows', 'truncated', 2), ('view', 'empty', 0), ('bad', 'failed', null)) v(output, status, n)")
def ou8_output_status(t):
    """Outputs run in the order of their dependencies; one that fails is recorded and the rest run."""
    from factloom.plans.outputs import run_outputs

    outputs = {
        "view": (("cube",), lambda: t.region.filter("r_regionkey < 0"), 10),
        "cube": ((), lambda: t.region.filter("r_regionkey < 3"), 10),
        "rows": ((), lambda: t.region, 2),
        "bad": ((), lambda: t.region.select("nothing"), 10),
    }
    return run_outputs(t.spark, outputs)


@query("select window_start, event_type, count(*) as n from (select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type from events) group by 1, 2")
def st1_tumbling_windows(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@query(
    """with e as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, count(*) as sessions, max(n) as longest from (select user_id, k, count(*) as n from s group by 1, 2) group by 1"""
)
def st1_session_windows(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("select user_id, count(*) as hits, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors from events group by 1")
def st1_streaming_totals(t):
    """Structured Streaming over the events to completion, counts by user."""
    from factloom.streaming.events import totals_of_stream

    return totals_of_stream(t.spark, f"{t.sf_dir}/events.parquet")
