"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

Logged conversations often repeat: each snapshot holds the turns of the one
before and a few more. Every turn gets the hash of the turns up to it (a
running bit_xor of hashes salted with the position, twice 64 bits); a
conversation whose last hash is a proper prefix hash of another is dropped by
an anti-join, exact copies keep their smallest id, and only the maximal
conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fixed parts of a rendered turn: before the role, between role and text, after the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns with position (from 1), n_turns, and the two halves of the hash of the turns up to each."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = turns.withColumn("position", F.row_number().over(order).cast("long"))
    # a null is told from an empty text by its own flag
    what: list[Column] = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    here = here.withColumns({"_a": F.xxhash64(F.lit(1), "position", *what), "_b": F.xxhash64(F.lit(2), *what, "position")})
    return here.select("conv_id", "position", "role", "text", F.bit_xor("_a").over(upto).alias("prefix_a"), F.bit_xor("_b").over(upto).alias("prefix_b"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of each conversation that is no proper prefix of another.

    Of exact copies the smallest conv_id stays, with their number in n_copies.
    """
    turns = _prefixes(conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null"))
    whole = turns.filter("position = n_turns").groupBy("prefix_a", "prefix_b", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = turns.filter("position < n_turns").select("prefix_a", "prefix_b", F.col("position").alias("n_turns")).distinct()
    return whole.join(inner, ["prefix_a", "prefix_b", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, n_chars, rendered of every maximal conversation.

    Turns are ordered by turn, then role, then text, nulls first, so ties and
    repeated rows have a fixed order and all stay. A null role renders as
    "user", a null text as empty, yet they differ from these when prefixes are
    compared. Rows without conv_id belong to no conversation and render
    nothing. An empty table gives an empty table; other columns are not read.
    """
    keep = maximal_conversations(conversations)
    role = F.coalesce("role", F.lit("user"))
    line = F.concat(F.lit(OPEN), role, F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    rows = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null").join(keep, "conv_id")
    # a null sorts first in a struct, as it does in the windows above
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    out = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(turns, lambda t: t["line"]), "").alias("rendered"))
    return out.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), "rendered")


#: DuckDB SQL for format_chats(): prefixes compared as lists of turns.
ORACLE_SQL = f"""
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as p
  from conversations where conv_id is not null),
c as (select conv_id, list(struct_pack(r := role, x := text) order by p) as turns, count(*) as n_turns from t group by conv_id),
w as (select turns, n_turns, min(conv_id) as conv_id, count(*) as n_copies from c group by turns, n_turns),
i as (select distinct list_slice(turns, 1, k) as turns from (select turns, unnest(range(1, n_turns)) as k from w)),
s as (select w.* from w anti join i on w.turns = i.turns)
select s.conv_id, s.n_turns, s.n_copies, length(r.rendered)::bigint as n_chars, r.rendered
from s join (select conv_id, string_agg('{OPEN}' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by p) as rendered from t group by conv_id) r using (conv_id)
"""
