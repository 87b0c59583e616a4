"""Revisions: ingest plans, update logs, as-of reads, compaction, tombstones, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan_ingest(before: DataFrame, now: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """(key, action): added, deleted, changed or unchanged by null-safe comparison of hash columns."""
    a = before.select(key, *(F.col(h).alias(f"_a_{h}") for h in hashes), F.lit(True).alias("_a"))
    b = now.select(key, *(F.col(h).alias(f"_b_{h}") for h in hashes), F.lit(True).alias("_b"))
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(f"_a_{h}").eqNullSafe(F.col(f"_b_{h}"))
    action = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, action.alias("action"))


def facts_at(log: DataFrame, rev: int, facts: list[str]) -> DataFrame:
    """Facts whose +1 and -1 updates up to a revision add up to more than nothing, with their count."""
    return log.filter(F.col("rev") <= rev).groupBy(*facts).agg(F.sum("diff").alias("count")).filter("count > 0")


def compact(log: DataFrame, watermark: int, facts: list[str]) -> DataFrame:
    """The log with updates below the watermark netted into one at it: reads at or above it stay exact."""
    old = log.filter(F.col("rev") < watermark).groupBy(*facts).agg(F.sum("diff").cast("long").alias("diff")).filter("diff <> 0").withColumn("rev", F.lit(watermark).cast("long"))
    new = log.filter(F.col("rev") >= watermark).select(*facts, F.col("diff").cast("long").alias("diff"), F.col("rev").cast("long").alias("rev"))
    return old.unionByName(new)


def latest(rows: DataFrame, key: list[str], rev: str, at=None) -> DataFrame:
    """The row of greatest rev of each key, at or before `at` if given; ties by all columns."""
    if at is not None:
        rows = rows.filter(F.col(rev) <= F.lit(at))
    others = [c for c in rows.columns if c not in key]
    whole = F.struct(rev, *(c for c in others if c != rev))
    best = rows.groupBy(*key).agg(F.max(whole).alias("_r"))
    return best.select(*key, *(F.col(f"_r.{c}").alias(c) for c in others))


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones.select(key), key, "left_anti")


def valid_at(rows: DataFrame, start: str, end: str, at) -> DataFrame:
    """Rows whose half-open validity [start, end) holds an instant; a null end is open."""
    return rows.filter((F.col(start) <= F.lit(at)) & (F.col(end).isNull() | (F.col(end) > F.lit(at))))


def timeline(rows: DataFrame, revs: DataFrame, name: str, contract: str) -> DataFrame:
    """(name, rev, change) of an interface over revisions: removed, reinstated, contract_changed.

    rows (name, rev, contract), at most one for each name and rev; revs: all revisions (rev).
    """
    order = revs.select("rev", F.row_number().over(Window.orderBy("rev")).alias("_n"))  # a row for each revision
    seen = rows.join(F.broadcast(order), "rev").select(name, "rev", contract, "_n")
    w = Window.partitionBy(name).orderBy("_n")
    steps = seen.select(name, "rev", F.col("_n"), F.col(contract), F.lag("_n").over(w).alias("_before"), F.lag(contract).over(w).alias("_old"), F.lead("_n").over(w).alias("_after"))
    back = steps.filter("_before is not null and _before < _n - 1").select(name, "rev", F.lit("reinstated").alias("change"))
    changed = steps.filter("_before = _n - 1").filter(~F.col(contract).eqNullSafe(F.col("_old"))).select(name, "rev", F.lit("contract_changed").alias("change"))
    last = order.agg(F.max("_n").alias("_last"))
    gone = steps.crossJoin(F.broadcast(last)).filter("coalesce(_after, _last + 1) > _n + 1 and _n < _last").select(name, (F.col("_n") + 1).alias("_n"))
    removed = gone.join(F.broadcast(order), "_n").select(name, "rev", F.lit("removed").alias("change"))
    return back.unionByName(changed).unionByName(removed)
