"""Derived metrics: churn, co-change, overlap, composite scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.scratch import cut


def touches(lines: DataFrame) -> DataFrame:
    """Line items as file touches: commit = order, path = part, added and deleted lines, author = supplier."""
    return lines.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.round(F.col("l_discount") * 100).cast("long").alias("deleted"), F.col("l_suppkey").alias("author"))


def without_bulk(rows: DataFrame, bulk: int | None) -> DataFrame:
    """rows without commits of more than `bulk` distinct paths."""
    if bulk is None:
        return rows
    wide = rows.groupBy("commit").agg(F.countDistinct("path").alias("_n")).filter(F.col("_n") > bulk).select("commit")
    return rows.join(wide, "commit", "left_anti")


def churn(rows: DataFrame, bulk: int | None = None, excluded_authors: tuple = ()) -> DataFrame:
    """path, commits, added, deleted, authors over touches, bulk commits and some authors excluded."""
    kept = without_bulk(rows, bulk)
    if excluded_authors:
        kept = kept.filter(~F.col("author").isin(*excluded_authors))
    return kept.groupBy("path").agg(F.countDistinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.countDistinct("author").alias("authors"))


def pairs(rows: DataFrame, bulk: int) -> DataFrame:
    """(commit, a, b) of paths touched together, a < b. bulk bounds the pairs of a commit."""
    each = without_bulk(rows.select("commit", "path").distinct(), bulk)
    return each.select("commit", F.col("path").alias("a")).join(each.select("commit", F.col("path").alias("b")), "commit").filter("a < b")


def newest_names(renames: DataFrame) -> DataFrame:
    """(old, new) with chains of renames followed to their end, by pointer jumping; a name renamed twice goes to the greater one.

    Each round doubles the steps a name has followed. Names that still move
    after as many rounds as the longest chain could need are on a cycle, which raises.
    """
    now = cut(renames.groupBy("old").agg(F.max("new").alias("new")), "renames")
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("old").alias("new"), F.col("new").alias("further"))
        step = cut(now.join(ahead, "new", "left").select("old", F.coalesce("further", "new").alias("new"), F.col("further").isNotNull().alias("moved")), "renames")
        now = step.select("old", "new")
        if step.filter("moved").isEmpty():
            return now
    raise ValueError("renames form a cycle")


def canonical_paths(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """rows with a path's newest name; renames are (old, new)."""
    renames = newest_names(renames)
    return rows.join(renames.withColumnRenamed("old", "path"), "path", "left").withColumn("path", F.coalesce("new", "path")).drop("new")


def cochange(rows: DataFrame, renames: DataFrame, bulk: int, least: int) -> DataFrame:
    """a, b, support, confidence (support over the rarer path's commits) of pairs seen at least `least` times."""
    each = without_bulk(canonical_paths(rows.select("commit", "path"), renames).distinct(), bulk)
    n = each.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    found = pairs(each, bulk).groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    both = found.join(n.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "support", F.round(F.col("support") / F.least("na", "nb"), 4).alias("confidence"))


def overlap(sets: DataFrame, least: int, widest: int | None = None) -> DataFrame:
    """a, b, shared, only_a, only_b, jaccard of owners with at least `least` items in common.

    Counting goes over an inverted list by item; items of more than `widest`
    owners are left out of it if given.
    """
    rows = sets.select("owner", "item").distinct()
    n = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    lists = rows
    if widest is not None:
        lists = rows.join(rows.groupBy("item").agg(F.count(F.lit(1)).alias("_w")).filter(F.col("_w") <= widest).select("item"), "item", "left_semi")
    both = lists.select("item", F.col("owner").alias("a")).join(lists.select("item", F.col("owner").alias("b")), "item").filter("a < b")
    shared = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    out = shared.join(n.select(F.col("owner").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("owner").alias("b"), F.col("n").alias("nb")), "b")
    s = F.col("shared")
    return out.select("a", "b", "shared", (F.col("na") - s).alias("only_a"), (F.col("nb") - s).alias("only_b"), (s / (F.col("na") + F.col("nb") - s)).alias("jaccard"))


def composite(rows: DataFrame, weights: dict[str | None, float], missing: float = 0.5) -> DataFrame:
    """rows with risk: the weighted sum of columns over their maxima; a null counts as `missing`, as does the column None."""
    names = [c for c in weights if c]
    top = rows.agg(*(F.max(c).alias(f"_max_{c}") for c in names))
    terms = [w * (F.coalesce(F.col(c) / F.col(f"_max_{c}"), F.lit(missing)) if c else F.lit(missing)) for c, w in weights.items()]
    return rows.crossJoin(F.broadcast(top)).withColumn("risk", reduce(lambda a, b: a + b, terms)).drop(*(f"_max_{c}" for c in names))
