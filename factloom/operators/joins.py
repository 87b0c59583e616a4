"""Joins beyond equality: containment, spans, as-of, resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_key(left: DataFrame, right: DataFrame, left_key: str, right_keys: list[Column]) -> DataFrame:
    """Rows of left whose key equals any of several keys of right: one equi-join on their distinct keys, so each pair of rows stands once."""
    keyed = right.withColumn("_key", F.explode(F.array_distinct(F.array(*right_keys))))
    return left.join(keyed, left[left_key] == keyed["_key"]).drop("_key")


def point_in_span(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, bin_size: int) -> DataFrame:
    """The innermost span [start, end) of the same group that covers each point.

    Spans are dealt to the bins they touch, so the join is on (group, bin); a
    tie of lengths goes to the smaller start. Equal points are found once and come back as often as they stand.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))))
    asked = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bin", F.floor(F.col(at) / bin_size))
    found = asked.join(binned, [group, "_bin"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    inner = Window.partitionBy(*points.columns).orderBy(F.col(end) - F.col(start), start)
    return found.withColumn("_n", F.row_number().over(inner)).filter("_n = 1").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_n", "_bin", "_copies", "_copy")


def overlapping(a: DataFrame, b: DataFrame, group: str, bin_size: int) -> DataFrame:
    """Pairs of a (a_start, a_end) and b (b_start, b_end) of one group whose half-open spans overlap, each once."""
    deal = lambda df, p: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / bin_size), F.floor((F.col(f"{p}_end") - 1) / bin_size))))
    both = deal(a, "a").join(deal(b, "b"), [group, "_bin"])
    first = F.floor(F.greatest("a_start", "b_start") / bin_size)
    return both.filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("_bin") == first)).drop("_bin")


def contained_first(texts: DataFrame, needles: DataFrame, text: str, needle: str, order: str, limit: int = 10_000) -> DataFrame:
    """Each text with the first needle, by order, that it contains; null if none. needles: at most `limit` rows, checked.

    The needles come to every task as one sorted array, so texts are not moved and equal rows all stay.
    """
    n = needles.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} needles: split them by a key first")
    sorted_needles = needles.filter(F.col(needle).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(needle).alias("n")))).alias("_needles"))
    hit = F.filter("_needles", lambda x: F.col(text).contains(x["n"]))
    return texts.crossJoin(F.broadcast(sorted_needles)).withColumn(needle, F.get(hit, F.lit(0))["n"]).drop("_needles")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, rev: str, value: str) -> DataFrame:
    """Each left row with the value of its key's latest right row at or before `at`: a union and one window, no range join.

    Of several right rows at the latest rev, the greatest value counts.
    """
    latest = right.groupBy(by, rev).agg(F.max(value).alias(value))
    tagged = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), F.col(at).alias("_at"))
    events = latest.select(F.col(by), F.col(value).alias("_v"), F.lit(0).alias("_side"), F.col(rev).alias("_at"))
    both = tagged.unionByName(events, allowMissingColumns=True)
    upto = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(upto)).filter("_side = 1").drop("_v", "_side", "_at")


def unique_names(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(name, key) of names that one key has, over all groups."""
    return rows.groupBy(name).agg(F.min(key).alias(key), F.countDistinct(key).alias("_n")).filter("_n = 1").drop("_n")
