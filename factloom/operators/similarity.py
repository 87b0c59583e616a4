"""Duplicates, nearest neighbours and hashed embeddings, exact and without all pairs where a key allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalar import l2_distance


def exact_classes(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, class, size) of rows whose content another row has: class is the smallest key."""
    h = rows.select(key, F.sha2(content, 256).alias("_h"))
    classes = h.groupBy("_h").agg(F.min(key).alias("class"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return h.join(classes, "_h").select(key, "class", "size")


def shared_lines(rows: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """(line, holders, first): normalised lines that several rows hold, longest texts included, no pairs made."""
    lines = rows.select(key, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(x))))).alias("line")).filter(F.length("line") >= least)
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("holders"), F.min(key).alias("first")).filter("holders > 1")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = 1000) -> DataFrame:
    """query, rank, id, distance: the k nearest rows of each query vector, itself excluded, ties to the smaller id.

    The stated queries are checked to be few, then sent to the blocks of the
    vectors; each block keeps its own k before anything is shuffled.
    """
    n = queries.limit(most_queries + 1).count()
    if n > most_queries:
        raise ValueError(f"more than {most_queries} queries: run them in blocks")
    q = F.broadcast(queries.select(F.col("id").alias("query"), F.col("vector").alias("_q")))
    rows = vectors.join(q, F.col("id") != F.col("query")).select("query", "id", l2_distance(F.col("vector"), F.col("_q")).alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hashed_embedding(rows: DataFrame, key: str, words: str, size: int = 64) -> DataFrame:
    """(key, slot, value) of a hashing-trick embedding: each word adds 1 and 1/2 to two slots; L2-normalised."""
    h = F.sha2(F.col("_w"), 256)
    part = lambda at: (F.conv(F.substring(h, at, 2), 16, 10).cast("int") % size)
    each = rows.select(key, F.explode(words).alias("_w"))
    both = each.select(key, F.explode(F.array(F.struct(part(1).alias("slot"), F.lit(1.0).alias("v")), F.struct(part(3).alias("slot"), F.lit(0.5).alias("v")))).alias("_s"))
    sums = both.groupBy(key, F.col("_s.slot").alias("slot")).agg(F.sum("_s.v").alias("v"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return sums.join(norms, key).select(key, "slot", (F.col("v") / F.col("n")).alias("value"))
