"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket
boundaries with the least padding; inside each bucket, documents are dealt to
batches of a token budget. Ranks inside a bucket come from counts of hashed
slices, so no task ever holds a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common, token_counts

#: Defaults: number of buckets, tokens of a batch with its padding.
BUCKETS, BUDGET = 16, 32768
#: Lengths above this share a bin with those of the same 15 leading bits, so the histogram has a fixed bound of about
#: 2 ** 19 rows. A bin gives its greatest length as a possible bound and its exact sum: a bucket's bound is a
#: real length, and only bounds inside a bin, less than a 2 ** -14 of the length apart, are not tried.
EXACT_LENGTH = 1 << 15
#: Documents of a slice on average.
SLICE = 20_000


def optimal_bounds(histogram: list[tuple], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding.

    histogram: (length, count), lengths distinct, or (greatest length, count,
    sum of lengths) of bins. cost(i, j) = L[j] * (N[j] - N[i]) - (S[j] - S[i])
    is linear in L[j] for each i, so each round keeps a lower hull
    of lines and needs one pass. Of equal optima, the one with fewer buckets.
    """
    rows = sorted(x for x in histogram if x[0] > 0)
    if not rows:
        return []
    counts, sums = [0], [0]
    for length, n, *total in rows:
        counts.append(counts[-1] + n)
        sums.append(sums[-1] + (total[0] if total else length * n))
    n = len(rows)
    best = [0] + [rows[j][0] * counts[j + 1] - sums[j + 1] for j in range(n)]
    rounds = [[0] * (n + 1)]
    done, k_best = best[n], 1
    for k in range(2, min(buckets, n) + 1):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        now, chosen, at = [0] * (n + 1), [0] * (n + 1), 0
        for j in range(1, n + 1):
            i = j - 1
            if i >= k - 1:
                line = (-counts[i], best[i] + sums[i], i)
                while len(hull) > 1:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (line[1] - b1) * (m1 - m2) <= (b2 - b1) * (m1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                now[j] = best[j]
                chosen[j] = -1
                continue
            x = rows[j - 1][0]
            value = lambda h, x=x: h[0] * x + h[1]
            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            now[j] = value(hull[at]) + x * counts[j] - sums[j]
            chosen[j] = hull[at][2]
        rounds.append(chosen)
        best = now
        if best[n] < done:
            done, k_best = best[n], k
    bounds, j = [], n
    for k in range(k_best, 0, -1):
        bounds.append(rows[j - 1][0])
        j = rounds[k - 1][j] if k > 1 else 0
    return bounds[::-1]


def binned(length: Column) -> Column:
    """Lengths up to EXACT_LENGTH as they are, longer ones rounded up to 15 leading bits: the name of their bin."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 14).cast("long")
    return F.when(length <= EXACT_LENGTH, length).otherwise(F.ceil(length / step).cast("long") * step)


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: id_col, length, bucket, bucket_length, batch, slot, padding.

    length: an expression over docs (default: words of the text). bucket counts
    from 0 by rising bucket_length; batch counts from 0 inside its bucket and
    holds floor(budget / bucket_length) documents, at least one, so a document
    longer than the budget is a batch alone; slot is the
    place in the batch. A document of no words, or null, is in no batch: bucket and the
    columns after it are null. Order inside a bucket is by a hash of the id and text,
    then id; rows without id are dealt like others, and equal rows take neighbouring places. An empty
    table gives an empty table; other columns are not read. Texts are read once, for (id, length, hash).
    """
    spark = docs.sparkSession
    size = F.coalesce(length if length is not None else word_count(F.col(text_col)), F.lit(0)).cast("long")
    rows = common.saved(docs.select(F.col(id_col).alias("_id"), size.alias("_n"), F.xxhash64(id_col, text_col).alias("_h")), "lengths")
    # the fixed bound of binned() holds for what comes to the driver
    bins = rows.groupBy(binned(F.col("_n")).alias("_l")).agg(F.max("_n").alias("m"), F.count(F.lit(1)).alias("c"), F.sum("_n").alias("s"))
    histogram = [(r.m, r.c, r.s) for r in bins.collect()]
    bounds = optimal_bounds(histogram, buckets)
    total = sum(x[1] for x in histogram)
    slices = max(1, total // SLICE)
    if bounds:
        bucket = F.array_position(F.transform(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("_n")), True).cast("int") - 1
        bound = F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("_b") + 1)
    else:
        bucket, bound = F.lit(None).cast("int"), F.lit(None).cast("long")
    rows = rows.withColumn("_b", F.when(F.col("_n") > 0, bucket)).withColumn("_s", F.pmod("_h", F.lit(slices)))
    counts = rows.filter("_b is not null").groupBy("_b", "_s").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", "_s", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b", "_s").orderBy("_h", "_id")
    placed = rows.withColumn("_k", F.row_number().over(inside)).join(offsets, ["_b", "_s"], "left")
    rank = F.col("_o") + F.col("_k") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_c")))
    out = placed.withColumn("_c", bound).withColumns({"_r": rank, "_w": room})
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").alias("length"), F.col("_b").alias("bucket"), F.col("_c").alias("bucket_length"),
        F.floor(F.col("_r") / F.col("_w")).cast("long").alias("batch"), F.pmod("_r", "_w").cast("long").alias("slot"), (F.col("_c") - F.col("_n")).alias("padding"),
    )


def pack_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """pack() with the token counts of a model file as lengths; the texts are read once, by the count."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_key"))
    counted = token_counts.count_tokens(rows, model_path, "_id", "_text", keep=("_key",))
    return pack(counted, "_id", "_key", F.col("n_tokens"), buckets, budget).withColumnRenamed("_id", id_col)
