"""Structured Streaming over the events table: totals, windows with watermarks, span mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.scratch import scratch_path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream; their local time stamps are taken as UTC instants, so a watermark can follow them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type; a window ends when the watermark passes it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def user_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("event_type") == "error").alias("errors"))


def run_to_end(rows: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """Run a stream over all that is there and read what it wrote; each batch lands in its own folder, so a repeated one replaces itself."""
    out = scratch_path(spark, "stream")

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")

    query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(out)
    if mode == "complete":
        last = written.agg(F.max("batch")).first()[0]
        written = written.filter(F.col("batch") == last)
    return written.drop("batch")


def totals_of_stream(spark: SparkSession, path: str) -> DataFrame:
    return run_to_end(user_totals(event_stream(spark, path)), "complete", spark)


def late_matches(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream join: a purchase with the views of its user in the hour before it; state is bounded by the watermarks."""
    left = events.filter("event_type = 'purchase'").select(F.col("user_id"), F.col("ts").alias("bought"), F.col("event_id").alias("purchase")).withWatermark("bought", "2 hours")
    right = events.filter("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("ts").alias("seen"), F.col("event_id").alias("view")).withWatermark("seen", "2 hours")
    return left.join(right, F.expr(f"user_id = viewer and seen <= bought and seen > bought - interval {within}")).select("purchase", "view")


def running_gap(events: DataFrame) -> DataFrame:
    """Custom state: the longest time between two events of a user, kept in one row of state a user."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        last, longest, n = state.get if state.exists else (0, 0, 0)
        stamps = sorted(int(t) for pdf in batches for t in pdf["s"])
        for t in stamps:
            longest = max(longest, t - last) if n else 0
            last, n = max(last, t), n + 1
        state.update((last, longest, n))
        yield pd.DataFrame({"user_id": [key[0]], "longest_gap": [longest], "n": [n]})

    rows = events.select("user_id", F.unix_timestamp("ts").alias("s"))
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, longest_gap long, n long", "last long, longest long, n long", "update", GroupStateTimeout.NoTimeout)
