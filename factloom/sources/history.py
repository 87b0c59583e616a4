"""Version history as text to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_numstat(logs: DataFrame, text: str = "log") -> DataFrame:
    """(commit, path, added, deleted, is_binary) of logs: "commit ID" headers, then added TAB deleted TAB path; - means binary."""
    blocks = logs.select(F.explode(F.filter(F.split(text, r"(?m)^commit "), lambda b: F.trim(b) != "")).alias("b"))
    lines = blocks.select(F.split("b", "\n").alias("l")).select(F.trim(F.col("l")[0]).alias("commit"), F.explode(F.slice("l", 2, F.size("l"))).alias("line")).filter("line <> ''")
    parts = F.split("line", "\t")
    return lines.select("commit", parts[2].alias("path"), parts[0].try_cast("int").alias("added"), parts[1].try_cast("int").alias("deleted"), ((parts[0] == "-") | (parts[1] == "-")).alias("is_binary"))
