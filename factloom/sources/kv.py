"""An ordered key-value store as an append-only table: the latest write of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.revision import latest


class KeyValue:
    """Writes (key, value, seq); a null value is a deletion. All reads are filters that reach the scan."""

    def __init__(self, writes: DataFrame):
        self.writes = writes

    def put(self, more: DataFrame) -> KeyValue:
        return KeyValue(self.writes.unionByName(more))

    def _live(self, rows: DataFrame) -> DataFrame:
        return latest(rows, ["key"], "seq").filter("value is not null").select("key", "value")

    def get(self, key: str) -> DataFrame:
        return self._live(self.writes.filter(F.col("key") == key))

    def prefix(self, prefix: str) -> DataFrame:
        return self._live(self.writes.filter(F.col("key").startswith(prefix)))

    def scan(self, low: str, high: str) -> DataFrame:
        """Keys in [low, high) in byte order."""
        return self._live(self.writes.filter((F.col("key") >= low) & (F.col("key") < high)))
