"""Revisions of tables: written under their own folder, published by a pointer that comes last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.scratch import scratch_path


class RevisionStore:
    """Tables by name and revision below a root folder; a revision without its pointer does not exist."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> RevisionStore:
        return cls(spark, scratch_path(spark, "revisions"))

    def _data(self, name: str, rev: int) -> str:
        return f"{self.root}/{name}/rev={rev}"

    def publish(self, df: DataFrame, name: str, rev: int) -> None:
        """Write the rows, then the pointer with their digest."""
        path = self._data(name, rev)
        df.write.option("compression", "zstd").parquet(path)
        digest = self._digest(self.spark.read.parquet(path))
        self.spark.createDataFrame([(rev, digest)], "rev long, digest string").coalesce(1).write.mode("append").json(f"{self.root}/{name}-head")

    @staticmethod
    def _digest(df: DataFrame) -> str:
        """An order-free digest: the count and two xors of row hashes."""
        row = F.to_json(F.struct(*sorted(df.columns)))
        n, a, b = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(row)), F.bit_xor(F.xxhash64(F.lit(1), row))).first()
        return f"{n}:{a}:{b}"

    def heads(self, name: str) -> DataFrame:
        return self.spark.read.schema("rev long, digest string").json(f"{self.root}/{name}-head")

    def revisions(self, name: str) -> list[int]:
        return sorted(r.rev for r in self.heads(name).collect())

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """The rows of the latest revision, at or before `at` if given."""
        found = [r for r in self.revisions(name) if at is None or r <= at]
        if not found:
            raise LookupError(f"{name} has no revision at or before {at}")
        return self.spark.read.parquet(self._data(name, found[-1]))

    def verify(self, name: str, rev: int) -> bool:
        """Whether the stored rows still have the published digest."""
        known = self.heads(name).filter(F.col("rev") == rev).first()
        return known is not None and known.digest == self._digest(self.spark.read.parquet(self._data(name, rev)))
