"""A ledger of derivation stages: one that fails is recorded, later ones run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_stages(spark: SparkSession, stages: dict[str, Callable[[], object]]) -> DataFrame:
    """(stage, status, error) after running each stage in turn."""
    rows = []
    for name, stage in stages.items():
        try:
            stage()
            rows.append((name, "done", None))
        except Exception as e:  # the ledger is what a failure goes to
            rows.append((name, "failed", str(e)[:200]))
    return spark.createDataFrame(rows, "stage string, status string, error string")
