"""Several outputs of one request, in the order of their dependencies, each with a status."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession


class CyclicOutputs(ValueError):
    """Outputs that need each other."""


def run_outputs(spark: SparkSession, outputs: dict[str, tuple[tuple[str, ...], Callable[[], DataFrame], int]]) -> DataFrame:
    """(output, status, n): ready, empty, truncated (more than its limit), failed, or unavailable (needs one that failed).

    outputs: name -> (names it needs, plan, limit). At most limit + 1 rows of each are counted.
    """
    unknown = {n for needs, _, _ in outputs.values() for n in needs} - set(outputs)
    if unknown:
        raise ValueError(f"no outputs {sorted(unknown)}")
    try:
        order = list(TopologicalSorter({k: v[0] for k, v in outputs.items()}).static_order())
    except CycleError as e:
        raise CyclicOutputs(str(e)) from e
    found: dict[str, tuple[str, int | None]] = {}
    for name in order:
        needs, plan, limit = outputs[name]
        if any(found[n][0] in ("failed", "unavailable") for n in needs):
            found[name] = ("unavailable", None)
            continue
        try:
            n = plan().limit(limit + 1).count()
            found[name] = ("truncated" if n > limit else "ready" if n else "empty", min(n, limit))
        except Exception:  # best effort: the status says it
            found[name] = ("failed", None)
    return spark.createDataFrame([(k, *found[k]) for k in outputs], "output string, status string, n long")
