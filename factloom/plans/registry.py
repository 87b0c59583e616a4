"""Registry of named queries: a Spark plan each, with DuckDB SQL for the same rows where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Modules whose import registers queries.
MODULES = ("q_select", "q_joins", "q_aggregates", "q_windows", "q_graph", "q_text", "q_rules", "q_more")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one directory, read lazily by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None):
    """Register a function from Tables to a DataFrame, with the oracle's SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            _ORACLES[key] = oracle
        return f

    return add


@query(
    """select c_mktsegment as segment, strftime(o_orderdate, '%Y-%m') as month, count(distinct o_orderkey) as n_orders, round(sum(o_totalprice), 2) as total
    from orders join customer on o_custkey = c_custkey where o_totalprice > 1000 group by 1, 2 having count(distinct o_orderkey) > 1
    order by n_orders desc, segment, month limit 10"""
)
def flagship_cube(t: Tables) -> DataFrame:
    """Orders above a price by customer segment and month, with HAVING, ordered, top 10."""
    rows = t.orders.filter("o_totalprice > 1000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    cells = rows.groupBy(F.col("c_mktsegment").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    out = cells.agg(F.countDistinct("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.filter("n_orders > 1").orderBy(F.desc("n_orders"), "segment", "month").limit(10)


def _load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"factloom.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
