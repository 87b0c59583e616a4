"""Typed entities and relations over the tables of one directory or revision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """An entity kind: its table, key column, and fields by name."""

    table: str
    key: str
    fields: dict[str, str]


KINDS = {
    "region": Kind("region", "r_regionkey", {"name": "r_name"}),
    "nation": Kind("nation", "n_nationkey", {"name": "n_name"}),
    "customer": Kind("customer", "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
    "supplier": Kind("supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}),
    "part": Kind("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "order": Kind("orders", "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}),
}

#: Relation: kinds of its source and target, and the table with the columns of both ends.
RELATIONS = {
    "in_region": ("nation", "region", "nation", "n_nationkey", "n_regionkey"),
    "customer_in": ("customer", "nation", "customer", "c_custkey", "c_nationkey"),
    "supplier_in": ("supplier", "nation", "supplier", "s_suppkey", "s_nationkey"),
    "placed_by": ("order", "customer", "orders", "o_orderkey", "o_custkey"),
    "contains": ("order", "part", "lineitem", "l_orderkey", "l_partkey"),
    "shipped_by": ("order", "supplier", "lineitem", "l_orderkey", "l_suppkey"),
    "supplies": ("supplier", "part", "lineitem", "l_suppkey", "l_partkey"),
}

#: Relations that lead from a member to its parent concept.
HIERARCHY = ("in_region", "customer_in", "placed_by")


class UnknownName(ValueError):
    """A kind, field or relation that the catalog doesn't have."""


class Catalog:
    """Lazy frames of entities and edges; nothing is read until a plan runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def kind(self, kind: str) -> Kind:
        if kind not in KINDS:
            raise UnknownName(f"no kind {kind!r}")
        return KINDS[kind]

    def entities(self, kind: str, fields: list[str] | None = None) -> DataFrame:
        """id and fields of a kind; an unknown field is an error, None means all fields."""
        k = self.kind(kind)
        for f in fields or ():
            if f not in k.fields:
                raise UnknownName(f"{kind} has no field {f!r}")
        names = list(k.fields) if fields is None else fields
        return self.table(k.table).select(F.col(k.key).cast("long").alias("id"), *(F.col(k.fields[f]).alias(f) for f in names))

    def edges(self, relation: str, incoming: bool = False) -> DataFrame:
        """Distinct (source, target) of a relation, turned round if incoming."""
        if relation not in RELATIONS:
            raise UnknownName(f"no relation {relation!r}")
        source, target, table, a, b = RELATIONS[relation]
        if incoming:
            a, b = b, a
        e = self.table(table).select(F.col(a).cast("long").alias("source"), F.col(b).cast("long").alias("target"))
        return e.distinct() if table == "lineitem" else e

    def ends(self, relation: str, incoming: bool = False) -> tuple[str, str]:
        if relation not in RELATIONS:
            raise UnknownName(f"no relation {relation!r}")
        source, target = RELATIONS[relation][:2]
        return (target, source) if incoming else (source, target)
