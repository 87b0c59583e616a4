"""Cubes over a query's entities: cells, measures, HAVING, totals, pivot keys, facets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.catalog import RELATIONS, Catalog

MAX_DIMENSIONS, MAX_MEASURES = 8, 32


@dataclass(frozen=True)
class Measure:
    """count, or sum, avg, min, max of a field; each entity counts once in a cell."""

    name: str
    op: str = "count"
    field: str | None = None

    def column(self) -> Column:
        if self.op == "count":
            return F.count(F.lit(1)).alias(self.name)
        c = F.col(self.field).cast("double")
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.op](c).alias(self.name)

    @property
    def additivity(self) -> str:
        """What may be added over cells that share entities: counts and averages can't, sums can, extremes fold."""
        return {"count": "non_additive", "avg": "non_additive", "sum": "additive"}.get(self.op, "semi_additive")


@dataclass(frozen=True)
class Cube:
    dimensions: dict[str, str]
    measures: tuple[Measure, ...]
    having: Column | None = None
    order: tuple[Column, ...] = ()
    limit: int | None = None
    buckets: dict[str, object] = field(default_factory=dict)


def members_of(catalog: Catalog, kind: str, dimension: str) -> DataFrame:
    """(id, member) by a dimension: a field, or relation/.../field of one to four steps; several members fan out."""
    *steps, name = dimension.split("/")
    if len(steps) > 4:
        raise ValueError("a dimension takes at most four steps")
    if not steps:
        return catalog.entities(kind, [name]).select("id", F.col(name).alias("member"))
    here, at = None, kind
    for step in steps:
        incoming = step.startswith("~")
        relation = step.lstrip("~")
        a, b = catalog.ends(relation, incoming)
        if a != at:
            raise ValueError(f"{relation} starts at {a}, not {at}")
        edges = catalog.edges(relation, incoming)
        here = edges.select(F.col("source").alias("id"), F.col("target").alias("at")) if here is None else here.join(edges, F.col("at") == F.col("source")).select("id", F.col("target").alias("at"))
        at = b
    ends = catalog.entities(at, [name]).select(F.col("id").alias("at"), F.col(name).alias("member"))
    return here.join(ends, "at").select("id", "member").distinct()


def fan_out(catalog: Catalog, kind: str, ids: DataFrame, cube: Cube) -> DataFrame:
    """One row for each entity and combination of its distinct members, with the measures' fields."""
    if not cube.dimensions or len(cube.dimensions) > MAX_DIMENSIONS or len(cube.measures) > MAX_MEASURES:
        raise ValueError(f"a cube has 1 to {MAX_DIMENSIONS} dimensions and up to {MAX_MEASURES} measures")
    fields = sorted({m.field for m in cube.measures if m.field})
    plain = {n: d for n, d in cube.dimensions.items() if "/" not in d}
    rows = catalog.entities(kind, sorted({*fields, *plain.values()})).join(ids, "id", "left_semi")
    rows = rows.select("id", *fields, *(F.col(d).alias(f"_{n}") for n, d in plain.items()))
    for name, d in cube.dimensions.items():
        if name not in plain:
            rows = rows.join(members_of(catalog, kind, d).withColumnRenamed("member", f"_{name}"), "id")
    for name in cube.dimensions:
        bucket = cube.buckets.get(name)
        rows = rows.withColumn(name, bucket(F.col(f"_{name}")) if bucket else F.col(f"_{name}")).drop(f"_{name}")
    # a bucket may make two members of one entity the same
    return rows.dropDuplicates(["id", *cube.dimensions]) if any("/" in d for d in cube.dimensions.values()) else rows


def cells(catalog: Catalog, kind: str, ids: DataFrame, cube: Cube) -> DataFrame:
    rows = fan_out(catalog, kind, ids, cube)
    out = rows.groupBy(*cube.dimensions).agg(*(m.column() for m in cube.measures))
    if cube.having is not None:
        out = out.filter(cube.having)
    if cube.order:
        out = out.orderBy(*cube.order)
    return out if cube.limit is None else out.limit(cube.limit)


def grand_totals(catalog: Catalog, kind: str, ids: DataFrame, cube: Cube) -> DataFrame:
    """Measures over the population before HAVING; an entity in many cells counts once."""
    fields = sorted({m.field for m in cube.measures if m.field})
    return catalog.entities(kind, fields).join(ids, "id", "left_semi").agg(*(m.column() for m in cube.measures))


def page_totals(catalog: Catalog, kind: str, ids: DataFrame, cube: Cube) -> DataFrame:
    """Measures over the distinct entities of the displayed cells."""
    shown = cells(catalog, kind, ids, cube).select(*cube.dimensions)
    rows = fan_out(catalog, kind, ids, cube)
    same = reduce(lambda a, b: a & b, (rows[d].eqNullSafe(shown[d]) for d in cube.dimensions))
    mine = rows.join(shown, same, "left_semi").dropDuplicates(["id"])
    return mine.agg(*(m.column() for m in cube.measures))


def is_partition(catalog: Catalog, kind: str, ids: DataFrame, cube: Cube) -> DataFrame:
    """One row: disjoint (no entity in two cells), complete (every entity in one)."""
    rows = fan_out(catalog, kind, ids, cube).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("distinct_ids"))
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    return rows.crossJoin(total).select((F.col("rows") == F.col("distinct_ids")).alias("disjoint"), (F.col("distinct_ids") == F.col("total")).alias("complete"))


def facets(catalog: Catalog, kind: str, population: dict[str, DataFrame], dimensions: dict[str, str]) -> DataFrame:
    """(dimension, member, n) for each dimension over its own population (without the dimension's own filter)."""
    parts = []
    for name, d in dimensions.items():
        rows = members_of(catalog, kind, d).join(population[name], "id", "left_semi").distinct()
        parts.append(rows.groupBy(F.lit(name).alias("dimension"), F.col("member").cast("string").alias("member")).agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def relation_names() -> list[str]:
    return sorted(RELATIONS)
