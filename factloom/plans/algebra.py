"""A small typed query algebra that compiles to lazy Spark plans.

A query gives a set of entity ids of known kinds. Kinds, fields, relations and
depths are validated before any plan is built. Predicates on fields become one
filter; quantified relation predicates become semi and anti joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import fold_case
from factloom.sources.catalog import HIERARCHY, RELATIONS, Catalog, UnknownName

MAX_DEPTH = 8


class InvalidQuery(ValueError):
    """A query that breaks a rule of the algebra."""


@dataclass(frozen=True)
class All:
    """Every entity."""


@dataclass(frozen=True)
class Ids:
    """Entities of the given ids; an id that doesn't exist is an error where `check` runs."""

    ids: tuple[int, ...]


@dataclass(frozen=True)
class And:
    of: tuple


@dataclass(frozen=True)
class Or:
    of: tuple


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Test:
    """A field against a value: eq, in, prefix, contains, prefix_fold, contains_fold, gt, ge, lt, le.

    Equality is null-safe. Text and number tests on a null are false, or an
    error where strict.
    """

    field: str
    op: str
    value: Any
    strict: bool = False


@dataclass(frozen=True)
class Related:
    """Entities related to the target set: any of it, all of a set that isn't empty, or none."""

    relation: str
    target: Any
    quantifier: str = "any"
    incoming: bool = False


@dataclass(frozen=True)
class Member:
    """Members of concepts (kind, ids): directly below, or anywhere below."""

    kind: str
    ids: tuple[int, ...]
    descendants: bool = False


@dataclass(frozen=True)
class Select:
    kind: str
    filter: Any = All()


@dataclass(frozen=True)
class Union:
    of: tuple


@dataclass(frozen=True)
class Intersect:
    of: tuple


@dataclass(frozen=True)
class Difference:
    left: Any
    right: Any


@dataclass(frozen=True)
class Follow:
    """Entities first reached in min_depth to max_depth steps; the start set is never reached again."""

    start: Any
    relation: str
    incoming: bool = False
    min_depth: int = 1
    max_depth: int = 1


@dataclass(frozen=True)
class CellContributors:
    """The exact population of a cube cell: the query's entities whose dimensions have the cell's members."""

    query: Any
    cell: tuple[tuple[str, Any], ...]


NUMERIC = {"gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}
TEXT = ("prefix", "contains", "prefix_fold", "contains_fold")


def kinds_of(q: Any) -> frozenset[str]:
    """The kinds that a query can give, or InvalidQuery."""
    match q:
        case Select(kind, _):
            return frozenset([kind])
        case Union(of) | Intersect(of):
            if not of:
                raise InvalidQuery("a set operation needs an operand")
            domains = [kinds_of(x) for x in of]
            if isinstance(q, Union):
                if any(d != domains[0] for d in domains):
                    raise InvalidQuery("a union needs operands of one kind")
                return domains[0]
            both = frozenset.intersection(*domains)
            if not both:
                raise InvalidQuery("an intersection of kinds that have nothing in common")
            return both
        case Difference(left, right):
            if kinds_of(left) != kinds_of(right):
                raise InvalidQuery("a difference needs operands of one kind")
            return kinds_of(left)
        case Follow(start, relation, incoming, low, high):
            if not 1 <= low <= high <= MAX_DEPTH:
                raise InvalidQuery(f"depths must be 1 <= min <= max <= {MAX_DEPTH}")
            if relation not in RELATIONS:
                raise UnknownName(f"no relation {relation!r}")
            a, b = RELATIONS[relation][:2]
            if incoming:
                a, b = b, a
            if kinds_of(start) != {a}:
                raise InvalidQuery(f"{relation} starts at {a}")
            if high > 1 and a != b:
                raise InvalidQuery(f"{relation} leads from {a} to {b} and can't be followed twice")
            return frozenset([b])
        case CellContributors(query, _):
            return kinds_of(query)
    raise InvalidQuery(f"no query: {q!r}")


def _condition(p: Any, catalog: Catalog, kind: str) -> Column | None:
    """p as one Column over the kind's entities, or None if it needs a join."""
    match p:
        case All():
            return F.lit(True)
        case Ids(ids):
            return F.col("id").isin(*ids) if ids else F.lit(False)
        case And(of) | Or(of):
            if not of:
                raise InvalidQuery("And and Or need an operand")
            parts = [_condition(x, catalog, kind) for x in of]
            if any(x is None for x in parts):
                return None
            out = parts[0]
            for x in parts[1:]:
                out = out & x if isinstance(p, And) else out | x
            return out
        case Not(of):
            inner = _condition(of, catalog, kind)
            return None if inner is None else ~inner
        case Test(field, op, value, strict):
            if field not in catalog.kind(kind).fields and field != "id":
                raise UnknownName(f"{kind} has no field {field!r}")
            c = F.col(field)
            if op == "eq":
                return c.eqNullSafe(F.lit(value))
            if op == "in":
                out = F.coalesce(c.isin(*[v for v in value if v is not None]), F.lit(False)) if any(v is not None for v in value) else F.lit(False)
                return out | c.isNull() if None in value else out
            if op in NUMERIC:
                c, test = c.cast("double"), NUMERIC[op]
                found = getattr(c, test)(F.lit(float(value)))
            elif op in TEXT:
                text = fold_case(c) if op.endswith("fold") else c
                value = F.lit(value)
                found = (text.startswith if op.startswith("prefix") else text.contains)(fold_case(value) if op.endswith("fold") else value)
            else:
                raise InvalidQuery(f"no test {op!r}")
            if strict:
                return F.when(c.isNull(), F.raise_error(F.lit(f"{field} has no value"))).otherwise(found)
            return F.coalesce(found, F.lit(False))
        case Related() | Member():
            return None
    raise InvalidQuery(f"no predicate: {p!r}")


def matching(p: Any, catalog: Catalog, kind: str) -> DataFrame:
    """Ids of a kind's entities that satisfy p."""
    simple = _condition(p, catalog, kind)
    if simple is not None:
        return catalog.entities(kind).filter(simple).select("id")
    match p:
        case And(of):
            out = matching(of[0], catalog, kind)
            for x in of[1:]:
                out = out.join(matching(x, catalog, kind), "id", "left_semi")
            return out
        case Or(of):
            out = matching(of[0], catalog, kind)
            for x in of[1:]:
                out = out.unionByName(matching(x, catalog, kind))
            return out.distinct()
        case Not(of):
            return catalog.entities(kind, []).join(matching(of, catalog, kind), "id", "left_anti")
        case Related(relation, target, quantifier, incoming):
            a, b = catalog.ends(relation, incoming)
            if a != kind or kinds_of(target) != {b}:
                raise InvalidQuery(f"{relation} relates {a} to {b}")
            goal = compile_query(target, catalog)
            ids = catalog.entities(kind, [])
            linked = catalog.edges(relation, incoming).join(goal.select(F.col("id").alias("target")), "target", "left_semi")
            if quantifier == "any":
                return ids.join(linked.select(F.col("source").alias("id")), "id", "left_semi")
            if quantifier == "none":
                return ids.join(linked.select(F.col("source").alias("id")), "id", "left_anti")
            if quantifier != "all":
                raise InvalidQuery(f"no quantifier {quantifier!r}")
            # relational division: the target's size is one row
            size = goal.agg(F.count(F.lit(1)).alias("size"))
            found = linked.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("n"))
            return found.join(F.broadcast(size), F.col("n") == F.col("size")).select("id").join(ids, "id", "left_semi")
        case Member(concept, ids, descendants):
            return members(catalog, kind, concept, ids, descendants)
    raise InvalidQuery(f"no predicate: {p!r}")


def members(catalog: Catalog, kind: str, concept: str, ids: tuple[int, ...], descendants: bool) -> DataFrame:
    """Entities of kind below the given concepts: one step down the hierarchy, or any number."""
    here, found = catalog.entities(concept, []).filter(F.col("id").isin(*ids)), concept
    steps = 0
    while found != kind:
        below = [r for r in HIERARCHY if RELATIONS[r][1] == found]
        if not below or (steps and not descendants):
            raise InvalidQuery(f"{kind} isn't below {concept}")
        here = catalog.edges(below[0]).join(here.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
        found, steps = RELATIONS[below[0]][0], steps + 1
    return here


def compile_query(q: Any, catalog: Catalog) -> DataFrame:
    """Distinct ids of a query's entities, as a lazy frame of one column id."""
    kinds_of(q)
    match q:
        case Select(kind, p):
            return matching(p, catalog, kind)
        case Union(of):
            out = compile_query(of[0], catalog)
            for x in of[1:]:
                out = out.unionByName(compile_query(x, catalog))
            return out.distinct()
        case Intersect(of):
            out = compile_query(of[0], catalog)
            for x in of[1:]:
                out = out.join(compile_query(x, catalog), "id", "left_semi")
            return out
        case Difference(left, right):
            return compile_query(left, catalog).join(compile_query(right, catalog), "id", "left_anti")
        case Follow(start, relation, incoming, low, high):
            from factloom.operators.graph import bfs

            seeds, edges = compile_query(start, catalog), catalog.edges(relation, incoming)
            a, b = catalog.ends(relation, incoming)
            if a != b:  # ids of two kinds never meet
                return edges.join(seeds.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
            return bfs(edges, seeds.select(F.col("id").alias("node")), high).filter(F.col("depth") >= low).select(F.col("node").alias("id"))
        case CellContributors(query, cell):
            from factloom.plans.cube import members_of

            out = compile_query(query, catalog)
            (kind,) = kinds_of(query)
            for dimension, member in cell:
                rows = members_of(catalog, kind, dimension).filter(F.col("member").eqNullSafe(F.lit(member)))
                out = out.join(rows, "id", "left_semi")
            return out
    raise InvalidQuery(f"no query: {q!r}")


def check_ids(q: Select, catalog: Catalog) -> list[int]:
    """Ids named by a selection that don't exist (for an error before the plan runs)."""
    wanted = [i for p in _walk(q.filter) if isinstance(p, Ids) for i in p.ids]
    if not wanted:
        return []
    there = catalog.entities(q.kind, []).filter(F.col("id").isin(*wanted)).collect()
    return sorted(set(wanted) - {r.id for r in there})


def _walk(p: Any):
    yield p
    for x in getattr(p, "of", ()) if isinstance(p, And | Or) else ([p.of] if isinstance(p, Not) else []):
        yield from _walk(x)
