"""Requests as plain data: a selection in JSON form, normalised to the algebra, and its outputs."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans import algebra as A
from factloom.plans import cube as C
from factloom.sources.catalog import KINDS, RELATIONS, Catalog

MAX_NESTING = 16


def predicate(d: Any, depth: int = 0) -> Any:
    """A predicate from {"all": []}, {"and": [...]}, {"or": [...]}, {"not": p}, {"ids": [...]}, {"field", "op", "value"}, {"related": {...}}, {"concept": {...}}."""
    if depth > MAX_NESTING:
        raise A.InvalidQuery("the predicate is nested too deep")
    match d:
        case None | {"all": _}:
            return A.All()
        case {"and": of}:
            return A.And(tuple(predicate(x, depth + 1) for x in of))
        case {"or": of}:
            return A.Or(tuple(predicate(x, depth + 1) for x in of))
        case {"not": of}:
            return A.Not(predicate(of, depth + 1))
        case {"ids": ids}:
            return A.Ids(tuple(ids))
        case {"related": r}:
            return A.Related(r["relation"], query(r["target"], depth + 1), r.get("quantifier", "any"), r.get("incoming", False))
        case {"concept": c}:
            return A.Member(c["kind"], tuple(c["ids"]), c.get("descendants", False))
        case {"field": field, **rest}:
            value = rest.get("value")
            return A.Test(field, rest.get("op", "eq"), tuple(value) if isinstance(value, list) else value, rest.get("strict", False))
    raise A.InvalidQuery(f"no predicate: {d!r}")


def query(d: dict, depth: int = 0) -> Any:
    """A query from {"select": kind, "where": predicate} or {"union" | "intersect": [...]}, {"difference": [a, b]}, {"follow": {...}}."""
    if depth > MAX_NESTING:
        raise A.InvalidQuery("the query is nested too deep")
    match d:
        case {"select": kind, **rest}:
            return A.Select(kind, predicate(rest.get("where"), depth + 1))
        case {"union": of}:
            return A.Union(tuple(query(x, depth + 1) for x in of))
        case {"intersect": of}:
            return A.Intersect(tuple(query(x, depth + 1) for x in of))
        case {"difference": [left, right]}:
            return A.Difference(query(left, depth + 1), query(right, depth + 1))
        case {"follow": f}:
            return A.Follow(query(f["start"], depth + 1), f["relation"], f.get("incoming", False), f.get("min_depth", 1), f.get("max_depth", 1))
    raise A.InvalidQuery(f"no query: {d!r}")


class Request:
    """One selection and its outputs, each a lazy frame."""

    def __init__(self, catalog: Catalog, selection: dict):
        self.catalog, self.selection, self.query = catalog, selection, query(selection)
        kinds = A.kinds_of(self.query)
        if len(kinds) != 1:
            raise A.InvalidQuery("a selection has one kind")
        (self.kind,) = kinds
        self.ids = A.compile_query(self.query, catalog)

    def entities(self, fields: list[str] | None = None, order: list | None = None, limit: int = 500) -> DataFrame:
        rows = self.catalog.entities(self.kind, fields).join(self.ids, "id", "left_semi")
        return rows.orderBy(*(order or []), "id").limit(limit)

    def relationships(self, relation: str) -> DataFrame:
        """Edges of a relation that start at a match."""
        return self.catalog.edges(relation).join(self.ids.select(F.col("id").alias("source")), "source", "left_semi")

    def evidence(self) -> DataFrame:
        """Where each match comes from: its table and key."""
        k = KINDS[self.kind]
        return self.ids.select("id", F.lit(k.table).alias("source_table"), F.concat_ws("=", F.lit(k.key), "id").alias("locator"))

    def cube(self, cube: C.Cube) -> DataFrame:
        return C.cells(self.catalog, self.kind, self.ids, cube)

    def facets(self, dimensions: dict[str, str]) -> DataFrame:
        return C.facets(self.catalog, self.kind, dict.fromkeys(dimensions, self.ids), dimensions)

    def detail(self, entity: int) -> DataFrame:
        return self.catalog.entities(self.kind).filter(F.col("id") == entity).join(self.ids, "id", "left_semi")

    def semantic_hash(self) -> str:
        """Equal for selections that differ only in the order of keys."""
        return hashlib.sha256(json.dumps(self.selection, sort_keys=True).encode()).hexdigest()

    def explain(self) -> str:
        return self.ids._sc._jvm.PythonSQLUtils.explainString(self.ids._jdf.queryExecution(), "formatted")


def describe() -> list[tuple[str, str, str]]:
    """(kind of thing, name, description) of all that a request can name."""
    out = [("kind", k, ",".join(sorted(v.fields))) for k, v in sorted(KINDS.items())]
    return out + [("relation", r, f"{v[0]}->{v[1]}") for r, v in sorted(RELATIONS.items())]


def check_view(spec: dict) -> list[str]:
    """Faults of a view of nodes and edges: repeated or dangling ids, too many elements."""
    nodes = [n["id"] for n in spec.get("nodes", [])]
    faults = [f"repeated node {n}" for n in sorted({n for n in nodes if nodes.count(n) > 1})]
    faults += [f"edge to nothing: {e['source']}->{e['target']}" for e in spec.get("edges", []) if e["source"] not in nodes or e["target"] not in nodes]
    return faults + (["too many elements"] if len(nodes) + len(spec.get("edges", [])) > 500 else [])


def view_hash(spec: dict) -> str:
    """A canonical hash: the order of nodes and edges doesn't count."""
    key = lambda x: json.dumps(x, sort_keys=True)
    return hashlib.sha256(key({"nodes": sorted(spec.get("nodes", []), key=key), "edges": sorted(spec.get("edges", []), key=key)}).encode()).hexdigest()
