"""Operators over small groups: flow graphs of one function each, and concept lattices of small contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct graphs whose results a task keeps before it starts anew.
KNOWN = 100_000


def control_dependence(edges: DataFrame) -> DataFrame:
    """(function, node, depends_on) of flow graphs (function, source, target).

    A node without successor leads to the exit. Post-dominator sets shrink to
    their fixpoint; node n depends on a branch b if n post-dominates a successor of b, or is it, but not b.
    A function's edges are gathered as text; a task works out each distinct graph once and gives batches of functions their rows.
    """

    def depends(text):
        after: dict[int, set[int]] = {}
        for edge in text.split(";"):
            a, b = map(int, edge.split(","))
            after.setdefault(a, set()).add(b)
            after.setdefault(b, set())
        nodes, leave = sorted(after), object()
        after = {n: s or {leave} for n, s in after.items()} | {leave: set()}
        post = {n: {*nodes, leave} for n in nodes} | {leave: {leave}}
        changed = True
        while changed:
            changed = False
            for n in nodes:
                new = {n} | set.intersection(*(post[s] for s in after[n]))
                if new != post[n]:
                    post[n], changed = new, True
        return sorted({(n, b) for b in nodes if len(after[b]) > 1 for s in after[b] for n in post[s] if n is not leave and (n == b or n not in post[b])})

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known: dict[str, np.ndarray] = {}
        for b in batches:
            coded = pc.dictionary_encode(b.column(1))
            if len(known) >= KNOWN:
                known = {}
            rows = []
            for text in coded.dictionary.to_pylist():
                if text not in known:
                    known[text] = np.array(depends(text), np.int64).reshape(-1, 2)
                rows.append(known[text])
            code, size = coded.indices.to_numpy(), np.array([len(r) for r in rows], np.int64)
            mine = size[code]
            first = (np.cumsum(size) - size)[code] - (np.cumsum(mine) - mine)
            pairs = np.concatenate(rows)[np.repeat(first, mine) + np.arange(mine.sum())]
            function = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), mine)))
            yield pa.RecordBatch.from_arrays([function, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["function", "node", "depends_on"])

    # an end that is missing is an error, as text that is no number
    end = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("none"))
    rows = edges.select(F.col("function").cast("long").alias("function"), F.concat(end("source"), F.lit(","), end("target")).alias("edge"))
    graphs = rows.groupBy("function").agg(F.array_join(F.array_sort(F.collect_set("edge")), ";").alias("graph"))
    return graphs.mapInArrow(run, "function long, node long, depends_on long")


def concepts(context: DataFrame, most_objects: int = 2000) -> DataFrame:
    """(extent, intent) of all formal concepts of a small context (object, attribute).

    The context is checked to be small and closed on the driver: a lattice can
    be exponential in it, so it is no operator for large tables.
    """
    rows = context.distinct().limit(most_objects * 64 + 1).collect()
    if len(rows) > most_objects * 64:
        raise ValueError("the context is too large for a lattice")
    have: dict[str, set[str]] = {}
    for r in rows:
        have.setdefault(r.object, set()).add(r.attribute)
    everything = frozenset(a for s in have.values() for a in s)
    intents = {everything}
    for s in have.values():
        intents |= {frozenset(i & s) for i in intents}
    out = [(sorted(o for o, s in have.items() if i <= s), sorted(i)) for i in intents]
    return context.sparkSession.createDataFrame(sorted(out), "extent array<string>, intent array<string>")
