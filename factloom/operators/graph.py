"""Graph and fixpoint operators over edge tables (source, target).

Loops run on the driver, but only counts come to it; each round's frontier is
written to the shared folder, so no lost executor repeats earlier rounds.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.scratch import cut


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of nodes first reached at depth 1 to max_depth, or at any depth; seeds (node) are never reached again."""
    edges = cut(edges.select("source", "target").distinct(), "bfs-edges")
    visited = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier = visited
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = cut(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % MERGED == 0:
            visited = cut(visited, "bfs")
    return visited.filter("depth > 0")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) of all nodes that a path of one edge or more leads to from each of a few seeds (node), to the end."""
    edges = cut(edges.select("source", "target").distinct(), "reach-edges")
    start = seeds.select(F.col("node").alias("seed")).distinct()
    known = delta = cut(start.join(edges, F.col("seed") == F.col("source")).select("seed", F.col("target").alias("node")).distinct(), "reach")
    for k in itertools.count(1):
        step = delta.join(edges, F.col("node") == F.col("source")).select("seed", F.col("target").alias("node")).distinct()
        delta = cut(step.join(known, ["seed", "node"], "left_anti"), "reach")
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)
        if k % MERGED == 0:
            known = cut(known, "reach")


#: Rounds after which what was found is written as one table; each round's own rows are written anyway.
MERGED = 16


def closure(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, str]:
    """(all pairs (source, target) with a path, state): state is "unknown" if rounds were given and ran out first."""
    return (reachable(edges), "exact") if max_rounds is None else _doubled(edges, max_rounds)


def _doubled(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, str]:
    """closure by rounds of joins, which write each pair and move it.

    Round k finds the pairs of distance above 2 ** (k - 1), up to 2 ** k: a
    shortest path of such a length is one of exactly 2 ** (k - 1) edges and one
    that is known, so rounds grow with the logarithm of the longest distance
    and a pair comes from the nodes halfway only. Without max_rounds it goes on until a round finds nothing.
    """
    near = edges.select("source", "target").distinct().withColumn("d", F.lit(1).cast("long"))
    known = delta = cut(near, "closure")
    for k in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        half = 1 << (k - 1)
        first = delta.filter(F.col("d") == half).select("source", F.col("target").alias("via"), F.col("d").alias("d1"))
        step = first.join(known.select(F.col("source").alias("via"), "target", F.col("d").alias("d2")), "via").groupBy("source", "target").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))
        delta = cut(step.join(known, ["source", "target"], "left_anti"), "closure")
        if delta.isEmpty():
            return known.select("source", "target"), "exact"
        known = known.unionByName(delta)
    return known.select("source", "target"), "unknown"


#: Edges of a weak component that one task may hold, and the pairs (bits) of a block of its targets; a block has BLOCK targets at least.
HELD, BITS, BLOCK = 1 << 22, 1 << 26, 1024


def _components_of(edges: DataFrame) -> DataFrame | None:
    """Distinct edges with the weak component of each and its nodes (component, nodes, source, target), or None if a task can't hold each component.

    An edge with a null end counts as one that can't be held: nulls never match, so they are no nodes of a component.
    """
    edges = cut(edges.select("source", "target").distinct(), "edges")
    if not edges.filter("source is null or target is null").isEmpty():
        return None
    member = components(edges)
    rows = edges.join(member, F.col("source") == F.col("node")).select("component", "source", "target")
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    rows = cut(rows.join(size, "component"), "edges")
    most = rows.groupBy("component").count().agg(F.max("count")).first()[0]
    return rows if (most or 0) <= HELD else None


def _ordered(source, target, n: int):
    """(strong component of each node, whether it has a cycle, successors of each): numbered so that all successors come before."""
    import numpy as np

    order = np.argsort(source, kind="stable")
    heads, starts = target[order].tolist(), np.searchsorted(source[order], np.arange(n + 1)).tolist()
    index, low, strong, at = [0] * n, [0] * n, [-1] * n, starts[:-1]
    path: list[int] = []
    clock = found = 0
    for root in range(n):
        if index[root]:
            continue
        clock += 1
        index[root] = low[root] = clock
        path.append(root)
        calls = [root]
        while calls:
            v = calls[-1]
            if at[v] < starts[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if not index[w]:
                    clock += 1
                    index[w] = low[w] = clock
                    path.append(w)
                    calls.append(w)
                elif strong[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                calls.pop()
                if calls:
                    low[calls[-1]] = min(low[calls[-1]], low[v])
                if low[v] == index[v]:
                    while True:
                        w = path.pop()
                        strong[w] = found
                        if w == v:
                            break
                    found += 1
    strong = np.array(strong, np.int64)
    a, b = strong[source], strong[target]
    cyclic = np.zeros(found, bool)
    cyclic[a[a == b]] = True
    links = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
    return strong, cyclic, np.split(links[:, 1], np.searchsorted(links[:, 0], np.arange(1, found)))


def _grouped(batches, keys: int):
    """(key, columns) of each run of equal key columns, which come first; batches are sorted by them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    key, held = None, []
    for b in batches:
        start = 0
        while start < len(b):
            now = tuple(b.column(k)[start].as_py() for k in range(keys))
            same = None
            for k in range(keys):
                e = pc.equal(b.column(k).slice(start), b.column(k)[start])
                same = e if same is None else pc.and_(same, e)
            end = pc.index(same, False).as_py()
            end = len(b) if end < 0 else start + end
            if now != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(b.slice(start, end - start))
            start = end
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _numbered(table):
    """(node values, source and target of each row as their numbers) of a table with these columns."""
    import pyarrow as pa
    import pyarrow.compute as pc

    both = pa.concat_arrays([c for name in ("source", "target") for c in table.column(name).chunks])
    coded = pc.dictionary_encode(both)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype("int64")
    return coded.dictionary, codes[: len(table)], codes[len(table) :]


def reachable(edges: DataFrame, from_: str = "true", to: str = "true") -> DataFrame:
    """All pairs (source, target) with a path, from sources and to targets that meet conditions on these columns; null counts as false.

    The pairs are never moved: each task has the edges of a weak component and a
    block of its targets, passes a bit for each target against the edges, in
    an order where successors come first, and streams the pairs out. What is
    moved is each component's edges, once for each block. Components that no task can hold are closed by doubling.
    """
    rows = _components_of(edges)
    if rows is None:
        return _doubled(edges)[0].filter(f"({from_}) and ({to})")
    width = F.greatest(F.lit(BLOCK), F.floor(F.lit(BITS) / F.col("nodes"))).cast("int")
    blocks = F.sequence(F.lit(0), F.ceil(F.col("nodes") / F.col("width")).cast("int") - 1)
    rows = rows.select("component", "source", "target", F.expr(f"coalesce({from_}, false)").alias("from"), F.expr(f"coalesce({to}, false)").alias("to"), width.alias("width"), "nodes")
    rows = rows.select("component", F.explode(blocks).alias("block"), "source", "target", "from", "to", "width")
    # blocks are work of equal size, whatever few bytes their edges have
    dealt = rows.repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "component", "block").sortWithinPartitions("component", "block")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for (_, block), table in _grouped(batches, 2):
            values, source, target = _numbered(table)
            n, width = len(values), table.column("width")[0].as_py()
            strong, cyclic, after = _ordered(source, target, n)
            starts, wanted = np.zeros(n, bool), np.zeros(n, bool)
            starts[source[table.column("from").to_numpy()]] = True
            wanted[target[table.column("to").to_numpy()]] = True
            order = np.argsort(strong, kind="stable")
            mine = order[block * width : (block + 1) * width]
            mine = mine[wanted[mine]]
            if not len(mine):
                continue
            # no strong component before the first of the block leads to it
            first = int(strong[mine[0]])
            own = np.zeros((len(after) - first, -(-len(mine) // 8)), np.uint8)
            place = np.arange(len(mine))
            np.bitwise_or.at(own, (strong[mine] - first, place // 8), (128 >> (place % 8)).astype(np.uint8))
            there = own.copy()
            own[~cyclic[first:]] = 0
            for c in range(first, len(after)):
                ahead = after[c]
                ahead = ahead[ahead >= first] - first
                if len(ahead):
                    bits = np.bitwise_or.reduce(there[ahead], axis=0)
                    own[c - first] |= bits
                    there[c - first] |= bits
            del there
            whose = order[strong[order] >= first]
            whose = whose[starts[whose]]
            step = max(1, (1 << 21) // own.shape[1] // 8)
            for k in range(0, len(whose), step):
                nodes = whose[k : k + step]
                a, b = np.nonzero(np.unpackbits(own[strong[nodes] - first], axis=1, count=len(mine)))
                for i in range(0, len(a), 1 << 18):
                    pair = nodes[a[i : i + (1 << 18)]], mine[b[i : i + (1 << 18)]]
                    yield pa.RecordBatch.from_arrays([values.take(pa.array(x)) for x in pair], ["source", "target"])

    kind = edges.schema["source"].dataType.simpleString()
    return dealt.mapInArrow(run, f"source {kind}, target {kind}")


def extremes(edges: DataFrame, values: DataFrame) -> DataFrame | None:
    """(node, low, high): least and greatest value (node, value) of each node and all that it reaches, null if none has one; None if a component can't be held.

    Nodes without a row of values are left out. NaN is the greatest, as in SQL. Edges and values are read once, no pairs are made.
    """
    rows = _components_of(edges)
    if rows is None:
        return None
    own = values.filter("node is not null").groupBy("node").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    own = cut(own, "extremes")
    side = lambda c: own.select(F.col("node").alias(c), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"), F.lit(True).alias(f"{c}_has"))
    rows = rows.join(side("source"), "source", "left").join(side("target"), "target", "left")
    names = ["component", "source", "target", *(f"{c}_{x}" for c in ("source", "target") for x in ("low", "high", "has"))]
    dealt = rows.select(*names).repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "component").sortWithinPartitions("component")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for _, table in _grouped(batches, 1):
            nodes, source, target = _numbered(table)
            strong, _, after = _ordered(source, target, len(nodes))
            has = np.zeros(len(nodes), bool)
            out = []
            for name, best in (("low", np.minimum), ("high", np.maximum)):
                both = pa.concat_arrays([c for s in ("source", "target") for c in table.column(f"{s}_{name}").chunks])
                ends = np.concatenate([source, target])
                rank = np.empty(len(both), np.int64)
                # nulls sort last; their ranks are replaced, as they never win
                order = pc.sort_indices(both).to_numpy()
                rank[order] = np.arange(len(both))
                none = len(both) if best is np.minimum else -1
                rank[both.is_null().to_numpy(zero_copy_only=False)] = none
                fold = np.full(len(after), none, np.int64)
                best.at(fold, strong[ends], rank)
                fold = fold.tolist()
                pick = min if best is np.minimum else max
                for c, ahead in enumerate(after):
                    for d in ahead.tolist():
                        fold[c] = pick(fold[c], fold[d])
                fold = np.array(fold)[strong]
                missing = fold == none
                out.append(both.take(pa.array(order[np.where(missing, 0, fold)], mask=missing)))
            for s, ends in (("source", source), ("target", target)):
                has[ends[table.column(f"{s}_has").is_valid().to_numpy()]] = True
            yield pa.RecordBatch.from_arrays([nodes, *out], ["node", "low", "high"]).filter(pa.array(has))

    kinds = own.schema.fields
    schema = f"node {kinds[0].dataType.simpleString()}, low {kinds[1].dataType.simpleString()}, high {kinds[2].dataType.simpleString()}"
    linked = dealt.mapInArrow(run, schema)
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target"))
    return linked.unionByName(own.join(ends, "node", "left_anti"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable when direction is ignored."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    both = cut(both, "cc-edges")
    labels = cut(both.groupBy(F.col("source").alias("node")).agg(F.least("node", F.min("target")).alias("component")), "cc")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("target"), F.col("component").alias("c")), "target").groupBy(F.col("source").alias("node")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        after = cut(lower.join(jump, "low", "left").select("node", F.least("low", "jump").alias("component"), F.col("component").alias("was")), "cc")
        if after.filter("component <> was").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
    raise RuntimeError("components did not settle")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    out = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi")
    return out.join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, degree, targets): the sorted neighbours of each node. For nodes of bounded degree."""
    return edges.groupBy("source").agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_set("target")).alias("targets"))


#: Rows of a cover that a task, or the driver, may hold at once.
SMALL_COVER = 1_000_000


def _picked(table, bound: tuple | None = None) -> list[tuple]:
    """Greedy picks (chooser, gain) from distinct rows (chooser, item), as long as they come before bound (-gain, chooser)."""
    import heapq

    import numpy as np
    import pyarrow.compute as pc

    table = table.combine_chunks().sort_by("chooser")
    coded = [pc.dictionary_encode(table.column(c)).combine_chunks() for c in ("chooser", "item")]
    chooser, item = (x.chunk(0) if hasattr(x, "chunk") else x for x in coded)
    # numbered in order, so that ties go to the smaller
    names = chooser.dictionary.to_pylist()
    starts = np.searchsorted(chooser.indices.to_numpy(), np.arange(len(names) + 1)).tolist()
    item, done, out = item.indices.to_numpy(), np.zeros(len(item.dictionary), bool), []
    heap = [(starts[k] - starts[k + 1], k) for k in range(len(names))]
    heapq.heapify(heap)
    while heap and (bound is None or (heap[0][0], names[heap[0][1]]) < bound):
        stale, k = heapq.heappop(heap)
        mine = item[starts[k] : starts[k + 1]]
        gain = len(mine) - int(np.count_nonzero(done[mine]))
        if gain == -stale:
            out.append((names[k], gain))
            done[mine] = True
        elif gain:
            heapq.heappush(heap, (-gain, k))
    return out


def greedy_cover(covers: DataFrame) -> DataFrame:
    """Greedy set cover of (chooser, item): (pick, chooser, gain) in order until all is covered; ties go to the smaller chooser.

    Choosers that no chain of shared items links don't change each other's
    gains, and gains only fall, so each component's picks come in the order of
    (gain falling, chooser), and all picks together too. Components of up to
    SMALL_COVER rows are covered in tasks, larger ones in rounds. Rows without
    a chooser or an item are no part of the cover.
    """
    spark = covers.sparkSession
    left = cut(covers.select("chooser", "item").filter("chooser is not null and item is not null").distinct(), "cover")
    least = left.groupBy("item").agg(F.min("chooser").alias("target"))
    member = components(left.join(least, "item").select(F.col("chooser").alias("source"), "target").distinct())
    rows = left.join(member.withColumnRenamed("node", "chooser"), "chooser")
    # the same components by rows, from the choosers' counts
    gains = left.groupBy("chooser").agg(F.count(F.lit(1)).alias("n")).join(member.withColumnRenamed("node", "chooser"), "chooser")
    small = cut(gains.groupBy("component").agg(F.sum("n").alias("n")).select("component", "n", (F.col("n") <= SMALL_COVER).alias("small")), "cover-sizes")
    # many small components are covered together
    together = 1 + 2 * (small.filter("small").agg(F.sum("n")).first()[0] or 0) // SMALL_COVER
    dealt = rows.join(small.filter("small"), "component").select(F.pmod(F.xxhash64("component"), F.lit(together)).alias("part"), "chooser", "item")
    dealt = dealt.repartition(4 * spark.sparkContext.defaultParallelism, "part").sortWithinPartitions("part")
    kind = covers.schema["chooser"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for _, table in _grouped(batches, 1):
            picks = _picked(table.select(["chooser", "item"]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in picks], table.schema.field("chooser").type), pa.array([n for _, n in picks], pa.int64())], ["chooser", "gain"])

    picks = dealt.mapInArrow(run, f"chooser {kind}, gain long")
    if not small.filter("not small").isEmpty():
        linked = cut(rows.join(small.filter("not small"), "component").select("chooser", "item"), "cover")
        picks = picks.unionByName(spark.createDataFrame(_picked_in_rounds(linked), f"chooser {kind}, gain long"))
    picks = cut(picks, "picks")
    return picks.select(F.row_number().over(Window.orderBy(F.desc("gain"), "chooser")).cast("long").alias("pick"), "chooser", "gain")


def _picked_in_rounds(left: DataFrame) -> list[tuple]:
    """Greedy picks (chooser, gain) from distinct rows of any number.

    Each round brings the choosers of the largest gains to the driver, in
    SMALL_COVER rows or fewer, and picks as long as no chooser left behind, whose gain can only have fallen, could
    come first. A chooser of more rows than that is picked without its rows.
    """
    import numpy as np

    spark, picks = left.sparkSession, []
    kind = left.schema["chooser"].dataType.simpleString()
    while True:
        gains = left.groupBy("chooser").agg(F.count(F.lit(1)).alias("gain"))
        best = gains.orderBy(F.desc("gain"), "chooser").limit(SMALL_COVER + 1).toArrow()
        if not len(best):
            return picks
        at = lambda k: (best.column("chooser")[k].as_py(), best.column("gain")[k].as_py())
        near = int((np.cumsum(best.column("gain").to_numpy()) <= SMALL_COVER).sum())
        # the first chooser whose rows stay where they are
        bound = (-at(near)[1], at(near)[0]) if near < len(best) else None
        if near == 0:
            found = [at(0)]
        else:
            rows = left
            if bound:
                before = (F.col("gain") > -bound[0]) | ((F.col("gain") == -bound[0]) & (F.col("chooser") < F.lit(bound[1])))
                rows = left.join(gains.filter(before).select("chooser"), "chooser", "left_semi")
            found = _picked(rows.toArrow(), bound)
        picks += found
        if bound is None:
            return picks
        done = left.join(spark.createDataFrame([(k,) for k, _ in found], f"chooser {kind}"), "chooser", "left_semi").select("item").distinct()
        left = cut(left.join(done, "item", "left_anti"), "cover")


def ancestors(parents: DataFrame, max_depth: int = 16) -> DataFrame:
    """(node, ancestor, distance) of a hierarchy (child, parent), every node its own at distance 0. Deeper than max_depth is an error."""
    up = cut(parents.select("child", "parent").distinct(), "up")
    nodes = up.select(F.col("child").alias("node")).union(up.select("parent")).distinct()
    level = cut(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")), "up")
    out = level
    for depth in range(1, max_depth + 1):
        level = cut(level.join(up, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("distance")).distinct(), "up")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("the hierarchy is deeper than allowed, or has a cycle")


def would_cycle(parents: DataFrame, parent, child) -> bool:
    """Whether linking child below parent closes a cycle."""
    if parent == child:
        return True
    spark = parents.sparkSession
    edges = parents.select(F.col("child").alias("source"), F.col("parent").alias("target"))
    kind = parents.schema["child"].dataType.simpleString()
    above = bfs(edges, spark.createDataFrame([(parent,)], f"node {kind}"))
    return not above.filter(F.col("node") == F.lit(child)).isEmpty()


def depth_limited(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, level, hidden) of a hierarchy (parent, child) down to depth; hidden counts the children that a node of the last level has."""
    steps = edges.select(F.col("parent").alias("source"), F.col("child").alias("target"))
    seen = roots.select("node", F.lit(0).alias("level")).distinct().union(bfs(steps, roots, depth))
    below = steps.distinct().groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    hidden = F.when(F.col("level") == depth, F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return seen.join(below, "node", "left").select("node", "level", hidden.alias("hidden"))


def fault_sets(lineage: DataFrame) -> DataFrame:
    """(trace, kind, a, b, size): the least sets of one or two faults that break each trace.

    lineage (trace, step, edge, idempotent): a trace succeeds while each of its
    steps has an edge left and no edge that isn't idempotent comes twice. So a
    crash breaks it, a duplicate of such an edge, the drop of a step's only
    edge, and the drop of both edges of a step that has two, unless one of them breaks it alone. Sets follow
    from counts by step: no pairs of edges are tried.
    """
    edges = lineage.groupBy("trace", "step", "edge").agg(F.bool_and("idempotent").alias("idempotent"))
    steps = edges.groupBy("trace", "step").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("a"), F.max("edge").alias("b")).filter("n <= 2")
    none = F.lit(None).cast(edges.schema["edge"].dataType)
    row = lambda df, kind, a, b, size: df.select("trace", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), F.lit(size).alias("size")).distinct()
    single = steps.filter("n = 1").select("trace", "a").distinct()
    two = steps.filter("n = 2").select("trace", "a", "b").join(single, ["trace", "a"], "left_anti").join(single.withColumnRenamed("a", "b"), ["trace", "b"], "left_anti")
    out = [row(lineage, "crash", none, none, 1), row(edges.filter("not idempotent"), "duplicate", F.col("edge"), none, 1), row(single, "drop", F.col("a"), none, 1), row(two, "drop", F.col("a"), F.col("b"), 2)]
    return reduce(lambda x, y: x.unionByName(y), out)
