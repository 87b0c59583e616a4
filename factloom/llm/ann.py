"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each block of the
index holds pivot inverted files: for every pivot, the vectors that have it
among their nearest, with its rank there. A query reads the files of its own
nearest pivots only, adds up the footrule
distance between its ranks and the posted ones (a pivot that is missing
counts as one rank past the last), takes the closest share of the block, and
ranks these again by the true distance in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Pivots, ranks kept of a vector, rows from which the driver takes pivots (the bound of what fits the index).
PIVOTS, RANKS, SAMPLE = 256, 128, 2048
#: Vectors of an index block, queries of a query block.
BLOCK, QUERY_BLOCK = 16_384, 1024
#: Of a block's distinct vectors, the share reranked, and the least number for each neighbour asked for.
SHARE, DEPTH = 1 / 20, 20

INDEX = "ids binary, vectors binary, members binary, dim int, offsets binary, posted binary, ranks binary"


@dataclass
class Block:
    """Distinct vectors with the ids of their copies, and the pivot inverted files."""

    ids: np.ndarray
    first: np.ndarray
    vectors: np.ndarray
    offsets: np.ndarray
    posted: np.ndarray
    ranks: np.ndarray

    def footrule(self, pivots: np.ndarray, keep: int) -> np.ndarray:
        """Distance of every vector's ranks to those of a query whose nearest pivots are given."""
        # all pivots missing on both sides, less what each shared pivot saves
        total = np.full(len(self.vectors), keep * (keep + 1), np.int32)
        for rank, pivot in enumerate(pivots):
            a, b = self.offsets[pivot], self.offsets[pivot + 1]
            here = self.ranks[a:b].astype(np.int32)
            total[self.posted[a:b]] -= (keep - rank) + (keep - here) - np.abs(here - rank)
        return total


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, keep: int) -> np.ndarray:
    """The `keep` nearest pivots of each vector, nearest first, ties to the smaller number."""
    d = (pivots**2).sum(1)[None] - 2 * vectors.astype(np.float64) @ pivots.T
    return np.argsort(d, 1, kind="stable")[:, :keep]


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _v of rows whose vector is not null or zero, and has no null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"))
    return rows.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"), odd.alias("_odd")).filter("_id is not null and _v is not null and not _odd").filter(F.exists("_v", lambda x: x != 0)).select(*out.columns)


def choose_pivots(vectors: DataFrame) -> np.ndarray | None:
    """Up to PIVOTS distinct vectors among the SAMPLE rows of smallest hash of the id; the commonest length rules."""
    rows = vectors.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()
    if not rows:
        return None
    sizes = [len(r["_v"]) for r in rows]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), -n))
    distinct = list(dict.fromkeys(tuple(r["_v"]) for r in rows if len(r["_v"]) == dim))
    return np.array(distinct[:PIVOTS], np.float64)


def build_index(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of up to BLOCK vectors, built where they are read and written to the shared folder."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches):
        import pyarrow as pa

        pivots = shared.value
        keep = min(RANKS, len(pivots))

        def block(ids, rows):
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            _, first, inverse = np.unique(rows.view([("", "<f8")] * rows.shape[1]).reshape(-1), return_index=True, return_inverse=True)
            distinct = rows[first]
            near = nearest_pivots(distinct, pivots, keep)
            by = np.argsort(near.reshape(-1), kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(near.reshape(-1), minlength=len(pivots)))])
            data = [ids.astype("<i8"), distinct.astype("<f8"), inverse.reshape(-1).astype("<i4"), None, offsets.astype("<i8"), (by // keep).astype("<i4"), (by % keep).astype(np.uint8)]
            return pa.RecordBatch.from_arrays([pa.array([rows.shape[1]], pa.int32()) if x is None else pa.array([x.tobytes()], pa.binary()) for x in data], ["ids", "vectors", "members", "dim", "offsets", "posted", "ranks"])

        ids, rows = [], []
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(k)
                rows.append(v)
                if len(ids) == BLOCK:
                    yield block(np.array(ids), np.array(rows, np.float64))
                    ids, rows = [], []
        if ids:
            yield block(np.array(ids), np.array(rows, np.float64))

    return common.saved(vectors.filter(F.size("_v") == pivots.shape[1]).mapInArrow(run, INDEX), "permutations")


def _query_files(spark, queries: DataFrame, dim: int) -> DataFrame:
    """Queries as files of QUERY_BLOCK in the shared folder; a table of their paths."""
    folder = common.scratch_path(spark, "ann-queries")

    def run(batches):
        import uuid

        import pyarrow as pa

        def write(part):
            path = f"{folder}/{uuid.uuid4().hex}.bin"
            head = np.array([len(part)], "<i8").tobytes()
            common.write_shared(path, head + np.array([p[0] for p in part], "<i8").tobytes() + np.array([p[1] for p in part], "<f8").tobytes(), "part")
            return pa.RecordBatch.from_pydict({"path": [path]})

        part = []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part.append(row)
                if len(part) == QUERY_BLOCK:
                    yield write(part)
                    part = []
        if part:
            yield write(part)

    return common.saved(queries.filter(F.size("_v") == dim).mapInArrow(run, "path string"), "ann-query-files")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score of the k nearest rows found for each row of queries, but itself.

    score is the Euclidean distance in double precision; ties go to the smaller
    id. Vectors that are null, zero, or hold a null or non-finite component,
    those of another length than the commonest, and rows without id take no
    part. Rows of an id are told apart only by it: a query never finds rows of its own id, and
    repeated ids are found as often as they stand. Fewer than k candidates give fewer rows; empty tables none.
    share: what part of each block's distinct vectors is reranked, k * DEPTH at least; a share of 1 is the exact search.
    """
    spark = vectors.sparkSession
    rows, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    pivots = choose_pivots(rows)
    if pivots is None:
        return spark.createDataFrame([], schema)
    index = build_index(rows, pivots)
    # a path for each QUERY_BLOCK queries
    paths = [r[0] for r in _query_files(spark, asked, pivots.shape[1]).orderBy("path").collect()]
    shared = spark.sparkContext.broadcast((pivots, paths))

    def run(batches):
        import pyarrow as pa

        pivots, paths = shared.value
        keep = min(RANKS, len(pivots))
        for b in batches:
            for row in range(len(b)):
                raw = [b.column(c)[row].as_py() for c in range(7)]
                ids, dim = np.frombuffer(raw[0], "<i8"), raw[3]
                members = np.frombuffer(raw[2], "<i4")
                order = np.argsort(members, kind="stable")
                block = Block(ids[order], np.searchsorted(members[order], np.arange(members.max() + 2)), np.frombuffer(raw[1], "<f8").reshape(-1, dim), np.frombuffer(raw[4], "<i8"), np.frombuffer(raw[5], "<i4"), np.frombuffer(raw[6], np.uint8))
                # copies stand in ascending id order, so a vector's first member decides its ties
                smallest = block.ids[block.first[:-1]]
                most = min(len(block.vectors), max(k * DEPTH, int(np.ceil(len(block.vectors) * share))))
                for path in paths:
                    fs, p = common.open_shared(path)
                    with fs.open_input_file(p) as f:
                        data = f.read()
                    n = int(np.frombuffer(data, "<i8", 1)[0])
                    names, asked = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<f8", offset=8 + 8 * n).reshape(n, dim)
                    near = nearest_pivots(asked, pivots, keep)
                    out: list[tuple] = []
                    for q in range(n):
                        far = block.footrule(near[q], keep)
                        chosen = np.lexsort((smallest, far))[:most] if most < len(far) else np.arange(len(far))
                        score = np.sqrt(((block.vectors[chosen] - asked[q]) ** 2).sum(1))
                        best = np.lexsort((smallest[chosen], score))[: k + 1]
                        found = []
                        for c in best:
                            a, z = block.first[chosen[c]], block.first[chosen[c] + 1]
                            own = block.ids[a:z]
                            own = own[own != names[q]][:k]
                            found += [(score[c], int(v)) for v in own]
                        # vectors as near as the last one may stand just past the cut
                        if len(best) == k + 1 and len(chosen) > k + 1 and (score == score[best[-1]]).sum() > 1:
                            ties = [c for c in np.flatnonzero(score == score[best[-1]]) if c not in set(best.tolist())]
                            for c in ties:
                                own = block.ids[block.first[chosen[c]] : block.first[chosen[c] + 1]]
                                found += [(score[c], int(v)) for v in own[own != names[q]][:k]]
                        found.sort()
                        out += [(int(names[q]), v, float(s)) for s, v in found[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["query_id", "vec_id", "score"])

    found = index.repartition(common.spread(spark)).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
