"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of rising doc_id. The keys that earlier batches have
seen lie in runs: tables bucketed and sorted by the key's 128-bit hash, with
the document that owns the key. The whole table is read once for the keys of
all batches. A batch's distinct keys are merge-joined with
each run (bucket by bucket, no run is shuffled again); those without a match
are the batch's own run on level 0. When a level has FANOUT runs they are
merged into one run of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: Least code points of a key; batches of a whole table; runs of a level before they are merged.
LEAST, BATCHES, FANOUT = 10, 4, 2
#: A document without id stands for one id after all others.
NO_ID = (1 << 63) - 1
STRIP = bytes(common.SPACE_CODES)
#: Distinct keys that a task gathers before it passes them on.
GATHERED = 200_000
#: Keys held by more than 1 / HOT of a batch's documents' keys are fewer than HOT: these are broadcast, and their holders don't move.
HOT = 50_000


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line's key, None if the key is too short: stripped, A-Z lower-cased."""
    import xxhash

    key = line.strip(STRIP).lower()  # bytes.lower() changes A-Z only
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode()) < LEAST:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(docs: DataFrame) -> DataFrame:
    """batch, k1, k2, docs of docs (_id, _text, _batch): distinct keys with the ids of documents that hold them, gathered in each task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def packed(seen):
            halves = np.frombuffer(b"".join(seen), ">i8").astype(np.int64).reshape(-1, 2)
            lists = pa.array([sorted(v) for v in seen.values()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([batch] * len(seen), pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), lists], ["batch", "k1", "k2", "docs"])

        seen: dict[bytes, set] = {}
        batch, held = None, 0
        for b in batches:
            for doc, text, mine in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if seen and (mine != batch or held >= GATHERED):
                    yield packed(seen)
                    seen, held = {}, 0
                batch = mine
                for line in (text or "").encode().split(b"\n"):
                    key = line_key(line)
                    if key is not None:
                        seen.setdefault(key, set()).add(doc)
                        held += 1
        if seen:
            yield packed(seen)
        seen = {}
        common.release()

    return docs.mapInArrow(run, "batch int, k1 long, k2 long, docs array<long>")


class LineRuns:
    """The runs: levels[i] lists the names of tables (k1, k2, owner), bucketed and sorted by the key."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels = spark, buckets, [[]]

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        path = common.scratch_path(self.spark, name)
        keys.write.options(**common.PLAIN).bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).saveAsTable(name)
        return name

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= FANOUT:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                # keys of runs are disjoint: a run holds only what the earlier had not
                run = self._write(merged.repartition(self.buckets, "k1", "k2"))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level] = []
                self.levels[level + 1].append(run)
                self._drop(names)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            row = self.spark.sql(f"describe table extended {name}").filter("col_name = 'Location'").first()
            self.spark.sql(f"drop table {name}")
            common.delete_path(self.spark, row.data_type)

    def add(self, batch: DataFrame) -> DataFrame:
        """Take batch (_id, _text), all of whose ids are above those before; returns drops (_id, _drops), written to the shared folder."""
        return self.add_keys(common.saved(_keys(batch.select("_id", "_text", F.lit(0).alias("_batch"))), "line-rows"))

    def add_keys(self, rows: DataFrame, last: bool = False) -> DataFrame:
        """As add(), from the batch's keys (k1, k2, docs) in a written table. No run is made of the last batch: none would read it."""
        keys = rows.groupBy("k1", "k2").agg(F.min(F.array_min("docs")).alias("first"), F.max(F.array_max("docs")).alias("last"), F.sum(F.size("docs")).alias("holders"))
        keys = keys.repartition(self.buckets, "k1", "k2")
        owners = []
        for k, name in enumerate(x for level in self.levels for x in level):
            keys = keys.join(self.spark.table(name).withColumnRenamed("owner", f"owner{k}"), ["k1", "k2"], "left")
            owners.append(F.col(f"owner{k}"))
        before = F.coalesce(*owners, F.lit(None).cast("long"))
        known = common.saved(keys.select("k1", "k2", before.alias("before"), F.coalesce(before, "first").alias("owner"), "last", "holders"), "line-keys")
        if not last:
            self.levels[0].append(self._write(known.filter("before is null").select("k1", "k2", "owner").repartition(self.buckets, "k1", "k2")))
        most = (known.agg(F.sum("holders")).first()[0] or 0) // HOT
        repeated = known.filter("last > owner").select("k1", "k2", "owner", "holders")
        # a hot key's holders stay where they are: fewer than HOT keys have more than that share of all, so the broadcast is bounded
        hot = rows.join(F.broadcast(repeated.filter(F.col("holders") > most)), ["k1", "k2"]) if most else None
        cold = rows.join(repeated.filter(F.col("holders") <= most) if most else repeated, ["k1", "k2"])
        both = cold if hot is None else cold.unionByName(hot)
        held = both.select("k1", "k2", "owner", F.explode("docs").alias("_id")).filter("_id <> owner")
        drops = common.saved(held.select("_id", "k1", "k2").groupBy("_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_drops")), "line-drops")
        if not last:
            self._compact()
        return drops

    def close(self) -> None:
        self._drop([x for level in self.levels for x in level])
        self.levels = [[]]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with text_col as it stays, and n_lines (before dropping), n_dropped.

    A line's key is the line stripped of U+0009 to U+000D and space, A-Z lower-cased. Keys of at
    least LEAST code points lose all lines but those in the smallest id that
    holds them; lines of one document never count against each other, rows of
    one id are one document, and rows without id are one document after all others. A null or
    empty text is one empty line and comes back empty. Row count and other
    columns stay as they are, but columns named n_lines or n_dropped give way; an empty table stays empty.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).alias("_text"))
    shares = [k / batches for k in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("_id", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    runs, parts = LineRuns(spark, common.spread(spark)), []
    number = sum(((F.col("_id") > c).cast("int") for c in cuts), F.lit(0))
    path = common.scratch_path(spark, "line-rows")
    _keys(rows.withColumn("_batch", number)).write.options(**common.PLAIN).partitionBy("batch").parquet(path)
    dealt = spark.read.schema("k1 long, k2 long, docs array<long>, batch int").parquet(path)
    for k in range(len(cuts) + 1):
        parts.append(runs.add_keys(dealt.filter(F.col("batch") == k).drop("batch"), last=k == len(cuts)))
    runs.close()
    drops = parts[0]
    for part in parts[1:]:
        drops = drops.unionByName(part)

    names = [c for c in docs.columns]
    at = names.index(text_col)
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"))
    joined = keyed.join(drops, "_id", "left").drop("_id")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts, n, gone = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                text = text or ""
                if not drop:
                    texts.append(text)
                    n.append(text.count("\n") + 1)
                    gone.append(0)
                    continue
                pairs = {np.array([d["k1"], d["k2"]], ">i8").tobytes() for d in drop}
                lines = text.encode().split(b"\n")
                stay = [x for x in lines if line_key(x) not in pairs]
                texts.append(b"\n".join(stay).decode())
                n.append(len(lines))
                gone.append(len(lines) - len(stay))
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*(f"_c{k}" for k in range(len(names))), "_n", "_d"])
        common.release()

    kinds = ", ".join(f"_c{k} {docs.schema[k].dataType.simpleString()}" for k in range(len(names)))
    out = joined.mapInArrow(run, f"{kinds}, _n long, _d long")
    extra = [F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped")]
    return out.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(names) if c not in ("n_lines", "n_dropped")), *extra)


ORACLE_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as p from documents),
k as (select doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, owner is not null and owner <> doc_id as gone from k left join o using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '')) as kept_sha256 from j group by doc_id
"""
