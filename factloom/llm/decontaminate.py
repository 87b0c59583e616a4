"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: a segment is a row with the documents of some
MB of text, its sorted distinct terms, and for each term the ascending
positions where it stands. Segments are built where the documents are read and
need no shuffle. A phrase is found by taking its terms from the rarest on and
intersecting their posting lists, each shifted by its place in the phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm import common

#: Words of a window, UTF-8 bytes and rows of a segment, segments that are searched together, words of benchmark items that are searched at once.
WINDOW, SEGMENT_BYTES, SLICE_ROWS, TOGETHER, BLOCK_WORDS = 13, 2 << 20, 1024, 4, 200_000

INDEX = "doc_ids array<long>, cuts binary, terms binary, counts binary, positions binary"
RESULT = "n_words long, n_hit long, n_items long, items array<string>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of docs, written to the shared folder. A null text has no words; ids are read as long."""

    def run(batches):
        import pyarrow as pa

        hasher = common.WordHasher(common.alnum_words())
        for b in (b.slice(a, SLICE_ROWS) for b in batches for a in range(0, len(b), SLICE_ROWS)):
            ids = b.column(0)
            data, cuts = common.text_bytes(b.column(1))
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SEGMENT_BYTES, "right")) - 1)
                part = cuts[at : to + 1] - cuts[at]
                terms, _, _, words = hasher.hashes(data[cuts[at] : cuts[to]], part)
                order = np.argsort(terms, kind="stable").astype(np.uint64)
                names, counts = np.unique(terms, return_counts=True)
                delta = np.diff(names, prepend=np.uint64(0))
                columns = [[ids.slice(at, to - at).to_pylist()], *([common.pack_u64(x)] for x in (words, delta, counts, order))]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int64())), *(pa.array(c, pa.binary()) for c in columns[1:])], ["doc_ids", "cuts", "terms", "counts", "positions"])
                at = to
        common.release()

    from pyspark.sql import functions as F

    common.bound_batches(docs.sparkSession)
    return common.saved(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, INDEX), "postings")


@dataclass
class Segment:
    """A segment in memory: ids of its documents, words before each, terms, and postings by term."""

    doc_ids: list
    cuts: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray

    @classmethod
    def of(cls, doc_ids: list, cuts: bytes, terms: bytes, counts: bytes, positions: bytes) -> Segment:
        words, names, n, order = (common.unpack_u64(x) for x in (cuts, terms, counts, positions))
        return cls(doc_ids, words.astype(np.int64), np.cumsum(names, dtype=np.uint64), np.concatenate([[0], np.cumsum(n)]).astype(np.int64), order.astype(np.int64))

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term among the segment's terms, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.starts[place] : self.starts[place + 1]]

    def phrase(self, places: np.ndarray) -> np.ndarray:
        """Positions where the terms stand one after another inside one document."""
        sizes = self.starts[places + 1] - self.starts[places]
        order = np.argsort(sizes, kind="stable")
        found = self.postings(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                return found
            there = self.postings(places[k])
            at = np.minimum(np.searchsorted(there, found + k), len(there) - 1)
            found = found[there[at] == found + k]
        first = np.searchsorted(self.cuts, found, "right")
        last = np.searchsorted(self.cuts, found + len(places) - 1, "right")
        return found[(found >= 0) & (first == last)]

    def near(self, places: np.ndarray, within: int) -> list[tuple[int, int]]:
        """(document, first position) of each least span of at most `within` words that holds all the terms, in any order."""
        places = np.unique(places)
        where = np.concatenate([self.postings(p) for p in places])
        which = np.repeat(np.arange(len(places)), [len(self.postings(p)) for p in places])
        order = np.argsort(where, kind="stable")
        where, which = where[order], which[order]
        have, kinds, left, out = np.zeros(len(places), np.int64), 0, 0, []
        for right in range(len(where)):
            have[which[right]] += 1
            kinds += have[which[right]] == 1
            while kinds == len(places):
                a, b = int(where[left]), int(where[right])
                doc = int(np.searchsorted(self.cuts, a, "right")) - 1
                if b - a < within and b < self.cuts[doc + 1] and have[which[left]] == 1:
                    out.append((doc, a))
                have[which[left]] -= 1
                kinds -= have[which[left]] == 0
                left += 1
        return out


@dataclass
class Queries:
    """Windows of some items: distinct terms, each window's terms as places in them, its length and its item."""

    terms: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    names: list[str]


def compile_windows(items: list[tuple[str, str]], window: int = WINDOW) -> Queries:
    """Windows of (item_id, text): `window` words one after another, or all words of a shorter item."""
    import pyarrow as pa

    data, cuts = common.text_bytes(pa.array([t for _, t in items], pa.string()))
    hashes, _, _, words = common.WordHasher(common.alnum_words()).hashes(data, cuts)
    terms, place = np.unique(hashes, return_inverse=True)
    rows, lengths, owner = [], [], []
    for k in range(len(items)):
        mine = place[words[k] : words[k + 1]]
        n = min(window, len(mine))
        for a in range(len(mine) - n + 1 if n else 0):
            rows.append(np.pad(mine[a : a + n], (0, window - n), mode="edge"))
            lengths.append(n)
            owner.append(k)
    return Queries(terms, np.array(rows, np.int64).reshape(-1, window), np.array(lengths, np.int64), np.array(owner, np.int64), [i for i, _ in items])


def search_segment(seg: Segment, q: Queries, covered: np.ndarray, items: list[set]) -> None:
    """Add to covered (a step array over the segment's positions) and to items (by document) what q's windows hit."""
    place = seg.find(q.terms)
    if not len(q.windows):
        return
    alive = np.flatnonzero((place[q.windows] >= 0).all(1))
    for k in alive:
        n = int(q.lengths[k])
        found = seg.phrase(place[q.windows[k, :n]])
        if len(found):
            np.add.at(covered, found, 1)
            np.add.at(covered, found + n, -1)
            for doc in set((np.searchsorted(seg.cuts, found, "right") - 1).tolist()):
                items[doc].add(q.names[q.items[k]])


def _blocks(benchmark: DataFrame) -> list:
    """Compiled blocks of the benchmark, of BLOCK_WORDS words each; past the first, they are files in the shared folder."""
    import pickle

    spark = benchmark.sparkSession
    folder, blocks, items, size = None, [], [], 0

    def close():
        nonlocal folder, items, size
        folder = folder or common.scratch_path(spark, "windows")
        blocks.append(compile_windows(items))
        if len(blocks) > 1 or size > 2 * BLOCK_WORDS:
            path = f"{folder}/{len(blocks)}.pickle"
            common.write_shared(path, pickle.dumps(vars(blocks[-1])), "part")
            blocks[-1] = path
        items, size = [], 0

    for r in benchmark.selectExpr("cast(item_id as string) as item", "text").toLocalIterator():
        words = len(r.text or "") // 2 + 1
        items.append((r.item, r.text or ""))
        size += words
        if size >= BLOCK_WORDS:
            close()
    if items:
        close()
    return blocks


def find_windows(index: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, n_hit (words inside a found window), n_items, items (their ids as sorted strings) of each indexed document."""
    spark = index.sparkSession
    blocks = spark.sparkContext.broadcast(_blocks(benchmark))  # at most one block of windows, and paths

    def run(batches):
        import pickle

        import pyarrow as pa

        for b in (b.slice(a, TOGETHER) for b in batches for a in range(0, len(b), TOGETHER)):
            segments = [Segment.of(*(b.column(c)[k].as_py() for c in range(5))) for k in range(len(b))]
            covered = [np.zeros(s.cuts[-1] + 1, np.int64) for s in segments]
            items = [[set() for _ in s.doc_ids] for s in segments]
            for q in blocks.value:
                if isinstance(q, str):
                    fs, p = common.open_shared(q)
                    with fs.open_input_file(p) as f:
                        q = Queries(**pickle.loads(f.read()))
                for s, c, i in zip(segments, covered, items, strict=True):
                    search_segment(s, q, c, i)
            for s, c, i in zip(segments, covered, items, strict=True):
                upto = np.concatenate([[0], np.cumsum(np.cumsum(c)[:-1] > 0)])
                found = [sorted(x for x in y if x is not None) for y in i]
                columns = [pa.array(s.doc_ids, pa.int64()), pa.array(np.diff(s.cuts)), pa.array(np.diff(upto[s.cuts])), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_hit", "n_items", "items"])
            del segments, covered, items
        common.release()

    return index.mapInArrow(run, f"`{id_col}` long, {RESULT}")


def find_near(index: DataFrame, words: list[str], within: int, id_col: str = "doc_id") -> DataFrame:
    """Proximity search: id_col, position (from 0) of each least span of at most `within` words with all the words, in any order."""
    terms = compile_windows([("", w) for w in words], 1).terms

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(len(b)):
                s = Segment.of(*(b.column(c)[k].as_py() for c in range(5)))
                place = s.find(terms)
                found = s.near(place, within) if len(place) and (place >= 0).all() else []
                yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[d] for d, _ in found], pa.int64()), pa.array([p - int(s.cuts[d]) for d, p in found], pa.int64())], [id_col, "position"])

    return index.mapInArrow(run, f"`{id_col}` long, position long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items, contaminated (n_hit > 0 and share * n_hit >= n_words).

    A null or empty text has no words; an item that is null or has no words has
    no window, an item with a null id hits but isn't listed. Items with equal
    ids count once. Repeated rows and null ids give a row each; an empty
    benchmark hits nothing, an empty table gives an empty table; other columns are not read.
    """
    found = find_windows(build_index(docs, id_col, text_col), benchmark, id_col)
    return found.selectExpr("*", f"n_hit > 0 and {int(share)} * n_hit >= n_words as contaminated")


#: DuckDB SQL for the query's columns: every window of a document is compared with every window of the items.
ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
q as (select distinct item_id, least(13, len(w)) as n, list_slice(w, k, k + least(13, len(w)) - 1) as g
  from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from b where len(w) > 0)),
s as (select distinct n from q),
g as (select doc_id, n, k, list_slice(w, k, k + n - 1) as g from (select doc_id, w, n, unnest(range(1, (len(w) - n + 2)::bigint)) as k from d, s where len(w) >= n)),
h as (select g.doc_id, g.k, g.n, q.item_id from g join q on g.n = q.n and g.g = q.g),
p as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(k, (k + n)::bigint)) as x from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join p using (doc_id) left join i using (doc_id)
"""
