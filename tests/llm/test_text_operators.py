"""N-gram join, decontamination, line dedup, language ID and nearest neighbours against brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from test_pipeline import brute_groups, brute_hits, brute_lines, shingles

from factloom.llm import ann, common, decontaminate, language_id, line_dedup, ngram_join
from factloom.llm.graph import components


def frame(spark, rows):
    return spark.createDataFrame([(t, "clash", k) for k, t in rows], "text string, key string, doc_id long")


def near_copies(seed, base=60, copies=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(3):
        start = [word() for _ in range(rng.choice([3, 5, 8, 20, base]))]
        for _ in range(copies):
            t = list(start)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            out.append((" " if rng.random() < 0.5 else "\n").join(t).title())
    common_part = " ".join(word() for _ in range(25))
    out += [f"{common_part} {' '.join(word() for _ in range(rng.choice([3, 6, 12, 40])))}" for _ in range(copies)]
    out += [" ".join(out[0].split()[:k]) for k in range(12)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed, monkeypatch):
    if seed == 2:  # several blocks for a family
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 15)
    texts = [None, "", " \t\n", "one", "One", *near_copies(seed)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    want = brute_groups([{"doc_id": k, "text": t} for k, t in rows])
    sets = [shingles(t or "") for t in texts]
    assert len(got) == len(rows)
    for k, t in rows:
        links = sum(j != k and bool(sets[k]) and 100 * len(sets[k] & s) >= 75 * len(sets[k] | s) for j, s in enumerate(sets))
        assert (got[k].n_shingles, got[k].component_id, got[k].n_links) == (len(sets[k]), want[k], links), (k, t)


def test_ngram_join_odd_rows(spark):
    long = " ".join(str(k) for k in range(30_000))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "other"), (7, "other"), (None, None), (9, long), (8, long + " x")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert got == sorted([("None", 2, "7", 2), ("None", 2, "7", 2), ("7", 2, "7", 2), ("7", 1, "7", 1), ("7", 1, "7", 1), ("None", 0, "None", 0), ("9", 29_996, "8", 1), ("8", 29_997, "8", 1)])
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_ngram_join_empty_block(spark, monkeypatch):
    # families of two sets in two or more blocks: in some of them both fall into one block
    monkeypatch.setattr(ngram_join, "BLOCK_FEATURES", 40)
    rows = []
    for k in range(24):
        text = " ".join(f"w{k}x{j}" for j in range(34))
        rows += [(2 * k, text), (2 * k + 1, f"{text} end")]
    got = {tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "component_id", "n_links").collect()}
    assert got == {(d, d - d % 2, 1) for d, _ in rows}


def test_every_similar_pair_shares_enough_signatures():
    rng, bands = np.random.default_rng(3), ngram_join.Bands(75, 100)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        pool = rng.integers(1, 2**64, n + 40, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[rng.integers(0, max(1, n // 4)) : n], pool[n : n + int(rng.integers(0, max(1, n // 6) + 1))]]))
        both = np.intersect1d(a, b).size
        if not len(b) or 100 * both < 75 * (a.size + b.size - both):
            continue
        out, needs = ngram_join.signatures(np.concatenate([a, b]), np.array([0, a.size, a.size + b.size]), bands)
        mine = [{(int(s) & 255, int(s)) for sig, who in out for s in sig[who == k]} for k in (0, 1)]
        need = [{int(i[k]): int(d[k]) for i, d in needs if i[k] >= 0} for k in (0, 1)]
        shared = mine[0] & mine[1]
        assert any(sum(i == inst for i, _ in shared) >= max(1, need[0][inst], need[1][inst]) for inst in need[0].keys() & need[1].keys())


def test_signatures_of_many_buckets_go_in_few_batches(monkeypatch):
    import pyarrow as pa
    import pyspark

    class Docs:
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    class Task:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(pyspark.TaskContext, "get", Task)
    texts = near_copies(5)
    given = pa.RecordBatch.from_pydict({"_id": list(range(len(texts))), "_text": texts})
    found = {}
    for buckets in (4, 4000):
        batches = list(ngram_join._signed(Docs(), 5, ngram_join.Bands(75, 100), buckets)(iter([given])))
        rows = pa.Table.from_batches(batches)
        names = rows.column("bucket").to_pylist()
        assert max(names) < buckets and len(batches) <= 3  # descriptions, frequent signatures, the others
        pairs = {}
        for p in set(names):
            for r in ngram_join._grouped(rows.filter(pa.array([x == p for x in names]))).to_pylist():
                key = tuple(r[c] for c in ("kind", "inst", "sig", "a", "b", "doc"))
                pairs[key] = pairs.get(key, 0) + (r["n"] or 1)
        found[buckets] = pairs
    assert found[4] == found[4000] and {k[0] for k in found[4]} == {0, 1, 2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 50), (50, 75), (75, 100), (3, 3), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {50: 50, 75: 50, 100: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hasher():
    h = common.WordHasher(common.space_words(), room=4)
    texts = ["Ab ab", "", "aB\tcd", "cd", "é É"]
    import pyarrow as pa

    data, cuts = common.text_bytes(pa.array(texts))
    words, starts, ends, at = h.hashes(data, cuts)
    assert at.tolist() == [0, 2, 2, 4, 5, 7]
    assert words[0] == words[1] == words[2] and words[3] == words[4] and words[5] != words[6]
    assert [bytes(data[a:z]).decode() for a, z in zip(starts, ends, strict=True)] == ["Ab", "ab", "aB", "cd", "cd", "é", "É"]


def test_word_hasher_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abC  \n") for _ in range(rng.randrange(60))) for _ in range(40)] + ["x" * 70, "", "end"]
    import pyarrow as pa

    data, cuts = common.text_bytes(pa.array(texts))
    whole = common.WordHasher(common.space_words()).hashes(data, cuts)
    for size in (1, 5, 16):
        monkeypatch.setattr(common, "AT_ONCE", size)
        parts = common.WordHasher(common.space_words(), room=2).hashes(data, cuts)
        assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    none = common.WordHasher(common.space_words()).hashes(data[:0], np.array([0, 0]))
    assert [len(x) for x in none] == [0, 0, 0, 2]


def test_decontaminate(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé9") for _ in range(4))
    items = [("i1", " ".join(word() for _ in range(30))), ("i2", "Lone-word"), ("i10", " ".join(word() for _ in range(13))), ("i3", None), ("i4", "!!"), ("i1", "second text of an item"), (None, "nameless item here")]
    texts = [None, "", "...", f"x {items[0][1]} y", items[0][1].upper().replace(" ", "--"), "a LONE word b", " ".join(items[0][1].split()[:13]), " ".join(items[0][1].split()[:12]), "w " * 600 + items[2][1], "w " * 300 + items[2][1], items[2][1] + " " + items[2][1], "a second text of an ITEM, nameless item here", "z " * 100_000]
    bench = spark.createDataFrame([(i, "clash", t) for i, t in items], "item_id string, doc_id string, text string")
    named = [(i, t) for i, t in items]
    for block in (200_000, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, list(enumerate(texts))), bench).collect()}
        for k, t in enumerate(texts):
            n, hit, names = brute_hits(t, named)
            assert (got[k].n_words, got[k].n_hit, got[k].items, got[k].contaminated) == (n, hit, sorted(x for x in names if x), hit > 0 and 20 * hit >= n), t
    nulls = frame(spark, [(None, "lone word"), (None, "lone word"), (3, "x")])
    assert sorted((str(r.doc_id), r.n_hit) for r in decontaminate.decontaminate(nulls, bench).collect()) == [("3", 0), ("None", 2), ("None", 2)]
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(nulls, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    index = decontaminate.build_index(frame(spark, [(1, "a x b y c"), (2, "c b a"), (3, "a b"), (4, "a q q q q b c")]))
    found = sorted((r.doc_id, r.position) for r in decontaminate.find_near(index, ["a", "b", "c"], 5).collect())
    assert found == [(1, 0), (2, 0)]


def test_line_dedup(spark):
    long = "a long line " * 3000
    texts = [None, "", "short\nshort", "The Same Line\nown line here\n\n", " the same line\r\nTHE SAME LINE\nother", "the same line", "exactly10!", "Exactly10!\n", "nine char", "nine char", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää\nÄÄÄÄÄÄÄÄÄÄ ", long, f"x\n{long}\ny", "\x1cpart of a key\x1c", "part of a key"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows).repartition(3)).collect()}
    want = {r["doc_id"]: r["text"] for r in brute_lines([{"doc_id": k, "text": t} for k, t in rows])}
    assert {k: r.text for k, r in got.items()} == want and all(r.key == "clash" for r in got.values())
    assert all(got[k].n_lines == (t or "").count("\n") + 1 for k, t in rows)
    assert {k: r.n_dropped for k, r in got.items() if r.n_dropped} == {4: 2, 5: 1, 7: 1, 11: 1, 13: 1}
    odd = frame(spark, [(None, "line without id\nkept by one"), (None, "line without id"), (4, "kept by one"), (4, "kept by one")])
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(odd).collect()) == [("4", "kept by one"), ("4", "kept by one"), ("None", "line without id"), ("None", "line without id")]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, 4)
    seen, total = set(), 0
    for k in range(5):
        lines = [f"line number {j:05d}" for j in range(k * 10, k * 10 + 15)]
        batch = spark.createDataFrame([(100 * k + j, t) for j, t in enumerate(lines)], "_id long, _text string")
        drops = runs.add(batch)
        assert drops.count() == len(seen & set(lines))
        seen |= set(lines)
        total = sum(spark.table(t).count() for level in runs.levels for t in level)
        assert total == len(seen) and all(len(level) < line_dedup.FANOUT for level in runs.levels)
    assert len(runs.levels) == 3
    runs.close()


def test_line_runs_are_all_read(spark, monkeypatch):
    sizes, write = [], line_dedup.LineRuns._write
    monkeypatch.setattr(line_dedup.LineRuns, "_write", lambda self, keys: sizes.append(len(self.levels[0])) or write(self, keys))
    rows = [(k, f"its own line number {k}\nshared by two of them {k // 2}\nin all the documents") for k in range(40)]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(r["doc_id"], r["text"]) for r in brute_lines([{"doc_id": k, "text": t} for k, t in rows])]
    assert len(sizes) == 4  # of three batches, the last one's aside, and the first two merged


def test_scratch_tables_have_no_checksum_files(spark):
    from factloom.sources.scratch import cut

    path = cut(spark.range(100).repartition(4)).inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert spark.read.parquet(path).count() == 100 and not [x for x in os.listdir(path) if x.endswith(".parquet.crc")]


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network.new(["a", "b", "c"], rng)
    net.x, net.u, net.out = (p.astype(np.float64) * 0.3 for p in (net.x, net.u, net.out))
    symbols = rng.integers(0, 257, (5, 7))
    symbols[:, -1] = language_id.PAD
    labels = np.array([0, 1, 2, 0, 1])

    def loss():
        _, p = net.positions(symbols)
        w = symbols.T != language_id.PAD
        return -(np.log(p[:, np.arange(5), labels]) * w).sum() / w.sum()

    for value, grad in zip((net.x, net.u, net.out, net.bias), net.gradients(symbols, labels), strict=True):
        for at in zip(*(rng.integers(0, n, 6) for n in value.shape), strict=True):
            if value is net.x:
                at = (at[0], int(symbols[0, 1]), at[2])
            keep = value[at]
            value[at] = keep + 1e-3
            up = loss()
            value[at] = keep - 1e-3
            down = loss()
            value[at] = keep
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-4


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROUNDS", 2)
    rows = [(k, f"some text of {k % 70}", f"l{k % 70}") for k in range(560)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.fit(docs).langs) == {f"l{k}" for k in range(70)}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, language_id.fit(docs), keep=("lang",)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (None, "the words of that and this one"), (5, "the " * 50_000)])
    net = language_id.fit(docs)
    rows = {r.doc_id: r for r in language_id.identify(odd, net).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[5].lang_pred == "en" and rows[None].lang_pred != "und"
    assert language_id.fit(docs.limit(0)) is None and language_id.identify(odd, None).first().lang_pred == "und"
    assert language_id.fit(docs.withColumn("lang", docs.lang.substr(5, 0)).filter("doc_id < 0")) is None


def brute_nearest(rows, asked, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None]
    out = []
    for q, v in ok:
        if q in asked:
            best = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q)[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(best)]
    return sorted(out)


def test_nearest_small_tables_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)] + [(100 + k, [1.0, 0.0, 0.0, 2.0]) for k in range(30)]
    rows += [(200, None), (300, [0.0] * 4), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(v, "clash", k) for k, v in rows], "embedding array<float>, score string, vec_id long")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect())
    single = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    assert got == brute_nearest(single, {0, 50, 100}, 10)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 4")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 3


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {(r.query_id, r.vec_id) for r in ann.search(df, df.filter("vec_id % 100 = 0")).collect()}
    x, ids = np.array([v for _, v in rows], np.float64), np.array([k for k, _ in rows])
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want |= {(int(ids[q]), int(ids[k])) for k in np.lexsort((ids, d))[:10]}
    assert len(got & want) / len(want) >= 0.9


def test_nearest_prunes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    asked = df.filter("vec_id % 200 = 0")
    got = {(r.query_id, r.vec_id) for r in ann.search(df, asked).collect()}
    want = set()
    for q in range(0, 6000, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want |= {(q, int(k)) for k in np.lexsort((np.arange(6000), d))[:10]}
    # 300 of 6,000 are reranked
    assert 10 * ann.DEPTH < ann.SHARE * 6000 == 300 and 0.9 <= len(got & want) / len(want)
    assert {(r.query_id, r.vec_id) for r in ann.search(df, asked, share=1.0).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_signatures_are_shared(seed):
    rng = np.random.default_rng(seed)
    bands = ngram_join.Bands(75, 100)
    for _ in range(150):
        n = int(rng.integers(1, 200))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 5, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        both = min(n, -(-3 * n // 4) + int(rng.integers(0, 3)))
        left = int(rng.integers(0, n - both + 1))
        a, b = np.sort(pool[: both + left]), np.sort(np.concatenate([pool[:both], pool[both + left : n]]))
        out, needs = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
        by = {}
        for (sig, who), (inst, need) in zip(out, needs, strict=True):
            for k in (0, 1):
                if inst[k] >= 0:
                    by.setdefault(int(inst[k]), {})[k] = (set(sig[who == k].tolist()), int(need[k]))
        assert any(len(v) == 2 and len(v[0][0] & v[1][0]) >= max(1, v[0][1], v[1][1]) for v in by.values())


def test_signature_covers_two_cells():
    bands = ngram_join.Bands(75, 100)
    assert [int(ngram_join.agree(4, k)) for k in range(9)] == [12, 10, 8, 6, 4, 3, 2, 1, 0]
    low, parts = bands.table(4000)
    for a, p in zip(low[20:-1].tolist(), parts[20:].tolist(), strict=True):
        # a signature is two of three cells of a partition: more than one element of even the smallest set of the band
        assert ngram_join.SUBSET * a / (ngram_join.CELLS * p) > 1.5


def test_common_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    rows = [(k, f"a line in every document\nits own line {k}\nshared by two {k // 2}") for k in range(200)]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows).repartition(4)).collect())
    assert got == [(r["doc_id"], r["text"]) for r in brute_lines([{"doc_id": k, "text": t} for k, t in rows])]


def test_marked(spark):
    rows, wanted = spark.range(1000), spark.createDataFrame([(k,) for k in range(0, 1000, 7)] + [(None,)], "w long")
    got = {r.id for r in common.marked(rows, rows["id"], wanted, wanted["w"], "m").filter("m").collect()}
    assert set(range(0, 1000, 7)) <= got and len(got) < 160


def test_language_keeps_odd_rows(spark):
    net = language_id.train([b"aaa bbb aab " * 9, b"xxyy zzx yzx " * 9], ["a", "x"])
    docs = spark.createDataFrame([(None, "aab aab", "k", 1.0), (1, "zzx", "k", 2.0), (1, "zzx", "k", 2.0), (2, None, "k", 3.0), (3, "12 -", "k", 4.0)], "doc_id long, text string, source string, score double")
    out = language_id.identify(docs, net, keep=("source", "score"))
    assert out.columns == ["doc_id", "source", "lang_pred", "score"]
    assert sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in out.collect()) == [("1", "x", True), ("1", "x", True), ("2", "und", False), ("3", "und", False), ("None", "a", True)]
    assert language_id.identify(docs.limit(0), net).count() == 0 and language_id.fit(docs.withColumn("lang", docs["source"]).limit(0)) is None


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
