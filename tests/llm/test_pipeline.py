"""The pipeline's stages against brute force on whole small tables."""

import importlib
import re

import corpus_pipeline as P
from factloom.llm import language_id

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows):
    owner, holders = {}, {}
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            holders.setdefault(key(line), set()).add(r["doc_id"])
    owner = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) > 1}
    return [r | {"text": "\n".join(x for x in (r["text"] or "").split("\n") if owner.get(key(x), r["doc_id"]) == r["doc_id"])} for r in rows]


def shingles(text):
    w = words(low(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [(r["doc_id"], shingles(r["text"] or "")) for r in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k, _ in sets}


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    hit, names = set(), set()
    for name, item in items:
        q = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item or ""))
        n = min(13, len(q))
        for g in {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == g:
                    hit.update(range(k, k + n))
                    names.add(name)
    return len(w), len(hit), names


def dicts(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    one = P.identify_language(spark, docs, DIR)
    one.write.parquet(str(tmp_path / "1"))
    one = spark.read.parquet(str(tmp_path / "1"))
    start, rows = dicts(docs), dicts(one)
    ids = {r["doc_id"] for r in rows}
    for r in start:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert r["doc_id"] not in ids
    assert len(rows) >= 0.99 * sum(bool(re.search(r"[^\W\d_]", r["text"] or "")) for r in start)

    two = P.drop_repeated_lines(spark, one, DIR)
    two.write.parquet(str(tmp_path / "2"))
    two, want = spark.read.parquet(str(tmp_path / "2")), brute_lines(rows)
    got = dicts(two)
    assert [(r["doc_id"], r["text"], r["lang"]) for r in got] == [(r["doc_id"], r["text"], r["lang"]) for r in want]
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    three = P.drop_near_duplicates(spark, two, DIR)
    three.write.parquet(str(tmp_path / "3"))
    three, group = spark.read.parquet(str(tmp_path / "3")), brute_groups(got)
    left = dicts(three)
    assert [r["doc_id"] for r in left] == [k for k in sorted(group) if group[k] == k]

    four = P.drop_contaminated(spark, three, DIR)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = []
    for r in left:
        n, hit, _ = brute_hits(r["text"], items)
        if not (hit and 20 * hit >= n):
            clean.append(r["doc_id"])
    assert [r["doc_id"] for r in dicts(four)] == clean

    five = P.run(spark, DIR)
    assert sorted(r.doc_id for r in five.collect()) == clean


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "word " * 30, None, None, 1), (3, "word " * 30, None, None, 1), (None, "les mots de la fin " * 8, "fr", "s", 3), (None, "other words in the end of it " * 8, "en", "s", 3), (5, "x " * 40_000, "en", "s", 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert P.drop_repeated_lines(spark, docs, DIR).count() == len(rows)
    near = P.drop_near_duplicates(spark, docs, DIR)
    assert near.columns == list(P.COLUMNS) and sorted(str(r.doc_id) for r in near.collect()) == sorted(["None", "None", "None", "1", "2", "3", "5"])
    assert P.drop_contaminated(spark, docs, DIR).count() == len(rows)
    assert P.pack_batches(spark, docs, DIR).count() == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0
    only = P.identify_language(spark, docs, DIR).collect()
    assert all(r.text for r in only)


def test_entry_works_without_llm(monkeypatch):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op1_ngram_join" in entry.queries()
    monkeypatch.setattr(entry, "OPTIONAL", ("factloom.llm.no_such_module", "no_such_pipeline"))
    names = entry.queries()
    assert names and not any(k.startswith("op") or k == "pipeline" for k in names)
    monkeypatch.undo()
    assert importlib.import_module("factloom.llm.queries").queries()


def test_names():
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"] and language_id.UNKNOWN == "und"
