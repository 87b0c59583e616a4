"""Token counts, token files, WARC bundles, packing and chat formatting against brute force."""

import hashlib
import io
import itertools
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from factloom.llm import chat_format, packing, token_counts, token_output, warc

ODD = ["", None, "a", " ", "  ", "a b", " lead", "trail ", "two  spaces", "tab\t \tmix", "nl\n next\n\n x", "<|endoftext|> inside <s></s><unk>", "▁mark ▁", "é ü ß 中文 🎉 x", "don't we'll I'd 123 4.5 -- ...", "x" * 3000, "word " * 5000, "a\x00b \x1f", " nbsp  em", "a \n b", " \n", "same row", "same row"]
SCHEMA = "lang string, doc_id long, text string, n_tokens string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([("en", k + first, t, "clash") for k, t in enumerate(texts)], SCHEMA)


def sample(n=150):
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:n]


def test_token_counts_equal_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + sample()
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts), path).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 4096), t
    assert token_counts.whole_tokens(open(path, "rb").read())
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ODD + sample()
    rows = token_output.token_files(frame(spark, texts), path, 2).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(rows, texts, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert token_output.token_files(frame(spark, []), path, 2).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c")], "doc_id long, text string")
    got = token_output.token_files(nulls, path, 2).collect()
    assert sorted(r.start for r in got) == [0, 2, 4, 6] and {r.start for r in got if r.doc_id is None} == {0, 2}


def test_shard_blocks(tmp_path):
    out = io.BytesIO()
    w = token_output.ShardWriter(out)
    data = [np.random.default_rng(k).integers(0, 2**32, n, dtype=np.uint32).tobytes() for k, n in enumerate([1, 200_000, 0, 3, 65_536])]
    for k, d in enumerate(data):
        w.add(None if k == 3 else k, d)
    assert out.tell() > 4 * len(data[1]) // 5  # whole blocks are in the file already
    w.finish()
    (tmp_path / "x").write_bytes(out.getvalue())
    r = token_output.ShardReader(str(tmp_path / "x"))
    assert list(r.documents()) == [(None if k == 3 else k, d) for k, d in enumerate(data)]
    assert r.block(1) == b"".join(data)[4 * token_output.BLOCK : 8 * token_output.BLOCK]


@pytest.mark.parametrize("change", ["none", "prefix space", "normalizer", "pattern", "dropped symbol", "truncation"])
def test_other_tokenizers_equal_library(change):
    from tokenizers import Tokenizer

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    if change == "prefix space":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "normalizer":
        spec["normalizer"] = {"type": "Lowercase"}
    elif change == "pattern":
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, spec["pre_tokenizer"]]}
    elif change == "dropped symbol":
        spec["model"]["unk_token"] = "!"
    elif change == "truncation":
        spec["truncation"] = {"max_length": 5, "strategy": "LongestFirst", "stride": 0, "direction": "Right"}
    made = json.dumps(spec)
    assert token_output.splits_alike(made) == (change in ("none", "truncation"))
    t = Tokenizer.from_str(made)
    t.no_truncation()
    texts = [x for x in ODD if x is not None] + ["One 12 TWO 345", " LEAD"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert token_output.encoder(made, ("<|endoftext|>",))(texts) == want


def test_warc_round_trip(spark):
    big, other = "é" * 700, "b" * 1000
    html = [big, "x", "x", None, big, other, big, "", "c" * 999, "c" * 999, "z" * 600_000]
    rows = [(f"http://h/{k}", h, k, "clash") for k, h in enumerate(html)] + [(None, other, 5, "again"), ("u\r\nX: y", big, None, "null id")]
    pages = spark.createDataFrame(rows, "url string, html string, page_id long, digest string")
    index = warc.write_archives(pages)
    got = warc.read_archives(spark, index).collect()
    assert len(got) == len(rows)
    want = []
    for _, h, k, _ in rows:
        data = (h or "").encode()
        same = [p for _, x, p, _ in rows if x == h and p is not None]
        best = max(same) if len(data) >= 1000 and sum(x == h for _, x, _, _ in rows) > 1 else None
        revisit = best is not None and best != k
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    for r in index.collect():
        for page, at, size in zip(r.page_id, r.record_offset, r.record_size, strict=True):
            fields, body = warc.read_record(r.bundle, r.frame, at, size)
            assert fields["WARC-Record-ID"] == f"<urn:page:{'' if page is None else page}>"
            if fields["WARC-Type"] == "response":
                assert body == (html[page] or "").encode()
    assert warc.warc_archives(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_bounds_are_optimal(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    lengths = sorted(rng.choice(40, n, replace=False) + 1)
    histogram = [(int(x), int(rng.integers(1, 20))) for x in lengths]
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in histogram)
    for k in range(1, 6):
        best = min(cost([*cut, int(lengths[-1])]) for m in range(min(k, n)) for cut in itertools.combinations(map(int, lengths[:-1]), m))
        got = packing.optimal_bounds(histogram, k)
        assert len(got) <= k and cost(got) == best


def test_packing(spark):
    texts = [None, "", " \t", *(" ".join(["w"] * n) for n in (1, 1, 1, 2, 5, 5, 9, 30, 31, 90, 40_001))]
    rows = packing.pack(frame(spark, texts), buckets=4, budget=64).collect()
    assert len(rows) == len(texts)
    batches = defaultdict(list)
    for r in rows:
        n = len((texts[r.doc_id] or "").split())
        assert r.length == n and (r.bucket is None) == (n == 0)
        if n:
            assert r.padding == r.bucket_length - n >= 0
            batches[r.bucket, r.batch].append(r)
    for (bucket, _), rs in batches.items():
        room = max(1, 64 // rs[0].bucket_length)
        assert len(rs) <= room and sorted(r.slot for r in rs) == list(range(len(rs)))
    for bucket in {b for b, _ in batches}:
        mine = sorted(k for b, k in batches if b == bucket)
        assert mine == list(range(len(mine)))
        assert all(len(batches[bucket, k]) == max(1, 64 // batches[bucket, k][0].bucket_length) for k in mine[:-1])
    assert packing.pack(frame(spark, [])).count() == 0 and packing.pack(frame(spark, [None])).first().batch is None


def test_bins_hold_real_lengths(spark):
    lengths = [5, 5, 40_001, 40_002, 40_003, 90_000]
    docs = spark.createDataFrame([(None if k == 0 else k, str(k), n) for k, n in enumerate(lengths)], "doc_id long, text string, n long")
    rows = packing.pack(docs, length=docs["n"], buckets=3, budget=64).collect()
    assert sorted((r.length, r.bucket_length, r.padding) for r in rows) == [(5, 5, 0), (5, 5, 0), (40_001, 40_003, 2), (40_002, 40_003, 1), (40_003, 40_003, 0), (90_000, 90_000, 0)]
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows) and sum(r.doc_id is None for r in rows) == 1


def test_packing_of_tokens(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "  ", *sample(30), "a very long text " * 20_000]
    rows = packing.pack_tokens(frame(spark, texts), path).collect()
    assert {r.doc_id: r.length for r in rows} == {k: len(sp.encode(t or "")) for k, t in enumerate(texts)}
    assert all((r.batch is None) == (r.length == 0) for r in rows)
    assert packing.pack_tokens(frame(spark, []), path).count() == 0


def test_packing_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 7)
    rows = packing.pack(frame(spark, ["a b"] * 100 + ["c"] * 50), buckets=2, budget=6).collect()
    seen = sorted((r.bucket, r.batch, r.slot) for r in rows)
    assert seen == [(0, k // 6, k % 6) for k in range(50)] + [(1, k // 3, k % 3) for k in range(100)]


def brute_chats(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role, text))
    low = lambda x: tuple((v is not None, v if v is not None else "") for v in x)
    seqs = {c: tuple((r, t) for _, r, t in sorted(v, key=low)) for c, v in convs.items()}
    keep = {}
    for c in sorted(seqs):
        if not any(len(o) > len(seqs[c]) and o[: len(seqs[c])] == seqs[c] for o in seqs.values()):
            keep.setdefault(seqs[c], []).append(c)
    return {v[0]: (len(s), len(v), "".join(f"<|im_start|>{'user' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in s)) for s, v in keep.items()}


def test_chat_format(spark):
    long = "é" * 100_000
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (3, 0, "user", "hi"), (4, 0, None, None), (5, 0, "user", ""), (6, None, "user", "a"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "z"), (8, 3, "user", long), (9, 5, "user", long), (9, 6, "user", long)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_format.format_chats(df).collect()}
    assert got == brute_chats(rows)
    assert chat_format.format_chats(df.limit(0)).count() == 0
