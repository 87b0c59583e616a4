"""Token ids on disk by bit-plane shuffling.

Each shard holds the ids of a range of documents in ascending id order. Its ids
are cut into blocks of BLOCK values; a block's 32-bit ids are transposed into
four byte planes and each plane is compressed with zstandard by itself, so the
high planes, nearly constant, shrink to almost nothing. A file is

    magic "PLN1" | planes of block 0 | planes of block 1 | ... |
    zstd(document table: id int64, null flag uint8, n_tokens int64) | zstd(chunk index) | footer

where the chunk index has for each block its number of ids and the offset and
size of every plane, and the footer (little-endian) the sizes of the last two parts,
the numbers of documents and blocks, and the magic again.
"""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common

MAGIC, FOOTER = b"PLN1", "<QQQQ4s"
#: Ids of a block; every block but a shard's last has as many.
BLOCK = 1 << 16
PLANES = 4

#: Chunks of a text whose ids a Python worker keeps, and the greatest length of one.
KEPT_CHUNKS, KEPT_LENGTH = 400_000, 64
#: White space but the space and the newline (a fixed value: all that Unicode has, and the ASCII separators).
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level splitting pattern where all characters are ASCII.
ASCII_PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Letters below this are letters for every library; a mark of these after them is a piece of its own.
LAST_LETTER, MARKS = "\u024f", ".,;:!?"


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in a byte-level vocabulary: printable bytes as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in plain]
    return {k: chr(k) for k in plain} | {k: chr(256 + i) for i, k in enumerate(rest)}


def splits_alike(tokenizer_json: str) -> bool:
    """Whether a tokenizer is proved to split texts as `encoder` does and to encode each piece alone.

    It must be a plain byte-level BPE without dropout, unknown token, affixes
    or byte fallback, with the symbols of all bytes in its vocabulary, a
    byte-level pre-tokenizer that uses its pattern and adds no space, no
    normalizer, and a post-processor that only adds special tokens, if any.
    """
    import json

    t = json.loads(tokenizer_json)
    model, before, after = t["model"], t.get("pre_tokenizer") or {}, t.get("post_processor") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    pattern = before.get("type") == "ByteLevel" and before.get("add_prefix_space") is False and before.get("use_regex", True)
    return bool(plain and pattern and not t.get("normalizer") and after.get("type") in (None, "ByteLevel", "TemplateProcessing") and set(byte_symbols().values()) <= set(model["vocab"]))


def encoder(tokenizer_json: str, special: tuple[str, ...]):
    """A function from a list of texts to their ids, as bytes of little-endian uint32.

    The byte-level splitting pattern takes at most one space before a word and
    never spans a lone space or newline otherwise, so a text whose spaces stand
    alone is the sum of its space-led chunks, and the library encodes each
    distinct chunk once. A chunk of letters, with a mark after them or
    newlines between, or of printable ASCII, is split here by the same pattern and its pieces go to the
    library's model. Texts with special strings, or with
    a space between other white space, go to the library whole, as do all texts
    of a tokenizer that isn't proved to split so (`splits_alike`).
    """
    import re

    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    t.no_truncation()
    t.no_padding()
    model = t.model.tokenize
    symbols = byte_symbols()
    space = symbols[32]

    def ids(texts):
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    if not splits_alike(tokenizer_json):
        whole = lambda texts: [ids([x])[0] if x else b"" for x in texts]
        whole.forget = lambda: None
        return whole

    between = re.compile(r"\s \s").search
    ascii_pieces = re.compile(ASCII_PIECES, re.ASCII).findall

    def odd(x: str) -> bool:
        """Whether a text must go to the library whole."""
        spaced = "  " in x or "\n \n" in x or any(c in x for c in OTHER_SPACE)
        return bool(spaced and between(x)) or any(c in x for c in special)

    marks = dict(zip(MARKS, ids(list(MARKS)), strict=True))
    newline = ids(["\n"])[0]
    as_bytes = [struct.pack("<I", k) for k in range(t.get_vocab_size())]

    def letters(word: str) -> bytes:
        """Ids of letters, with or without a space before them."""
        shown = word.replace(" ", space) if word.isascii() else word.encode().decode("latin-1").translate(symbols)
        return b"".join([as_bytes[x.id] for x in model(shown)])

    def known(word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) <= LAST_LETTER)

    small: dict[str, bytes] = {}

    def piece(shown: str) -> bytes:
        """Ids of a piece of printable ASCII, whose space is shown as its symbol; short ones are remembered."""
        found = small.get(shown)
        if found is None:
            found = b"".join([as_bytes[x.id] for x in model(shown)])
            if len(shown) <= 3 and len(small) < 50_000:
                small[shown] = found
        return found

    def pieces(chunk: str, lead: str) -> bytes | None:
        """Ids of a chunk by its pieces; None if only the library can split it."""
        if chunk.isascii():
            if chunk.isalpha():
                return letters(lead + chunk)
            if chunk.isprintable():
                return b"".join([piece(x.replace(" ", space)) for x in ascii_pieces(lead + chunk)])
        elif known(chunk):
            return letters(lead + chunk)
        else:
            mark = marks.get(chunk[-1:])
            if mark is not None and known(chunk[:-1]):
                return letters(lead + chunk[:-1]) + mark
        if "\n" not in chunk:
            return None
        out = []
        for part in chunk.split("\n"):
            found = pieces(part, lead) if part else None
            if found is None:
                return None
            out.append(found)
            lead = ""
        return newline.join(out)

    class Kept(dict):
        """Ids of chunks, with a space before them."""

        def __missing__(self, chunk: str) -> bytes:
            short = len(chunk) <= KEPT_LENGTH
            found = pieces(chunk, " ") if short else None
            if found is None:
                found = ids([" " + chunk])[0]
            if short:
                if len(self) >= KEPT_CHUNKS:
                    self.clear()
                self[chunk] = found
            return found

    kept = Kept()
    of = kept.__getitem__

    def run(texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for x in texts:
            if not x:
                out.append(b"")
            elif odd(x):
                out.append(ids([x])[0])
            else:
                first, *rest = x.split(" ")
                out.append((pieces(first, "") or ids([first])[0]) + b"".join(map(of, rest)))
        return out

    run.forget = kept.clear
    return run


class ShardWriter:
    """Writes one shard to a file as ids come; a block is compressed and written once it is whole."""

    def __init__(self, out):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=1).compress
        self.out, self.size, self.index, self.docs = out, len(MAGIC), [], []
        out.write(MAGIC)
        self.rest, self.n_rest = [], 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.rest.append(ids)
        self.n_rest += len(ids) // 4
        if self.n_rest >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), np.uint8).reshape(-1, 4)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, end, BLOCK):
            block = ids[a : min(a + BLOCK, end)]
            entry = [len(block)]
            for plane in np.ascontiguousarray(block.T):
                data = self.zip(plane.tobytes())
                entry += [self.size, len(data)]
                self.out.write(data)
                self.size += len(data)
            self.index.append(entry)
        self.rest, self.n_rest = [ids[end:].tobytes()], len(ids) - end

    def finish(self) -> None:
        if self.n_rest:
            self._flush(True)
        ids = np.array([d if d is not None else 0 for d, _ in self.docs], "<i8").tobytes()
        null = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
        table = self.zip(ids + null + np.array([n for _, n in self.docs], "<i8").tobytes())
        index = self.zip(np.array(self.index, "<u8").tobytes())
        self.out.write(table + index + struct.pack(FOOTER, len(table), len(index), len(self.docs), len(self.index), MAGIC))


class ShardReader:
    """Random access to a shard: its document table, and any block by the chunk index."""

    def __init__(self, path: str):
        import zstandard

        self.unzip = lambda b: zstandard.ZstdDecompressor().decompress(b)
        fs, p = common.open_shared(path)
        self.file = fs.open_input_file(p)
        end = self.file.size()
        foot = struct.calcsize(FOOTER)
        n_table, n_index, n_docs, n_blocks, magic = struct.unpack(FOOTER, self._at(end - foot, foot))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of this format")
        table = self.unzip(self._at(end - foot - n_index - n_table, n_table))
        self.ids = np.frombuffer(table, "<i8", n_docs)
        self.null = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
        self.index = np.frombuffer(self.unzip(self._at(end - foot - n_index, n_index)), "<u8").reshape(n_blocks, 1 + 2 * PLANES).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, k: int) -> bytes:
        """The ids of block k as little-endian uint32."""
        planes = [np.frombuffer(self.unzip(self._at(int(o), int(s))), np.uint8) for o, s in self.index[k, 1:].reshape(PLANES, 2)]
        return np.stack(planes, 1).tobytes()

    def documents(self):
        """(document id or None, its ids as bytes), holding one block and one document at a time."""
        block, at, k = b"", 0, 0
        for doc, null, n in zip(self.ids.tolist(), self.null.tolist(), self.lengths.tolist(), strict=True):
            need, parts = n * 4, []
            while need:
                if at == len(block):
                    block, at, k = self.block(k), 0, k + 1
                take = min(need, len(block) - at)
                parts.append(block[at : at + take])
                at, need = at + take, need - take
            yield None if null else doc, b"".join(parts)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the shards of docs; returns (folder, table shard, path, n_docs, n_tokens).

    Shards are ranges of (id, hash of the text), nulls first, so many rows of one id spread
    over shards. The table names only files of tasks that ended, so a lost
    executor or a second attempt changes nothing.
    """
    import json

    spark = docs.sparkSession
    common.bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    special = tuple(x["content"] for x in json.loads(model).get("added_tokens", []))
    shared = spark.sparkContext.broadcast((model, special))  # a vocabulary file: bounded
    folder = common.scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    rows = rows.repartitionByRange(common.spread(spark), F.col("_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_tie", "_text").select("_id", "_text")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        batches = (b for b in batches if len(b))
        head = next(batches, None)
        if head is None:
            return
        encode, end = common.worker_value(shared.value, lambda: encoder(*shared.value)), struct.pack("<I", end_id)
        k = TaskContext.get().partitionId()
        path = f"{folder}/shard-{k:06d}-{uuid.uuid4().hex[:8]}.pln"
        with common.shared_output(path, "part") as out:
            w = ShardWriter(out)
            for b in itertools.chain([head], batches):
                names = b.column(0).to_pylist()
                for a in range(0, len(names), 128):
                    for doc, ids in zip(names[a : a + 128], encode(b.column(1).slice(a, 128).to_pylist()), strict=True):
                        w.add(doc, ids + end)
            w.finish()
        encode.forget()  # an idle worker holds no table
        if w.docs:
            yield pa.RecordBatch.from_pydict({"shard": [k], "path": [path], "n_docs": [len(w.docs)], "n_tokens": [sum(n for _, n in w.docs)]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return folder, common.saved(rows.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "shards")


def read_tokens(spark: SparkSession, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of every document, read from the shard files.

    start counts the ids of all documents before it, over all shards.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    plan = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "base").repartition(common.spread(spark), "path")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, n, crc = [], [], []
                for doc, data in ShardReader(path).documents():
                    ids.append(doc)
                    n.append(len(data) // 4)
                    crc.append(zlib.crc32(data))
                start = base + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files and read them back: id_col, start, n_tokens, ids_crc32.

    Documents stand in ascending id order, null ids first; rows of one id are
    ordered by a hash of the text, then the text, and each keeps its place. A null or empty text has
    only end_id. Special strings inside a text are what the library makes of
    them by default. An empty table writes no file and gives no row; other columns are not read.
    """
    _, shards = write_tokens(docs, tokenizer_path, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, shards, id_col)
