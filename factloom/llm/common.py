"""Shared pieces of the training-data operators: scratch tables, shared files, packed arrays."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from factloom.sources.scratch import PLAIN, delete_path, scratch_path
from factloom.sources.scratch import cut as saved

__all__ = ["PLAIN", "delete_path", "saved", "scratch_path"]

#: The white space that separates words and is stripped from lines: space and U+0009 to U+000D.
SPACE_CODES = (9, 10, 11, 12, 13, 32)


#: UTF-8 bytes that go to a Python worker at once: both sides hold a batch, and 10,000 long texts would be one.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of a batch for Python workers to BATCH_BYTES, where they are more or unbounded."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def spread(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions of the session, the knob that grows with the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bits of a filter that a scan passes before it is joined: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str) -> DataFrame:
    """rows with a column name: false where key is surely not among wanted's keys, by a broadcast bitmap of hashed keys.

    The bitmap comes in rows of 4 kB, FILTER_BITS in all. Once keys are many
    more than the bits it marks all rows; the join after it decides. Neither
    side moves. A null key counts as a value.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = wanted.groupBy(F.bitmap_bucket_number(slot(wanted_key)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(wanted_key))).alias("_bits"))
    at = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(slot(key))).join(F.broadcast(bits), "_bucket", "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))


def open_shared(path: str):
    """(file system, path) of a shared folder's path for file access in a task."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)


@contextmanager
def shared_output(path: str, attempt: str):
    """A file to write under a name of its attempt, moved once it is whole: a lost or repeated task leaves no torn file."""
    fs, p = open_shared(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{p}.{attempt}") as f:
        yield f
    fs.move(f"{p}.{attempt}", p)


def write_shared(path: str, data: bytes, attempt: str) -> None:
    with shared_output(path, attempt) as f:
        f.write(data)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pack_u64(values: np.ndarray, level: int = 1) -> bytes:
    """Unsigned 64-bit values as eight byte planes, compressed; sorted values are best given as differences."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack_u64(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes that are hashed at once; a byte takes some 50 bytes of arrays meanwhile.
AT_ONCE = 512 << 10
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    Words are runs of bytes that `is_word` allows, after A-Z is lower-cased. A
    prefix sum of byte values times powers of an odd base gives the hash of any
    run of bytes by one subtraction; the base's inverse moves it to position 0.
    """

    def __init__(self, is_word: np.ndarray, room: int = AT_ONCE + 1):
        self.is_word = is_word
        self.table = mix64((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        self.table = self.table[_FOLD]
        self.room = 0
        self._grow(room)

    def _grow(self, n: int) -> None:
        self.room = n
        one = np.full(n, _BASE, np.uint64)
        one[0] = 1
        self.power = np.multiply.accumulate(one)
        one[1:] = _BASE_INVERSE
        self.inverse = np.multiply.accumulate(one)

    def hashes(self, data: np.ndarray, cuts: np.ndarray):
        """data: the bytes of texts one after another; cuts: where they begin, and the end.

        Returns (hash of each word, its start byte, its end byte, number of words before each cut).
        Beyond AT_ONCE bytes it goes piece by piece, each ending where a word does."""
        found, at = [], 0
        while at < len(data):
            to = min(len(data), at + AT_ONCE)
            if to < len(data):
                gaps = np.flatnonzero(~self.is_word[data[at:to]])
                to = at + int(gaps[-1]) + 1 if len(gaps) else self._word_end(data, to)
            inner = cuts[(cuts > at) & (cuts < to)] - at
            h, starts, ends = self._piece(data[at:to], np.concatenate([[0], inner, [to - at]]))
            found.append((h, starts + at, ends + at))
            at = to
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        h, starts, ends = found[0] if len(found) == 1 else [np.concatenate([none[k], *(f[k] for f in found)]) for k in range(3)]
        return h, starts, ends, np.searchsorted(starts, cuts)

    def _word_end(self, data: np.ndarray, at: int) -> int:
        """The end of a word that is longer than a piece."""
        while at < len(data):
            gaps = np.flatnonzero(~self.is_word[data[at : at + AT_ONCE]])
            if len(gaps):
                return at + int(gaps[0])
            at += AT_ONCE
        return len(data)

    def _piece(self, data: np.ndarray, cuts: np.ndarray):
        n = len(data)
        if n + 1 > self.room:
            self._grow(n + 1 + n // 8)
        word = self.is_word[data]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[cuts[:-1][cuts[:-1] < n]] = False
        starts = np.flatnonzero(word & ~before)
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        last = cuts[1:] - 1
        after[last[last >= 0]] = False
        ends = np.flatnonzero(word & ~after) + 1
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:n], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * self.inverse[starts]
        return mix64(h + (ends - starts).astype(np.uint64)), starts, ends


def space_words() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    ok = np.ones(256, bool)
    ok[list(SPACE_CODES)] = False
    return ok


def alnum_words() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased: digits, letters, all from U+0080."""
    ok = np.zeros(256, bool)
    ok[48:58] = ok[65:91] = ok[97:123] = ok[128:] = True
    return ok


def text_bytes(column):
    """(bytes of all texts as one array, cuts) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def worker_value(key, make):
    """make()'s value, kept by the Python worker for its next tasks; another key replaces it."""
    import sys
    import types

    kept = sys.modules.setdefault("_factloom_worker", types.ModuleType("_factloom_worker")).__dict__
    if kept.get("key") != key:
        kept["key"], kept["value"] = key, make()
    return kept["value"]


def release() -> None:
    """Give a task's freed memory back to the system, so that an idle worker holds little."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)
