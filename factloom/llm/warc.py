"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent zstd frames, each with whole records, then a
skippable frame with the seek table (compressed and decompressed size of each
frame), in Zstandard's seekable format. The record index maps a record to its bundle, frame
and offset inside the frame, so any record is read by one seek and one frame.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: Numbers of the seekable format: a skippable frame's magic, the seek table's magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed at so many bytes, a bundle at so many before compression.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Payloads from this size on are written once; equal ones become revisits.
REVISIT_BYTES = 1000
NO_DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"
#: Parts in which the rows of one repeated digest are dealt.
SALTS = 16

INDEX = "bundle string, frame int, frame_offset long, frame_size long, page_id array<long>, record_offset array<long>, record_size array<long>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, html: bytes, n_bytes: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its header has the payload's digest and length."""
    kind = "revisit" if revisit else "response"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {NO_DATE}"]
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head += [f"WARC-Target-URI: {target}"] if url is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    body = b"" if revisit else html
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n_bytes}", f"Content-Length: {len(body)}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class BundleWriter:
    """Collects records into frames; finish() appends the seek table."""

    def __init__(self):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=3).compress
        self.parts, self.frames, self.size, self.plain = [], [], 0, 0
        self.open, self.open_size, self.entries, self.index = [], 0, [], []

    def add(self, page_id, data: bytes) -> None:
        if self.open and self.open_size + len(data) > FRAME_BYTES:
            self._close()
        self.entries.append((page_id, self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)
        self.plain += len(data)

    def _close(self) -> None:
        frame = self.zip(b"".join(self.open))
        self.index.append((len(self.frames), self.size, len(frame), self.entries))
        self.frames.append((len(frame), self.open_size))
        self.parts.append(frame)
        self.size += len(frame)
        self.open, self.open_size, self.entries = [], 0, []

    def finish(self) -> bytes:
        if self.open:
            self._close()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(table)), table])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = list(struct.iter_unpack("<II", data[-9 - 8 * n : -9]))
    out, at = [], 0
    for a, b in sizes:
        out.append((at, a, b))
        at += a
    return out


def read_record(path: str, frame: int, offset: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: the footer gives the frame, only that frame is decompressed."""
    import zstandard

    fs, p = common.open_shared(path)
    with fs.open_input_file(p) as f:
        f.seek(f.size() - 9)
        n = struct.unpack("<IBI", f.read(9))[0]
        f.seek(f.size() - 9 - 8 * n)
        at, packed, _ = seek_table(f.read(9 + 8 * n))[frame]
        f.seek(at)
        return parse(zstandard.ZstdDecompressor().decompress(f.read(packed))[offset : offset + size])


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with n_bytes, digest, revisit and refers_to (the largest page_id of equal payloads of REVISIT_BYTES or more)."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumns({"n_bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    large = common.saved(rows.filter(F.col("n_bytes") >= REVISIT_BYTES).select("page_id", "url", "n_bytes", "digest"), "warc-digests")
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    last = common.saved(last, "warc-repeats")
    # a revisit needs no payload: it comes from the narrow rows, of which only those of a repeated digest move, dealt in SALTS parts
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    again = common.marked(large, F.col("digest"), last, F.col("digest"), "_maybe").filter("_maybe").withColumn("_s", salt("page_id"))
    revisits = again.join(last.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "_s"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = common.saved(revisits.select("page_id", "url", "n_bytes", "digest", "refers_to"), "warc-revisits")
    # a payload stays where it is read unless the bitmap of revisits' pages may hold it
    checked = common.marked(rows, F.col("page_id"), revisits, F.col("page_id"), "_maybe")
    mine = revisits.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d")).distinct()
    rest = checked.filter("_maybe").join(mine, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left_anti")
    responses = checked.filter("not _maybe").unionByName(rest).select("page_id", "url", "html", "n_bytes", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    return responses.unionByName(revisits.select("page_id", "url", F.lit(b"").alias("html"), "n_bytes", "digest", "refers_to", F.lit(True).alias("revisit")))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write bundles into the shared folder; returns their index, a row for each frame."""
    spark = pages.sparkSession
    common.bound_batches(spark)
    folder = common.scratch_path(spark, "warc")

    def run(batches):
        import uuid

        import pyarrow as pa

        def closed(w):
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            common.write_shared(path, w.finish(), "part")
            columns = [[path] * len(w.index), *([x[k] for x in w.index] for k in range(3)), *([[e[k] for e in x[3]] for x in w.index] for k in range(3))]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bundle", "frame", "frame_offset", "frame_size", "page_id", "record_offset", "record_size"])

        w = BundleWriter()
        for b in batches:
            for page, url, html, n, digest, refers, revisit in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                w.add(page, record(page, url, html, n, digest, refers, revisit))
                if w.plain >= BUNDLE_BYTES:
                    yield closed(w)
                    w = BundleWriter()
        if w.plain:
            yield closed(w)

    return common.saved(plan_records(pages).mapInArrow(run, INDEX), "warc-index")


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the bundles.

    A response's payload is read and its digest and length computed anew; a
    wrong one is an error. A revisit's come from its header.
    """
    def run(batches):
        import hashlib

        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for row in b.to_pylist():
                fs, p = common.open_shared(row["bundle"])
                with fs.open_input_file(p) as f:
                    f.seek(row["frame_offset"])
                    plain = unzip.decompress(f.read(row["frame_size"]))
                for page, at, size in zip(row["page_id"], row["record_offset"], row["record_size"], strict=True):
                    fields, body = parse(plain[at : at + size])
                    named = fields["WARC-Record-ID"][1 + len(URN) : -1]
                    if named != ("" if page is None else str(page)):
                        raise ValueError(f"the index has {page} where the archive has {named}")
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, n):
                        raise ValueError(f"page {page}: the payload read is not the one written")
                    refers = int(fields["WARC-Refers-To"][1 + len(URN) : -1]) if kind == "revisit" else None
                    out.append((page, n, digest, kind, refers))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(5)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.repartition(common.spread(spark), "bundle", "frame").mapInArrow(run, RECORDS)


def warc_archives(pages: DataFrame) -> DataFrame:
    """Write a record for each row of pages and read all back.

    A null html is an empty payload. Payloads under REVISIT_BYTES are all
    responses, and so are rows whose page_id equals the response's (repeated rows).
    Null page_ids are written too: among equal payloads they are revisits, unless all are null. An
    empty table gives no bundle and no row; other columns are not read.
    """
    return read_archives(pages.sparkSession, write_archives(pages))


ORACLE_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
m as (select d, max(page_id) as r from p where n >= 1000 group by d having count(*) > 1)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when r is not null and page_id is distinct from r then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from r then r end as refers_to
from p left join m using (d)
"""
