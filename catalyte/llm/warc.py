"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader cuts archives into byte ranges that
know nothing of each other: a task looks for the gzip magic from its range's start on,
takes a candidate only if its first bytes inflate to a WARC header, and from there follows
member after member. It owns the records that start inside its range, and reads past the
range's end to finish the last of them. Files are reached through ``pyarrow.fs``, so a path
may be in any store it knows, as long as all executors see it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize, scratch, table, text_or_empty
from .tokens import pieces_of

#: gzip magic with the deflate method; a record's flags are none or a few known ones.
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 18
#: What a header must begin with, once inflated.
FIRST_LINE = re.compile(rb"WARC/1\.[01]\r\n")


# --- records ---------------------------------------------------------------------------


def _record(page_id, url: str | None, payload: bytes, n: int, digest: str, refers_to) -> bytes:
    """One WARC record, compressed. A revisit carries HTTP headers but no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {n}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(4, f"WARC-Refers-To: <urn:page:{refers_to}>")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _urn(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


# --- writing ---------------------------------------------------------------------------


#: Repeated payloads up to which their digests (about 100 bytes each) are sent to all tasks.
MOST_SENT = 500_000


def plan_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Add payload, n, digest and refers_to (the smallest page_id with the same payload, for all others).

    Only digests are shuffled, to find those that occur more than once. If these are few they
    are sent to where the pages lie, and no payload moves; else payloads and digests are
    joined, a join whose hot keys adaptive execution splits.
    """
    sized = pages.select("page_id", "url", text_or_empty("html").alias("payload")).withColumns(
        {"n": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)}
    )
    groups = (
        sized.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first is not null")
        .select(F.col("digest").alias("__digest"), "first")
    )
    groups = materialize(groups, "warc-repeated")
    joined = sized.join(F.broadcast(groups) if groups.count() <= MOST_SENT else groups, F.col("digest") == F.col("__digest"), "left")
    return joined.select("page_id", "url", "payload", "n", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, *, least: int = 100, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write (page_id, url, html) as archives under ``path``; returns the manifest (file, bytes, records).

    Every task writes under a name of its attempt and renames when done, so lost or repeated
    tasks leave no half archive, and no late attempt replaces what the manifest has sized. What the manifest
    names is the result; whole archives of attempts that lost may lie beside it. Null html is an empty payload, a null url leaves its header
    out, a null page_id is never referred to, equal rows each get a record (those of a repeated
    payload's smallest page_id are all responses). Other columns are ignored, whatever their
    names. A payload of any length is one record; no rows make no archive.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        made, out, name, size, count = [], None, "", 0, 0

        def close():
            nonlocal out
            out.close()
            final = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
            store.move(name, f"{root}/{final}")
            made.append((final, size, count))
            out = None

        for batch in pieces_of(batches):
            for page_id, url, payload, n, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, count = f"{root}/.try-{task.taskAttemptId()}-{len(made)}", 0, 0
                    out = store.open_output_stream(name)
                record = _record(page_id, url, payload.encode(), n, digest, first)
                out.write(record)
                size, count = size + len(record), count + 1
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "bytes", "records"])

    return materialize(plan_revisits(pages, least).mapInArrow(run, "file string, bytes long, records long"), "warc-manifest")


# --- reading ---------------------------------------------------------------------------


class _Bytes:
    """A window over an open file that moves forward and grows as needed."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def more(self) -> bool:
        place = self.at + len(self.data)
        if place >= self.size:
            return False
        self.file.seek(place)
        self.data += self.file.read(min(BLOCK, self.size - place))
        return True

    def skip(self, n: int):
        self.data, self.at = self.data[n:], self.at + n


def _looks_like_record(head: bytes) -> bool:
    """Does a gzip member start here whose content is a WARC header?"""
    try:
        return FIRST_LINE.match(zlib.decompressobj(31).decompress(head, 64)) is not None
    except zlib.error:
        return False


def first_record(data: _Bytes, end: int) -> bool:
    """Move ``data`` to the first record that starts before ``end``."""
    while data.at < end:
        k = data.data.find(MAGIC)
        if k < 0:
            data.skip(max(0, len(data.data) - 2))  # the magic may straddle two blocks
            if not data.more():
                return False
            continue
        data.skip(k)
        if data.at >= end:
            return False
        while len(data.data) < 4096 and data.more():
            pass
        if _looks_like_record(data.data[:4096]):
            return True
        data.skip(1)
    return False


def _member(data: _Bytes) -> bytes:
    """Inflate the member at hand and move behind it."""
    inflate, out = zlib.decompressobj(31), []
    while True:
        if not data.data and not data.more():
            raise EOFError("an archive ends inside a record")
        used = len(data.data)
        out.append(inflate.decompress(data.data))
        data.skip(used - len(inflate.unused_data))
        if inflate.eof:
            return b"".join(out)


def records_in(file, size: int, start: int, end: int):
    """Headers and block of every record that starts in [start, end)."""
    data = _Bytes(file, size, start)
    if not first_record(data, end):
        return
    while data.at < end and (data.data or data.more()):
        head, _, block = _member(data).partition(b"\r\n\r\n")
        found = _headers(head)
        yield found, block[: int(found["content-length"])]


#: A read is cut into so many ranges at most, whatever it holds.
MOST_RANGES = 50_000


def split_ranges(manifest: DataFrame, split_bytes: int) -> tuple[DataFrame, int]:
    """(file, size, start, end) of every byte range, and how many there are about."""
    total, count = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    each = max(split_bytes, -(-total // MOST_RANGES))
    starts = manifest.filter("bytes > 0").select("file", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(each).cast("long"))).alias("start"))
    return starts.withColumn("end", F.least("size", F.col("start") + each)), total // each + count


def read_warc(spark: SparkSession, path: str, manifest: DataFrame, *, split_bytes: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """Read archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url and,
    with ``payloads``, the payload (null for revisits). ``manifest``: file (under ``path``) and
    bytes, one row a file; no files give no rows. Ranges grow with the archives above
    ``MOST_RANGES`` times ``split_bytes``. A response whose payload differs from its digest is
    an error, as is an archive that ends inside a record.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(batches):
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{name}") as file:
                    for head, block in records_in(file, size, start, end):
                        digest, n, payload = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"]), None
                        if head["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: {head['warc-record-id']} does not match its digest")
                        yield (_urn(head["warc-record-id"]), n, digest, head["warc-type"], _urn(head.get("warc-refers-to")), head.get("warc-target-uri"), *([payload] if payloads else []))

    def run(batches):
        some: list[tuple] = []
        held = 0
        for row in rows(batches):
            some.append(row)
            held += len(row[-1] or b"") if payloads else 0
            if len(some) >= 4096 or held >= 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=[x.split()[0] for x in schema.split(", ")])
                some, held = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=[x.split()[0] for x in schema.split(", ")])

    ranges, number = split_ranges(manifest, split_bytes)
    return ranges.repartition(max(1, number)).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to archives and back."""
    bounded_batches(spark)
    path = scratch(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, manifest, split_bytes=8 << 20, payloads=False).drop("url")


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), g AS (
            SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM g
    """
}
