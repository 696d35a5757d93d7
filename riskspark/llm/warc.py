"""WARC archives: writing with identical-payload revisits, and a sequential reader.

An archive file is a series of gzip members, one record each. The reader takes the file in
blocks, inflates one member at a time with an incremental zlib object, splits headers from
content by Content-Length and checks the payload digest on the way, so its memory holds one
block and one record's headers, besides the payload where the caller asks for it.

Writing runs as Spark tasks: a task writes files of its own under new names and returns one
row for each finished file; that list is stored, and only files on it are read. What a lost
or repeated task left behind is on no list.

Defined cases: a null payload is an empty one; null keys are written as such and come back
null; rows that repeat a key and payload are all responses if that key is the smallest, else
all revisits; a null key is never the smallest unless all are null; an empty table gives no
file and no rows; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.llm.common import read, shared_path, stored

MIN_REVISIT_BYTES = 100        # shorter payloads are always written in full
FILE_BYTES = 64 << 20          # a task begins a new file beyond this many compressed bytes
BLOCK = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the standard
KEY_URN = "urn:record:"


class WarcError(ValueError):
    """A record that breaks the format or whose payload doesn't have its digest."""


# ---------------------------------------------------------------- records

def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member, its block the payload itself. A revisit carries no payload,
    but its digest and length."""
    name = lambda k: f"<{KEY_URN}{'' if k is None else k}>"
    content = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(content)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(content) + z.compress(b"\r\n\r\n") + z.flush()


def read_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an open archive in order: their headers (lower-case names), plus
    ``payload_sha256`` and ``payload_bytes`` of what stands in the file, and ``payload``
    where asked for. Raises WarcError on damage: a cut or corrupt member, wrong framing, or
    a payload that doesn't match its digest or length."""
    raw = stream.read(BLOCK)
    while raw:
        z = zlib.decompressobj(31)
        head, headers, left, sha, size, kept = b"", None, 0, hashlib.sha256(), 0, []
        tail = b""
        while not z.eof:
            if not raw:
                raw = stream.read(BLOCK)
                if not raw:
                    raise WarcError("the file ends within a member")
            try:
                data = z.decompress(raw, BLOCK)
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            raw = z.unused_data if z.eof else z.unconsumed_tail
            if headers is None:
                head += data
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    continue
                headers = parse_head(head[:end])
                data, left = head[end + 4:], headers["content-length"]
            body, data = data[:left], data[left:]
            if body:
                sha.update(body)
                size, left = size + len(body), left - len(body)
                if with_payload:
                    kept.append(body)
            tail += data
            if len(tail) > 4:
                raise WarcError("content longer than Content-Length")
        if headers is None or left or tail != b"\r\n\r\n":
            raise WarcError("content shorter than Content-Length")
        out = headers | {"payload_sha256": sha.hexdigest(), "payload_bytes": size}
        if headers.get("warc-type") != "revisit" and headers.get("warc-payload-digest") != f"sha256:{out['payload_sha256']}":
            raise WarcError(f"wrong payload digest in {headers.get('warc-record-id')}")
        if with_payload:
            out["payload"] = b"".join(kept)
        yield out
        raw = raw or stream.read(BLOCK)


def parse_head(head: bytes) -> dict:
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise WarcError(f"not a record: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    if not out.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    return out | {"content-length": int(out["content-length"])}


def key_of(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(KEY_URN)
    return int(digits) if digits else None


# ---------------------------------------------------------------- Spark jobs

def mark_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """``pages`` (key, url, payload) with _digest (sha256) and _first, the smallest key of rows
    with an equal payload. Digests are counted before they are joined, and the join is a
    plain equi-join, so Spark splits a payload that a third of the rows share."""
    pages = pages.withColumn("_digest", F.sha2(F.encode(F.coalesce(payload, F.lit("")), "UTF-8"), 256))
    shared = (pages.filter(F.octet_length(payload) >= MIN_REVISIT_BYTES).groupBy("_digest")
              .agg(F.min(key).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    return pages.join(shared, "_digest", "left")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record for each row; returns the stored list of files (path, records, bytes)."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, rows = None, None, []
        for rb in batches:
            for k, u, p, d, first in zip(*(rb.column(c).to_pylist() for c in (key, url, payload, "_digest", "_first"))):
                if out is None:
                    place, base = fs.FileSystem.from_uri(path)
                    place.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = place.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                body = (p or "").encode()
                member = record(k, u, body, d, first, first is not None and k != first, date)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    rows.append((f"{path}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            rows.append((f"{path}/{name}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    marked = mark_revisits(pages.select(key, url, payload), key, payload)
    return stored(marked.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def scan(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the listed archives (column path), one task reading whole files in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * with_payload
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        for rb in batches:
            for path in rb.column("path").to_pylist():
                place, base = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with place.open_input_stream(base, compression=None) as f:
                    for r in read_records(f, with_payload):
                        rows.append((key_of(r["warc-record-id"]), r.get("warc-target-uri"), int(r["x-payload-length"]), r["warc-payload-digest"].removeprefix("sha256:"), r["warc-type"], key_of(r.get("warc-refers-to")), *([r["payload"]] if with_payload else [])))
                        size += r["payload_bytes"]
                        if len(rows) >= 4096 or with_payload and size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)], names)

    # by whole files; their number follows the data and each is bounded, so files are dealt out evenly
    wide = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path").repartition(wide, "path").mapInArrow(run, RECORD + ", payload binary" * with_payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every row of pages to archives and reads them back."""
    files = write(read(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return scan(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, strlen(h) n, sha256(h) d from p),
f as (select d, min(page_id) first from q where n >= {MIN_REVISIT_BYTES} group by d having count(*) > 1)
select page_id, n::bigint payload_bytes, q.d payload_digest, case when first is null or page_id is not distinct from first then 'response' else 'revisit' end record_type,
  case when page_id is distinct from first then first end refers_to
from q left join f on q.d = f.d"""
