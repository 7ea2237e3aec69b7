"""WARC archives with a two-level capture index.

Writing: a table of decisions says of each page whether it is a response or a
revisit of an equal payload; then each task writes one archive, a gzip member
a record, into the shared folder, under a name of its own, and returns where
each record lies. Only rows of tasks that ended count, so a task run twice
leaves an archive that nothing points to.

Index: capture lines are sorted by reversed-host URL key (and page_id) over
range partitions and packed into compressed blocks; a sparse directory has the
first key of each block and where it lies. A lookup binary-searches the
directory, inflates one block, and reads the record's byte range.

Reading back: the blocks are read in order of the directory, their captures
dealt by archive, and each archive's ranges read in order of offset, adjoining
ones together.

Null html counts as empty, a null URL has the key "-". Of records with equal
payloads of at least MIN_REVISIT bytes that with the smallest page_id is the
response (rows that repeat it: one is), the others revisit it; smaller ones are
all responses. A null page_id comes last. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.llm import common

MIN_REVISIT = 100
#: Capture lines of a block.
BLOCK_LINES = 512
#: Adjoining ranges are read together up to this many bytes.
READ_BYTES = 4 << 20
_NO_ID = 2**63 - 1
_CDX = "key string, page_id long, url string, type string, refers_to long, payload_bytes long, digest string, archive string, start long, size long"


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: com,example,www)/path?query, without scheme, user and fragment."""
    if not url:
        return "-"
    try:
        p = urlsplit(url if "//" in url else "//" + url)
        host, port = (p.hostname or "").rstrip("."), p.port
    except ValueError:
        return "-"
    port = f":{port}" if port and port not in (80, 443) else ""
    tail = p.path or "/"
    if p.query:
        tail += "?" + "&".join(sorted(p.query.split("&")))
    return (",".join(reversed(host.split("."))) + port + ")" + tail).replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")


def _open(base: str):
    """The file system and path of a folder URL, as pyarrow has them."""
    return pafs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else "file://" + base)


def _record(page_id, url: str, kind: str, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload if kind == "response" else b"")
    safe = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {safe}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record (inflated)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(out["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"headers": out, "payload": payload, "size": size}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, kind, refers, digest, html in zip(*(c for c in (b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)))):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    member = gzip.compress(_record(page_id, url or "", kind, digest, len(payload), refers, payload), 1, mtime=0)
                    if out is None:
                        where, path = _open(folder)
                        where.create_dir(path, recursive=True)
                        out = where.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member)
                    rows.append((surt(url), page_id, url, kind, refers, len(payload), digest, name, at, len(member)))
                    at += len(member)
                cols = list(zip(*rows)) if rows else [[]] * 10
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _CDX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """A record per page into archives under folder/archives; their capture lines."""
    common.ship(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    ident = F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    # one row a digest, so that texts need not be sorted or joined by what may repeat a million times
    first = rows.select("digest", F.octet_length("html").alias("n"), ident.alias("ident")).where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("ident").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (ident != F.col("first"))
    rows = rows.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, F.col("first")).alias("refers_to"), "digest", F.encode("html", "utf-8").alias("html"))
    return common.saved(rows.mapInArrow(_writer(f"{folder}/archives"), _CDX), f"{folder}/captures")


def _packer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, out, lines, first = f"{uuid.uuid4().hex}.cdx.gz", 0, None, [], None
        made = []

        def flush():
            nonlocal at, lines, out
            if out is None:
                where, path = _open(folder)
                where.create_dir(path, recursive=True)
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            z = zlib.compress("\n".join(lines).encode(), 6)
            out.write(z)
            made.append((first[0], first[1], name, at, len(z), len(lines)))
            at, lines = at + len(z), []

        for b in batches:
            for row in b.to_pylist():
                if not lines:
                    first = (row["key"], row["page_id"] if row["page_id"] is not None else _NO_ID)
                lines.append(json.dumps([row[k] for k in b.schema.names], ensure_ascii=False))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
        cols = list(zip(*made)) if made else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "page_id", "file", "start", "size", "lines"])

    return run


def build_index(spark: SparkSession, captures: DataFrame, folder: str) -> DataFrame:
    """Sorted capture lines in blocks under folder/index, and the directory: one row a block."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.col("page_id").asc_nulls_last(), F.col("archive"), F.col("start")]
    lines = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.saved(lines.mapInArrow(_packer(f"{folder}/index"), "key string, page_id long, file string, start long, size long, lines int"), f"{folder}/directory")


class Lookup:
    """Random access by URL. The directory is sparse: one entry for BLOCK_LINES captures."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = spark.read.parquet(f"{folder}/directory").orderBy("key", "page_id").toPandas()
        self.keys = list(rows["key"])
        self.blocks = list(zip(rows["file"], rows["start"], rows["size"]))
        self.where, self.path = _open(folder)

    def _range(self, name: str, start: int, size: int) -> bytes:
        with self.where.open_input_file(f"{self.path}/{name}") as f:
            f.seek(start)
            return f.read(size)

    def captures(self, url: str) -> list[dict]:
        key, out = surt(url), []
        k = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while k < len(self.keys) and self.keys[k] <= key:
            name, start, size = self.blocks[k]
            for line in zlib.decompress(self._range(f"index/{name}", int(start), int(size))).decode().split("\n"):
                row = dict(zip((x.split()[0] for x in _CDX.split(", ")), json.loads(line)))
                if row["key"] == key:
                    out.append(row)
            k += 1
        return out

    def record(self, capture: dict) -> dict:
        return parse(gzip.decompress(self._range(f"archives/{capture['archive']}", capture["start"], capture["size"])))


def _block_reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        for b in batches:
            for row in b.to_pylist():
                with where.open_input_file(f"{path}/{row['file']}") as f:
                    f.seek(row["start"])
                    lines = zlib.decompress(f.read(row["size"])).decode().split("\n")
                rows = [json.loads(x) for x in lines]
                yield pa.record_batch([pa.array([r[7] for r in rows], pa.string()), pa.array([r[8] for r in rows], pa.int64()), pa.array([r[9] for r in rows], pa.int64())], names=["archive", "start", "size"])

    return run


def _record_reader(folder: str):
    """Rows sorted by (archive, start): page_id, size, digest, type, refers_to as the archives have them."""

    def read(where, path, archive, run_):
        with where.open_input_file(f"{path}/{archive}") as f:
            f.seek(run_[0][0])
            raw = f.read(run_[-1][0] + run_[-1][1] - run_[0][0])
        for start, size in run_:
            rec = parse(gzip.decompress(raw[start - run_[0][0] : start - run_[0][0] + size]))
            h = rec["headers"]
            ident = h["warc-record-id"][10:-1]
            digest = h["warc-payload-digest"][7:]
            if h["warc-type"] == "response":
                digest = hashlib.sha256(rec["payload"]).hexdigest()
                if digest != h["warc-payload-digest"][7:] or len(rec["payload"]) != rec["size"]:
                    raise ValueError(f"{archive} at {start}: the payload is not what was written")
            refers = h.get("warc-refers-to")
            yield None if ident == "None" else int(ident), rec["size"], digest, h["warc-type"], int(refers[10:-1]) if refers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            rows, own, now, total = [], [], None, 0
            for archive, start, size in zip(*(c.to_pylist() for c in b.columns)):
                if own and (archive != now or start != own[-1][0] + own[-1][1] or total + size > READ_BYTES):
                    rows += read(where, path, now, own)
                    own, total = [], 0
                now = archive
                own.append((start, size))
                total += size
            if own:
                rows += read(where, path, now, own)
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def read_back(spark: SparkSession, folder: str, directory: DataFrame) -> DataFrame:
    """Every record, found by the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = directory.select("file", "start", "size").repartition(parts, "file", "start").mapInArrow(_block_reader(f"{folder}/index"), "archive string, start long, size long")
    # an archive's captures are dealt in stretches, so that one of any length spreads over tasks
    dealt = found.repartition(parts, "archive", F.floor(F.col("start") / (2 * READ_BYTES))).sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(_record_reader(f"{folder}/archives"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages, index them, and read all records back through the index."""
    folder = folder or common.workdir(spark, "warc")
    directory = build_index(spark, write_archives(spark, pages, folder), folder)
    return read_back(spark, folder, directory)
