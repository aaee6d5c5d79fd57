"""WARC archives: writing, a two-level capture index, and reading back by range.

Records are gzip members of WARC/1.1 files in the shared folder, one file a task (attempts have
names of their own; only a successful attempt's files are in the index). The index is sorted by
reversed-host URL keys and cut into compressed blocks, some thousand captures each; beside every index file
lies its sparse directory, a line a block. A lookup sorts its keys, finds the index file of a key by binary search
in the files' first and last keys (a row per index partition, so bounded by a setting and broadcast),
the block by binary search in that file's directory, reads the blocks by range, and then the records by
range. Files are opened through the file system that the folder's URI names.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkey.llm.shared import in_tasks, materialised, shared_folder

#: Payloads of fewer bytes are never deduplicated.
LEAST_PAYLOAD = 100
BLOCK_ENTRIES = 2000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of records that one task reads, about.
READ_BYTES = 64 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = "url_key string, page_id long, file string, at long, bytes long"


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def _uri(folder: str) -> str:
    """Hadoop's short form of a local URI, as other libraries read it."""
    if folder.startswith("file:"):
        return "file:///" + folder[5:].lstrip("/")
    return folder if "://" in folder else "file:///" + folder.lstrip("/")


def url_key(url: str | None) -> str:
    """The sort key of a capture: host labels reversed, then path and query; ``-`` without a URL."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return quote(key + (f"?{parts.query}" if parts.query else ""), safe="!#$%&'()*+,/:;=?@[]~-._")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with the whole payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def parse(member: bytes) -> dict:
    """Headers and payload of one record, its payload's digest checked against the header."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
    }


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)``; returns index entries (materialised).

    Of equal payloads of ``least`` bytes or more the smallest page_id's is the response (every row
    of that id, if it repeats), the others revisit it; rows without a page_id come last. A null
    html is an empty payload, a null or malformed url is kept as it is under a key of its own; rows that
    repeat are captures each; other columns are ignored; no rows, no files.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= least)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    first = materialised(first, "first-pages")  # so that the join is over two shuffles, whose hot keys are split
    typed = rows.join(first, "digest", "left").withColumn("revisit", F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)))
    base = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{base}/part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            entries: list[tuple] = []
            for x in batch.to_pylist():
                if out is None:
                    out = _open(name, write=True)
                member = record(x["page_id"], x["url"], x["payload"], x["digest"], x["first"], x["revisit"])
                out.write(member)
                entries.append((url_key(x["url"]), x["page_id"], name, at, len(member)))
                at += len(member)
            if entries:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*entries), kinds)], ["url_key", "page_id", "file", "at", "bytes"])
        if out is not None:
            out.close()

    return materialised(in_tasks(typed.select("page_id", "url", "payload", "digest", "first", "revisit"), run, _ENTRY), "captures")


def build_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Sorts ``entries`` into compressed blocks and writes each index file's directory beside it.

    Returns the directories (materialised): ``(first_key, last_key, file, at, bytes, entries)``, a row a block.
    """
    base = _uri(folder)
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(partitions, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name, lines, blocks = None, 0, f"{base}/part-{uuid.uuid4().hex}.cdxj.gz", [], []

        def flush():
            nonlocal out, at, lines
            out = out or _open(name, write=True)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = packer.compress("".join(f"{k} {json.dumps(rest)}\n" for k, *rest in lines).encode()) + packer.flush()
            out.write(block)
            row = [[lines[0][0]], [lines[-1][0]], [name], [at], [len(block)], [len(lines)]]
            blocks.append((lines[0][0], lines[-1][0], at, len(block)))
            at, lines = at + len(block), []
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["first_key", "last_key", "file", "at", "bytes", "entries"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "at", "bytes"))):
                lines.append(x)
                if len(lines) >= block_entries:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()
            with _open(_directory(name), write=True) as f:
                f.write("".join(json.dumps(b) + "\n" for b in blocks).encode())

    return materialised(ordered.mapInArrow(run, "first_key string, last_key string, file string, at long, bytes long, entries long"), "directory")


def _directory(index_file: str) -> str:
    return index_file.removesuffix(".cdxj.gz") + ".directory.jsonl"


class _Blocks:
    """The directory of one index file, to be searched by key."""

    def __init__(self, index_file: str):
        with _open(_directory(index_file)) as f:
            rows = [json.loads(line) for line in f.read().splitlines()]
        self.firsts, self.lasts = [r[0] for r in rows], [r[1] for r in rows]
        self.places = [(index_file, r[2], r[3]) for r in rows]

    def of(self, key: str) -> list[tuple[str, int, int]]:
        return self.places[bisect.bisect_left(self.lasts, key) : bisect.bisect_right(self.firsts, key)]


def _block(file: str, at: int, n: int) -> list[tuple]:
    with _open(file) as f:
        f.seek(at)
        text = zlib.decompress(f.read(n), 31).decode()
    return [(key, *json.loads(rest)) for key, _, rest in (line.partition(" ") for line in text.splitlines())]


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["url_key", "page_id", "file", "at", "bytes"])


def index_entries(blocks: DataFrame) -> DataFrame:
    """The entries of the directory rows ``blocks``, each block read by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                yield _entry_batch(_block(x["file"], x["at"], x["bytes"]))

    return blocks.repartition("file", "at").select("file", "at", "bytes").mapInArrow(run, _ENTRY)


def url_keys(urls: DataFrame) -> DataFrame:
    """``(url_key)`` of ``urls(url)``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], ["url_key"])

    return urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(run, "url_key string").distinct()


def lookup(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """Index entries of the captures of ``urls(url)``, by binary search; a null url finds captures without one."""
    files = directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last").collect()
    held = directory.sparkSession.sparkContext.broadcast(([r["first"] for r in files], [r["last"] for r in files], [r["file"] for r in files]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, names = held.value
        blocks: dict[str, _Blocks] = {}  # keys come sorted: the directories of a key's files, and no others, are held
        last = None
        for batch in batches:
            found = []
            for key in batch.column("url_key").to_pylist():
                near = names[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]
                blocks = {f: blocks.get(f) or _Blocks(f) for f in near}
                for place in chain.from_iterable(blocks[f].of(key) for f in near):
                    if place != last:
                        found.append(place)
                        last = place
            if found:
                kinds = (pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], ["file", "at", "bytes"])

    keys = materialised(url_keys(urls), "keys")
    ordered = keys.repartitionByRange("url_key").sortWithinPartitions("url_key")
    blocks = ordered.mapInArrow(search, "file string, at long, bytes long").distinct()
    return index_entries(blocks).join(keys, "url_key", "left_semi")


def read_captures(entries: DataFrame) -> DataFrame:
    """The records of index entries, read by range and in file order; tasks get about equal bytes."""
    entries = materialised(entries, "wanted")
    total = entries.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // READ_BYTES))
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name = None, None
        for batch in batches:
            rows, held = [], 0
            for x in batch.to_pylist():
                if x["file"] != name:
                    if f is not None:
                        f.close()
                    f, name = _open(x["file"]), x["file"]
                f.seek(x["at"])
                rows.append(parse(f.read(x["bytes"])))
                held += len(rows[-1]["payload"])
                if held > 4 << 20:
                    yield _records(rows, names)
                    rows, held = [], 0
            if rows:
                yield _records(rows, names)
        if f is not None:
            f.close()

    return entries.repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at").select("file", "at", "bytes").mapInArrow(run, schema)


def _records(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes ``pages`` and their index under ``folder``; returns (entries, directory)."""
    folder = folder or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    entries = write_archives(pages, f"{folder}/archive")
    return entries, build_index(entries, f"{folder}/index")


def query(spark, sf_dir: str) -> DataFrame:
    """Archives all pages and reads each back by its URL, through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    _, directory = archive(pages)
    read = read_captures(lookup(directory, pages))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
