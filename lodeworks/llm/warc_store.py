"""WARC archives with a two-level capture index.

write() puts one record a page into gzip-per-record WARC files in a shared folder, one file a task and rolled over by
size. Of pages with equal payloads that with the smallest id holds the payload, the others are revisit records that
refer to it. Only digests and ids are shuffled for that; the pages themselves are joined with the revisits by broadcast
if Spark finds their table small, else by a shuffle on the id.

index() sorts the captures by reversed-host URL key and id into parts; a part is a file of compressed blocks of lines
with a sparse directory (the first key of each block and where it lies) at its end. find() range-partitions and sorts
the wanted keys, so that a task walks through few parts: it picks the part by binary search among the parts' first keys,
reads that part's directory, picks the block by binary search, and reads only that block. read() then fetches records
by range reads in file order and checks their digests.

Files are written and read by the executors through pyarrow's file systems, so the folder may be any that these reach
and that all executors share. Each attempt of a task writes files of its own name; only those of the attempts that
Spark counted are in the capture table, so lost executors leave at most files that nothing refers to.

Cases: null html is the empty payload; null urls are empty; payloads under MIN_REVISIT bytes are always stored whole;
repeated rows are captures each (rows that share id and payload are all stored whole); rows with a null id are stored
whole and nothing refers to them; control characters in urls are percent-encoded in headers; very long payloads are
records like others; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, checkpoint, spread

MIN_REVISIT = 100
#: What stands for a null id in the index, before all others.
NO_ID = -(1 << 63)
BLOCK_LINES = 3000
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
_URL = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?)?([^#]*)")
_CAPTURE = "page_id bigint, url_key string, file string, offset bigint, length bigint"
_NAMES = ["page_id", "url_key", "file", "offset", "length"]


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the rest without scheme and fragment: com,example,www)/path?query."""
    _, host, port, rest = _URL.match(url or "").groups()
    labels = ",".join(reversed((host or "").lower().split(".")))
    return f"{labels}{':' + port if port and port not in ('80', '443') else ''}){rest}"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _header(value) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP header of its page but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(i))}>"
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(uuid.uuid4() if page_id is None else page_id), "WARC-Date": date,
            "WARC-Target-URI": _header(url or ""), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if page_id is not None:
        head["X-Page-Id"] = page_id
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to), "X-Refers-To-Page-Id": refers_to}
    body = http + (payload if refers_to is None else b"")
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    field = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(field["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    whole = field["WARC-Type"] == "response"
    if whole and (len(payload) != size or f"sha256:{hashlib.sha256(payload).hexdigest()}" != field["WARC-Payload-Digest"]):
        raise ValueError(f"record of page {field.get('X-Page-Id')} is damaged")
    number = lambda name: int(field[name]) if name in field else None
    return {"page_id": number("X-Page-Id"), "url": field["WARC-Target-URI"], "payload_bytes": size, "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha256:"),
            "record_type": field["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if whole else None}


def _writer(folder: str, most: int):
    def run(batches):
        store, base = _open(folder)
        out = name = None
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            at = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(base, recursive=True)
                    out, place = store.open_output_stream(f"{base}/{name}", compression=None), 0
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page_id, url, payload, digest, refers_to)) + squeeze.flush()
                out.write(data)
                at.append((page_id, url_key(url), name, place, len(data)))
                place += len(data)
                if place >= most:
                    out.close()
                    out = None
            rows = list(zip(*at, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=_NAMES)
        if out is not None:
            out.close()
    return run


def write(pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives and return where each capture lies: page_id, url_key, file, offset, length."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    digests = scratch.keep(rows.select("page_id", "digest", F.octet_length("payload").alias("n")).filter(F.col("n") >= MIN_REVISIT).select("page_id", F.unhex("digest").alias("digest")), "digests")
    first = scratch.keep(digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    again = digests.join(first, "digest").filter("page_id <> refers_to").select("page_id", F.hex("digest").alias("same"), "refers_to").distinct()
    again = scratch.keep(again, "revisits")
    # The digest is part of the condition for the sake of repeated ids.
    same = (rows["page_id"] == again["page_id"]) & (F.upper(rows["digest"]) == again["same"])
    placed = rows.join(again, same, "left").select(rows["page_id"], "url", "payload", rows["digest"], "refers_to")
    return scratch.keep(placed.mapInArrow(_writer(folder, FILE_BYTES), _CAPTURE), "captures")


def _blocks(folder: str, lines: int):
    def run(batches):
        store, base = _open(folder)
        name, out, place, directory, block, first = f"{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def close_block():
            nonlocal place, block
            data = zlib.compress("\n".join(block).encode(), 6)
            out.write(data)
            directory.append([*first, place, len(data)])
            place, block = place + len(data), []

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                page_id = NO_ID if page_id is None else page_id
                if not block:
                    first = (key, page_id)
                block.append(json.dumps([key, page_id, file, offset, length]))
                if len(block) >= lines:
                    close_block()
        if out is not None:
            if block:
                close_block()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data + struct.pack("<Q", len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name]), pa.array([place + len(data) + 8], pa.int64())], names=["url_key", "page_id", "part", "size"])
    return run


def index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES, per_part: int = 100_000, most_parts: int = 20_000) -> list[tuple[str, int, str, int]]:
    """Write the index; its fences: for each part (first key, first id, file, size). There are most_parts at most."""
    parts = min(most_parts, spread(captures.count(), per_part, 1))
    ordered = captures.repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    made = checkpoint(ordered.mapInArrow(_blocks(folder, lines), "url_key string, page_id bigint, part string, size bigint"))
    return sorted(tuple(r) for r in made.collect())


class _Part:
    """A part of the index: its directory, and the block read last."""

    def __init__(self, store, path: str, size: int):
        self.file, self.last, self.block = store.open_input_file(path), -1, []
        n = struct.unpack("<Q", self.file.read_at(8, size - 8))[0]
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.firsts = [(d[0], d[1]) for d in self.directory]

    def lines(self, k: int) -> list:
        if self.last != k:
            _, _, offset, length = self.directory[k]
            self.last, self.block = k, [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")]
        return self.block


def _finder(folder: str, fences: list):
    def run(batches):
        store, base = _open(folder)
        starts, now, part = [(f[0], f[1]) for f in fences], -1, None
        for batch in batches:
            found = []
            for key, page_id in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                low = (key, NO_ID if page_id is None else page_id)
                # Equal lines may begin in the part, and the block, before the first that starts with them.
                p, beyond = max(0, bisect_left(starts, low) - 1), False
                while p < len(fences) and not beyond:
                    if now != p:
                        now, part = p, _Part(store, f"{base}/{fences[p][2]}", fences[p][3])
                    k = max(0, bisect_left(part.firsts, low) - 1)
                    while k < len(part.directory) and not beyond:
                        block = part.lines(k)
                        for line in block[bisect_left(block, low, key=lambda x: (x[0], x[1])) :]:
                            if line[0] != key or (page_id is not None and line[1] != page_id):
                                beyond = True
                                break
                            found.append([line[0], None if line[1] == NO_ID else line[1], *line[2:]])
                        k += 1
                    p += 1
            rows = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(rows[1], pa.int64()), pa.array(rows[0], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=_NAMES)
    return run


def find(wanted: DataFrame, folder: str, fences: list, per_task: int = 50_000) -> DataFrame:
    """The captures of the distinct wanted (url_key, page_id) rows, each once; a null page_id wants all captures of the key."""
    if not fences:
        return wanted.sparkSession.createDataFrame([], _CAPTURE)
    asked = wanted.select("url_key", F.col("page_id").cast("long").alias("page_id")).distinct()
    n, named = asked.agg(F.count("*"), F.count("page_id")).first()
    out = asked.repartitionByRange(spread(n, per_task, 1), "url_key", "page_id").sortWithinPartitions("url_key", "page_id").mapInArrow(_finder(folder, fences), _CAPTURE)
    # Only a key that is asked for as a whole can give a capture twice.
    return out if n == named else out.dropDuplicates(["file", "offset"])


_READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _reader(folder: str, payloads: bool):
    names = [x.split()[0] for x in _READ.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store, base = _open(folder)
        name = file = None
        for batch in batches:
            rows = []
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if f != name:
                    name, file = f, store.open_input_file(f"{base}/{f}")
                rows.append(parse(zlib.decompress(file.read_at(length, offset), 31)))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names=names)
    return run


def read(captures: DataFrame, folder: str, payloads: bool = False, per_task: int = 20_000) -> DataFrame:
    """The records at the given places, by range reads in file order."""
    tasks = spread(captures.count(), per_task, 1)
    ordered = captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(folder, payloads), _READ + ", payload binary" * payloads)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, look each capture up in the index, and read it back."""
    with Scratch(spark) as scratch:
        archives, parts = f"{scratch.path}/archives", f"{scratch.path}/index"
        captures = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), archives, scratch)
        fences = index(captures, parts)
        places = scratch.keep(find(captures, parts, fences), "places")
        return checkpoint(read(places, archives).drop("url"))


OP3_SQL = """
SELECT page_id, octet_length(p) AS payload_bytes, sha256(p) AS payload_digest,
       CASE WHEN octet_length(p) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(p) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, encode(coalesce(html, '')) AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
