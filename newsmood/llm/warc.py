"""WARC archives with a two-level capture index.

``write_archives`` stores a WARC record per row, each a gzip member of its own, in files of the
shared folder. Of rows with equal payloads of ``revisit_bytes`` or more the one with the largest
page id is a response and the others are revisits of it; all other rows are responses.

``build_index`` sorts captures by reversed-host URL key (and page id) into files of compressed
blocks. Each file ends with its own sparse directory, the first key of every block; the driver
only knows first and last key of each file, one row a file. ``lookup`` finds the files of a key by
binary search, the block by binary search in the file's directory, the captures by binary search
in the block, and ``read_records`` then reads the captures' byte ranges from the archives.

File names are new for each attempt of a task and reach later steps through rows that Spark
commits, so a repeated or lost task leaves an unused file and no wrong rows.

Null html is an empty payload; a null URL has the empty key and no target header; rows with a
null page id are responses; equal rows with the largest page id are all responses; an empty table
writes no records. Control characters and blanks of a URL are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.llm.words import broadcast, pick, slices, written
from newsmood.session import work_path

REVISIT_BYTES = 1000
BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
# End of the fixed values.


def _fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def url_key(url: str | None) -> str:
    """Sort key of a URL: host reversed, then path and query, in lower case; no scheme or fragment."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    m = re.match(r"([^/?]*)(.*)", rest, re.S)
    host = m[1].rsplit("@", 1)[-1].lower()
    host, _, port = host.partition(":")
    host = re.sub(r"^www\d*\.", "", host)
    port = f":{port}" if port not in ("", "80", "443") else ""
    path = _quoted(m[2].lower()) or "/"
    return ",".join(reversed(host.split("."))) + port + ")" + path


def _quoted(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _page(page_id) -> str:
    return "" if page_id is None else str(page_id)


def capture_key(key: str, page_id) -> str:
    """Index key: URL key, a blank (no key holds one) and the page id in sortable form."""
    return f"{key} {'' if page_id is None else format(int(page_id) + (1 << 63), '020d')}"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {_page(page_id)}'.encode()).digest())}>"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record. A revisit has the response's HTTP header and no payload."""
    http = _HTTP.format(size).encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record as ``record`` writes it; a wrong length or digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    number = lambda k: int(headers[k]) if k in headers else None
    return {
        "page_id": number("Page-ID"), "url": headers.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


CAPTURES = "key string, page_id long, file string, offset long, length long"


def write_archives(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    folder: str | None = None,
    revisit_bytes: int = REVISIT_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Captures (``key, page_id, file, offset, length``) of the records written.

    The payload travels once, in the join with the digests that occur more than once; a digest
    shared by many rows is split by Spark's skew join.
    """
    folder = folder or work_path(pages.sparkSession, "warc")
    payload: Column = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html")
    ).withColumns({"digest": F.sha1(payload), "size": F.octet_length(payload).cast("long")})
    shared = (
        rows.where((F.col("size") >= revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("same"))
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("least"))
        .where("least < last")
        .drop("least")
    )
    refers = F.when((F.col("size") >= revisit_bytes) & (F.col("page_id") < F.col("last")), F.col("last"))
    rows = rows.join(shared, rows["digest"] == shared["same"], "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("refers_to")
    )

    def run(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for part in slices(batch, "html"):
                done = []
                for r in part.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(
                        record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["size"], r["refers_to"]), 6, mtime=0
                    )
                    out.write(member)
                    done.append((capture_key(url_key(r["url"]), r["page_id"]), r["page_id"], f"{folder.rstrip('/')}/{name}", at, len(member)))
                    at += len(member)
                key, page, file, offset, length = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(page, pa.int64()), pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                    names=["key", "page_id", "file", "offset", "length"],
                )
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, CAPTURES), "captures")


def _line(r: dict) -> str:
    return f"{r['key']}\t{r['file']}\t{r['offset']}\t{r['length']}"


def build_index(captures: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The top level of the index: ``first, last, file, directory`` (place of the file's own
    sparse directory), one row for each index file. Ties of a key are split between files, too."""
    folder = folder or work_path(captures.sparkSession, "capture-index")
    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches):
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        out, at, name = None, 0, f"{uuid.uuid4().hex}.cdx"
        directory, lines, ends = [], [], []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(data)}")
            at += len(data)
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    ends = [r["key"], r["key"]]
                ends[1] = r["key"]
                lines.append(_line(r))
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            data = zlib.compress("\n".join(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ends[0]]), pa.array([ends[1]]), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([at]), pa.array([len(data)])],
                names=["first", "last", "file", "offset", "length"],
            )

    return written(ordered.mapInArrow(run, "first string, last string, file string, offset long, length long"), "index-files")


class _IndexFile:
    """An open index file: its directory in memory, its last block decompressed."""

    def __init__(self, path: str, offset: int, length: int):
        fs, name = _fs(path)
        self.file = fs.open_input_file(name)
        lines = zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")
        self.blocks = [x.split("\t") for x in lines]
        self.keys = [x[0] for x in self.blocks]
        self.block, self.lines, self.starts = -1, [], []

    def find(self, key: str):
        """(archive, offset, length) of the captures with exactly this key."""
        b = max(0, bisect.bisect_left(self.keys, key) - 1)  # the key may begin at the end of a block
        while b < len(self.blocks) and self.keys[b] <= key:
            if b != self.block:
                data = zlib.decompress(self.file.read_at(int(self.blocks[b][2]), int(self.blocks[b][1])))
                self.block, self.lines = b, data.decode().split("\n")
                self.starts = [x.split("\t", 1)[0] for x in self.lines]
            for i in range(bisect.bisect_left(self.starts, key), bisect.bisect_right(self.starts, key)):
                _, file, offset, length = self.lines[i].split("\t")
                yield file, int(offset), int(length)
            b += 1


def lookup(index: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``key, file, offset, length`` of the captures of each distinct key that is not null."""
    files = sorted(tuple(r) for r in index.select("first", "last", "file", "offset", "length").toLocalIterator())
    top = broadcast(keys.sparkSession, files)  # one row for each index file
    wanted = keys.select(keys[key].alias("key")).dropna().distinct()

    def route(batches):
        known = top()
        firsts, reach, last = [f[0] for f in known], [], ""
        for f in known:
            last = max(last, f[1])
            reach.append(last)
        for batch in batches:
            key, place = [], []
            for k in batch.column(0).to_pylist():
                i = bisect.bisect_left(reach, k)  # the first file that reaches the key
                while i < len(known) and firsts[i] <= k:
                    if known[i][1] >= k:
                        key.append(k)
                        place.append(i)
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(place, pa.int32())], names=["key", "place"])

    def search(batches):
        known, at, opened = top(), -1, None
        for batch in batches:
            rows = []
            for k, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if place != at:
                    at, opened = place, _IndexFile(*known[place][2:])
                rows += [(k, *x) for x in opened.find(k)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["key", "file", "offset", "length"],
            )

    routed = wanted.mapInArrow(route, "key string, place int")
    return (
        routed.repartitionByRange("place", "key").sortWithinPartitions("place", "key").mapInArrow(search, "key string, file string, offset long, length long")
    )


RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def read_records(places: DataFrame, payloads: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records at (``file, offset, length``), read in ranges of neighbouring captures."""
    dealt = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = T.StructType.fromDDL(RECORDS)
    if not payloads:
        schema = T.StructType(schema.fields[:-1])

    def members(rows):
        """Bytes of each member; rows next to each other come from one read."""
        opened, at, i = None, None, 0
        while i < len(rows):
            file, begin, length = rows[i]
            end, j = begin + length, i + 1
            while j < len(rows) and rows[j][0] == file and rows[j][1] == end and end - begin < read_bytes:
                end, j = end + rows[j][2], j + 1
            if file != at:
                fs, name = _fs(file)
                opened, at = fs.open_input_file(name), file
            data = opened.read_at(end - begin, begin)
            for k in range(i, j):
                a = rows[k][1] - begin
                yield data[a : a + rows[k][2]]
            i = j

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            out, held = [], 0
            for member in members(rows):
                r = parse(gzip.decompress(member))
                held += r["payload_bytes"] if payloads else 200
                out.append({k: r[k] for k in arrow.names})
                if held >= read_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)


def keys_of(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Index keys of pages."""
    rows = pick(pages, page_id, url)

    def run(batches):
        for batch in batches:
            key = [capture_key(url_key(u), p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string())], names=["key"])

    return rows.mapInArrow(run, "key string")
