"""WARC records in ZIP packages.

``write`` puts one record per page into packages of stored members ``archive/data.warc.gz`` and
``indexes/index.cdxj``. ``read`` opens a package at its end, follows the central directory (ZIP64
too) to the members, reads the index, and reads the records by byte ranges; nothing is extracted.

Defined cases: a null html is an empty payload; payloads under ``revisit_from`` bytes are always
responses; of equal longer payloads all rows with the largest page_id are responses, the others
(null ids too) revisit it; a null url has no target line; empty tables make no package; repeated
rows are records of their own; other columns are ignored. An archive that a lost task left behind
is in no manifest and is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import cut, mapped, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "uri string, records long, bytes long"
PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"


def open_store(uri: str):
    """The file system of a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP header of its page but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """A record's parts from its bytes, gzip or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = warc["warc-type"] == "revisit"
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(fields(http)["content-length"]) if revisit else len(payload)
    number = lambda k: int(warc[k]) if k in warc else None
    return {
        "page_id": number("x-page-id"), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": number("x-refers-to-page"),
        "payload_bytes": size, "payload_digest": digest if revisit else hashlib.sha1(payload).hexdigest(),
        "payload": None if revisit else payload, "intact": revisit or hashlib.sha1(payload).hexdigest() == digest,
    }


class Package:
    """Members of a ZIP file that can be read by ranges."""

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - 66_000)
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        locator = tail.rfind(b"PK\x06\x07", 0, at)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            if locator < 0:
                raise ValueError("no ZIP64 locator")
            where = struct.unpack("<Q", tail[locator + 8 : locator + 16])[0]
            end = self.range(where, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, p = self.range(start, length), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
            packed, full, name_len, extra_len, note_len = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
            offset = struct.unpack("<I", directory[p + 42 : p + 46])[0]
            name = directory[p + 46 : p + 46 + name_len].decode("utf-8")
            extra, q = directory[p + 46 + name_len : p + 46 + name_len + extra_len], 0
            while q + 4 <= len(extra):
                tag, n = struct.unpack("<HH", extra[q : q + 4])
                if tag == 1:  # 64-bit values of those fields that are full, in this order
                    values = iter(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    offset = next(values) if offset == 0xFFFFFFFF else offset
                q += 4 + n
            self.members[name] = (method, offset, packed, full)
            p += 46 + name_len + extra_len + note_len

    def range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def start(self, name: str) -> int:
        """Where a member's bytes begin: the local header may be longer than the directory says."""
        head = self.range(self.members[name][1], 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        return self.members[name][1] + 30 + sum(struct.unpack("<HH", head[26:30]))

    def small(self, name: str) -> bytes:
        """A whole member, inflated if it was deflated."""
        method, _, packed, _ = self.members[name]
        data = self.range(self.start(name), packed)
        return data if method == 0 else zlib.decompress(data, -15)

    def records(self, data: str = DATA, index: str = INDEX, gather: int = 4 << 20) -> Iterator[bytes]:
        """The records that the index lists, neighbours in one read of about ``gather`` bytes."""
        if self.members[data][0] != 0:
            raise ValueError(f"{data} isn't stored, its records can't be read by ranges")
        begin, run = self.start(data), []
        for line in io.BytesIO(self.small(index)):
            entry = json.loads(line.split(b" ", 2)[2])
            piece = int(entry["offset"]), int(entry["length"])
            if run and (piece[0] != run[-1][0] + run[-1][1] or piece[0] + piece[1] - run[0][0] > gather):
                yield from self._cut(begin, run)
                run = []
            run.append(piece)
        if run:
            yield from self._cut(begin, run)

    def _cut(self, begin: int, run: list[tuple[int, int]]) -> Iterator[bytes]:
        first = run[0][0]
        data = self.range(begin + first, run[-1][0] + run[-1][1] - first)
        for offset, length in run:
            yield data[offset - first : offset - first + length]


def decide(pages: DataFrame, revisit_from: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, payload, size, digest, refers_to); the payload of a revisit is null."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    rows = rows.withColumn("same", F.when(F.col("size") >= revisit_from, F.sha2("payload", 256)))
    groups = rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 and kept is not null")
    # payloads that can't repeat are dealt out by their page, so that their missing key is no hot one
    rows = rows.withColumn("key", F.coalesce("same", F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.sha1("payload")))))
    rows = rows.join(groups.select(F.col("same").alias("g"), "kept"), F.col("key") == F.col("g"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def write(pages: DataFrame, folder: str | None = None, revisit_from: int = 1000, package_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", **columns) -> DataFrame:
    """Writes packages under ``folder`` (the shared folder by default); the manifest: uri, records, bytes."""
    target = (folder or f"{shared_dir(pages.sparkSession)}/lexiloom/warc-{uuid.uuid4().hex}").rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(target)
        out = None

        def begin() -> None:
            nonlocal out
            store.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            out = {"uri": f"{target}/{name}", "sink": store.open_output_stream(f"{path}/{name}"), "index": [], "at": 0}
            out["zip"] = zipfile.ZipFile(out["sink"], "w", zipfile.ZIP_STORED)
            out["data"] = out["zip"].open(DATA, "w", force_zip64=True)

        def end() -> pa.RecordBatch:
            out["data"].close()
            out["zip"].writestr(INDEX, "".join(out["index"]))
            out["zip"].close()
            out["sink"].close()
            return pa.RecordBatch.from_pydict({"uri": [out["uri"]], "records": [len(out["index"])], "bytes": [out["at"]]})

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for row in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to")], strict=True):
                    if out is None:
                        begin()
                    data = gzip.compress(build(*row, date), 1, mtime=0)
                    out["data"].write(data)
                    out["index"].append(f"{row[0]} {date} {json.dumps({'offset': str(out['at']), 'length': str(len(data)), 'filename': DATA})}\n")
                    out["at"] += len(data)
                    if out["at"] >= package_bytes:
                        yield end()
                        out = None
        if out is not None:
            yield end()

    return cut(mapped(decide(pages, revisit_from, **columns), run, MANIFEST))


def read(manifest: DataFrame, uri_col: str = "uri", payload: bool = True) -> DataFrame:
    """The records of all packages that ``uri_col`` names."""
    names = [part.split()[0] for part in PAGE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] if payload or n != "payload" else None for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = open_store(uri)
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for data in Package(file, file.size()).records():
                        rows.append(parse(data))
                        held += rows[-1]["payload_bytes"]
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return mapped(manifest.select(F.col(uri_col).alias("uri")).filter("uri is not null"), run, PAGE)
