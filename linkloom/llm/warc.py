"""WARC archives of Zstandard frames: a dictionary in a leading skippable frame, then one frame per record.

``write`` makes archives of bounded size on the cluster and returns their manifest; ``read`` decodes a manifest's
archives frame by frame, checking magic numbers, mandatory headers, lengths and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import free_name, map_rows, new_folder, saved

FRAME = 0xFD2FB528
SKIPPABLE = 0x184D2A50  # to ...5F
DICTIONARY = 0x184D2A5D
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: A cell of a table holds less than 2 GB, so every record that can be written can be read; what claims more is broken.
LONGEST_RECORD = (1 << 31) + (1 << 20)


class BadArchive(ValueError):
    """An archive that breaks the format; the message says where."""


# ---------------------------------------------------------------- records


def _safe(value: str) -> str:
    """A header value without control characters (they are percent-encoded)."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def build_record(kind: str, record_id: str, date: str, block: bytes, headers: dict[str, str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {_safe(v)}" for k, v in headers.items()]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_block(length: int, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return head.encode() + payload


def parse_headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"bad header line {line[:80]!r}")
        key = name.lower()
        if key in out and key in MANDATORY:
            raise BadArchive(f"header {name} occurs twice")
        out[key] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """Fields of one record; raises BadArchive where headers or lengths are wrong."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not blank:
        raise BadArchive("no WARC version line")
    h = parse_headers(fields)
    for name in MANDATORY:
        if name not in h:
            raise BadArchive(f"header {name} is missing")
    if not h["content-length"].isdigit() or rest[int(h["content-length"]):] != b"\r\n\r\n":
        raise BadArchive("content length does not fit the record")
    block = rest[:int(h["content-length"])]
    digest = h.get("warc-payload-digest", "")
    out = {
        "record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"], "date": h["warc-date"],
        "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": None, "payload_bytes": None, "payload": None,
    }
    if digest:
        algorithm, _, value = digest.partition(":")
        if algorithm.lower() != "sha1":
            raise BadArchive(f"unknown digest {algorithm}")
        out["payload_digest"] = base64.b32decode(value).hex() if len(value) == 32 else value.lower()
    if h["warc-type"] not in ("response", "revisit"):
        out["payload"], out["payload_bytes"] = block, len(block)
        return out
    http, blank, payload = block.partition(b"\r\n\r\n")
    length = parse_headers(http.partition(b"\r\n")[2]).get("content-length", "")
    if not http.startswith(b"HTTP/") or not blank or not length.isdigit():
        raise BadArchive("no HTTP headers with a length")
    out["payload_bytes"] = int(length)
    if h["warc-type"] == "revisit":
        if out["refers_to"] is None or payload:
            raise BadArchive("a revisit must refer to a record and hold no payload")
        return out
    if len(payload) != int(length):
        raise BadArchive("HTTP length does not fit the payload")
    if digest and hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
        raise BadArchive("payload digest does not fit")
    out["payload"] = payload
    return out


# ---------------------------------------------------------------- frames


def frame_end(buf: bytes | bytearray | memoryview, at: int) -> int | None:
    """Where the frame that starts at ``at`` ends; None if the buffer ends before it."""
    if len(buf) < at + 8:
        return None
    magic, size = struct.unpack_from("<II", buf, at)
    if SKIPPABLE <= magic <= SKIPPABLE + 15:
        return at + 8 + size if len(buf) >= at + 8 + size else None
    if magic != FRAME:
        raise BadArchive(f"no frame at byte {at}")
    flags = buf[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        if len(buf) < pos + 3:
            return None
        block = int.from_bytes(buf[pos:pos + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise BadArchive(f"reserved block type in the frame at byte {at}")
        pos += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    return pos if len(buf) >= pos else None


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each frame of a file object; holds one frame and a megabyte at most."""
    buf, base, at, need = bytearray(), 0, 0, 1
    while True:
        end = frame_end(buf, at) if len(buf) - at >= need else None
        if end is not None:
            yield base + at, bytes(memoryview(buf)[at:end])
            at, need = end, 1
            continue
        if len(buf) - at > LONGEST_RECORD:
            raise BadArchive(f"the frame at byte {base + at} is too long")
        del buf[:at]
        base, at = base + at, 0
        more = stream.read(max(1 << 20, len(buf)))
        if not more:
            if buf:
                raise BadArchive(f"the file ends within the frame at byte {base}")
            return
        buf += more


def dictionary_of(frame: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary in a leading skippable frame: plain, or a Zstandard frame itself."""
    if len(frame) < 8 or struct.unpack_from("<I", frame)[0] != DICTIONARY:
        return None
    data = frame[8:]
    if data[:4] == struct.pack("<I", FRAME):
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=64 << 20)
    return zstandard.ZstdCompressionDict(data)


def read_archive(stream, name: str = "") -> Iterator[dict]:
    """Records of one archive, each with its byte offset. The dictionary may only lead; other skippable frames are passed over."""
    reader = zstandard.ZstdDecompressor()
    for k, (offset, frame) in enumerate(frames(stream)):
        try:
            magic = struct.unpack_from("<I", frame)[0]
            if magic != FRAME:
                if magic == DICTIONARY and k == 0:
                    reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(frame))
                continue
            size = zstandard.frame_content_size(frame)
            if size > LONGEST_RECORD:
                raise BadArchive("record too long")
            raw = reader.decompress(frame, max_output_size=LONGEST_RECORD if size < 0 else 0)
            yield {"archive": name, "offset": offset, **parse_record(raw)}
        except (BadArchive, zstandard.ZstdError, ValueError, struct.error) as e:
            raise BadArchive(f"{name}, byte {offset}: {e}") from e


class ArchiveWriter:
    """Collects records, learns a dictionary from the first megabytes, and gives whole archives."""

    def __init__(self, level: int = 3):
        self.level = level
        self.waiting: list[bytes] = []
        self.held = 0
        self.out: list[bytes] = []
        self.size = self.records = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def _start(self) -> None:
        dictionary = None
        sizes = [len(r) for r in self.waiting]
        if len(sizes) >= 32 and sum(sizes) >= 8 * DICTIONARY_BYTES:
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
            except zstandard.ZstdError:  # too little in common
                dictionary = None
        if dictionary is not None:
            body = zstandard.ZstdCompressor(level=19, write_checksum=True).compress(dictionary.as_bytes())
            self._emit(struct.pack("<II", DICTIONARY, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True)
        for r in self.waiting:
            self._emit(self.compressor.compress(r))
        self.waiting, self.held = [], 0

    def _emit(self, data: bytes) -> None:
        self.out.append(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._start()
        else:
            self._emit(self.compressor.compress(record))

    def close(self) -> bytes:
        if self.compressor is None:
            self._start()
        return b"".join(self.out)


# ---------------------------------------------------------------- on the cluster


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def mark_revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Add payload (binary), payload_bytes, payload_digest (hex SHA-1) and refers_to.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest id stands for all others, whose
    ``refers_to`` names it and whose payload becomes empty. Rows that share this largest id are all kept whole; a NULL id never
    stands for others. NULL payloads are empty. Input columns named as these four are replaced, all others stay.
    """
    body, first, n = (free_name(c, pages) for c in ("_body", "_first", "_n"))
    content = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumns({body: content, "payload_digest": F.sha1(content), "payload_bytes": F.octet_length(content).cast("bigint")})
    repeated = (
        rows.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest").agg(F.max(id_col).alias(first), F.count("*").alias(n)).filter(F.col(n) > 1)
    )
    joined = rows.join(repeated, "payload_digest", "left")
    other = F.col(first).isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) < F.col(first)))
    return joined.withColumns({
        "refers_to": F.when(other, F.col(first)),
        "payload": F.when(other, F.lit(b"")).otherwise(F.col(body)),
    }).drop(body, first, n)


def write(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Write rows marked by ``mark_revisits`` to archives below ``folder``; returns (path, records, bytes) of each.

    Tasks write under names of their own attempt, and the manifest, written once, names the archives of those that succeeded:
    repeated attempts add nothing. A NULL url leaves out the target. Archives hold about 32 MB.
    """
    schema = "path string, records bigint, bytes bigint"

    def work(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        writer, k = None, 0

        def finish():
            data = writer.close()
            path = f"{base}/{stem}-{k:03d}.warc.zst"
            with store.open_output_stream(path) as out:
                out.write(data)
            name = f"{folder.rstrip('/')}/{stem}-{k:03d}.warc.zst"
            return {"path": [name], "records": [writer.records], "bytes": [len(data)]}

        for b in batches:
            for page, url, digest, size, refers, payload in zip(*(b[c] for c in ("page", "url", "digest", "size", "refers", "payload"))):
                if writer is None:
                    writer = ArchiveWriter()
                headers = {} if url is None else {"WARC-Target-URI": url}
                headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                if refers is not None:
                    headers["WARC-Refers-To"] = f"<urn:page:{refers}>"
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                headers["Content-Type"] = "application/http; msgtype=response"
                kind = "response" if refers is None else "revisit"
                writer.add(build_record(kind, f"urn:page:{'' if page is None else page}", date, http_block(size, payload), headers))
                if writer.size >= ARCHIVE_BYTES:
                    yield finish()
                    writer, k = None, k + 1
        if writer is not None:
            yield finish()

    rows = pages.select(
        F.col(id_col).cast("string").alias("page"), F.col(url_col).alias("url"), F.col("payload_digest").alias("digest"),
        F.col("payload_bytes").alias("size"), F.col("refers_to").cast("string").alias("refers"), "payload",
    )
    return saved(map_rows(rows, schema, work), "warc-manifest")


FIELDS = (
    "archive string, offset bigint, record_id string, record_type string, date string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _batched(records: Iterator[dict], most: int = 8 << 20) -> Iterator[dict]:
    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += 200 + len(r["payload"] or b"")
        if size >= most:
            yield {c: [x[c] for x in rows] for c in _NAMES}
            rows, size = [], 0
    if rows:
        yield {c: [x[c] for x in rows] for c in _NAMES}


def read(archives: DataFrame) -> DataFrame:
    """All records of the archives of a manifest (column ``path``), streamed from the store the executors share."""
    n = archives.count()
    spread = archives.select("path").repartition(max(1, min(n, 10_000)))

    def work(batches):
        for b in batches:
            for path in b["path"]:
                store, where = _store(path)
                with store.open_input_stream(where) as f:
                    yield from _batched(read_archive(f, path))

    return map_rows(spread, FIELDS, work)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All records of archives in any folder or store that Spark reads; an archive must be below 2 GB."""

    def work(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield from _batched(read_archive(pa.BufferReader(content), name))

    return map_rows(spark.read.format("binaryFile").load(path).select("path", "content"), FIELDS, work)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in the shared folder and read the archives back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(mark_revisits(pages, least_bytes), folder))
