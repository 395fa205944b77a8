"""WARC archives of pages: written with revisits, segments and chunked framing, read back and reassembled.

Archives are gzip files that Spark's own writer and reader move, so they may lie in any store.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.llm.tables import saved, small_enough
from sievenet.session import new_dir

SEGMENT = 64 << 10  # bytes of a record's block; a longer block goes on in continuation records
CHUNK = 16 << 10  # bytes of a chunk of the transfer framing
RECORDS = 2000  # of an archive file
BATCH = 4 << 20  # bytes handed over at once

_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped.  A ValueError names a fault."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size cut off")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut off")
        parts.append(body[at : at + size])
        at += size + 2


def _head(first: bytes, fields: list[tuple[str, object]]) -> bytes:
    return first + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def records(number: int, page: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int) -> Iterator[bytes]:
    """The records of one page, each without the two line ends that close it."""
    name = f"urn:page:{'' if page is None else page}:{number}"
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to is not None:
        block = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
        yield _head(b"WARC/1.1", [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block
        return
    block = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Transfer-Encoding", "chunked")]) + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts):
        cut = [("WARC-Segment-Number", k + 1)] if len(parts) > 1 else []
        if k:
            kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k + 1}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", f"<{name}>")]
            if k == len(parts) - 1:
                cut.append(("WARC-Segment-Total-Length", len(block)))
        else:
            kind = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, ("Content-Type", "application/http; msgtype=response")]
        yield _head(b"WARC/1.1", [*kind, *cut, ("Content-Length", len(part))]) + part


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, per_file: int = RECORDS) -> None:
    """Archives of pages (page_id, url, html) below path.

    Of pages with equal html of at least `least` bytes the one with the largest page_id is a response and the
    others revisit it; a null html is empty.  Pages without a page_id are responses.  Rows that
    share the largest page_id and html are all responses.  A null url gives no target.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    equal = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "size", "first")
    equal = saved(equal, "equal")
    rows = rows.join(F.broadcast(equal) if small_enough(equal, 128) else equal, ["digest", "size"], "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    rows = rows.select(F.monotonically_increasing_id().alias("number"), "page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, weight = [], 0
            for row in zip(*(batch.column(c) for c in range(5)), strict=True):
                for record in records(*(x.as_py() for x in row), segment):
                    out.append(record)
                    weight += len(record)
                    if weight >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, weight = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # a record ends with two line ends, which is what the text writer puts after each row
    rows.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=per_file).text(path)


class _Reader:
    """Records of an archive, decompressed piece by piece if it is gzip: head fields, block and fault.

    A fault ends the archive: what was cut off or can't be read comes as one last record that names it.
    """

    def __init__(self, content: bytes):
        self.content, self.at, self.held = memoryview(content), 0, bytearray()
        self.engine = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _fill(self) -> bool:
        tail = self.engine.unconsumed_tail if self.engine else b""
        if self.at >= len(self.content) and not tail:
            return False
        piece = tail or self.content[self.at : self.at + (1 << 16)]
        if not tail:
            self.at += len(piece)
        if not self.engine:
            self.held += piece
            return True
        self.held += self.engine.decompress(piece, 1 << 20)
        if self.engine.eof:
            self.at -= len(self.engine.unused_data)
            self.engine = zlib.decompressobj(31)  # archives may hold many members
        return True

    def _until(self, size: int) -> bool:
        while len(self.held) < size:
            if not self._fill():
                return False
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
        fields: dict[str, str] = {}
        try:
            while True:
                fields, looked = {}, 0
                while (end := self.held.find(b"\r\n\r\n", looked)) < 0:
                    looked = max(0, len(self.held) - 3)
                    if not self._fill():
                        if self.held.strip():
                            yield fields, b"", "archive cut off in a head"
                        return
                first, fields = _fields(bytes(self.held[:end]))
                if not first.startswith("WARC/"):
                    yield {}, b"", f"not a WARC record: {first[:40]!r}"
                    return
                if not re.fullmatch("[0-9]{1,18}", length := fields.get("content-length", "")):
                    yield fields, b"", f"no length: {length[:40]!r}"
                    return
                size = int(length)
                if not self._until(end + 4 + size):
                    yield fields, b"", "archive cut off in a block"
                    return
                yield fields, bytes(self.held[end + 4 : end + 4 + size]), None
                self._until(end + 8 + size)  # the last record may lack its line ends
                del self.held[: end + 8 + size]
        except zlib.error as fault:
            yield fields, b"", f"not gzip: {fault}"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line of a head and its fields by lower-case name; folded lines are joined, bytes that aren't UTF-8 replaced."""
    first, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


_PARSED = "name string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_name string, problem string, segment int, total bigint, block binary"


def _judged(block: bytes, digest: str | None) -> tuple[int | None, str | None, str | None]:
    """Bytes and digest of the payload in a block, and what is wrong with it."""
    try:
        payload = _payload(block)
    except ValueError as fault:
        return None, None, str(fault)
    found = base32_sha1(payload)
    return len(payload), found, None if digest in (None, f"sha1:{found}") else "digest differs"


def _row(fields: dict[str, str], block: bytes, fault: str | None) -> tuple | None:
    """The row of a record, in the order of _PARSED; None if its type is another."""
    kind, name, url = fields.get("warc-type"), fields.get("warc-record-id", "").strip("<>"), fields.get("warc-target-uri")
    segment, total, digest = fields.get("warc-segment-number"), fields.get("warc-segment-total-length"), fields.get("warc-payload-digest")
    refers = fields.get("warc-refers-to", "").strip("<>") or None
    if fault:
        return name or None, url, kind, None, None, refers, fault, None, None, None
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", block)
        return name, url, kind, int(length[1]) if length else None, digest and digest.removeprefix("sha1:"), refers, None if refers else "no record referred to", None, None, None
    if kind == "response" and segment is None:
        size, found, problem = _judged(block, digest)
        return name, url, kind, size, found, None, problem, None, None, None
    if kind in ("response", "continuation"):
        origin = fields.get("warc-segment-origin-id", name).strip("<>")
        whole = re.compile("[0-9]{1,9}")
        if not whole.fullmatch(segment or "") or (total is not None and not re.fullmatch("[0-9]{1,18}", total)):
            return name, url, kind, None, None, None, "segment without a number", None, None, None
        return origin, url, "response", None, digest, None, None, int(segment), None if total is None else int(total), block
    return None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, problem, record_id and refers_name of each page in
    the archives (*.gz and *.warc) below path.

    Segments are grouped by their origin, put in order and checked against the total length; then the
    chunked framing is taken off and the digest compared.  A record that fails keeps its row, with the
    fault in problem, and so does an archive that is cut off or isn't one: the records before the fault stay.
    Other record types are skipped.  record_id and refers_name are the names in the archive; page_id and refers_to are
    the pages they stand for, null if another program gave the names.  A revisit of a record that isn't named
    has that as its problem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in _PARSED.split(", ")]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 10, kinds, strict=True)], names=names)
        for batch in batches:
            for content in batch.column(0):
                rows, weight = [], 0
                for record in _Reader(content.as_py()):
                    row = _row(*record)
                    if row:
                        rows.append(row)
                        weight += len(row[-1] or b"")
                    if len(rows) >= 5000 or weight >= BATCH:
                        yield flush(rows)
                        rows, weight = [], 0
                yield flush(rows)

    parsed = saved(files.mapInArrow(parse, _PARSED), "parsed")
    parts = parsed.where("segment is not null").groupBy("name").agg(F.max("url").alias("url"), F.max("payload_digest").alias("digest"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, total, parts in zip(*(batch.column(c) for c in ("digest", "total", "parts")), strict=True):
                own = parts.as_py()
                block = b"".join(p["block"] for p in own)
                if [p["segment"] for p in own] != list(range(1, len(own) + 1)) or total.as_py() != len(block):
                    rows.append((None, None, "segments missing"))
                else:
                    rows.append(_judged(block, digest.as_py()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("url"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["name", "url", "payload_bytes", "payload_digest", "problem"])

    whole = parts.mapInArrow(assemble, "name string, url string, payload_bytes bigint, payload_digest string, problem string")
    whole = whole.withColumns({"record_type": F.lit("response"), "refers_name": F.lit(None).cast("string")})
    found = parsed.where("segment is null").select(*[c for c in parsed.columns if c not in ("segment", "total", "block")]).unionByName(whole)
    page = lambda name: F.regexp_extract(name, r"^urn:page:(\d+|-\d+)(?::|$)", 1).try_cast("bigint")
    return found.select(page("name").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", page("refers_name").alias("refers_to"), "problem", F.col("name").alias("record_id"), "refers_name")


def report(pages: DataFrame) -> DataFrame:
    """pages written as archives in the shared folder and read back."""
    path = new_dir(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
