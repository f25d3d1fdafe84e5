"""WARC archives: records with revisits, segments and chunked bodies written by Spark, read back, reassembled and verified.

A page becomes one HTTP response whose body is sent in chunks. A record longer than `segment_bytes` is cut into a first
record and continuation records (WARC-Segment-Origin-ID, -Number, and -Total-Length on the last). Spark's text writer puts the records,
which it ends with the blank line that WARC asks for, into gzip files in the shared folder. A record is of `segment_bytes` and its
headers at most, a file of `records_per_file` records, so a file's size is bounded however long the pages are. A revisit names
the record that it repeats.

Reading walks the gzip stream record by record. Whole records are decoded at once; segments, which may lie in any archive, are
grouped by origin, put in order, checked for gaps and against the total length, joined, and their chunked framing is undone. A
revisit is verified if the archives hold a response of that page with that digest and length.

Defined results: null html is an empty payload; a null url leaves the header out; a null page_id keeps its row and is never referred
to; repeated rows are records of their own (the rows that share the smallest page_id of a payload are all responses); payloads under
`least` bytes are always responses; an empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns, materialize, scratch_path

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(body: bytes, size: int = 4096) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := body[i : i + size]), c) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """Undo chunked transfer framing; chunk extensions and trailers are skipped, anything else raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("a chunk has a negative size")
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than it says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without its transfer framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("the HTTP head has no end")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the blank line at the end, which the writer adds."""
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), f"Content-Length: {len(block)}\r\n\r\n"]).encode() + block


def page_records(number: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int, page: str) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response with its continuations."""
    name = f"<urn:page:{page}:{number}>"
    common = [("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        common.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return [record(head, _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), *common], block)]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], pieces[0])]
    for i, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(pieces) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{number}/{i}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i)), *last], piece))
    return out


def write_archives(pages: DataFrame, path: str, least: int = 100, segment_bytes: int = 8192, records_per_file: int = 4000) -> None:
    """Write a record per row of pages. Which payloads are equal is told by their SHA-256, counted before any text moves."""
    rows = ensure_columns(pages, page_id="long", url="string", html="string").withColumn("body", F.coalesce("html", F.lit("")).cast("binary")).withColumn("digest", F.sha2("body", 256)).withColumn("number", F.monotonically_increasing_id())
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number"))).alias("first")
    firsts = rows.where(F.octet_length("body") >= least).groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "first")
    record = F.concat_ws(":", "first.page_id", "first.number")
    marked = rows.join(firsts, "digest", "left").select("page_id", "url", "body", "digest", F.when(F.col("page_id") != F.col("first.page_id"), record).alias("refers_to"), "number")

    def records(batches):
        for b in batches:
            out, held = [], 0
            for page, url, body, digest, refers, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = page_records(str(number), url, body, digest, refers, segment_bytes, "" if page is None else str(page))
                out += new
                held += sum(map(len, new))
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    text = marked.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class Stream:
    """Lines and exact lengths from gzip members or plain bytes, decompressed a piece at a time."""

    def __init__(self, data: bytes, piece: int = 1 << 18):
        self.data, self.piece, self.at, self.held, self.read = memoryview(data), piece, 0, b"", 0
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        """Hold another piece behind what has not been read; False at the end."""
        if self.zip is None:
            piece = bytes(self.data[self.at : self.at + self.piece])
            self.at += len(piece)
        else:
            piece = b""
            while not piece and (self.at < len(self.data) or self.zip.unconsumed_tail):
                tail = self.zip.unconsumed_tail
                if not tail:
                    tail = self.data[self.at : self.at + self.piece]
                    self.at += len(tail)
                piece = self.zip.decompress(tail, 4 * self.piece)
                if self.zip.eof:
                    self.at -= len(self.zip.unused_data)
                    self.zip = zlib.decompressobj(31)
        if not piece:
            return False
        self.held, self.read = self.held[self.read :] + piece, 0
        return True

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n", self.read)) < 0:
            if not self.more():
                return None
        out, self.read = self.held[self.read : end], end + 2
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if self.read == len(self.held):
                self.held, self.read = b"", 0
                if not self.more():
                    raise ValueError("an archive ends inside a record")
            part = self.held[self.read : self.read + n - have]
            parts.append(part)
            have += len(part)
            self.read += len(part)
        return b"".join(parts)


def walk(data: bytes):
    """(headers by lower-case name, block) of every record of an archive."""
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        headers: dict[str, str] = {}
        while line := stream.line():
            k, _, v = line.partition(b":")
            headers[k.decode().strip().lower()] = v.decode().strip()
        yield headers, stream.take(int(headers["content-length"]))


_READ = "origin string, page_id long, segment int, total long, type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, block binary, payload binary"
_NAMES = [c.split()[0] for c in _READ.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_FIELDS = [_TYPES[c.split()[1]] for c in _READ.split(", ")]


def _page(name: str) -> int | None:
    digits = name.strip("<>").split(":")[2]
    return int(digits) if digits else None


def decode(headers: dict[str, str], block: bytes, keep: bool) -> dict:
    """One whole record; a revisit's length is that of the HTTP head it repeats, its digest that of the record it refers to, which
    verify_revisits looks for."""
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    out = {"origin": headers["warc-record-id"], "page_id": _page(headers["warc-record-id"]), "type": headers["warc-type"], "payload_digest": digest}
    if headers["warc-type"] == "revisit":
        length = next((int(x.split(b":")[1]) for x in block.lower().split(b"\r\n") if x.startswith(b"content-length:")), None)
        return out | {"refers_to": _page(headers["warc-refers-to"]), "payload_bytes": length, "verified": length is not None}
    try:
        body = payload_of(block)
    except ValueError:
        return out | {"verified": False}
    found = hashlib.sha256(body).hexdigest()
    return out | {"payload_bytes": len(body), "payload_digest": found, "verified": found == digest, "payload": body if keep else None}


def read_archives(spark, path: str, keep_payload: bool = False) -> DataFrame:
    """A row per page: page_id, type, refers_to, payload_bytes, payload_digest, verified, payload (null unless asked for)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _FIELDS, strict=True)], names=_NAMES)

    def parse(batches):
        for b in batches:
            for i in range(b.num_rows):
                out, held = [], 0
                for headers, block in walk(b.column(0)[i].as_py()):
                    if "warc-segment-number" in headers:
                        total = headers.get("warc-segment-total-length")
                        out.append({"origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "segment": int(headers["warc-segment-number"]), "total": int(total) if total else None, "type": headers["warc-type"], "payload_digest": headers.get("warc-payload-digest"), "block": block})
                        held += len(block)
                    else:
                        out.append(decode(headers, block, keep_payload))
                        held += len(block) * keep_payload
                    if len(out) >= 2000 or held > 8 << 20:
                        yield batch(out)
                        out, held = [], 0
                if out:
                    yield batch(out)

    records = materialize(files.mapInArrow(parse, _READ), "records")

    def assemble(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["origin", "segment", "total", "type", "payload_digest", "block"]).to_pylist(), key=lambda r: r["segment"])
        block = b"".join(r["block"] for r in rows)
        whole = [r["segment"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["total"] == len(block)
        headers = {"warc-record-id": rows[0]["origin"], "warc-type": "response", "warc-payload-digest": rows[0]["payload_digest"] or ""}
        out = decode(headers, block, keep_payload) if whole else {"origin": rows[0]["origin"], "page_id": _page(rows[0]["origin"]), "type": "response", "verified": False}
        return pa.Table.from_batches([batch([out])])

    joined = materialize(records.where("segment is not null").groupBy("origin").applyInArrow(assemble, _READ), "joined")
    whole = records.where("segment is null").union(joined)
    return verify_revisits(whole.select("page_id", "type", "refers_to", "payload_bytes", "payload_digest", "verified", "payload"))


def verify_revisits(rows: DataFrame) -> DataFrame:
    """rows, where a revisit is verified only if there is a verified response of the page it refers to with its digest and length.

    What revisits refer to is reduced to distinct records before it meets the responses, so the copies of one page are no hot key."""
    named = ["page", "digest", "n"]
    revisits = rows.where("type = 'revisit'").select(F.col("refers_to").alias("page"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("n")).distinct()
    responses = rows.where("type = 'response' and verified and page_id is not null").select(F.col("page_id").alias("page"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("n")).distinct()
    lost = materialize(revisits.join(responses, named, "left_anti"), "lost")
    if lost.isEmpty():
        return rows
    on = (F.col("refers_to") == F.col("page")) & (F.col("payload_digest") == F.col("digest")) & F.col("payload_bytes").eqNullSafe(F.col("n"))
    return rows.join(lost, on, "left").withColumn("verified", F.col("verified") & F.col("page").isNull()).select(rows.columns)


def archive_round_trip(pages: DataFrame, least: int = 100, segment_bytes: int = 8192) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least, segment_bytes)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "verified")
