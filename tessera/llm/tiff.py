"""TIFF as a media column: text bytes stored losslessly as 8-bit grey samples, and a reader that walks image directories.

The reader follows the chain of directories in either byte order, decodes strips or tiles stored plain, by PackBits, LZW or
deflate, undoes the horizontal predictor, and gives one image per page, of 8- or 16-bit samples, one or several a pixel. What it
inflates is bounded by what the directory says, and that by `MOST_BYTES` a page. The writer lays a payload out as rows of 192 samples,
at most `PAGE_ROWS` rows a page; the checksum of a page's samples, whatever its size, chooses between PackBits, LZW and deflate
(the last two with predictor or without) and between strips and tiles, so equal texts give equal files.

Defined results: null text is an empty one, whose payload is one row of spaces; repeated rows and ids are rows of their own; other
columns are ignored; an empty table gives no rows. In tiff_pages a null file has no pages, and a file that can't be read gives one row
with the reason in `error`.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ensure_columns

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE_W, TILE_H = 192, 2048, 32, 64, 32
#: Samples of a page in bytes that the reader takes.
MOST_BYTES = 1 << 28
# Fixed values of the TIFF 6.0 format: tags and compression codes.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 322, 323, 324, 325
PLANAR = 284
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


_REPEATS = re.compile(rb"(.)\1{2,}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, last = bytearray(), 0

    def plain(a: int, z: int) -> None:
        for i in range(a, z, 128):
            out.append(min(128, z - i) - 1)
            out.extend(data[i : min(z, i + 128)])

    for m in _REPEATS.finditer(data):
        a, z = m.span()
        plain(last, a)
        for i in range(a, z, 128):
            n = min(128, z - i)
            out.extend((257 - n, data[a]) if n > 1 else (0, data[a]))
        last = z
    plain(last, len(data))
    return bytes(out)


def unpack_bits(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_pack(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits that widen one code early."""
    acc, held, width, nxt = 256, 9, 9, 258
    out = bytearray()
    table: dict[int, int] = {}  # by the code so far and the next byte
    find = table.get
    word = data[0] if data else -1
    for c in data[1:]:
        code = find(word << 8 | c)
        if code is not None:
            word = code
            continue
        acc = acc << width | word
        held += width
        table[word << 8 | c] = nxt
        nxt += 1
        word = c
        if nxt == 4094:
            acc = acc << width | 256
            held += width
            table.clear()
            width, nxt = 9, 258
        elif nxt >> width:
            width += 1
        if held > 512:
            rest = held % 8
            out += (acc >> rest).to_bytes(held // 8, "big")
            acc &= (1 << rest) - 1
            held = rest
    if word >= 0:
        acc = acc << width | word
        held += width
        nxt += 1
        if nxt == 4094:
            acc = acc << width | 256
            held += width
            width = 9
        elif nxt >= 1 << width:
            width += 1
    acc = acc << width | 257
    held += width
    return bytes(out) + (acc << -held % 8).to_bytes((held + 7) // 8, "big")


_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_unpack(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Codes up to the end code, the end of the data or `most` bytes; a code ahead of its table raises ValueError."""
    out: list[bytes] = []
    table = list(_SINGLE)
    acc = held = size = 0
    width, last = 9, b""
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held & ((1 << width) - 1)
        if code == 257 or size >= most:
            break
        if code == 256:
            table, width, last = list(_SINGLE), 9, b""
            continue
        if not last:
            if code > 255:
                raise ValueError("an LZW code is ahead of its table")
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code is ahead of its table")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        size += len(word)
        last = word
    return b"".join(out)


def _pack(samples: np.ndarray, how: int, predictor: int) -> bytes:
    if predictor == 2:
        samples = np.concatenate([samples[:, :1], samples[:, 1:] - samples[:, :-1]], axis=1)
    raw = samples.tobytes()
    return pack_bits(raw) if how == PACKBITS else lzw_pack(raw) if how == LZW else zlib.compress(raw, 6)


def layout_of(page: np.ndarray) -> tuple[int, int, bool]:
    """(compression, predictor, tiled) from the checksum of the samples."""
    pick = zlib.crc32(page.tobytes()) >> 4
    how = (PACKBITS, LZW, DEFLATE)[pick % 3]
    return how, 1 if how == PACKBITS else 1 + (pick // 3) % 2, (pick // 6) % 2 == 1


def write_tiff(pages: list[np.ndarray]) -> bytes:
    """A little-endian file with a directory for each array of 8-bit rows."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        rows, width = page.shape
        how, predictor, tiled = layout_of(page)
        if tiled:
            high = min(TILE_H, -(-rows // 16) * 16)
            full = np.zeros((-(-rows // high) * high, -(-width // TILE_W) * TILE_W), np.uint8)
            full[:rows, :width] = page
            parts = [_pack(full[y : y + high, x : x + TILE_W], how, predictor) for y in range(0, full.shape[0], high) for x in range(0, full.shape[1], TILE_W)]
        else:
            parts = [_pack(page[y : y + STRIP_ROWS], how, predictor) for y in range(0, rows, STRIP_ROWS)]
        offsets = []
        for p in parts:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) & 1)
        entries = {IMAGE_WIDTH: [width], IMAGE_LENGTH: [rows], BITS: [8], COMPRESSION: [how], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        entries |= {TILE_WIDTH: [TILE_W], TILE_LENGTH: [high], TILE_OFFSETS: offsets, TILE_COUNTS: [len(p) for p in parts]} if tiled else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [STRIP_ROWS], STRIP_COUNTS: [len(p) for p in parts]}
        fields = []
        for tag, values in sorted(entries.items()):
            at = values[0]
            if len(values) > 1:
                at = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            fields.append(struct.pack("<HHII", tag, 4, len(values), at))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _unpacked(raw: bytes, how: int, size: int) -> bytes:
    """size bytes of a strip or tile; inflates no further."""
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise ValueError(f"deflate: {e}") from e
    elif how in (LZW, PACKBITS):
        out = (lzw_unpack if how == LZW else unpack_bits)(raw, size)
    elif how == PLAIN:
        out = raw
    else:
        raise ValueError(f"compression {how} is not read")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    """The whole-number tags of a directory, and the place of the next one."""
    n, tags = struct.unpack_from(order + "H", data, at)[0], {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        form, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
        if size:
            if count * size > len(data):
                raise ValueError("a tag has more values than the file has bytes")
            where = at + 10 + 12 * i
            where = where if count * size <= 4 else struct.unpack_from(order + "I", data, where)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{form}", data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _image(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    width, rows, each, bits = one(IMAGE_WIDTH, 0), one(IMAGE_LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or any(b != bits for b in tags.get(BITS, ())) or one(PLANAR, 1) != 1:
        raise ValueError("only chunky samples of 8 or 16 bits are read")
    if not 0 < width * rows * each * bits // 8 <= MOST_BYTES:
        raise ValueError("a page is empty or larger than what is read")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(order + "u2")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, rows), rows))
    if not (0 < w * h * each * bits // 8 <= MOST_BYTES):
        raise ValueError("a strip or tile is empty or larger than what is read")
    across, down = -(-width // w), -(-rows // h)
    offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
    if not offsets or not counts or not len(offsets) == len(counts) == across * down:
        raise ValueError("the strips or tiles don't make up the page")
    page = np.zeros((rows, width * each), kind.newbyteorder("="))
    for i, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        y, x = i // across * h, i % across * w
        tall = h if tiled else min(h, rows - y)
        raw = _unpacked(data[o : o + c], one(COMPRESSION, PLAIN), tall * w * each * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(tall, w, each).astype(page.dtype)
        if one(PREDICTOR, 1) == 2:
            part = np.add.accumulate(part, axis=1, dtype=page.dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("this predictor is not undone")
        part = part.reshape(tall, w * each)
        page[y : y + tall, x * each : (x + w) * each] = part[: rows - y, : (width - x) * each]
    return page


def read_tiff(data: bytes) -> list[np.ndarray]:
    """The pages of a file, each as rows of samples (those of a pixel next to each other); what it can't read raises ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        pages, seen, at = [], set(), struct.unpack_from(order + "I", data, 4)[0]
        while at:
            if at in seen:
                raise ValueError("the image directories form a ring")
            seen.add(at)
            tags, at = _directory(data, order, at)
            pages.append(_image(data, order, tags))
    except struct.error as e:
        raise ValueError(f"the file ends too early: {e}") from e
    return pages


def payload_pages(body: bytes) -> list[np.ndarray]:
    size = max(WIDTH, -(-len(body) // WIDTH) * WIDTH)
    rows = np.frombuffer(body.ljust(size, b" "), np.uint8).reshape(-1, WIDTH)
    return [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]


def page_feature(page: np.ndarray) -> str:
    """Size, mean, spread and mean step between neighbours in thousandths, as whole numbers."""
    n, s = page.size, int(page.sum(dtype=np.int64))
    squares = int((page.astype(np.int64) ** 2).sum())
    step = int(np.abs(np.diff(page.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{page.shape[1]}x{page.shape[0]}:{1000 * s // n}:{1000 * (n * squares - s * s) // (n * n)}:{1000 * step // n}"


def store_as_tiff(documents: DataFrame) -> DataFrame:
    """(doc_id, media): the file of each text."""

    def store(batches):
        for b in batches:
            files = [write_tiff(payload_pages((t or "").encode())) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(files, pa.large_binary()).cast(pa.binary())], names=["doc_id", "media"])

    return ensure_columns(documents, doc_id="long", text="string").mapInArrow(store, "doc_id long, media binary")


def tiff_pages(media: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, feature, samples, error) per page of (doc_id, media); width counts samples."""
    schema = "doc_id long, page int, width int, height int, feature string, samples binary, error string"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def pages(batches):
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(i, n, p.shape[1], p.shape[0], page_feature(p), p.tobytes(), None) for n, p in enumerate(read_tiff(m) if m is not None else [])]
                except ValueError as e:
                    rows = [(i, None, None, None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "media").mapInArrow(pages, schema)


def tiff_digest(documents: DataFrame) -> DataFrame:
    """Store each text, read the file back and describe both; one pass, as a file and its pages belong to one row."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"

    def digest(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body = (t or "").encode()
                media = write_tiff(payload_pages(body))
                pages = read_tiff(media)
                back = b"".join(p.tobytes() for p in pages)
                rows.append((i, len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(page_feature, pages)), len(pages)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return ensure_columns(documents, doc_id="long", text="string").mapInArrow(digest, schema)
