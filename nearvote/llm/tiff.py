"""TIFF pages: directories, PackBits, LZW and deflate, strips and tiles, predictors.

``read_pages`` walks the image file directories of a TIFF in either byte order and
yields every page as raw samples of whole bytes: 8, 16 or 32 bits as they are, 1, 2 and 4
bits as one byte each. Planes stored apart are put together. What a file claims is checked
before memory is taken for it, and any fault is a ``TiffError``. ``tiff_pages`` is the
same over a DataFrame column, one row per page. ``write_pages`` makes such files, so that whole
texts can be stored as images and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearvote.llm import common

# Fixed values of the TIFF 6.0 format: tags, field type sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 266, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257

#: Bytes of decoded pixels that a page may have; a larger one is an error.
MAX_PAGE = 1 << 28
#: More than any of the schemes can shrink data.
MAX_RATIO = 4096


@dataclass(frozen=True)
class Page:
    """One image: ``pixels`` has height * width * samples values, row by row, in the file's
    byte order; values of less than 8 ``bits`` have a byte each."""

    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


class TiffError(ValueError):
    """The bytes are not a TIFF that this module reads."""


def unpack_bits(data: bytes, limit: int | None = None) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and (limit is None or len(out) < limit):
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as such, all between them as literals."""
    raw = np.frombuffer(data, np.uint8)
    if not raw.size:
        return b""
    edges = np.concatenate(([0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(raw)]))
    lengths = np.diff(edges)
    out, literal = bytearray(), 0

    def put(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(b, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(lengths >= 3).tolist():
        start, left = int(edges[k]), int(lengths[k])
        put(literal, start)
        literal = start + left
        value = data[start : start + 1]
        while left >= 2:
            run = min(left, 128)
            out.append(257 - run)
            out.extend(value)
            left -= run
        if left:
            literal -= 1
    put(literal, len(data))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits, widened one code early, as TIFF has them."""
    codes, widths = [LZW_CLEAR], [9]
    table: dict[tuple[int, int], int] = {}
    following, width, prefix = 258, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        table[prefix, byte] = following
        following += 1
        prefix = byte
        if following == 4095:
            codes.append(LZW_CLEAR)
            widths.append(12)
            table.clear()
            following, width = 258, 9
        elif following >= 1 << width:
            width += 1
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        if following + 1 >= 1 << width and width < 12:
            width += 1
    codes.append(LZW_END)
    widths.append(width)
    return _join_codes(np.array(codes, np.int64), np.array(widths, np.int64))


def _join_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    shift = np.arange(11, -1, -1)
    bits = (codes[:, None] >> shift) & 1
    return np.packbits(bits[shift < widths[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, limit: int | None = None) -> bytes:
    """Decoded bytes; decoding ends with the data, the end code or ``limit`` bytes."""
    out: list[bytes] = []
    size = 0
    table: list[bytes] = []
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    width, held, bits, previous = 9, 0, 0, b""
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, previous = singles.copy(), 9, b""
            continue
        if not table:
            table = singles.copy()
        if not previous:
            if code >= len(table):
                raise TiffError("LZW code beyond the table")
            previous = table[code]
            out.append(previous)
            size += 1
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table):
            entry = previous + previous[:1]
        else:
            raise TiffError("LZW code beyond the table")
        table.append(previous + entry[:1])
        out.append(entry)
        size += len(entry)
        if limit is not None and size >= limit:
            break
        previous = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def difference(block: np.ndarray) -> np.ndarray:
    """Horizontal differencing of (rows, columns, samples), modulo the sample range."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def undo_difference(block: np.ndarray) -> np.ndarray:
    return np.cumsum(block, axis=1, dtype=block.dtype)


def undo_float_difference(raw: np.ndarray, samples: int, order: str) -> np.ndarray:
    """Floating-point predictor: (rows, bytes) of differenced byte planes, highest first, as values of 4 bytes."""
    rows = len(raw)
    planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, 4, -1)
    values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">u4")[:, :, 0]
    return values.astype(f"{order}u4").reshape(rows, -1, samples)


def _inflate(scheme: int, data: bytes, size: int) -> bytes:
    """``size`` bytes, or fewer if there are no more."""
    if scheme == NONE:
        return data[:size]
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (ADOBE_DEFLATE, DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    raise TiffError(f"compression {scheme} is not read")


def _deflate(scheme: int, data: bytes) -> bytes:
    if scheme == NONE:
        return data
    if scheme == PACKBITS:
        return pack_bits(data)
    if scheme == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """Integer fields of the directory at ``at``, and where the next directory is."""
    (count,) = struct.unpack_from(f"{order}H", data, at)
    found = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        place = at + 10 + 12 * i
        if TYPE_SIZES.get(kind, 1) * n > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if kind in TYPE_CODES:
            found[tag] = struct.unpack_from(f"{order}{n}{TYPE_CODES[kind]}", data, place)
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)
    return found, following


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages of a TIFF in the order of its directories; TiffError on anything malformed."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
            raise TiffError("no TIFF header")
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            fields, following = _fields(data, at, order)
            yield _page(data, fields, len(seen) - 1, order)
            at = following
    except TiffError:
        raise
    except (struct.error, LookupError, ArithmeticError, ValueError, MemoryError) as e:
        raise TiffError(f"truncated or incomplete: {e}") from e


def _reversed_bits(data: bytes) -> bytes:
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8)), bitorder="little").tobytes()


def _page(data: bytes, fields: dict[int, tuple[int, ...]], index: int, order: str) -> Page:
    width, height = fields[WIDTH][0], fields[HEIGHT][0]
    samples = fields.get(SAMPLES, (1,))[0]
    depths = set(fields.get(BITS, (1,)))
    scheme = fields.get(COMPRESSION, (NONE,))[0]
    predictor = fields.get(PREDICTOR, (1,))[0]
    apart = fields.get(PLANAR, (1,))[0] == 2
    bits = depths.pop() if len(depths) == 1 else 0
    if bits not in (1, 2, 4, 8, 16, 32) or not samples or predictor not in (1, 2, 3) or (predictor == 2 and bits < 8) or (predictor == 3 and bits != 32):
        raise TiffError(f"{bits or 'mixed'} bits with predictor {predictor} are not read")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    tiled = TILE_OFFSETS in fields
    if tiled:
        wide, high = fields[TILE_WIDTH][0], fields[TILE_HEIGHT][0]
        offsets, sizes = fields[TILE_OFFSETS], fields[TILE_BYTES]
    else:
        wide, high = width, min(height, fields.get(ROWS_PER_STRIP, (height,))[0]) or 1
        offsets, sizes = fields[STRIP_OFFSETS], fields[STRIP_BYTES]
    whole = width * height * samples * kind.itemsize
    if whole > MAX_PAGE or wide * high * samples * kind.itemsize > MAX_PAGE:
        raise TiffError(f"a page or tile of more than {MAX_PAGE} bytes")
    planes, each = (samples, 1) if apart else (1, samples)
    across = -(-width // wide) if wide else 0
    count = across * -(-height // high) if high else 0
    if not wide or not high or len(offsets) < planes * count or len(sizes) < planes * count:
        raise TiffError("strips or tiles are missing")
    if whole > MAX_RATIO * 8 * sum(min(n, len(data)) for n in sizes):
        raise TiffError("more pixels than the data can hold")
    image = np.zeros((height, width, samples), kind)
    row_bytes = -(-wide * each * bits // 8)
    for i in range(planes * count):
        plane, place = divmod(i, count)
        x, y = place % across * wide, place // across * high
        rows = high if tiled else min(high, height - y)
        packed = data[offsets[i] : offsets[i] + sizes[i]]
        if fields.get(FILL_ORDER, (1,))[0] == 2:
            packed = _reversed_bits(packed)
        raw = _inflate(scheme, packed, rows * row_bytes)
        if len(raw) < rows * row_bytes:
            raise TiffError("a strip or tile is too short")
        lines = np.frombuffer(raw, np.uint8, rows * row_bytes).reshape(rows, row_bytes)
        if bits < 8:
            values = np.unpackbits(lines, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
            block = values[:, : wide * each].astype(np.uint8).reshape(rows, wide, each)
        elif predictor == 3:
            block = undo_float_difference(lines, each, order)
        else:
            block = lines.view(kind).reshape(rows, wide, each)
            if predictor == 2:
                block = undo_difference(block)
        image[y : y + rows, x : x + wide, plane : plane + each] = block[: height - y, : width - x]
    return Page(index, width, height, samples, bits, scheme, predictor, tiled, image.tobytes())


@dataclass(frozen=True)
class Layout:
    """How a page is stored: strips of ``high`` rows, or tiles of ``wide`` x ``high`` pixels."""

    compression: int = ADOBE_DEFLATE
    predictor: int = 1
    wide: int = 0
    high: int = 64


def write_pages(pages: list[tuple[np.ndarray, Layout]], order: str = "<") -> bytes:
    """A TIFF of 8-bit grey pages (height, width), each with its layout."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for image, layout in pages:
        height, width = image.shape
        wide = layout.wide or width
        offsets, sizes = [], []
        for y in range(0, height, layout.high):
            for x in range(0, width, wide):
                block = image[y : y + layout.high, x : x + wide]
                if layout.wide:
                    full = np.zeros((layout.high, wide), np.uint8)
                    full[: block.shape[0], : block.shape[1]] = block
                    block = full
                if layout.predictor == 2:
                    block = difference(block[:, :, None])
                body = _deflate(layout.compression, block.tobytes())
                offsets.append(len(out))
                sizes.append(len(body))
                out += body
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [layout.compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1])]
        if layout.wide:
            entries += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [layout.high]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [layout.high]), (STRIP_BYTES, 4, sizes)]
        if layout.predictor == 2:
            entries.append((PREDICTOR, 3, [2]))
        fields = bytearray()
        for tag, kind, values in sorted(entries):
            body = struct.pack(f"{order}{len(values)}{TYPE_CODES[kind]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                place, body = len(out), b""
                out += struct.pack(f"{order}{len(values)}{TYPE_CODES[kind]}", *values)
                body = struct.pack(f"{order}I", place)
            fields += struct.pack(f"{order}HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + fields
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


PAGE_TYPE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("samples", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("pixels", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


#: Most bytes of pixels for each byte of a file: above what deflate (1,032) and LZW (1,366) can make of it.
MAX_RATIO = 2048


def _page_rows(key: int | None, data: bytes) -> Iterator[tuple]:
    total = 0
    try:
        for p in read_pages(data):
            total += len(p.pixels)
            if total > MAX_RATIO * len(data):
                raise TiffError("pages share their data: more pixels than the file can hold")
            yield (key, p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None)
    except TiffError as e:
        yield (key, *[None] * 9, str(e))


def tiff_pages(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per page of every TIFF in ``data_col``, a page in memory at a time.

    A null or unreadable file gives one row that has only its id and ``error``; pages
    that come before a fault are kept. So are those before a file has more than ``MAX_RATIO``
    times its size in pixels, which no scheme reaches unless pages share their data. An
    empty table gives none.
    """
    names = [f.name for f in PAGE_TYPE]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("id", pa.int64()), *((n, pa.int32()) for n in names[1:8]), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _page_rows(key, data.as_py() or b""):
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds.types)], schema=kinds)

    return media.select(media[id_col].cast("long").alias("id"), media[data_col].cast("binary").alias("data")).mapInArrow(scan, PAGE_TYPE)


#: Pixels of a row and rows of a page in stored texts.
TEXT_WIDTH, TEXT_ROWS = 64, 4096


def text_layout(crc: int) -> Layout:
    """Layout of a stored text, by its crc32: every scheme gets its share of the corpus."""
    scheme = (ADOBE_DEFLATE, PACKBITS, LZW)[crc % 3]
    predictor = 2 if crc // 3 % 2 and scheme == ADOBE_DEFLATE else 1
    return Layout(scheme, predictor, *((32, 64) if crc // 6 % 4 == 0 else (0, 512)))


def text_payload(raw: bytes) -> bytes:
    """The bytes padded with zeros to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store_text(raw: bytes) -> bytes:
    """The payload of a text as grey pages of 64 columns."""
    payload = text_payload(raw)
    layout = text_layout(zlib.crc32(payload))
    image = np.frombuffer(payload, np.uint8).reshape(-1, TEXT_WIDTH)
    return write_pages([(image[y : y + TEXT_ROWS], layout) for y in range(0, len(image), TEXT_ROWS)])


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a TIFF, read the file back and digest what came out.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. The feature names each page's shape and scheme with the sum
    and the high-nibble histogram of its pixels. A null text is empty; equal texts give
    equal values; an empty table gives no rows.
    """
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(n, T.StringType() if n.endswith("sha256") or n == "feature" else T.LongType()) for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (value.as_py() or "").encode()
                media = store_text(raw)
                whole, tail, size, features = hashlib.sha256(), b"", 0, []
                for page in read_pages(media):
                    whole.update(page.pixels)
                    tail, size = page.pixels[-64:], size + len(page.pixels)
                    pixels = np.frombuffer(page.pixels, np.uint8)
                    bars = np.bincount(pixels >> 4, minlength=16)
                    features.append(f"{page.width}x{page.height}:{page.compression}/{page.predictor}{'t' if page.tiled else 's'}:{int(pixels.sum(dtype=np.int64))}:" + ",".join(map(str, bars)))
                rows.append((key, len(raw), size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), ";".join(features)))
            kinds = [pa.string() if n.endswith("sha256") or n == "feature" else pa.int64() for n in schema.names]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return common.documents(docs, id_col, text_col).select("id", "text").mapInArrow(scan, schema)
