"""TIFF pages as rows.

``pages`` walks the image directories of a TIFF file and decodes each to its raw samples: strips or tiles, stored
plain or as PackBits, LZW or deflate, with the horizontal predictor undone. ``decode_pages`` emits one row a page.
``encode`` writes such files, for storing bytes and for round trips.

Defined results: a null or empty file, or one whose directories can't be walked, gives a row with page null and the reason in
``error``, after the pages before it; a damaged or unsupported page gives a row of its number with the reason, and the pages after it
are read; a page that declares more samples than its stored bytes can hold, or more than ``max_bytes``, counts as damaged before
any memory is taken; samples of 1 and 4 bits come as bytes. A null text is stored as the empty text; a very long one as many
pages; equal files and equal texts give equal rows; a null identifier is kept; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Fixed values of the TIFF 6.0 format: tag numbers, field type sizes, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257

#: Bytes that one stored byte can stand for at most, by compression.
GROWTH = {PLAIN: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 4096}
#: Decoded bytes of one page at most.
MAX_BYTES = 1 << 28


class TiffError(ValueError):
    """The file isn't a TIFF that this module can decode."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


# ---------------------------------------------------------------- codecs


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1\1+", re.S)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes and more as such, the rest as it is; 128 bytes a packet at most."""
    out, at = bytearray(), 0

    def plain(start: int, end: int) -> None:
        for k in range(start, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        plain(at, m.start())
        n = m.end() - m.start()
        while n > 1:
            k = min(n, 128)
            out.extend((257 - k, data[m.start()]))
            n -= k
        at = m.end() - n
    plain(at, len(data))
    return bytes(out)


#: Codes since the last clear from which each width holds.
_WIDTHS = ((9, 254), (10, 766), (11, 1790), (12, 1 << 62))


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes from the high bit down, of 9 to 12 bits, widened one code early. How wide a code is hangs on its number since the last clear, so
    that codes are taken from the bits many at a time."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    out: list[bytes] = []
    got = at = number = 0
    table: list[bytes] | None = None
    last = b""
    while got < size:
        width, until = next(x for x in _WIDTHS if number < x[1])
        n = min(until - number, 4096, (len(bits) - at) // width)
        if n <= 0:
            break
        codes = bits[at : at + n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1))
        for k, code in enumerate(codes.tolist()):
            if code == LZW_CLEAR:
                table, last, number = [bytes((x,)) for x in range(256)] + [b"", b""], b"", 0
                at += (k + 1) * width
                break
            if code == LZW_END:
                return b"".join(out)
            if table is None:
                raise TiffError("LZW data without a clear code")
            known = len(table)
            if last:
                if code < known:
                    entry = table[code]
                elif code == known:
                    entry = last + last[:1]
                else:
                    raise TiffError("LZW code out of range")
                table.append(last + entry[:1])
            elif code > 255:
                raise TiffError("LZW code out of range")
            else:
                entry = table[code]
            out.append(entry)
            last = entry
            got += len(entry)
            if got >= size:
                return b"".join(out)
        else:
            at += n * width
            number += n
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW; the codes are found one after another and laid into bits together."""
    codes, widths = [LZW_CLEAR], [9]
    add, widen = codes.append, widths.append
    table: dict[int, int] = {}  # the code of a longer run, by its beginning's code and its last byte
    find = table.get
    size, width, run = 258, 9, -1
    for k in data:
        key = run << 8 | k
        longer = find(key) if run >= 0 else k
        if longer is not None:
            run = longer
            continue
        add(run)
        widen(width)
        table[key] = size
        size += 1
        if size == 4094:
            add(LZW_CLEAR)
            widen(width)
            table.clear()
            size, width = 258, 9
        elif size == 512 or size == 1024 or size == 2048:
            width += 1
        run = k
    if run >= 0:
        add(run)
        widen(width)
        size += 1
        width = min(12, max(9, size.bit_length()))
    add(LZW_END)
    widen(width)
    w = np.array(widths)
    ends = np.cumsum(w)
    place = np.arange(ends[-1])
    shift = np.repeat(ends, w) - 1 - place
    return np.packbits((np.repeat(np.array(codes), w) >> shift & 1).astype(np.uint8)).tobytes()


def unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data[:size]
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size) if size else b""
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError(f"{len(out)} of {size} bytes in a strip or tile")
    return out[:size]


def packed(data: bytes, compression: int) -> bytes:
    return {PLAIN: bytes, DEFLATE: lambda x: zlib.compress(x, 1), OLD_DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits, LZW: lzw_encode}[compression](data)


# ---------------------------------------------------------------- reading


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("directory beyond the end")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("directory beyond the end")
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        size = TYPE_SIZE.get(kind, 0) * count
        if kind not in (1, 3, 4):
            continue
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + size > len(data):
            raise TiffError(f"tag {tag} beyond the end")
        tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, place)
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _unpredicted(block: np.ndarray, predictor: int) -> np.ndarray:
    """Samples of rows whose differences to the left neighbour were stored."""
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def walk(data: bytes, max_bytes: int = MAX_BYTES) -> Iterator[tuple[int | None, Page | TiffError]]:
    """The pages of a TIFF file in the order of its directories, each with its number, or what is wrong with one; what is wrong with
    the file itself has no number and ends it."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        yield None, TiffError("no TIFF header")
        return
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            yield None, TiffError("directories form a circle")
            return
        seen.add(at)
        try:
            tags, at = _directory(data, order, at)
        except (TiffError, struct.error) as e:
            yield None, TiffError(str(e))
            return
        number = len(seen) - 1
        try:
            yield number, _page(data, order, tags, number, max_bytes)
        except (TiffError, IndexError, ValueError, OverflowError, struct.error, zlib.error, MemoryError) as e:
            yield number, e if isinstance(e, TiffError) else TiffError(f"{type(e).__name__}: {e}")
    if not seen:
        yield None, TiffError("no page")


def pages(data: bytes, max_bytes: int = MAX_BYTES) -> Iterator[Page]:
    """The pages of a TIFF file; raises what is wrong with it."""
    for _, page in walk(data, max_bytes):
        if isinstance(page, TiffError):
            raise page
        yield page


def _page(data: bytes, order: str, tags: dict[int, tuple], number: int, max_bytes: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, bits, samples = one(WIDTH), one(HEIGHT), one(BITS, 1), one(SAMPLES, 1)
    if not width or not height or not samples or bits not in (1, 4, 8, 16) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise TiffError("no size, or not samples of 1, 4, 8 or 16 bits")
    compression, predictor, tiled = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), TILE_OFFSETS in tags
    if compression not in GROWTH:
        raise TiffError(f"compression {compression}")
    if predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise TiffError(f"predictor {predictor} of samples of {bits} bits")
    planes = samples if one(PLANAR, 1) == 2 else 1
    depth = 1 if planes > 1 else samples
    if tiled:
        across, down = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, counts = tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
    if not across or not down:
        raise TiffError("no tile or strip size")
    cols, rows = -(-width // across), -(-height // down)
    if len(offsets) < cols * rows * planes or len(counts) < len(offsets):
        raise TiffError("missing strips or tiles")
    # what is declared against what is there, before any memory is taken
    row_bytes = -(-across * depth * bits // 8)
    size = width * height * samples * max(1, bits // 8)
    whole = row_bytes * down
    if max(size, whole) > max_bytes:
        raise TiffError(f"{max(size, whole)} bytes are more than {max_bytes}")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    blocks = []
    for k in range(cols * rows * planes):
        high = down if tiled else min(down, height - (k // cols % rows) * down)
        stored = data[offsets[k] : offsets[k] + counts[k]]
        if row_bytes * high > len(stored) * GROWTH[compression]:
            raise TiffError(f"{len(stored)} bytes can't hold a strip or tile of {row_bytes * high}")
        blocks.append((stored, high))
    out = np.empty((height, width, planes, depth), np.uint16 if bits == 16 else np.uint8)
    for k, (stored, high) in enumerate(blocks):
        raw = np.frombuffer(unpacked(stored, compression, row_bytes * high), np.uint8).reshape(high, row_bytes)
        if bits < 8:
            raw = np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], axis=2).reshape(high, -1)
            raw = np.ascontiguousarray(raw[:, : across * depth])
        block = _unpredicted(raw.view(kind).reshape(high, across, depth).astype(out.dtype), predictor)
        plane, y, x = k // (cols * rows), k // cols % rows * down, k % cols * across
        out[y : y + high, x : x + across, plane] = block[: height - y, : width - x]
    return Page(number, width, height, samples, bits, compression, predictor, tiled, out.reshape(height, width, samples).tobytes())


# ---------------------------------------------------------------- writing


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: int = 0) -> bytes:
    """A little-endian TIFF of pages, each an array (height, width) or (height, width, samples) of uint8.

    tile: the side of square tiles, a multiple of 16; 0 for strips.
    """
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        across, down = (tile, tile) if tile else (width, rows_per_strip)
        offsets, counts = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = image[y : y + down, x : x + across]
                if tile and block.shape[:2] != (tile, tile):
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                stored = packed(np.ascontiguousarray(block).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(stored))
                out += stored + b"\0" * (len(stored) % 2)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        where = [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        tags = sorted([*tags, *where, (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])])
        entries = bytearray()
        for tag, kind, values in tags:
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                place = struct.pack("<I", len(out))
                out += body + b"\0" * (len(body) % 2)
                body = place
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---------------------------------------------------------------- operators

PAGE_SCHEMA = "id bigint, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def decode_pages(df: DataFrame, id_col: str, file_col: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row for each page of the TIFF files of a binary column; pages leave one at a time, however many a file has."""
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def rows(batches):
        for batch in batches:
            for i, data in zip(batch.column(0), batch.column(1), strict=True):
                for number, p in walk(data.as_py() or b"", max_bytes):
                    if isinstance(p, TiffError):
                        row = (i.as_py(), number, *[None] * 8, str(p))
                    else:
                        row = (i.as_py(), p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, None)
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, TYPES, strict=True)], names)

    TYPES = [pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(file_col).alias("file")).mapInArrow(rows, PAGE_SCHEMA)


WIDTH_SAMPLES = 64
STORED_SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of 64, and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * ((-len(data)) % WIDTH_SAMPLES or (0 if data else WIDTH_SAMPLES)), len(data)


#: Rows of samples of one page; a longer text has more pages.
PAGE_ROWS = 1024
#: How texts are stored, by turns: compression, predictor, side of tiles or 0 for strips.
FORMS = [(DEFLATE, 2, 0), (LZW, 1, 0), (PACKBITS, 1, 64), (OLD_DEFLATE, 1, 32)]


def stored(text: str | None) -> tuple:
    """A text kept as a TIFF of 64 grey samples a row, read back through pages(). A checksum chooses the form, so that equal texts are
    stored alike."""
    data, n = payload(text)
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH_SAMPLES)
    compression, predictor, tile = FORMS[zlib.crc32(data) % len(FORMS)]
    media = encode([rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)], compression, predictor, rows_per_strip=256, tile=tile)
    got = list(pages(media))
    back = b"".join(p.data for p in got)
    grey = np.frombuffer(back, np.uint8)
    levels = np.bincount(grey, minlength=256)
    share = levels[levels > 0] / len(grey)
    feature = f"{len(got)}x{got[0].width}x{sum(p.height for p in got)};{compression};mean={grey.mean():.4f};levels={len(share)};entropy={-(share * np.log2(share)).sum():.4f}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH_SAMPLES:]), len(media), hashlib.sha256(media).hexdigest(), feature


def store_texts(docs: DataFrame) -> DataFrame:
    """Every text of documents stored as TIFF, read back and described."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in STORED_SCHEMA.split(", ")]

    @F.arrow_udf(f"struct<{STORED_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def store(texts: pa.Array) -> pa.Array:
        rows = [stored(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    ship(docs.sparkSession)
    return docs.select("doc_id", store("text").alias("s")).select("doc_id", "s.*")
