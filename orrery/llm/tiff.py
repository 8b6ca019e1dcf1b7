"""Media columns: TIFF files in a binary column, one row out for each page.

A reader walks the chain of image directories (either byte order, classic or big), decodes strips or tiles that are
plain, PackBits, LZW or deflate, in either fill order, undoes horizontal and floating-point predictors, and puts the
samples together in rows, interleaved where they came in planes.  Samples of less than a byte, palette indices among them, stay packed; others come
out in little-endian order.  Data that break off, lie past the file's end or decode to less than the directory says make an error and never pixels, and
so does a page of more than ``MOST_BYTES``, of which nothing is decoded.

The test tables hold no media, so ``render`` makes a column of them: the bytes of a page's HTML as a raster,
one directory for each 64 kB, whose compression, layout, byte order, predictor and kind of samples go by the page's id.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import column, pieces, quoted, spread

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_KIND = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
COMPRESSIONS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
WIDTH, PAGE_BYTES, MOST_BYTES = 256, 65_536, 1 << 28
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class Malformed(ValueError):
    pass


# ---------------------------------------------------------------- codecs


def unpack_bits(raw: bytes, need: int = MOST_BYTES) -> bytes:
    """At least ``need`` bytes, if there are as many."""
    out, i, n, got = [], 0, len(raw), 0
    while i < n and got < need:
        c = raw[i]
        if c < 128:
            out.append(raw[i + 1 : i + 2 + c])
            i += 2 + c
        elif c > 128:
            out.append(raw[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
            continue
        got += len(out[-1])
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,}", re.S)


def pack_bits(raw: bytes) -> bytes:
    out, at = [], 0

    def literal(stop: int) -> None:
        out.extend(bytes([min(128, stop - i) - 1]) + raw[i : min(i + 128, stop)] for i in range(at, stop, 128))

    for m in _RUN.finditer(raw):
        literal(m.start())
        for i in range(m.start(), m.end(), 128):
            n = min(128, m.end() - i)
            out.append(bytes([257 - n if n > 1 else 0]) + m[1])
        at = m.end()
    literal(len(raw))
    return b"".join(out)


_SINGLE = [bytes([i]) for i in range(256)]


def unpack_lzw(raw: bytes, need: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, most significant first, the width growing one code early; 256 clears, 257 ends.  At least ``need`` bytes, if there are as many."""
    out: list[bytes] = []
    put = out.append
    table = [*_SINGLE, b"", b""]
    width, bits, held, prev, size, got = 9, 0, 0, None, 258, 0
    for byte in raw:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code < 256 and prev is None:
            prev = _SINGLE[code]
            put(prev)
            got += 1
        elif code == 256:
            table = [*_SINGLE, b"", b""]
            width, prev, size = 9, None, 258
        elif code == 257:
            break
        elif prev is None:
            raise Malformed("LZW: the first code is not a literal")
        else:
            if code < size:
                entry = table[code]
            elif code == size:
                entry = prev + prev[:1]
            else:
                raise Malformed("LZW: code out of range")
            put(entry)
            got += len(entry)
            if got >= need:
                break
            table.append(prev + entry[:1])
            size += 1
            prev = entry
            if size >= 511:
                width = 10 if size < 1023 else 11 if size < 2047 else 12
    return b"".join(out)


def pack_lzw(raw: bytes) -> bytes:
    codes, widths = [256], [9]
    table: dict[int, int] = {}
    size, width, word = 258, 9, -1
    for c in raw:
        if word < 0:
            word = c
            continue
        key = word << 8 | c
        if (longer := table.get(key)) is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(width)
        table[key] = size
        size += 1
        if size >= 512:
            width = 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            codes.append(256)
            widths.append(12)
            table, size, width = {}, 258, 9
        word = c
    if word >= 0:
        codes.append(word)
        widths.append(width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    code, wide = np.array([*codes, 257], np.uint32), np.array([*widths, width])
    ends = np.cumsum(wide)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for b in range(12):
        has = wide > b
        bits[ends[has] - 1 - b] = code[has] >> b & 1
    return np.packbits(bits).tobytes()


def _decompress(raw: bytes, how: int, need: int) -> bytes:
    """The ``need`` bytes of a strip or tile; fewer are an error."""
    if how == 1:
        out = raw
    elif how == 5:
        out = unpack_lzw(raw, need)
    elif how == 32773:
        out = unpack_bits(raw, need)
    elif how in (8, 32946):
        out = zlib.decompressobj().decompress(raw, need)
    else:
        raise Malformed(f"compression {how}")
    if len(out) < need:
        raise Malformed(f"a strip or tile has {len(out)} bytes of {need}")
    return out[:need]


def _undo(raw: bytes, rows: int, cols: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Rows of samples as little-endian bytes, or packed as they are."""
    if bits % 8:
        if predictor != 1:
            raise Malformed(f"a predictor of {bits} bits")
        return np.frombuffer(raw, np.uint8).reshape(rows, -1)
    width = bits // 8
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, cols * width, samples), 1, dtype=np.uint8).reshape(rows, width, cols * samples)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).reshape(rows, -1)
    x = np.frombuffer(raw, f"{order}u{width}").reshape(rows, cols, samples)
    if predictor == 2:
        x = np.cumsum(x, 1, dtype=f"u{width}")
    return np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(rows, -1)


# ---------------------------------------------------------------- reader


def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise Malformed("no TIFF header")
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    if magic not in (42, 43):
        raise Malformed("no TIFF header")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    seen = set()
    while at:
        if at in seen:
            raise Malformed("directories form a circle")
        seen.add(at)
        count = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
        at += 8 if big else 2
        tags: dict[int, list] = {}
        for _ in range(count):
            tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, at)
            size = _SIZE.get(kind, 1) * n
            inline = 8 if big else 4
            place = at + (12 if big else 8)
            if size > inline:
                place = struct.unpack_from(order + ("Q" if big else "I"), raw, place)[0]
            if kind in _KIND:
                tags[tag] = list(struct.unpack_from(f"{order}{n}{_KIND[kind]}", raw, place))
            at += 20 if big else 12
        yield order, tags
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, at)[0]


def _page(raw: bytes, order: str, tags: dict[int, list], most: int) -> dict:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height = one(256, 0), one(257, 0)
    bits, how, samples, predictor, fill = one(258, 1), one(259, 1), one(277, 1), one(317, 1), one(266, 1)
    if not width or not height or not samples or predictor not in (1, 2, 3) or fill not in (1, 2) or len(set(tags.get(258, [1]))) > 1:
        raise Malformed("directory without a size, or of a kind that isn't read")
    if bits not in (1, 2, 4, 8, 12, 16, 32, 64):
        raise Malformed(f"{bits} bits a sample")
    split = one(284, 1) == 2
    planes, per = (samples, 1) if split else (1, samples)
    line = -(-width * per * bits // 8)
    if line * planes * height > most:
        raise Malformed(f"a page of {line * planes * height} bytes; {most} are read at most")
    tiled = 322 in tags
    cols, rows = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    if not cols or not rows or tiled and cols * per * bits % 8:
        raise Malformed("strip or tile without a size, or of parts of bytes")
    places, sizes = (tags.get(324, []), tags.get(325, [])) if tiled else (tags.get(273, []), tags.get(279, []))
    across, down = -(-width // cols), -(-height // rows)
    n, wide = across * down * planes, -(-cols * per * bits // 8)
    if wide * across * rows * down * planes > 4 * most:
        raise Malformed("tiles far larger than the page")
    if len(places) < n or len(sizes) < n:
        raise Malformed("strips or tiles are missing")
    image = np.zeros((planes, down * rows, across * wide), np.uint8)
    for k, (p, s) in enumerate(zip(places[:n], sizes)):
        if p + s > len(raw):
            raise Malformed("strip or tile beyond the end")
        plane, r = divmod(k, across * down)
        y, x = divmod(r, across)
        here = rows if tiled else min(rows, height - y * rows)
        data = raw[p : p + s] if fill == 1 else raw[p : p + s].translate(_REVERSED)
        image[plane, y * rows : y * rows + here, x * wide : (x + 1) * wide] = _undo(_decompress(data, how, here * wide), here, cols, per, bits, predictor, order)
    image = image[:, :height, :line]
    if split and bits % 8:
        each = np.unpackbits(image, axis=2)[:, :, : width * bits].reshape(planes, height, width, bits)
        image = np.packbits(each.transpose(1, 2, 0, 3).reshape(height, -1), axis=1)
    elif split:
        image = image.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": COMPRESSIONS[how], "predictor": predictor, "tiled": tiled, "pixels": np.ascontiguousarray(image).tobytes(), "error": None}


_EMPTY = dict.fromkeys(("width", "height", "bits", "samples", "compression", "predictor", "tiled", "pixels"))


def read(raw: bytes, most: int = MOST_BYTES) -> list[dict]:
    """The pages of a file.  One that can't be read has an ``error``, and so has a file whose directories break off."""
    out: list[dict] = []
    try:
        for order, tags in _directories(raw):
            try:
                out.append(_page(raw, order, tags, most))
            except (Malformed, struct.error, zlib.error, ValueError, IndexError, KeyError, TypeError, MemoryError) as e:
                out.append(_EMPTY | {"error": str(e) or type(e).__name__})
    except (Malformed, struct.error, ValueError) as e:
        out.append(_EMPTY | {"error": str(e)})
    return out


_KINDS = [("page_no", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32()), ("samples", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("n_bytes", pa.int64()), ("pixel_sum", pa.int64()), ("crc32", pa.int64()), ("pixels", pa.binary()), ("error", pa.string())]
_FIELDS = "page_no int, width long, height long, bits int, samples int, compression string, predictor int, tiled boolean, n_bytes long, pixel_sum long, crc32 long, pixels binary, error string"


def _expand(with_pixels: bool, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            for k, raw in enumerate(batch.column(1)):
                rows = []
                for no, page in enumerate(read(raw.as_py(), most) if raw.is_valid else []):
                    data = page["pixels"]
                    more = {"page_no": no, "n_bytes": None, "pixel_sum": None, "crc32": None}
                    if data is not None:
                        more |= {"n_bytes": len(data), "pixel_sum": int(np.frombuffer(data, np.uint8).sum(dtype=np.int64)), "crc32": zlib.crc32(data)}
                    rows.append(page | more | ({} if with_pixels else {"pixels": None}))
                if rows:
                    keys = batch.column(0).take(pa.array([k] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[n] for r in rows], t) for n, t in _KINDS)], names=["key", *(n for n, _ in _KINDS)])

    return run


def pages(files: DataFrame, key: str, media: str, with_pixels: bool = True, most: int = MOST_BYTES) -> DataFrame:
    """One row for each page: ``key``, ``page_no`` from 0, what the directory says, size, sum and CRC-32 of the decoded bytes, and the bytes.

    A null file has no pages; an empty or foreign one gives one row with an ``error``; pages before a break
    are kept; a page that can't be read whole, or has more than ``most`` bytes, has an error and no bytes.  Repeated rows give theirs each, null keys
    stay null, an empty table gives no rows, and other columns are not read.  ``key`` may not have the name of a result.
    """
    if key.lower() in {n for n, _ in _KINDS}:
        raise ValueError(f"{key} is the name of a result")
    plain = files.select(quoted(key).alias("key"), quoted(media).alias("media"))
    kind = T.StructType([plain.schema["key"], *T.StructType.fromDDL(_FIELDS)])
    out = spread(plain).mapInArrow(_expand(with_pixels, most), kind).withColumnRenamed("key", key)
    return out if with_pixels else out.drop("pixels")


# ---------------------------------------------------------------- writer of test media


def write(images: list[np.ndarray], how: int, predictor: int = 1, tiled: bool = False, order: str = "<", big: bool = False, planar: bool = False, fill: int = 1) -> bytes:
    """A file of pages: arrays of rows and columns, or of rows, columns and samples, of unsigned integers or, for single bits, of booleans."""
    at_kind, count = ("Q", "Q") if big else ("I", "H")
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0)))
    link = len(out) - (8 if big else 4)
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        bits = 1 if image.dtype == bool else 8 * image.dtype.itemsize
        pixel = max(bits // 8, 1) * (1 if planar else samples)
        rows, cols = (16, max(16, 64 // pixel // 16 * 16)) if tiled else (max(1, min(height, 8192 // width // pixel)), width)
        places, sizes = [], []
        for plane in np.split(image, samples, 2) if planar else [image]:
            for y in range(0, height, rows):
                for x in range(0, width, cols):
                    part = plane[y : y + rows, x : x + cols]
                    if tiled:
                        part = np.pad(part, ((0, rows - part.shape[0]), (0, cols - part.shape[1]), (0, 0)))
                    n, per = len(part), part.shape[2]
                    if bits == 1:
                        raw = np.packbits(part.reshape(n, -1), axis=1).tobytes()
                    elif predictor == 3:  # bytes of one weight together, greatest first, then differences
                        split = part.astype(f">u{bits // 8}").reshape(n, -1).view(np.uint8).reshape(n, -1, bits // 8).transpose(0, 2, 1).reshape(n, -1, per)
                        raw = np.diff(split, axis=1, prepend=np.zeros((n, 1, per), np.uint8)).tobytes()
                    else:
                        part = np.diff(part, axis=1, prepend=np.zeros((n, 1, per), part.dtype)) if predictor == 2 else part
                        raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                    data = {1: bytes, 5: pack_lzw, 8: lambda r: zlib.compress(r, 1), 32773: pack_bits}[how](raw)
                    places.append(len(out))
                    sizes.append(len(data))
                    out += data if fill == 1 else data.translate(_REVERSED)
        entries = {256: [width], 257: [height], 258: [bits] * samples, 259: [how], 262: [2 if samples == 3 else 1], 266: [fill], 277: [samples], 284: [2 if planar else 1], 317: [predictor]}
        entries |= {322: [cols], 323: [rows], 324: places, 325: sizes} if tiled else {273: places, 278: [rows], 279: sizes}
        packed = []
        for tag, values in sorted(entries.items()):
            kind = 3 if tag in (258, 259, 262, 266, 277, 284, 317) else 16 if big else 4
            body = struct.pack(f"{order}{len(values)}{_KIND[kind]}", *values)
            room = 8 if big else 4
            if len(body) > room:
                out += b"\0" * (len(out) % 2)
                spot = len(out)
                out += body
                body = struct.pack(order + at_kind, spot)
            packed.append(struct.pack(order + "HH" + at_kind, tag, kind, len(values)) + body.ljust(room, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + at_kind, out, link, len(out))
        out += struct.pack(order + count, len(packed)) + b"".join(packed)
        link = len(out)
        out += struct.pack(order + at_kind, 0)
    return bytes(out)


#: Kinds of samples that ``render`` takes turns with: type, samples in a pixel, in planes or not.
SAMPLES = [("u1", 1, False), ("u2", 1, False), ("u1", 3, False), ("u1", 3, True), ("u4", 1, False), ("?", 1, False)]


def width_of(kind: str, samples: int) -> int:
    """Pixels in a row: as many, in sixteens, as ``WIDTH`` bytes hold, but ``WIDTH`` single bits."""
    return WIDTH if kind == "?" else WIDTH // (samples * int(kind[1])) // 16 * 16


def raster(raw: bytes, kind: str = "u1", samples: int = 1) -> list[np.ndarray]:
    """Bytes, or their bits, in rows of ``width_of`` pixels, zero-padded, ``PAGE_BYTES`` to a page; no bytes are one row of zeros."""
    out = []
    for i in range(0, max(1, len(raw)), PAGE_BYTES):
        part = raw[i : i + PAGE_BYTES]
        wide = width_of(kind, samples)
        line = wide // 8 if kind == "?" else wide * samples * int(kind[1])
        rows = max(1, -(-len(part) // line))
        x = np.frombuffer(part.ljust(rows * line, b"\0"), np.uint8)
        out.append(np.unpackbits(x).astype(bool).reshape(rows, wide, 1) if kind == "?" else x.view(f"<{kind}").astype(kind).reshape(rows, wide, samples))
    return out


def form(i: int) -> dict:
    """How the page of an id is written."""
    kind, samples, planar = SAMPLES[i // 32 % len(SAMPLES)]
    how = (1, 5, 8, 32773)[i % 4]
    predictor = (3 if kind == "u4" else 2) if how in (5, 8) and i // 4 % 2 and kind != "?" else 1
    return {"kind": kind, "samples": samples, "how": how, "predictor": predictor, "tiled": bool(i // 8 % 2), "order": "<>"[i // 16 % 2], "big": bool(i // 64 % 2), "planar": planar, "fill": 2 if kind == "?" and i % 3 == 0 else 1}


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 64):
        out = []
        for id_, html in zip(column(batch, "page_id"), column(batch, "html")):
            f = form(id_ or 0)
            out.append(None if html is None else write(raster(html.encode(), f.pop("kind"), f.pop("samples")), **f))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), pa.array(out, pa.binary())], names=["page_id", "media"])


def render(pages_: DataFrame) -> DataFrame:
    """``(page_id, media)``: a TIFF of each page's HTML, null for null."""
    return spread(pages_.select("page_id", "html")).mapInArrow(_render, T.StructType([pages_.schema["page_id"], T.StructField("media", T.BinaryType())]))


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = render(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages(files, "page_id", "media", with_pixels=False)

