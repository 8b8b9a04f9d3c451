"""Pictures: sharpness, gradient hashes, embedded tags. Arrow-batched, as Spark has no such functions."""

from __future__ import annotations

import struct
import zlib
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_SIDE = 256
THUMBNAIL_SIDE = 180


def laplacian(luma: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian over inner pixels."""
    z = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * luma[1:-1, 1:-1]
    return float((z * z).mean() - z.mean() ** 2)


def nearest(luma: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture at another size, by nearest pixels."""
    rows = np.minimum((np.arange(height) + 0.5) * luma.shape[0] / height, luma.shape[0] - 1).astype(int)
    columns = np.minimum((np.arange(width) + 0.5) * luma.shape[1] / width, luma.shape[1] - 1).astype(int)
    return luma[rows][:, columns]


def sharpness(picture: np.ndarray) -> float:
    """laplacian() of a picture of at most LONGEST_SIDE and at least three pixels a side; others are sampled to that size first."""
    scale = np.float32(min(1.0, LONGEST_SIDE / max(picture.shape)))
    height, width = (max(3, int(np.float32(n) * scale)) for n in picture.shape)
    return laplacian(picture if (height, width) == picture.shape else nearest(picture, height, width))


def laplacian_variance(luma: Column, width: Column) -> Column:
    """Sharpness of pictures as rows of luma values and a width; pictures over LONGEST_SIDE are sampled down first."""

    @F.pandas_udf("double")
    def run(pixels: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for p, w in zip(pixels, widths, strict=True):
            if p is None or not w:
                out.append(None)
                continue
            out.append(sharpness(np.asarray(p, float).reshape(-1, w)))
        return pd.Series(out, dtype="float64")

    return run(luma, width)


def gradient_hash(luma: np.ndarray) -> int:
    """64 bits: of a picture of 8 rows and 9 columns, whether each pixel is brighter than the one before."""
    edges_y, edges_x = np.linspace(0, luma.shape[0], 9).astype(int), np.linspace(0, luma.shape[1], 10).astype(int)
    small = np.array([[luma[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(edges_x[:-1], edges_x[1:], strict=True)] for a, b in zip(edges_y[:-1], edges_y[1:], strict=True)])
    return int(np.packbits((small[:, 1:] > small[:, :-1]).ravel(), bitorder="little").view(np.int64)[0])


def dimensions_of(content: bytes | None) -> tuple[int, int]:
    """(width, height) from a picture's header: PNG, GIF, BMP, JPEG, WebP, TIFF, HEIC, AVIF; (0, 0) for others and for broken ones."""
    try:
        return _dimensions(content or b"")
    except (struct.error, IndexError):
        return 0, 0


def _dimensions(c: bytes) -> tuple[int, int]:
    if c[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack_from(">II", c, 16)
    if c[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack_from("<HH", c, 6)
    if c[:2] == b"BM":
        width, height = struct.unpack_from("<ii", c, 18)
        return width, abs(height)
    if c[:4] == b"RIFF" and c[8:12] == b"WEBP":
        if c[12:16] == b"VP8X":
            return 1 + int.from_bytes(c[24:27], "little"), 1 + int.from_bytes(c[27:30], "little")
        if c[12:16] == b"VP8L":
            bits = int.from_bytes(c[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        width, height = struct.unpack_from("<HH", c, 26)
        return width & 0x3FFF, height & 0x3FFF
    if c[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if c[:2] == b"II" else ">"
        entries, _ = _directory(c, struct.unpack_from(order + "I", c, 4)[0], order)
        return tuple(struct.unpack(order + ("H" if entries[t][0] == 3 else "I"), entries[t][2][: 2 if entries[t][0] == 3 else 4])[0] if t in entries else 0 for t in (0x0100, 0x0101))
    if c[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(c):
            if c[at] != 0xFF:
                return 0, 0
            marker = c[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", c, at + 5)
                return width, height
            at += 1 if marker == 0xFF else 2 + struct.unpack_from(">H", c, at + 2)[0]
    return boxed_facts(c)[0]


def luma_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Brightness of a picture's rows of blue, green and red values, as the image source gives them."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return pixels[:, :, 0] if channels == 1 else np.floor(pixels[:, :, :3] @ np.array([0.0722, 0.7152, 0.2126]))


def picture_features(image: Column) -> Column:
    """(phash, blur_score) of decoded pictures, as the image source gives them; null for null."""

    @F.pandas_udf("phash long, blur_score double")
    def run(images: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data, height, width, channels in zip(images["data"], images["height"], images["width"], images["nChannels"], strict=True):
            if data is None or not height or not width or height < 0:
                rows.append((None, None))
                continue
            luma = luma_of(bytes(data), int(height), int(width), int(channels))
            rows.append((gradient_hash(luma), sharpness(luma)))
        return pd.DataFrame({"phash": pd.array([r[0] for r in rows], dtype="Int64"), "blur_score": [r[1] for r in rows]})

    return run(image)


def header_facts(content: Column) -> Column:
    """(width, height) of pictures by their headers, 0 where unknown."""

    @F.pandas_udf("width int, height int")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dimensions_of(None if c is None else bytes(c)) for c in contents], columns=["width", "height"]).astype("int32")

    return run(content)


def orient(picture: np.ndarray, orientation: int) -> np.ndarray:
    """A picture turned and mirrored as its orientation tag (1 to 8) says."""
    turned = {3: 2, 4: 2, 5: -1, 6: -1, 7: 1, 8: 1}.get(orientation, 0)
    picture = np.rot90(picture, turned)
    return picture[:, ::-1] if orientation in (2, 4, 5, 7) else picture


def png_of(pixels: np.ndarray) -> bytes:
    """A PNG file of rows of red, green and blue bytes."""
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def thumbnail_of(data: bytes, height: int, width: int, channels: int, orientation: int) -> bytes:
    """A picture, turned as its orientation says, at most THUMBNAIL_SIDE a side, as PNG; smaller ones keep their size."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    colours = pixels[:, :, [0, 0, 0]] if channels == 1 else pixels[:, :, 2::-1]
    turned = orient(colours, orientation)
    scale = min(1.0, THUMBNAIL_SIDE / max(turned.shape[:2]))
    return png_of(nearest(turned, *(max(1, round(n * scale)) for n in turned.shape[:2])))


def thumbnail(image: Column, orientation: Column) -> Column:
    """thumbnail_of() decoded pictures, as the image source gives them; null for null."""

    @F.pandas_udf("binary")
    def run(images: pd.DataFrame, turns: pd.Series) -> pd.Series:
        rows = zip(images["data"], images["height"], images["width"], images["nChannels"], turns, strict=True)
        return pd.Series([None if data is None or not height or height < 0 else thumbnail_of(bytes(data), int(height), int(width), int(channels), 1 if pd.isna(turn) else int(turn)) for data, height, width, channels, turn in rows], dtype=object)

    return run(image, orientation)


# Fixed values of EXIF: tags by number.
ORIENTATION, EXIF_IFD, DATE_ORIGINAL, THUMBNAIL_AT, THUMBNAIL_SIZE = 0x0112, 0x8769, 0x9003, 0x0201, 0x0202


def _directory(tiff: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, int, bytes]], int]:
    """Entries by tag (type, count, value field), and where the next directory is."""
    if at <= 0 or at + 2 > len(tiff):
        return {}, 0
    (n,) = struct.unpack_from(order + "H", tiff, at)
    entries = {}
    for i in range(n):
        if at + 14 + 12 * i > len(tiff):
            return entries, 0
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
        entries[tag] = (kind, count, tiff[at + 10 + 12 * i : at + 14 + 12 * i])
    end = at + 2 + 12 * n
    return entries, struct.unpack_from(order + "I", tiff, end)[0] if end + 4 <= len(tiff) else 0


def exif_of(content: bytes | None) -> dict:
    """date_taken (ISO, wall time), orientation and thumbnail of the EXIF of a JPEG, TIFF or HEIC; what is missing or broken is left out."""
    at = 2
    if content and content[:4] in (b"II*\0", b"MM\0*"):
        return tiff_facts(content)
    if not content or content[:2] != b"\xff\xd8":
        return boxed_facts(content)[1]
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
        if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            tiff = content[at + 10 : at + 2 + size]
            break
        if marker == 0xDA:
            return {}
        at += 2 + size
    else:
        return {}
    return tiff_facts(tiff)


def tiff_facts(tiff: bytes) -> dict:
    """date_taken, orientation and thumbnail of a TIFF structure's directories, as they are in EXIF blocks and TIFF files; nothing of broken ones."""
    try:
        return _tiff_facts(tiff)
    except struct.error:
        return {}


def _tiff_facts(tiff: bytes) -> dict:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}
    number = lambda e: struct.unpack(order + ("H" if e[0] == 3 else "I"), e[2][: 2 if e[0] == 3 else 4])[0]
    first, following = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    found: dict = {}
    if ORIENTATION in first:
        found["orientation"] = number(first[ORIENTATION])
    if EXIF_IFD in first:
        inner, _ = _directory(tiff, number(first[EXIF_IFD]), order)
        if DATE_ORIGINAL in inner and inner[DATE_ORIGINAL][1] >= 19:
            place = struct.unpack(order + "I", inner[DATE_ORIGINAL][2])[0]
            text = tiff[place : place + 19].decode("ascii", "replace")
            if len(text) == 19 and text[4] == text[7] == ":" and not text.startswith("0000"):
                found["date_taken"] = f"{text[:4]}-{text[5:7]}-{text[8:10]}T{text[11:]}Z"
    second, _ = _directory(tiff, following, order)
    if THUMBNAIL_AT in second and THUMBNAIL_SIZE in second:
        a, n = number(second[THUMBNAIL_AT]), number(second[THUMBNAIL_SIZE])
        if a + n <= len(tiff):
            found["thumbnail"] = tiff[a : a + n]
    return found


def _boxes(c: bytes, at: int, end: int):
    """(kind, where the body begins, where the box ends) of ISO boxes; a box that says more than there is ends with its parent."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", c, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", c, at + 8)
            body = at + 16
        stop = end if size == 0 else at + size
        if stop < body:
            return
        yield kind, body, min(stop, end)
        at = stop


def _sized(c: bytes, at: int, size: int) -> tuple[int, int]:
    """(a big-endian number of so many bytes, what follows it)."""
    return int.from_bytes(c[at : at + size], "big"), at + size


def _items(c: bytes, at: int) -> dict[int, bytes]:
    """Kinds of items by id, from the body of an `iinf` box."""
    version = c[at]
    count, at = _sized(c, at + 4, 2 if version == 0 else 4)
    found = {}
    for kind, body, _ in islice(_boxes(c, at, len(c)), count):
        if kind == b"infe" and c[body] >= 2:
            own, rest = _sized(c, body + 4, 2 if c[body] == 2 else 4)
            found[own] = c[rest + 2 : rest + 6]
    return found


def _places(c: bytes, at: int) -> dict[int, list[tuple[int, int]]]:
    """(offset, length) of items' parts in the file by id, from the body of an `iloc` box; items kept elsewhere are left out."""
    version = c[at]
    sizes, more = c[at + 4], c[at + 5]
    offset_size, length_size, base_size, index_size = sizes >> 4, sizes & 15, more >> 4, more & 15 if version else 0
    wide = 4 if version == 2 else 2
    count, at = _sized(c, at + 6, wide)
    found: dict[int, list[tuple[int, int]]] = {}
    for _ in range(count):
        own, at = _sized(c, at, wide)
        method = 0
        if version:
            method, at = _sized(c, at, 2)
        base, at = _sized(c, at + 2, base_size)
        parts, at = _sized(c, at, 2)
        for _ in range(parts):
            offset, at = _sized(c, at + index_size, offset_size)
            length, at = _sized(c, at, length_size)
            if method & 15 == 0:
                found.setdefault(own, []).append((base + offset, length))
        if at > len(c):
            break
    return found


def _linked(c: bytes, at: int) -> dict[int, list[int]]:
    """Numbers of items' properties, from 1, by id, from the body of an `ipma` box."""
    version, wide = c[at], c[at + 3] & 1
    count, at = _sized(c, at + 4, 4)
    found = {}
    for _ in range(count):
        own, at = _sized(c, at, 2 if version == 0 else 4)
        n, at = _sized(c, at, 1)
        found[own] = []
        for _ in range(n):
            number, at = _sized(c, at, 2 if wide else 1)
            found[own].append(number & (0x7FFF if wide else 0x7F))
        if at > len(c):
            break
    return found


def boxed_facts(content: bytes | None) -> tuple[tuple[int, int], dict]:
    """((width, height), what tiff_facts() says) of a HEIC or AVIF by its boxes; nothing is decoded.

    The sizes are those of the primary item, turned as it is. Its EXIF block may stand
    anywhere in the file; where content is only the head and ends before it, there is
    none. Other and broken files give (0, 0) and nothing.
    """
    c = content or b""
    size, facts = (0, 0), {}
    if c[4:8] != b"ftyp":
        return size, facts
    try:
        for kind, body, end in _boxes(c, 0, len(c)):
            if kind != b"meta":
                continue
            inner = {k: (b, e) for k, b, e in _boxes(c, body + 4, end)}
            primary = _sized(c, inner[b"pitm"][0] + 4, 2 if c[inner[b"pitm"][0]] == 0 else 4)[0] if b"pitm" in inner else None
            if b"iprp" in inner:
                parts = {k: (b, e) for k, b, e in _boxes(c, *inner[b"iprp"])}
                known = list(_boxes(c, *parts[b"ipco"]))
                numbers = _linked(c, parts[b"ipma"][0]).get(primary, [])
                for own, at, _ in [known[n - 1] for n in numbers if 0 < n <= len(known)]:
                    if own == b"ispe":
                        size = struct.unpack_from(">II", c, at + 4)
                    elif own == b"irot" and c[at] & 1:
                        size = size[::-1]
            if b"iinf" in inner and b"iloc" in inner:
                places = _places(c, inner[b"iloc"][0])
                for own, name in _items(c[: inner[b"iinf"][1]], inner[b"iinf"][0]).items():
                    if name == b"Exif" and places.get(own):
                        block = b"".join(c[a : a + n] for a, n in places[own])
                        facts = tiff_facts(block[4 + int.from_bytes(block[:4], "big") :])
            break
    except (struct.error, IndexError, KeyError):
        pass
    return size, facts


def exif(content: Column) -> Column:
    """exif_of as a struct (date_taken, orientation, thumbnail)."""

    @F.pandas_udf("date_taken string, orientation int, thumbnail binary")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = [exif_of(None if c is None else bytes(c)) for c in contents]
        return pd.DataFrame({"date_taken": [r.get("date_taken") for r in rows], "orientation": pd.array([r.get("orientation") for r in rows], dtype="Int32"), "thumbnail": [r.get("thumbnail") for r in rows]})

    return run(content)
