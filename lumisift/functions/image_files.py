"""Image files: sizes and orientations from their headers, decoding, and
encoding for a model within a limit of bytes.

Sizes need no decoder and cover HEIC. Pixels come from Pillow where it is
installed (with ``pillow_heif`` for HEIC), else from a reader of plain PNG;
what neither reads is None, as a file that cannot be decoded.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import area_resize, exif_oriented, pad_blur_fade

try:
    from PIL import Image, ImageOps
except ImportError:
    Image = ImageOps = None
try:
    import pillow_heif

    pillow_heif.register_heif_opener()
except ImportError:
    pillow_heif = None

PNG = b"\x89PNG\r\n\x1a\n"


def _boxes(data: bytes, start: int, end: int):
    """``(kind, first, last)`` of the boxes of an ISO media file."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        last = min(end, start + size) if size else end
        if last < start + head:
            return
        yield kind, start + head, last
        start = last


def _heic_size(data: bytes) -> tuple[int, int] | None:
    """The largest of the sizes that the item properties state (thumbnails and
    tiles have sizes too), turned if a quarter turn is stated."""
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        for inner, c, d in _boxes(data, a + 4, b):
            if inner != b"iprp":
                continue
            for store, e, f in _boxes(data, c, d):
                if store == b"ipco":
                    found = [(k, x) for k, x, _ in _boxes(data, e, f)]
                    sizes = [struct.unpack_from(">II", data, x + 4) for k, x in found if k == b"ispe" and x + 12 <= f]
                    if sizes:
                        w, h = max(sizes, key=lambda s: s[0] * s[1])
                        return (h, w) if any(k == b"irot" and data[x] & 1 for k, x in found) else (w, h)
    return None


def _jpeg_segments(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield kind, at + 4, min(len(data), at + 2 + size)
        if kind == 0xDA or size < 2:
            return
        at += 2 + size


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """``(width, height)`` as the header states them, or None."""
    try:
        if not data:
            return None
        if data[:8] == PNG:
            return struct.unpack_from(">II", data, 16)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", data, 6)
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            for kind, a, _ in _jpeg_segments(data):
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", data, a + 1)
                    return w, h
            return None
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack_from("<HH", data, 26)
            return w & 0x3FFF, h & 0x3FFF
        if data[4:8] == b"ftyp":
            return _heic_size(data)
    except (struct.error, IndexError):
        pass
    return None


def exif_orientation(data: bytes | None) -> int:
    """The orientation (1 to 8) of a JPEG's EXIF block; 1 without one."""
    if not data or data[:2] != b"\xff\xd8":
        return 1
    for kind, a, b in _jpeg_segments(data):
        if kind != 0xE1 or data[a:a + 6] != b"Exif\0\0":
            continue
        block = data[a + 6:b]
        order = {b"II": "<", b"MM": ">"}.get(block[:2])
        try:
            at = struct.unpack_from(order + "I", block, 4)[0]
            for i in range(struct.unpack_from(order + "H", block, at)[0]):
                tag, form, _, value = struct.unpack_from(order + "HHIH", block, at + 2 + 12 * i)
                if tag == 0x0112 and form == 3:
                    return value if 1 <= value <= 8 else 1
        except (struct.error, TypeError):
            pass
        return 1
    return 1


def _png_pixels(data: bytes) -> np.ndarray | None:
    """BGR pixels of a PNG of 8 bits a channel that is not interlaced."""
    at, packed, palette, head = 8, [], None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8:at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6]:
        return None
    w, h, kind = head[0], head[1], head[3]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int32)
    for y in range(h):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int32)
        if how == 1:  # each channel is a running sum
            line = (np.cumsum(line.reshape(w, n), axis=0) & 255).reshape(-1)
        elif how in (3, 4):  # these depend on the pixel to the left in other ways
            for x in range(w * n):
                left = line[x - n] if x >= n else 0
                up, corner = above[x], above[x - n] if x >= n else 0
                if how == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                line[x] = (line[x] + guess) & 255
        elif how == 2:
            line = (line + above) & 255
        out[y] = above = line
    img = out.reshape(h, w, n)
    rgb = palette[img[..., 0]] if kind == 3 else img[..., :3] if n >= 3 else np.repeat(img[..., :1], 3, axis=2)
    return np.ascontiguousarray(rgb[..., ::-1])


def decode(data: bytes | None) -> np.ndarray | None:
    """Upright BGR pixels of a file, or None."""
    try:
        if not data:
            return None
        if Image is not None:
            with Image.open(io.BytesIO(data)) as image:
                return np.ascontiguousarray(np.asarray(ImageOps.exif_transpose(image).convert("RGB"))[..., ::-1])
        return _png_pixels(data) if data[:8] == PNG else None
    except Exception:  # a decoder fails in its own ways on a broken file
        return None


def encode_png(img: np.ndarray) -> bytes:
    """A BGR picture as PNG."""
    h, w = img.shape[:2]
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = img[..., ::-1].reshape(h, 3 * w)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def review_copy(img: np.ndarray, max_side: int = 1600, quality: int = 84, max_bytes: int = 900_000) -> tuple[str, bytes, int, int, int]:
    """``(mime, data, width, height, quality)`` of a copy for a model: the first
    rung of the ladder of sides and qualities within ``max_bytes``, else the
    last. Without Pillow it is a PNG, for which only the side counts."""
    sides, side = [], max_side
    while side >= 768:
        sides.append(side)
        side = int(side * 0.85)
    if min(img.shape[:2]) < 768:
        sides.append(max(img.shape[:2]))
    qualities = list(range(quality, 59, -6)) if Image is not None else [100]
    out = None
    for side in sides:
        h, w = img.shape[:2]
        k = min(1.0, side / max(h, w))
        size = max(1, round(w * k)), max(1, round(h * k))
        if Image is not None:
            small = Image.fromarray(img[..., ::-1]).resize(size, Image.Resampling.LANCZOS)
        else:
            small = img if k == 1 else np.clip(np.rint(area_resize(img, size[1], size[0], True)), 0, 255).astype(np.uint8)
        for q in qualities:
            if Image is not None:
                buffer = io.BytesIO()
                small.save(buffer, format="JPEG", quality=q, optimize=True)
                out = "image/jpeg", buffer.getvalue(), *size, q
            else:
                out = "image/png", encode_png(small), *size, q
            if len(out[1]) <= max_bytes:
                return out
    return out


def dimensions(content: Column) -> Column:
    """``struct<width, height>`` of files' bytes, by their headers alone."""
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(x) or (None, None) for x in data], columns=["width", "height"]).astype("Int64")

    return F.pandas_udf(run, "width long, height long")(content)


def for_review(content: Column, max_side: int = 1600, quality: int = 84, max_bytes: int = 900_000, pad_sides: Column | None = None, pad_percent: int = 0) -> Column:
    """``struct<mime, data, width, height, quality>`` of files' bytes; null
    fields if a file cannot be decoded. Listed sides (``pad_sides``, an array)
    are padded by ``pad_percent`` before the copy is shrunk and encoded."""
    names = ["mime", "data", "width", "height", "quality"]

    def copied(data: bytes | None, sides) -> tuple:
        img = decode(data)
        if img is None:
            return (None,) * 5
        return review_copy(pad_blur_fade(img, [] if sides is None else list(sides), pad_percent), max_side, quality, max_bytes)

    def run(data: pd.Series, sides: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame(list(map(copied, data, sides)), columns=names)
        return rows.astype({"width": "Int64", "height": "Int64", "quality": "Int64"})

    sides = F.array().cast("array<string>") if pad_sides is None else pad_sides
    return F.pandas_udf(run, "mime string, data binary, width long, height long, quality long")(content, sides)


def orientation(content: Column) -> Column:
    """The EXIF orientation (1 to 8) of files' first bytes."""
    return F.pandas_udf(lambda data: data.map(exif_orientation).astype("int32"), "int")(content)


def upright(image: Column, turn: Column) -> Column:
    """A decoded image struct turned by its orientation; others are as they
    were. Height and width change places at a quarter turn."""
    names = ["origin", "height", "width", "nChannels", "mode", "data"]

    def run(origin: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, mode: pd.Series, data: pd.Series, turn: pd.Series) -> pd.DataFrame:
        rows = []
        for o, h, w, c, m, d, t in zip(origin, height, width, channels, mode, data, turn):
            if d is not None and h is not None and h > 0 and t is not None and t > 1:
                img = exif_oriented(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c)), int(t))
                h, w, d = img.shape[0], img.shape[1], img.tobytes()
            rows.append((o, h, w, c, m, d))
        return pd.DataFrame(rows, columns=names).astype({k: "Int32" for k in names[1:5]})

    return F.pandas_udf(run, "origin string, height int, width int, nChannels int, mode int, data binary")(*[image[n] for n in names], turn)
