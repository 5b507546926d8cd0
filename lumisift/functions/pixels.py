"""Pixel kernels in numpy, hosted by Arrow-batched UDFs. Images are BGR; a
kernel takes one picture or a stack of pictures of equal size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(n: int, m: int) -> np.ndarray:
    edges = np.linspace(0, n, m + 1)
    left = np.maximum(edges[:-1, None], np.arange(n)[None])
    right = np.minimum(edges[1:, None], np.arange(1, n + 1)[None])
    return np.clip(right - left, 0, None) * (m / n)


def area_resize(img: np.ndarray, height: int, width: int, channels: bool | None = None) -> np.ndarray:
    """Area-weighted mean resampling, as a product with two band matrices.
    ``channels`` says whether the last axis is one; by default three axes have
    it."""
    channels = img.ndim == 3 if channels is None else channels
    x = img.astype(np.float64) if channels else img[..., None].astype(np.float64)
    h, w, c = x.shape[-3:]
    out = (_bands(h, height) @ x.reshape(*x.shape[:-3], h, w * c)).reshape(*x.shape[:-3], height, w, c)
    out = _bands(w, width) @ out
    return out if channels else out[..., 0]


def fit_side(img: np.ndarray, side: int) -> np.ndarray:
    """Shrunk so that the longer side is ``side``; never enlarged."""
    h, w = img.shape[-3:-1] if img.ndim > 2 else img.shape
    if max(h, w) <= side:
        return img
    k = side / max(h, w)
    return np.clip(np.rint(area_resize(img, max(1, int(h * k)), max(1, int(w * k)), img.ndim > 2)), 0, 255).astype(np.uint8)


def gray(img: np.ndarray) -> np.ndarray:
    b, g, r = (img[..., i].astype(np.float64) for i in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def laplacian_variance(g: np.ndarray):
    """Population variance of the 4-neighbour Laplacian, mirrored borders."""
    edge = [(0, 0)] * (g.ndim - 2) + [(1, 1), (1, 1)]
    p = np.pad(g.astype(np.float64), edge, mode="reflect" if min(g.shape[-2:]) > 1 else "edge")
    inner = p[..., 1:-1, 1:-1]
    return (p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * inner).var(axis=(-2, -1))


def clip_percentages(g: np.ndarray) -> tuple:
    return 100 * (g < 5).mean(axis=(-2, -1)), 100 * (g >= 251).mean(axis=(-2, -1))


def _flat(x: np.ndarray, axes: int) -> np.ndarray:
    return x.reshape(*x.shape[: x.ndim - axes], -1)


def image_vector(img: np.ndarray) -> np.ndarray:
    v = _flat(np.rint(area_resize(gray(img), 32, 32, False)), 2).astype(np.float32)
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=v, where=n > 0)


def color_thumb(img: np.ndarray) -> np.ndarray:
    return _flat(np.rint(area_resize(img, 32, 32, True)) / 255, 3).astype(np.float32)


_DCT = np.array([[math.sqrt((1 if u == 0 else 2) / 32) * math.cos((2 * x + 1) * u * math.pi / 64) for x in range(32)] for u in range(32)])


def perceptual_hash(img: np.ndarray) -> np.ndarray:
    """64 bits of the lowest frequencies against the median of rows 1 to 7."""
    x = np.rint(area_resize(gray(img), 32, 32, False))
    low = _DCT[:8] @ x @ _DCT[:8].T
    middle = np.median(_flat(low[..., 1:, :], 2), axis=-1)
    return _flat(low > middle[..., None, None], 2).astype(np.int8)


def _blur(img: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(img, [(r, r) if a == axis else (0, 0) for a in range(img.ndim)], mode="edge")
        img = sum(w * np.take(p, np.arange(i, i + img.shape[axis]), axis=axis) for i, w in enumerate(k))
    return img


def pad_geometry(h: int, w: int, sides: list[str], percent: int) -> tuple[int, int, int, int]:
    """Padding ``(left, right, top, bottom)`` of the listed sides."""
    if not sides or percent <= 0:
        return 0, 0, 0, 0
    x, y = max(1, int(w * percent / 100)), max(1, int(h * percent / 100))
    return x * ("left" in sides), x * ("right" in sides), y * ("top" in sides), y * ("bottom" in sides)


def pad_blur_fade(img: np.ndarray, sides: list[str], percent: int) -> np.ndarray:
    """Padded with the mean colour, fading softly into the picture."""
    left, right, top, bottom = pad_geometry(*img.shape[:2], sides, percent)
    if not (left or right or top or bottom):
        return img
    h, w = img.shape[:2]
    x, y = max(1, int(w * percent / 100)), max(1, int(h * percent / 100))
    canvas = np.empty((h + top + bottom, w + left + right, 3))
    canvas[:] = img.reshape(-1, 3).mean(axis=0).astype(int)
    canvas[top:top + h, left:left + w] = img
    mask = np.zeros(canvas.shape[:2])
    mask[top:top + h, left:left + w] = 1
    mask = _blur(mask, min(x, y) * 0.8)[..., None]
    return np.clip(np.rint(canvas * mask + _blur(canvas, float(max(x, y))) * (1 - mask)), 0, 255).astype(np.uint8)


def pad_all_sides(img: np.ndarray, percent: int) -> np.ndarray:
    return pad_blur_fade(img, ["left", "right", "top", "bottom"], percent)


def exif_oriented(img: np.ndarray, orientation: int) -> np.ndarray:
    """Turned upright by its EXIF orientation (1 to 8)."""
    turns = {2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: np.swapaxes(a, 0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.swapaxes(a[::-1, ::-1], 0, 1), 8: lambda a: np.rot90(a)}
    return np.ascontiguousarray(turns.get(orientation, lambda a: a)(img))


#: Measures and their types.
METRICS = {"laplacian_var": "double", "black_clip_pct": "double", "white_clip_pct": "double", "img_vector": "array<float>", "color_thumb": "array<float>", "phash": "array<tinyint>"}
#: Numbers that a row of each measure holds.
NUMBERS = {"laplacian_var": 1, "black_clip_pct": 1, "white_clip_pct": 1, "img_vector": 1024, "color_thumb": 3072, "phash": 64}
#: Bytes of pictures that are looked at together; floats made of them take several times as many.
STACK = 4 << 20


def stacks(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series, decode: Callable[[pd.Series], pd.Series] | None = None) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of rows whose pictures have equal size, and the stack of those;
    rows without a picture are left out. ``decode`` makes the pixels of what
    ``data`` holds (null: none), a stack at a time."""
    sizes: dict[tuple, list[int]] = {}
    for i, (h, w, c, d) in enumerate(zip(height, width, channels, data)):
        if d is not None and h is not None and h > 0:
            sizes.setdefault((int(h), int(w), int(c)), []).append(i)
    for (h, w, c), members in sizes.items():
        step = max(1, STACK // (h * w * c))
        for at in range(0, len(members), step):
            some = data.iloc[members[at:at + step]]
            found = [(i, d) for i, d in zip(members[at:at + step], some if decode is None else decode(some)) if d is not None]
            if found:
                yield [i for i, _ in found], np.frombuffer(b"".join(d for _, d in found), np.uint8).reshape(len(found), h, w, c)


def _measures(stack: np.ndarray, names: tuple) -> dict:
    """The named measures of pictures of equal size."""
    out = {}
    if not {"laplacian_var", "black_clip_pct", "white_clip_pct"}.isdisjoint(names):
        g = gray(stack if max(stack.shape[1:3]) <= 1500 else np.stack([fit_side(x, 1500) for x in stack]))
        out["black_clip_pct"], out["white_clip_pct"] = clip_percentages(g)
        if "laplacian_var" in names:
            out["laplacian_var"] = laplacian_variance(g)
    for name, kernel in (("img_vector", image_vector), ("color_thumb", color_thumb), ("phash", perceptual_hash)):
        if name in names:
            out[name] = kernel(stack)
    return {k: out[k] for k in names}


def measured(batches: Iterator[tuple], names: tuple, decode: Callable[[pd.Series], pd.Series] | None = None) -> Iterator[pd.DataFrame]:
    """The named measures of ``(height, width, channels, data)``, in the order of
    the rows. What is given out at once holds ``STACK`` bytes of numbers at most,
    or one row, however many rows a batch has."""
    step = max(1, STACK // max(1, 4 * sum(NUMBERS[n] for n in names)))
    for batch in batches:
        for first in range(0, len(batch[0]), step):
            height, width, channels, data = (x.iloc[first:first + step] for x in batch)
            rows: dict[str, list] = {n: [None] * len(data) for n in names}
            for places, stack in stacks(height, width, channels, data, decode):
                stack = np.repeat(stack, 3, axis=3) if stack.shape[3] == 1 else stack[..., :3]
                for name, values in _measures(stack, names).items():
                    for i, v in zip(places, values):
                        rows[name][i] = v
            yield pd.DataFrame(rows, columns=list(names))


def measure(image: Column, names=tuple(METRICS), decode: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """A struct of the named measures of a decoded image struct (Spark's image
    source), in one pass; nulls if it could not be decoded. Pictures of equal
    size that lie near each other are measured as one stack. With ``decode``
    pixels are made of what ``image`` holds in the same worker."""
    names = tuple(names)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return measured(batches, names, decode)

    schema = ", ".join(f"{n} {METRICS[n]}" for n in names)
    return F.pandas_udf(run, schema)(image["height"], image["width"], image["nChannels"], image["data"])


def shrunk(image: Column, side: int, decode: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """A decoded image struct whose longer side is ``side`` at most. With
    ``decode`` pixels are made of what ``image`` holds in the same worker, and
    data is null where it makes none."""
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = list(zip(height, width, channels, data if decode is None else [None] * len(data)))
        for places, stack in stacks(height, width, channels, data, decode):
            small = fit_side(stack, side)
            for i, img in zip(places, small):
                rows[i] = (*img.shape, img.tobytes())
        return pd.DataFrame(rows, columns=["height", "width", "nChannels", "data"])

    return F.pandas_udf(run, "height int, width int, nChannels int, data binary")(image["height"], image["width"], image["nChannels"], image["data"])


def padding(height: Column, width: Column, sides: Column, percent: int) -> Column:
    """``struct<left, right, top, bottom>``: how much is padded on listed sides."""
    names = ["left", "right", "top", "bottom"]

    def run(h: pd.Series, w: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pad_geometry(int(a), int(b), [] if c is None else list(c), percent) for a, b, c in zip(h, w, s)], columns=names)

    return F.pandas_udf(run, ", ".join(f"{n} int" for n in names))(height, width, sides)
