"""Images as pixel relations, one row for each (image, y, x, c) with a value, and as arrays in Arrow batches.

The relational forms are exact and need no Python; interpolating and random transforms run on arrays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per-channel statistics of the evaluation transform, in RGB order: fixed values.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Training augmentation: area of a crop, chances of the two flips, strength of brightness, contrast,
#: saturation and hue, degrees of rotation: fixed values.
CROP_SCALE, FLIP_X, FLIP_Y, JITTER, DEGREES = (0.8, 1.0), 0.5, 0.1, (0.3, 0.3, 0.3, 0.1), 15


def pixels(tiles: DataFrame, size: int, image: str = "image", values: str = "values") -> DataFrame:
    """Flat one-channel tiles of ``size`` x ``size`` as rows (image, y, x, v)."""
    rows = tiles.select(F.col(image).alias("image"), F.posexplode(values).alias("pos", "v"))
    return rows.select("image", F.floor(F.col("pos") / size).cast("int").alias("y"), (F.col("pos") % size).cast("int").alias("x"), "v")


def scale_normalize(v: Column, mean: float, std: float, top: float = 255.0) -> Column:
    return (v / F.lit(top) - F.lit(mean)) / F.lit(std)


def hflip(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("x", F.lit(width - 1) - F.col("x"))


def vflip(rows: DataFrame, height: int) -> DataFrame:
    return rows.withColumn("y", F.lit(height - 1) - F.col("y"))


def mask_apply(v: Column, mask: Column) -> Column:
    """The pixel where the mask is false, else 0."""
    return F.when(~mask, v).otherwise(F.lit(0.0))


def bounding_box(rows: DataFrame, mask: Column) -> DataFrame:
    """Half-open box of each image's true pixels; an image without one vanishes."""
    return rows.filter(mask).groupBy("image").agg(
        F.min("y").alias("ymin"), F.min("x").alias("xmin"), (F.max("y") + 1).alias("ymax"), (F.max("x") + 1).alias("xmax")
    )


def crop(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside their image's box, counted from its corner."""
    inside = rows.join(boxes, "image").filter("y >= ymin and y < ymax and x >= xmin and x < xmax")
    return inside.select("image", (F.col("y") - F.col("ymin")).alias("y"), (F.col("x") - F.col("xmin")).alias("x"), "v")


def replace_background(rows: DataFrame, mask: Column, backgrounds: DataFrame) -> DataFrame:
    """Pixels of the image where the mask is false, those of its background (image, y, x, bg) elsewhere."""
    both = rows.join(backgrounds, ["image", "y", "x"])
    return both.select("image", "y", "x", F.when(~mask, F.col("v")).otherwise(F.col("bg")).alias("v"))


def resize_nearest(rows: DataFrame, size: int, new: int) -> DataFrame:
    """Each new pixel takes the old one at floor(place * size / new)."""
    grid = F.sequence(F.lit(0), F.lit(new - 1))
    source = lambda c: F.filter(grid, lambda k: F.floor(k * size / F.lit(new)) == F.col(c))
    return rows.withColumn("y", F.explode(source("y"))).withColumn("x", F.explode(source("x")))


def gray_to_rgb(rows: DataFrame) -> DataFrame:
    return rows.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


# -- arrays: float64 [height, width, 3], RGB, 0 to 255 --------------------------------------------------


def _taps(old: int, new: int) -> np.ndarray:
    """Weights (new, old) of a triangle filter, widened when it shrinks an axis (antialiasing)."""
    scale = old / new
    reach = max(1.0, scale)
    centers = (np.arange(new) + 0.5) * scale - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(old) - centers[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.einsum("yh,hwc,xw->yxc", _taps(img.shape[0], height), img, _taps(img.shape[1], width), optimize=True)


def to_tensor(img: np.ndarray, size: int = 224) -> np.ndarray:
    """The evaluation transform: resize, scale to 0..1, normalise by channel; channels first."""
    x = resize(img, size, size) / 255.0
    return ((x - np.array(MEAN)) / np.array(STD)).transpose(2, 0, 1)


def random_resized_crop(img: np.ndarray, rng: np.random.Generator, size: int = 224, scale: tuple = CROP_SCALE) -> np.ndarray:
    h, w = img.shape[:2]
    for _ in range(10):
        area = h * w * rng.uniform(*scale)
        ratio = np.exp(rng.uniform(np.log(3 / 4), np.log(4 / 3)))
        cw, ch = round(np.sqrt(area * ratio)), round(np.sqrt(area / ratio))
        if 0 < cw <= w and 0 < ch <= h:
            y, x = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
            return resize(img[y : y + ch, x : x + cw], size, size)
    return resize(img, size, size)


def _gray(img: np.ndarray) -> np.ndarray:
    return img @ np.array([0.299, 0.587, 0.114])


def jitter(img: np.ndarray, factors: Sequence[float], order: Sequence[int]) -> np.ndarray:
    """Brightness, contrast, saturation (0, 1, 2) by their factors and hue (3) by its part of a turn, in ``order``."""
    for k in order:
        f = factors[k]
        if k == 0:
            img = img * f
        elif k == 1:
            img = _gray(img).mean() * (1 - f) + img * f
        elif k == 2:
            img = _gray(img)[..., None] * (1 - f) + img * f
        else:  # turn the chroma plane of YIQ
            yiq = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]])
            c, s = np.cos(2 * np.pi * f), np.sin(2 * np.pi * f)
            turn = np.linalg.inv(yiq) @ np.array([[1, 0, 0], [0, c, -s], [0, s, c]]) @ yiq
            img = img @ turn.T
        img = np.clip(img, 0, 255)
    return img


def color_jitter(img: np.ndarray, rng: np.random.Generator, strength: tuple = JITTER) -> np.ndarray:
    """``jitter`` by drawn factors in a drawn order."""
    factors = [rng.uniform(max(0, 1 - s), 1 + s) for s in strength[:3]] + [rng.uniform(-strength[3], strength[3])]
    return jitter(img, factors, rng.permutation(4))


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, nearest pixel, black outside."""
    h, w = img.shape[:2]
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.rint(np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx).astype(int)
    sy = np.rint(np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros_like(img)
    out[ok] = img[sy[ok], sx[ok]]
    return out


def augment(img: np.ndarray, rng: np.random.Generator, size: int = 224) -> np.ndarray:
    """Training augmentation: crop, flips, colours, rotation, in this order."""
    img = random_resized_crop(img, rng, size)
    img = img[:, ::-1] if rng.random() < FLIP_X else img
    img = img[::-1] if rng.random() < FLIP_Y else img
    return rotate(color_jitter(img, rng), rng.uniform(-DEGREES, DEGREES))


def composite(img: np.ndarray, mask: np.ndarray, background: np.ndarray, size: int = 224) -> np.ndarray:
    """The image where the mask is false, the resized background elsewhere; resized to a square."""
    if background.ndim == 2:
        background = np.repeat(background[..., None], 3, axis=2)
    bg = resize(background, *img.shape[:2])
    return resize(np.where(~mask[..., None], img, bg), size, size)


def decode(row: dict) -> np.ndarray:
    """An RGB array from a struct of Spark's image source, which holds BGR bytes."""
    raw = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    raw = np.repeat(raw, 3, axis=2) if row["nChannels"] == 1 else raw[..., 2::-1]
    return raw.astype(np.float64)


def png(rgb: np.ndarray) -> bytes:
    """A PNG of an array [height, width, 3]; values are rounded and cut to 0..255."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = rgb.shape
    lines = np.clip(np.rint(rgb), 0, 255).astype(np.uint8).reshape(h, 3 * w)
    body = np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1).tobytes()  # each line is stored as it is
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def resized(images: DataFrame, size: int) -> DataFrame:
    """``images`` with every ``image`` struct resized to ``size`` x ``size`` pixels of three channels."""
    at = images.columns.index("image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for image in b.column(at).to_pylist():
                small = np.clip(np.rint(resize(decode(image), size, size)), 0, 255).astype(np.uint8)
                out.append(image | {"height": size, "width": size, "nChannels": 3, "mode": 16, "data": small[..., ::-1].tobytes()})  # 16: bytes, BGR
            columns = list(b.columns)
            columns[at] = pa.array(out, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return images.mapInArrow(run, images.schema)


Transform = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def compose(*steps: Transform) -> Transform:
    """One transform after the other."""

    def run(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        for step in steps:
            img = step(img, rng)
        return img

    return run


def apply(images: DataFrame, steps: Sequence[Transform], seed: int = 42, key: str = "path") -> DataFrame:
    """``images`` (key, label, image struct) to (key, label, tensor array<float>).

    Each row's random numbers follow from the seed and its key, whatever task it falls to.
    """
    import hashlib

    run_all = compose(*steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, image in zip(b[key].to_pylist(), b["image"].to_pylist(), strict=True):
                digest = hashlib.md5(f"{seed}:{k}".encode()).digest()
                rng = np.random.default_rng(int.from_bytes(digest, "big"))
                out.append(run_all(decode(image), rng).ravel().astype(np.float32))
            yield pa.RecordBatch.from_arrays([b[key], b["label"], pa.array(out, pa.list_(pa.float32()))], names=[key, "label", "tensor"])

    kind = dict(images.dtypes)
    return images.select(key, "label", "image").mapInArrow(run, f"{key} {kind[key]}, label {kind['label']}, tensor array<float>")
