"""Pixel kernels on NumPy arrays, for Arrow UDFs over decoded images; thresholds are applied afterwards as Columns.

Images come as encoded bytes with a decoder (lodestone.adapters.images) or as raw uint8 with height and width. What
needs no decoder (quantisation tables) reads the JPEG bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = (
    "ela_mean double, ela_std double, ela_max double, copy_move_matches int, noise_mean_spread double, noise_std_spread double, straight_lines int, discontinuity_ratio double, "
    "ghost_ratio double, quantization_tables int, odd_quantization boolean, shadow_spread double, cfa_ratio double"
)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an H x W x 3 image; H x W stays."""
    if image.ndim == 2:
        return image.astype(np.uint8)
    return np.rint(image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def gaussian5(image: np.ndarray) -> np.ndarray:
    """5 x 5 binomial blur with mirrored edges."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    padded = np.pad(image.astype(float), 2, mode="reflect") if min(image.shape) > 2 else np.pad(image.astype(float), 2, mode="edge")
    rows = sum(w * padded[i : i + image.shape[0]] for i, w in enumerate(k))
    return np.rint(sum(w * rows[:, i : i + image.shape[1]] for i, w in enumerate(k)))


def noise_spread(image: np.ndarray, grid: int = 4) -> tuple[float, float]:
    """Spread (population) of the means and of the deviations of the residual over a grid of cells."""
    g = gray(image)
    residual = np.clip(g.astype(float) - gaussian5(g), 0, 255)
    h, w = (max(1, n // grid) for n in g.shape)
    cells = [residual[i * h : (i + 1) * h, j * w : (j + 1) * w] for i in range(grid) for j in range(grid)]
    cells = [c for c in cells if c.size]
    return float(np.std([c.mean() for c in cells])), float(np.std([c.std() for c in cells]))


def dct_matrix(n: int = 8) -> np.ndarray:
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def blocks_of(image: np.ndarray, size: int) -> np.ndarray:
    h, w = image.shape[0] // size, image.shape[1] // size
    return image[: h * size, : w * size].reshape(h, size, w, size).swapaxes(1, 2).reshape(-1, size, size)


def ghost_ratio(image: np.ndarray) -> float:
    """Share of 8 x 8 blocks whose low frequencies hold under a tenth of the energy."""
    b = blocks_of(gray(image).astype(float), 8)
    if not len(b):
        return 0.0
    d = dct_matrix()
    energy = (d @ b @ d.T) ** 2
    total = energy.sum(axis=(1, 2))
    low = energy[:, :4, :4].sum(axis=(1, 2))
    return float(((low < 0.1 * total) & (total > 0)).mean())


def discontinuity_ratio(image: np.ndarray) -> float:
    """Jumps of over 30 to the four neighbours, over all pixels; can exceed 1."""
    g = gray(image).astype(int)
    jumps = sum(int((np.abs(g - np.roll(g, s, a)) > 30).sum()) for s in (1, -1) for a in (0, 1))
    return jumps / max(1, g.size)


def cfa_ratio(image: np.ndarray, size: int = 16) -> float:
    """Share of blocks where, on any channel, the variances of horizontal and vertical differences differ threefold; differences wrap as bytes do."""
    if image.ndim != 3 or min(image.shape[:2]) < size:
        return 0.0
    bad = False
    for c in range(3):
        blocks = blocks_of(image[..., c].astype(np.uint8), size)
        across, down = (np.diff(blocks, axis=axis).var(axis=(1, 2)) for axis in (2, 1))
        ratio = across / np.where(down > 0, down, 1)
        bad = bad | ((down > 0) & ((ratio < 0.33) | (ratio > 3)))
    return float(bad.mean())


def error_level(image: np.ndarray, resaved: np.ndarray) -> tuple[float, float, float]:
    """Mean, deviation and maximum of the difference to a recompressed copy."""
    d = np.abs(image.astype(int) - resaved.astype(int))
    return float(d.mean()), float(d.std()), float(d.max())


def copy_move(descriptors: np.ndarray, places: np.ndarray, ratio: float = 0.7, apart: float = 20.0) -> int:
    """Keypoints whose nearest other one is clearly nearer than the next and lies apart; a keypoint is no match of itself."""
    n = len(descriptors)
    if n < 3:
        return 0
    hits = 0
    square = (descriptors.astype(float) ** 2).sum(axis=1)
    for start in range(0, n, 512):
        part = slice(start, min(n, start + 512))
        d = np.sqrt(np.maximum(square[part, None] + square[None, :] - 2 * descriptors[part].astype(float) @ descriptors.astype(float).T, 0))
        d[np.arange(d.shape[0]), np.arange(part.start, part.stop)] = np.inf
        two = np.argpartition(d, 1, axis=1)[:, :2]
        first = np.take_along_axis(d, two, axis=1)
        order = np.argsort(first, axis=1)
        two, first = np.take_along_axis(two, order, axis=1), np.take_along_axis(first, order, axis=1)
        far = np.linalg.norm(places[part] - places[two[:, 0]], axis=1) > apart
        hits += int(((first[:, 0] < ratio * first[:, 1]) & far).sum())
    return hits


def quantization(data: bytes) -> tuple[int, bool]:
    """Tables in the DQT segments of a JPEG, and whether any has an unusual length."""
    n, odd, at = 0, False, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA or length < 2:
            break
        if marker == 0xDB:
            inner, end = at + 4, at + 2 + length
            while inner < end:
                size = 64 * (2 if data[inner] >> 4 else 1)
                n += 1
                odd |= size != 64 or inner + 1 + size > end
                inner += 1 + size
        at += 2 + length
    return n, odd


def shadow_spread(image: np.ndarray, limit: int = 60, least: int = 100) -> float:
    """Deviation of the mean gradient angles of dark regions (degrees)."""
    g = gray(image).astype(float)
    if min(g.shape) < 3:
        return 0.0
    gy, gx = np.gradient(g)
    dark = g < limit
    place = np.cumsum(dark).reshape(g.shape) - 1  # of each dark pixel among them
    side = [place[:, :-1][dark[:, :-1] & dark[:, 1:]], place[:-1][dark[:-1] & dark[1:]]]
    region = regions(int(dark.sum()), np.concatenate(side), np.concatenate([side[0] + 1, place[1:][dark[:-1] & dark[1:]]]))
    n = np.bincount(region, minlength=1)
    large = n > least
    sums = [np.bincount(region, part[dark], len(n))[large] / n[large] for part in (gy, gx)]
    angles = np.degrees(np.arctan2(*sums))
    return float(np.std(angles)) if len(angles) > 1 else 0.0


def regions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, from edges: roots hook to lesser roots, then paths are halved."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(up := root[root], root):
            root = up


def metrics(pixels: Column, height: Column, width: Column, channels: Column) -> Column:
    """Struct of METRICS of raw uint8 images; what needs the encoded file or a recompressed copy is null."""

    @F.pandas_udf(METRICS)
    def run(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in METRICS.split(", ")]
        out = []
        for raw, hh, ww, cc in zip(data, h, w, c, strict=True):
            row = dict.fromkeys(names)
            if raw is not None:
                image = np.frombuffer(raw, np.uint8).reshape((int(hh), int(ww), int(cc)) if cc > 1 else (int(hh), int(ww)))
                row["noise_mean_spread"], row["noise_std_spread"] = noise_spread(image)
                row |= {"discontinuity_ratio": discontinuity_ratio(image), "ghost_ratio": ghost_ratio(image), "cfa_ratio": cfa_ratio(image), "shadow_spread": shadow_spread(image)}
            out.append(row)
        return pd.DataFrame(out, columns=names).astype({"copy_move_matches": "Int32", "straight_lines": "Int32", "quantization_tables": "Int32", "odd_quantization": "boolean"})

    return run(pixels, height, width, channels)


@F.pandas_udf(T.StructType([T.StructField("quantization_tables", T.IntegerType()), T.StructField("odd_quantization", T.BooleanType())]))
def quantization_tables(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([quantization(bytes(x)) if x is not None else (0, False) for x in content], columns=["quantization_tables", "odd_quantization"])
