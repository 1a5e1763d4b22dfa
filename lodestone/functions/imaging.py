"""Preparation of scanned pages for text recognition, on gray NumPy arrays (H x W, uint8): each step and the whole chain.

Steps return a new array and refuse an empty one. Edges are mirrored unless said otherwise.
"""

from __future__ import annotations

import numpy as np

from .kernels import gray, regions

# The largest side, sizes and strengths of the steps, and the least region that counts as writing.
MAX_SIDE, MEDIAN, CLIP, TILES, BILATERAL, SIGMA, WINDOW, OFFSET, LEAST_REGION = 4096, 3, 2.0, 3, 9, 75.0, 11, 2, 15
SKEWS = np.arange(-15, 15.01, 0.5)


def checked(image: np.ndarray | None) -> np.ndarray:
    if image is None or not image.size:
        raise ValueError("the image is empty")
    return gray(image)


def shifted(image: np.ndarray, reach: int, mode: str = "reflect") -> np.ndarray:
    """All neighbours within reach: (2 reach + 1, 2 reach + 1, H, W)."""
    if mode == "reflect" and min(image.shape) <= reach:
        mode = "edge"
    padded = np.pad(image, reach, mode=mode)
    view = np.lib.stride_tricks.sliding_window_view(padded, image.shape)
    return view


def resize(image: np.ndarray, longest: int = MAX_SIDE) -> np.ndarray:
    """At most `longest` on a side; a new pixel is the mean of the area it covers."""
    image = checked(image)
    if max(image.shape) <= longest:
        return image
    scale = longest / max(image.shape)
    out = image.astype(float)
    for axis in (0, 1):
        n, m = out.shape[axis], max(1, int(image.shape[axis] * scale))
        edges = np.linspace(0, n, m + 1)
        sums = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        low = np.minimum(edges.astype(int), n - 1)
        shape = [1, 1]
        shape[axis] = m + 1
        at = sums.take(low, axis) + (edges - low).reshape(shape) * out.take(low, axis)
        out = np.diff(at, axis=axis) * m / n
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float, background: int = 0) -> np.ndarray:
    """Counter-clockwise about the centre, on a canvas that holds all of it; bilinear."""
    image = checked(image)
    h, w = image.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    high, wide = int(round(abs(s) * w + abs(c) * h)), int(round(abs(c) * w + abs(s) * h))
    y, x = np.mgrid[:high, :wide].astype(float)
    dy, dx = y - (high - 1) / 2, x - (wide - 1) / 2
    sy, sx = s * dx + c * dy + (h - 1) / 2, c * dx - s * dy + (w - 1) / 2
    padded = np.pad(image.astype(float), 1, constant_values=background)
    sy, sx = np.clip(sy + 1, 0, h + 0.999), np.clip(sx + 1, 0, w + 0.999)
    top, left = sy.astype(int), sx.astype(int)
    fy, fx = sy - top, sx - left
    rows = [padded[top + i, left] * (1 - fx) + padded[top + i, left + 1] * fx for i in (0, 1)]
    return np.rint(rows[0] * (1 - fy) + rows[1] * fy).astype(np.uint8)


def skew(image: np.ndarray) -> float:
    """Degrees by which lines of writing rise: the turn whose rows differ most in ink; 0 without ink."""
    image = checked(image)
    ink = 255 - resize(image, 400).astype(float)
    if ink.std() == 0:
        return 0.0
    y, x = np.nonzero(ink > ink.mean())
    weight = ink[y, x]

    def sharpness(degrees: float) -> float:
        at = np.rint(y * np.cos(np.radians(degrees)) + x * np.sin(np.radians(degrees))).astype(int)
        return float(np.square(np.bincount(at - at.min(), weights=weight)).sum())

    return float(max(SKEWS, key=lambda d: (sharpness(d), -abs(d))))


def deskew(image: np.ndarray) -> np.ndarray:
    degrees = skew(image)
    return rotate(image, -degrees) if degrees else checked(image)


def median(image: np.ndarray, size: int = MEDIAN) -> np.ndarray:
    near = shifted(checked(image), size // 2, "edge")
    return np.median(near.reshape(-1, *image.shape[:2]), axis=0).astype(np.uint8)


def equalize(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Histogram equalisation by tile with clipped counts; between tile centres the four nearest curves are blended."""
    image = checked(image)
    h, w = image.shape
    high, wide = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, high * tiles - h), (0, wide * tiles - w)), mode="edge")
    limit = max(1, int(clip * high * wide / 256))
    curves = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * high : (i + 1) * high, j * wide : (j + 1) * wide].ravel(), minlength=256)
            over = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + over / 256
            curves[i, j] = np.cumsum(counts) * 255 / (high * wide)
    blend = []
    for n, size in ((h, high), (w, wide)):
        at = np.clip((np.arange(n) + 0.5) / size - 0.5, 0, tiles - 1)
        low = np.minimum(at.astype(int), max(0, tiles - 2))
        blend.append((low, np.minimum(low + 1, tiles - 1), at - low))
    (y0, y1, fy), (x0, x1, fx) = blend
    fy, fx = fy[:, None], fx[None, :]
    value = lambda y, x: curves[y[:, None], x[None, :], image]
    out = (value(y0, x0) * (1 - fx) + value(y0, x1) * fx) * (1 - fy) + (value(y1, x0) * (1 - fx) + value(y1, x1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def bilateral(image: np.ndarray, size: int = BILATERAL, colour: float = SIGMA, space: float = SIGMA) -> np.ndarray:
    """A mean of the disc around, by nearness in place and in shade, so that edges stay."""
    image = checked(image)
    near, reach = shifted(image, size // 2), size // 2
    total, weights = np.zeros(image.shape), np.zeros(image.shape)
    for dy in range(size):
        for dx in range(size):
            distance = (dy - reach) ** 2 + (dx - reach) ** 2
            if distance <= reach**2:
                shade = near[dy, dx].astype(float)
                weight = np.exp(-distance / (2 * space**2) - (shade - image) ** 2 / (2 * colour**2))
                total += weight * shade
                weights += weight
    return np.rint(total / weights).astype(np.uint8)


def adaptive(image: np.ndarray, window: int = WINDOW, offset: float = OFFSET) -> np.ndarray:
    """White where a pixel exceeds the Gaussian mean of its window less the offset."""
    image = checked(image)
    reach = window // 2
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    padded = np.pad(image.astype(float), reach, mode="edge")
    rows = sum(v * padded[i : i + image.shape[0]] for i, v in enumerate(k))
    mean = np.rint(sum(v * rows[:, i : i + image.shape[1]] for i, v in enumerate(k)))
    return np.where(image > mean - offset, 255, 0).astype(np.uint8)


def otsu(image: np.ndarray) -> np.ndarray:
    """White above the shade that parts dark and light with the most variance between them."""
    image = checked(image)
    share = np.bincount(image.ravel(), minlength=256) / image.size
    below, mean = np.cumsum(share), np.cumsum(share * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((mean[-1] * below - mean) ** 2 / (below * (1 - below)))
    return np.where(image > int(between.argmax()), 255, 0).astype(np.uint8)


def _cross(image: np.ndarray, least: bool) -> np.ndarray:
    p = np.pad(image, 1, constant_values=255 if least else 0)
    parts = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    return (np.minimum if least else np.maximum).reduce(parts)


def erode(image: np.ndarray) -> np.ndarray:
    """Least of the cross of five."""
    return _cross(checked(image), True)


def dilate(image: np.ndarray) -> np.ndarray:
    """Greatest of the cross of five."""
    return _cross(checked(image), False)


def opened(image: np.ndarray) -> np.ndarray:
    return dilate(erode(image))


def closed(image: np.ndarray) -> np.ndarray:
    return erode(dilate(image))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) points, in turn (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ordered) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ordered = [tuple(p) for p in points.tolist()]
    return np.array(chain(ordered) + chain(ordered[::-1]))


def writing(image: np.ndarray, least: int = LEAST_REGION) -> np.ndarray:
    """Opened and eroded; black outside the hull (two pixels wider) of the white regions of at least so many pixels."""
    image = erode(opened(image))
    white = image > 0
    place = np.cumsum(white).reshape(white.shape) - 1
    across, down = white[:, :-1] & white[:, 1:], white[:-1] & white[1:]
    a = np.concatenate([place[:, :-1][across], place[:-1][down]])
    region = regions(int(white.sum()), a, np.concatenate([place[:, 1:][across], place[1:][down]]))
    large = np.bincount(region, minlength=1)[region] >= least if len(region) else np.empty(0, bool)
    if not large.any():
        return image
    y, x = (v[large] for v in np.nonzero(white))
    corners = hull(np.stack([x, y], axis=1))
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    inside = np.ones(image.shape, bool)
    if len(corners) > 2:
        for (x0, y0), (x1, y1) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
            inside &= (x1 - x0) * (yy - y0) - (y1 - y0) * (xx - x0) >= -2 * np.hypot(x1 - x0, y1 - y0)
    return np.where(inside, image, 0).astype(np.uint8)


def prepared(image: np.ndarray) -> np.ndarray:
    """The whole chain: size, skew, median, contrast, bilateral, threshold, writing, closing, opening and a last widening."""
    for step in (resize, deskew, median, equalize, bilateral, adaptive, writing, closed, opened, dilate):
        image = step(image)
    return image
