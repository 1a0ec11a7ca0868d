"""Signals over pixels, for crops given as arrays (blue, green, red): sharpness and clothing.

Both return None for what can't be measured; None is unknown, never bad.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Fixed values of the descriptor: hue and saturation bins, brightness bins, and their bounds.
HUES, SATURATIONS, BRIGHTNESSES = 12, 3, 3
GREY_BELOW, DARKEST, LIGHTEST = 40, 30, 252
LEAST_PIXELS, LEAST_SIDE = 100, 24
SIDE = 64
#: Grey of a letterbox's margin, a fixed value.
PAD = 114


def _weights(n: int, side: int) -> np.ndarray:
    """Shares of ``n`` source cells in ``side`` equal target cells."""
    edges = np.arange(side + 1) * (n / side)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(n)[None, :]
    share = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image.astype(float)
    return np.rint(image @ np.array([0.114, 0.587, 0.299]))


def inside(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of an image under a box of whole pixels; empty where they don't meet."""
    x, y, w, h = np.rint(box).astype(int)
    own = [range(max(at, 0), min(at + size, most)) for at, size, most in ((y, h, image.shape[0]), (x, w, image.shape[1]))]
    return image[np.ix_(*own)] if all(own) else image[:0, :0]


def sharpness(image: np.ndarray, box: tuple[float, float, float, float]) -> float | None:
    """Variance of the Laplacian of a box's crop, brought to one size by area averages."""
    crop = inside(image, box)
    if min(crop.shape[:2]) < 2:
        return None
    small = np.rint(resized(grey(crop), SIDE, SIDE))
    wide = np.pad(small, 1, mode="reflect")
    across = wide[1:-1, :-2] + wide[1:-1, 2:]
    return round(float((across + wide[:-2, 1:-1] + wide[2:, 1:-1] - 4 * small).var()), 2)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image at another size: each new pixel is the mean of the area it covers."""
    rows, columns = _weights(image.shape[0], height), _weights(image.shape[1], width)
    return np.einsum("ia,jb,ab...->ij...", rows, columns, image.astype(float), optimize=True)


def fit(image: np.ndarray, max_width: int = 0, max_height: int = 0) -> np.ndarray:
    """An image shrunk, never grown, to the bounds; 0 is no bound. Face pixels shrink with it."""
    height, width = image.shape[:2]
    scale = min([1.0, *(most / own for most, own in ((max_width, width), (max_height, height)) if most)])
    if scale == 1.0:
        return image
    return np.rint(resized(image, max(1, round(width * scale)), max(1, round(height * scale)))).astype(np.uint8)


def letterbox(image: np.ndarray, width: int, height: int) -> tuple[np.ndarray, float]:
    """An image scaled into the upper left of a grey canvas, and the scale; growing repeats pixels' areas."""
    scale = min(height / image.shape[0], width / image.shape[1])
    canvas = np.full((height, width, 3), PAD, np.uint8)
    own = resized(image, int(image.shape[1] * scale), int(image.shape[0] * scale))
    canvas[: own.shape[0], : own.shape[1]] = np.rint(own)
    return canvas, scale


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0 to 180), saturation and value (0 to 255)."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    value, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    spread = value - low
    safe = np.where(spread == 0, 1, spread)
    hue = np.select([value == r, value == g], [60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    hue = np.where(spread == 0, 0, np.rint((hue % 360) / 2) % 180)
    return hue, np.rint(np.where(value == 0, 0, 255 * spread / np.where(value == 0, 1, value))), value


def clothing(crop: np.ndarray) -> list[float] | None:
    """48 numbers that add up to 1: hue by saturation, then brightness of grey pixels, softly binned."""
    if min(crop.shape[:2]) < LEAST_SIDE:
        return None
    hue, saturation, value = hsv(crop)
    lit = (value >= DARKEST) & (value <= LIGHTEST)
    if lit.sum() < LEAST_PIXELS:
        return None
    out = np.zeros(48)
    coloured = saturation >= GREY_BELOW
    both = np.histogram2d(hue[lit & coloured], saturation[lit & coloured], (HUES, SATURATIONS), ((0, 180), (GREY_BELOW, 256)))[0]
    out[: both.size] = both.ravel()
    # A grey pixel counts for the two bins whose centres it lies between, by nearness; for the outer ones alone beyond them.
    span = (LIGHTEST + 1 - DARKEST) / BRIGHTNESSES
    centres = DARKEST + span * (np.arange(BRIGHTNESSES) + 0.5)
    greys = value[lit & ~coloured]
    out[both.size : both.size + BRIGHTNESSES] = [np.interp(greys, centres, one).sum() for one in np.eye(BRIGHTNESSES)]
    return (out / out.sum()).tolist()


def clothing_column(pixels: Column, width: Column, height: Column) -> Column:
    """Descriptor of a crop's raw pixels (binary, three bytes each), in Arrow batches."""

    @pandas_udf("array<double>")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        one = lambda d, x, y: None if d is None else clothing(np.frombuffer(d, np.uint8).reshape(int(y), int(x), 3))
        return pd.Series([one(d, x, y) for d, x, y in zip(data, w, h, strict=True)])

    return run(pixels, width, height)


def fit_column(pixels: Column, width: Column, height: Column, max_width: int = 0, max_height: int = 0) -> Column:
    """Raw pixels shrunk to the bounds: ``pixels, width, height``; null stays null."""

    @pandas_udf("pixels binary, width int, height int")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        def one(d, x, y):
            if d is None:
                return None, None, None
            small = fit(np.frombuffer(d, np.uint8).reshape(int(y), int(x), 3), max_width, max_height)
            return small.tobytes(), small.shape[1], small.shape[0]

        return pd.DataFrame([one(*row) for row in zip(data, w, h, strict=True)], columns=["pixels", "width", "height"])

    return run(pixels, width, height)


def letterbox_column(pixels: Column, width: Column, height: Column, side: int = 416) -> Column:
    """Raw pixels on a square canvas: ``pixels, scale``; null stays null."""

    @pandas_udf("pixels binary, scale double")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        def one(d, x, y):
            if d is None:
                return None, None
            canvas, scale = letterbox(np.frombuffer(d, np.uint8).reshape(int(y), int(x), 3), side, side)
            return canvas.tobytes(), scale

        return pd.DataFrame([one(*row) for row in zip(data, w, h, strict=True)], columns=["pixels", "scale"])

    return run(pixels, width, height)
