"""Column functions of the DataFrame API; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column | str) -> Column:
    """A vector of length one; null for vectors that are zero or shorter than 8."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.when((F.size(v) >= 8) & (norm > 0), F.transform(v, lambda x: x.cast("double") / norm))


def histogram_overlap(a: Column | str, b: Column | str) -> Column:
    """The sum of the smaller values; null where either side is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, v: s + v)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two box structs ``x, y, w, h``; 0 for a box without area."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when((a["w"] * a["h"] <= 0) | (b["w"] * b["h"] <= 0), 0.0).otherwise(both / union)


def image_bytes(text: Column | str) -> Column:
    """A frame's bytes from its base64 text; null where the text is no base64 (frames are kept as bytes)."""
    return F.try_to_binary(text, F.lit("base64"))


def jpeg_dims(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from a JPEG's header, without decoding; None if there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:  # fill
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # no length
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's start
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None
