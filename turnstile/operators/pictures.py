"""Signals of pictures: what the pixel functions say of whole images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from turnstile.functions.columns import image_bytes, jpeg_dims
from turnstile.functions.pixels import clothing, fit, letterbox, sharpness
from turnstile.plans.registry import frames
from turnstile.settings import Settings


def _measured(pixels: Column, width: Column, height: Column, k: Settings) -> Column:
    """What the pixel functions say of each image; what they paint stays in the task, one image at a time."""

    @pandas_udf("sharpness double, look array<double>, scale double, boxed_bytes int, width int, height int")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        def one(d, x, y):
            if d is None:
                return (None,) * 6
            image = np.frombuffer(d, np.uint8).reshape(int(y), int(x), 3)
            canvas, scale = letterbox(image, k.letterbox_side, k.letterbox_side)
            small = fit(image, k.frame_width, k.frame_height)
            return sharpness(image, (0, 0, int(x), int(y))), clothing(image), scale, canvas.nbytes, small.shape[1], small.shape[0]

        return pd.DataFrame([one(*row) for row in zip(data, w, h, strict=True)], columns=["sharpness", "look", "scale", "boxed_bytes", "width", "height"])

    return run(pixels, width, height)


def _wire_sql() -> str:
    """What the headers were made of."""
    sized = "page_id % 7 <> 3 AND page_id % 5 <> 0"
    return f"""SELECT page_id AS image_id, CASE WHEN page_id % 7 <> 3 THEN CAST(octet_length(encode(html)) + CASE WHEN page_id % 5 <> 0 THEN 18 ELSE 0 END AS BIGINT) END AS bytes,
      CASE WHEN {sized} THEN page_id % 500 + 1 END AS width, CASE WHEN {sized} THEN page_id % 300 + 1 END AS height FROM pages WHERE html IS NOT NULL"""


@frames("wire", oracle=_wire_sql)
def wire_images(k: Settings, wire: DataFrame) -> DataFrame:
    """Frames from base64: how many bytes, and the size that the header tells; null where the text is no base64, or no header is there."""

    @pandas_udf("width long, height long")
    def dims(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_dims(None if x is None else bytes(x)) or (None, None) for x in data], columns=["width", "height"], dtype="Int64")

    decoded = wire.select("image_id", image_bytes("data").alias("content"))
    return decoded.select("image_id", F.octet_length("content").cast("long").alias("bytes"), dims("content").alias("d")).select("image_id", "bytes", "d.width", "d.height")


@frames("images")
def image_signals(k: Settings, images: DataFrame) -> DataFrame:
    """Of each image its sharpness, the clothing descriptor's mass, the letterbox's scale and the size it is sent in.

    An image under two pixels has no sharpness, one too small or too dark no descriptor; that is null, never 0.
    """
    signals = images.select("image_id", _measured(F.col("pixels"), F.col("width"), F.col("height"), k).alias("m"))
    mass = F.round(F.aggregate("m.look", F.lit(0.0), lambda s, v: s + v), 6)
    return signals.select("image_id", "m.sharpness", mass.alias("mass"), "m.scale", "m.boxed_bytes", "m.width", "m.height")
