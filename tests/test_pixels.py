import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.functions.columns import image_bytes
from turnstile.functions.pixels import clothing, clothing_column, fit, fit_column, hsv, inside, letterbox, letterbox_column, sharpness


def flat(bgr, side=32):
    return np.tile(np.array(bgr, np.uint8), (side, side, 1))


def test_hues_of_pure_colours():
    for bgr, hue in (((0, 0, 255), 0), ((0, 255, 0), 60), ((255, 0, 0), 120)):
        h, s, v = hsv(flat(bgr))
        assert (h[0, 0], s[0, 0], v[0, 0]) == (hue, 255, 255)


def test_clothing_of_flat_crops():
    red = clothing(flat((0, 0, 200)))
    assert sum(red) == pytest.approx(1) and red[2] == pytest.approx(1)
    light, lighter = clothing(flat((205, 205, 205))), clothing(flat((218, 218, 218)))
    assert sum(map(min, light, lighter)) > 0.8  # soft bins: a small drift moves little
    assert clothing(flat((5, 5, 5))) is None and clothing(flat((0, 0, 200), 20)) is None


def test_sharpness_orders_focus():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (80, 80, 3)).astype(np.uint8)
    assert sharpness(flat((90, 90, 90)), (0, 0, 32, 32)) == 0.0
    assert sharpness(noise, (0, 0, 64, 64)) > 1000
    assert sharpness(noise, (79.6, 0, 20, 20)) is None


def test_clothing_column(spark):
    df = spark.createDataFrame([(flat((0, 0, 200)).tobytes(), 32, 32), (None, 1, 1)], "p binary, w int, h int")
    got = df.select(clothing_column(F.col("p"), F.col("w"), F.col("h")).alias("c")).collect()
    assert got[0].c[2] == pytest.approx(1) and got[1].c is None


def test_crops_off_the_image_are_empty():
    image = np.arange(300).reshape(10, 10, 3).astype(np.uint8)
    assert inside(image, (-4, -4, 3, 3)).size == 0 and inside(image, (20, 2, 5, 5)).size == 0
    assert (inside(image, (-2, 8, 5, 5)) == image[8:10, 0:3]).all()


def test_grey_pixels_are_binned_softly():
    """Between two centres by nearness, beyond the outer ones whole."""
    span = 223 / 3
    first, second = 30 + span / 2, 30 + 1.5 * span
    got = clothing(flat((100, 100, 100)))
    assert got[36] == pytest.approx((second - 100) / (second - first)) and got[37] == pytest.approx((100 - first) / (second - first))
    assert clothing(flat((40, 40, 40)))[36] == pytest.approx(1) and clothing(flat((250, 250, 250)))[38] == pytest.approx(1)


def test_fit_shrinks_and_never_grows():
    image = np.zeros((60, 120, 3), np.uint8)
    image[:, :60] = 200
    small = fit(image, max_width=40)
    assert small.shape == (20, 40, 3) and (small[:, :19] == 200).all() and (small[:, 21:] == 0).all()
    assert fit(image, 500, 500) is image and fit(image) is image
    assert fit(image, max_height=1).shape == (1, 2, 3)


def test_letterbox_pads_below_and_to_the_right():
    canvas, scale = letterbox(flat((10, 20, 30), 52), 104, 208)
    assert scale == 2.0 and canvas.shape == (208, 104, 3)
    assert (canvas[:104] == (10, 20, 30)).all() and (canvas[104:] == 114).all()


def test_image_columns(spark):
    df = spark.createDataFrame([(flat((0, 0, 200)).tobytes(), 32, 32), (None, 1, 1)], "p binary, w int, h int")
    got = df.select(fit_column(F.col("p"), F.col("w"), F.col("h"), 8).alias("f"), letterbox_column(F.col("p"), F.col("w"), F.col("h"), 16).alias("l")).collect()
    assert (got[0].f.width, got[0].f.height, len(got[0].f.pixels)) == (8, 8, 192) and got[0].l.scale == 0.5
    assert got[1].f.pixels is None and got[1].l.pixels is None
    text = spark.createDataFrame([("QUJD",), ("no base64!",), (None,)], "t string").select(image_bytes("t").alias("b")).collect()
    assert [r.b and bytes(r.b) for r in text] == [b"ABC", None, None]
