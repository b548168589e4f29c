"""Images as long tables of cells: rasterising, filling, normalising, resizing."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .quantiles import quantiles


def raster(points: DataFrame, features: list[str], by: str = "station_id") -> DataFrame:
    """Mean of each feature in each pixel (v, u), all features in one aggregation: (by, feature, v, u, value, n)."""
    long = points.filter("valid").select(by, "v", "u", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))).alias("feature", "value"))
    return long.groupBy(by, "feature", "v", "u").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def top_down(points: DataFrame, feature: str, cell: float, by: str = "station_id") -> DataFrame:
    """Orthographic means over square cells of the x, y plane, counted from the station's corner."""
    corner = points.groupBy(by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    place = lambda k: F.floor((F.col(k) - F.col(f"{k}0")) / cell).cast("int")
    return points.join(corner, by).groupBy(by, place("y").alias("v"), place("x").alias("u")).agg(F.avg(feature).alias("value"), F.count(F.lit(1)).alias("n"))


def filled_from_neighbours(cells: DataFrame, reach: int = 1) -> DataFrame:
    """NaN cells get the mean of the other cells in the square around them; those without any stay NaN."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    empty = cells.filter(F.isnan("value")).select("image_id", "v", "u")
    asked = empty.select("*", F.explode(F.transform(steps, lambda i: F.col("v") + i)).alias("nv")).select("*", F.explode(F.transform(steps, lambda i: F.col("u") + i)).alias("nu"))
    known = cells.filter(~F.isnan("value")).select("image_id", F.col("v").alias("nv"), F.col("u").alias("nu"), "value")
    fill = asked.join(known, ["image_id", "nv", "nu"]).groupBy("image_id", "v", "u").agg(F.avg("value").alias("fill"))
    return cells.join(fill, ["image_id", "v", "u"], "left").select("image_id", "v", "u", F.when(F.isnan("value"), F.coalesce("fill", "value")).otherwise(F.col("value")).alias("value"))


def limits(cells: DataFrame) -> DataFrame:
    """Least and largest value of each image, NaN left out."""
    real = F.when(~F.isnan("value"), F.col("value"))
    return cells.groupBy("image_id").agg(F.min(real).alias("low"), F.max(real).alias("high"))


def filled(cells: DataFrame, fill: str | float = "max", seed: int = 0) -> DataFrame:
    """Replaces NaN by the image's max or min, zero, a seeded random value between them, or a number; adds low and high.

    A number above the image's maximum becomes the new maximum; the minimum is not lowered.
    """
    out = cells.join(limits(cells), "image_id")
    if fill in ("max", "min"):
        new = F.col("high" if fill == "max" else "low")
    elif fill == "zero":
        new = F.lit(0.0)
    elif fill == "random":
        share = F.pmod(F.xxhash64(F.lit(seed), "image_id", "v", "u"), F.lit(1 << 30)) / float(1 << 30)
        new = F.col("low") + share * (F.col("high") - F.col("low"))
    elif isinstance(fill, (int, float)) and not isinstance(fill, bool):
        new = F.lit(float(fill))
        out = out.withColumn("high", F.greatest("high", new))
    else:
        raise ValueError(f"unknown fill: {fill!r}")
    return out.withColumn("value", F.when(F.isnan("value"), new).otherwise(F.col("value")))


def scaled(cells: DataFrame, top: float | None = 1.0) -> DataFrame:
    """filled() cells to 0..top by the image's limits; a constant image is 0; None changes nothing."""
    if top is None:
        return cells
    span = F.col("high") - F.col("low")
    return cells.withColumn("value", F.when(span == 0, 0.0).otherwise((F.col("value") - F.col("low")) / span * top))


def percentile_scaled(cells: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clips to two exact percentiles of the image and scales to 0..1; NaN stays."""
    real = F.when(~F.isnan("value"), F.col("value"))
    cut = quantiles(cells, "image_id", real, {"p0": low, "p1": high})
    inside = F.greatest("p0", F.least("p1", "value"))
    span = F.col("p1") - F.col("p0")
    out = F.when(F.isnan("value"), F.col("value")).when(span == 0, 0.0).otherwise((inside - F.col("p0")) / span)
    return cells.join(cut, "image_id").withColumn("value", out).drop("p0", "p1")


def as_bytes(value: Column) -> Column:
    """Truncates towards zero, as a cast to an unsigned byte does for 0..255."""
    return value.cast("smallint")


def lanczos(x: Column, lobes: int = 3) -> Column:
    a = F.lit(math.pi) * x
    return F.when(F.abs(x) < 1e-12, 1.0).when(F.abs(x) >= lobes, 0.0).otherwise(lobes * F.sin(a) * F.sin(a / lobes) / (a * a))


def resized(cells: DataFrame, width: int | Column, height: int | Column, factor: float | Column) -> DataFrame:
    """Shrinks images by a separable three-lobe filter: taps over the source cells in reach, border cells repeated, weights summing to one.

    Sizes and factor may be columns of cells, one value an image. An image of factor 1 stays as it is.
    """
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    images = cells.groupBy("image_id").agg(*[F.first(value(x)).alias(k) for k, x in (("w", width), ("h", height), ("f", factor))])
    out = filled(cells.select("image_id", "v", "u", "value"), "max").select("image_id", "v", "u", "value")
    for axis, other, size in (("u", "v", "w"), ("v", "u", "h")):
        reach = F.ceil(3 / F.col("f"))
        taps = images.select("image_id", "f", F.col(size).alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.col(size) * F.col("f") + 0.5)).cast("int") - 1)).alias("i"))
        taps = taps.withColumn("centre", (F.col("i") + 0.5) / F.col("f") - 0.5)
        taps = taps.select("*", F.explode(F.sequence(F.ceil(F.col("centre") - reach).cast("int"), F.floor(F.col("centre") + reach).cast("int"))).alias("j"))
        weight = F.when(F.col("f") == 1, (F.col("j") == F.col("i")).cast("double")).otherwise(lanczos((F.col("j") - F.col("centre")) * F.col("f")))
        taps = taps.select("image_id", "i", F.greatest(F.lit(0), F.least(F.col("size") - 1, "j")).alias(axis), weight.alias("weight"))
        taps = taps.groupBy("image_id", "i", axis).agg(F.sum("weight").alias("weight")).filter("weight <> 0")
        out = out.join(taps, ["image_id", axis]).groupBy("image_id", other, "i").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))
        out = out.withColumnRenamed("i", axis)
    return out.select("image_id", "v", "u", "value")


def shrunk(size: Column, factor: Column) -> Column:
    """Cells of an axis after resized()."""
    return F.greatest(F.lit(1), F.floor(size * factor + 0.5)).cast("int")


def spread_to_neighbours(cells: DataFrame, width: Column, height: Column) -> DataFrame:
    """Sparse cells: an empty cell beside known ones gets their mean, as filled_from_neighbours() gives to a NaN cell. width, height: columns of cells."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    known = cells.filter(~F.isnan("value"))
    near = known.select("image_id", "v", "u", "value", width.alias("w"), height.alias("h"), F.explode(F.transform(steps, lambda i: F.col("v") + i)).alias("nv"))
    near = near.select("*", F.explode(F.transform(steps, lambda i: F.col("u") + i)).alias("nu")).filter("nv >= 0 and nu >= 0 and nv < h and nu < w")
    fill = near.groupBy("image_id", F.col("nv").alias("v"), F.col("nu").alias("u")).agg(F.avg("value").alias("fill"))
    own = known.groupBy("image_id", "v", "u").agg(F.first("value").alias("value"))
    return fill.join(own, ["image_id", "v", "u"], "left").select("image_id", "v", "u", F.coalesce("value", "fill").alias("value"))


def flow_colour(points: DataFrame, dx: str, dy: str, by: str = "station_id", share: float = 0.95) -> DataFrame:
    """Adds hue (0..1, direction) and strength (0..1, magnitude up to a quantile of the station's)."""
    size = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy))
    cap = quantiles(points, by, size, {"cap": share})
    hue = (F.atan2(F.col(dy), F.col(dx)) + math.pi) / (2 * math.pi)
    return points.join(cap, by).withColumns({"hue": hue, "strength": F.least(F.lit(1.0), F.coalesce(F.try_divide(size, F.col("cap")), F.lit(0.0)))}).drop("cap")


def nearest_three(pixels: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """pixels (station_id, v, u) with `near`: the three nearest points (d, point_id, pu, pv, value), nearest first, ties by point_id.

    Pixels meet the points of the 3 x 3 cells around them by an equi-join; a third point within one
    cell width settles a pixel, the others go on with cells of four times the width. A station of fewer
    than three points leaves its pixels out.
    """
    place = lambda k: F.floor(F.col(k) / F.lit(cell))
    todo, done = cut(pixels.select("station_id", "v", "u")), None
    points = points.select("station_id", "point_id", "pu", "pv", "value")
    widest = points.agg(F.max(F.greatest(F.abs("pu"), F.abs("pv")))).first()[0] or 0.0
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    order = Window.partitionBy("station_id", "v", "u").orderBy("d", "point_id")
    while True:
        asked = todo.select("*", F.explode(F.transform(around, lambda i: place("v") + i)).alias("cv")).select("*", F.explode(F.transform(around, lambda i: place("u") + i)).alias("cu"))
        fixed = points.withColumns({"cv": place("pv"), "cu": place("pu")})
        d = F.sqrt(F.pow(F.col("pu") - F.col("u"), 2) + F.pow(F.col("pv") - F.col("v"), 2))
        met = asked.join(fixed, ["station_id", "cv", "cu"]).withColumn("d", d).withColumn("i", F.row_number().over(order)).filter("i <= 3")
        near = met.groupBy("station_id", "v", "u").agg(F.sort_array(F.collect_list(F.struct("d", "point_id", "pu", "pv", "value"))).alias("near"))
        found = cut(todo.join(near, ["station_id", "v", "u"], "left"))
        settled = (F.size("near") == 3) & (F.get("near", 2)["d"] <= cell)
        done = found.filter(settled) if done is None else done.unionByName(found.filter(settled))
        todo = found.filter(~F.coalesce(settled, F.lit(False))).select("station_id", "v", "u")
        if cell > 4 * widest + 4 or todo.isEmpty():
            return done
        cell *= 4


def barycentric(near: DataFrame) -> DataFrame:
    """nearest_three() to (station_id, v, u, value): barycentric weights, negative ones cut to 0; points in a line give the nearest's value."""
    p = lambda i, k: F.get("near", i)[k]
    (x1, y1), (x2, y2), (x3, y3) = ((p(i, "pu"), p(i, "pv")) for i in range(3))
    x, y = F.col("u"), F.col("v")
    det = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    a = F.try_divide((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3), det)
    b = F.try_divide((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3), det)
    cutoff = [F.greatest(F.lit(0.0), w) for w in (a, b, 1 - a - b)]
    mean = sum((w * p(i, "value") for i, w in enumerate(cutoff)), F.lit(0.0)) / (cutoff[0] + cutoff[1] + cutoff[2])
    return near.select("station_id", "v", "u", F.when(F.abs(det) < 1e-9, p(0, "value")).otherwise(mean).alias("value"))


def checked(shape: tuple[int, ...], dtype: str) -> None:
    """What an image must be before it is encoded: two axes, or three with three channels, of a known type."""
    if len(shape) not in (2, 3) or (len(shape) == 3 and shape[2] != 3):
        raise ValueError(f"not an image: shape {shape}")
    if dtype not in ("uint8", "float32"):
        raise ValueError(f"not an image: type {dtype}")


def passes_through(shape: tuple[int, ...], low: float, high: float) -> bool:
    """A three-channel image within 0..255 is encoded already."""
    return len(shape) == 3 and shape[2] == 3 and 0 <= low and high <= 255


def model_input(image, fill: str | float = "max"):
    """A tile for a model: NaN filled by the tile's max or min, zero, or a number, then scaled to 0..1; a constant tile is 0."""
    image = np.asarray(image, np.float32)
    known = image[~np.isnan(image)]
    if not len(known):
        return np.zeros_like(image)
    low, high = float(known.min()), float(known.max())
    if fill not in ("max", "min", "zero") and (isinstance(fill, (str, bool)) or not isinstance(fill, (int, float))):
        raise ValueError(f"unknown fill: {fill!r}")
    new = {"max": high, "min": low, "zero": 0.0}.get(fill, fill)
    if not isinstance(fill, str):
        high = max(high, float(fill))
    image = np.where(np.isnan(image), np.float32(new), image)
    return np.zeros_like(image) if high == low else (image - np.float32(low)) / np.float32(high - low)


def three_channels(image):
    """A read-only view with the one channel three times; at the model boundary only."""
    return np.broadcast_to(image[:, :, None], (*image.shape, 3))


def png(image, comment: str = "") -> bytes:
    """A grey or colour image of bytes as a PNG file, with a comment if there is one."""
    image = np.ascontiguousarray(image, np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + (part(b"iTXt", b"Comment\0\0\0\0\0" + comment.encode()) if comment else b"") + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def encoded(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, path, content): a PNG of each image of byte cells, row 0 at the bottom as in the raster. One image is one task's."""

    def draw(cells_of: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), np.uint8)
        image[cells_of["v"], cells_of["u"]] = cells_of["value"]
        name = cells_of["image_id"].iloc[0]
        return pd.DataFrame({"image_id": [str(name)], "path": [f"images/{name}.png"], "content": [png(image[::-1])]})

    return cells.select("image_id", "v", "u", "value").groupBy("image_id").applyInPandas(draw, "image_id string, path string, content binary")
