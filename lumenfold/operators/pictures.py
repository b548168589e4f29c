"""Pictures of results: masks and boxes over a grey image, as tables of coloured cells and as PNG files.

A picture is one task's; those of detections hold at most the sample that first_by_hash() takes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detections as D
from .images import png

#: Share of a mask's colour over the image.
ALPHA = 0.5
#: Multipliers by which a class number becomes a colour.
COLOUR = {"red": 97, "green": 57, "blue": 151}


def colour(number: Column, channel: str) -> Column:
    return F.pmod(number * COLOUR[channel] + 64, F.lit(256)).cast("int")


def framed(found: DataFrame) -> DataFrame:
    """(image_id, v, u, class_id): the outlines of boxes, one cell wide; where they cross, the box of the later det_id."""
    x0, y0, x1, y1 = (F.floor(k).cast("int") for k in ("x0", "y0", "x1", "y1"))
    box = found.select("image_id", "det_id", "class_id", x0.alias("x0"), y0.alias("y0"), (x1 - 1).alias("x1"), (y1 - 1).alias("y1")).filter("x1 >= x0 and y1 >= y0")
    across = box.select("*", F.explode(F.sequence("x0", "x1")).alias("u")).select("image_id", "det_id", "class_id", "u", F.explode(F.array("y0", "y1")).alias("v"))
    down = box.select("*", F.explode(F.sequence("y0", "y1")).alias("v")).select("image_id", "det_id", "class_id", F.explode(F.array("x0", "x1")).alias("u"), "v")
    return across.unionByName(down).groupBy("image_id", "v", "u").agg(F.max_by("class_id", "det_id").alias("class_id"))


def drawn(cells: DataFrame, found: DataFrame, pixels: DataFrame | None = None, outlines: bool = False, boxes: bool = True) -> DataFrame:
    """(image_id, v, u, red, green, blue): cells of 0..1 in grey, masks blended over them, small over large, their outlines in black, and boxes on top."""
    grey = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("value", F.lit(1.0)), F.lit(1.0)) * 255))).cast("int")
    out = cells.select("image_id", "v", "u", *[grey.alias(k) for k in COLOUR])
    if pixels is not None:
        own = pixels.join(found.select("image_id", "det_id").hint("shuffle_hash"), ["image_id", "det_id"], "left_semi")
        masks = D.painted(own, found).select("image_id", F.col("r").alias("v"), F.col("c").alias("u"), F.col("class_id").alias("_class"))
        edge = D.contours(own).select("image_id", F.col("r").alias("v"), F.col("c").alias("u"), F.lit(0).alias("_edge")).distinct() if outlines else masks.limit(0).select("image_id", "v", "u", F.lit(0).alias("_edge"))
        blend = lambda k: F.when(F.col("_edge").isNotNull(), 0).when(F.col("_class").isNotNull(), F.floor(F.col(k) * (1 - ALPHA) + colour(F.col("_class"), k) * ALPHA)).otherwise(F.col(k)).cast("int").alias(k)
        out = out.join(masks, ["image_id", "v", "u"], "left").join(edge, ["image_id", "v", "u"], "left").select("image_id", "v", "u", *[blend(k) for k in COLOUR])
    if not boxes:
        return out
    lines = framed(found).withColumnRenamed("class_id", "_class")
    top = lambda k: F.when(F.col("_class").isNotNull(), colour(F.col("_class"), k)).otherwise(F.col(k)).alias(k)
    return out.join(lines, ["image_id", "v", "u"], "left").select("image_id", "v", "u", *[top(k) for k in COLOUR])


def files(coloured: DataFrame, width: int, height: int, folder: str, suffix: str = "", texts: DataFrame | None = None) -> DataFrame:
    """(image_id, path, content): a PNG of each image of drawn(), row 0 at the bottom. texts (image_id, text), such as labels, go into the file as a comment."""
    said = texts if texts is not None else coloured.select("image_id").distinct().withColumn("text", F.lit(""))

    def draw(cells: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width, 3), np.uint8)
        image[cells["v"], cells["u"]] = cells[list(COLOUR)]
        name = str(cells["image_id"].iloc[0])
        return pd.DataFrame({"image_id": [name], "path": [f"{folder}/{name.replace('/', '_')}{suffix}.png"], "content": [png(image[::-1], cells["text"].iloc[0] or "")]})

    return coloured.join(said, "image_id", "left").groupBy("image_id").applyInPandas(draw, "image_id string, path string, content binary")


def captions(found: DataFrame) -> DataFrame:
    """(image_id, text): the labels of an image's detections, in order of det_id, for a file's comment."""
    one = F.struct("det_id", F.concat(F.col("class_name"), F.lit(" "), F.regexp_replace(F.format_number("score", 2), ",", "")).alias("t"))
    return found.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), "; ").alias("text"))


def grey(cells: DataFrame, feature: str) -> DataFrame:
    """Cells of one feature as drawn() gives them, without detections: the picture of a raster."""
    level = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.nanvl("value", F.lit(1.0)) * 255))).cast("int")
    return cells.select(F.concat_ws("/", F.col("image_id").cast("string"), F.lit(feature)).alias("image_id"), "v", "u", *[level.alias(k) for k in COLOUR])
