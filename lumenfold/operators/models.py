"""Where detectors and segmenters plug in: table functions over tiles, one model instance a worker.

No weights are bundled. A detector takes a tile's pixels and a prompt and gives boxes; a segmenter takes
the pixels and boxes and gives pixel lists. Both run in one stage, so a tile's image crosses to Python
once; boxes go to the segmenter in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import model_input


class Detector(Protocol):
    def __call__(self, image: np.ndarray, prompt: str) -> list[tuple[str, float, tuple[float, float, float, float]]]:
        """(label, score, (x0, y0, x1, y1)) of each box, in tile pixels."""


class Segmenter(Protocol):
    def __call__(self, image: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> list[np.ndarray]:
        """(row, column) pairs for each box, in tile pixels."""


class Everything(Protocol):
    def __call__(self, image: np.ndarray) -> list[np.ndarray]:
        """Masks without a prompt."""


def tile_cells(cells: DataFrame, cut: DataFrame, size: tuple[int, int], overlap: tuple[int, int]) -> DataFrame:
    """(image_id, tile_id, x0, y0, x1, y1, v, u, value): each tile with the places and values of its own cells, as three arrays.

    A cell knows the few tiles it lies in by arithmetic, so it meets no other: an equi-join on the tile's corner.
    """

    def corners(at: str, length: int, step: int):
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - length + 1) / F.lit(step))).cast("int")
        return F.explode(F.transform(F.sequence(low, F.floor(F.col(at) / F.lit(step)).cast("int")), lambda i: i * step))

    (w, h), (ow, oh) = size, overlap
    dealt = cells.select("image_id", "v", "u", "value", corners("u", w, w - ow).alias("x0")).select("*", corners("v", h, h - oh).alias("y0"))
    one = F.struct((F.col("v") - F.col("y0")).cast("int").alias("v"), (F.col("u") - F.col("x0")).cast("int").alias("u"), F.col("value").cast("float").alias("value"))
    met = cut.join(dealt, ["image_id", "x0", "y0"]).filter((F.col("u") < F.col("x1")) & (F.col("v") < F.col("y1")))
    tiles = met.groupBy("image_id", "tile_id", "x0", "y0", "x1", "y1").agg(F.collect_list(one).alias("cells"))
    return tiles.select("image_id", "tile_id", "x0", "y0", "x1", "y1", "cells.v", "cells.u", "cells.value")


def picture(tile, fill: str | float) -> np.ndarray:
    """A row of tile_cells() as a dense image for a model."""
    image = np.full((tile.y1 - tile.y0, tile.x1 - tile.x0), np.nan, np.float32)
    image[tile.v, tile.u] = tile.value
    return model_input(image, fill)


def wanted(found: list, names: list[str], share: float, shape: tuple[int, int], least: float) -> list:
    """Detections that name a class, score over `least` and fill less than `share` of the tile: only these go to a segmenter."""
    out = []
    for label, score, box in found:
        name = label if label in names else next((k for k in names if k in label), None)
        if name is not None and score > least and (box[2] - box[0]) * (box[3] - box[1]) < share * shape[0] * shape[1]:
            out.append((name, score, box))
    return out


def pixels_of(mask) -> list[dict]:
    return [{"r": int(r), "c": int(c)} for r, c in mask]


MASK = "pixels array<struct<r:int,c:int>>"
FOUND = "tile_id int, det int, class_name string, score double, x0 double, y0 double, x1 double, y1 double, " + MASK


def inferred(tiles: DataFrame, models: Callable[[], tuple[Detector, Segmenter]], prompt: str, batch: int = 16, share: float = float("inf"), least: float = float("-inf"), fill: str | float = "max") -> DataFrame:
    """Detections with their mask pixels, for each tile of tile_cells(). models() runs once in a worker's task."""
    names = prompt.split(".")

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect, segment = models()
        for frame in frames:
            rows = []
            for t in frame.itertuples():
                image = picture(t, fill)
                found = wanted(detect(image, prompt), names, share, image.shape, least)
                masks: list[np.ndarray] = []
                for i in range(0, len(found), batch):
                    masks += segment(image, [f[2] for f in found[i : i + batch]])
                if len(masks) != len(found):
                    raise ValueError("a segmenter must give one mask a box")
                rows += [(t.image_id, t.tile_id, i, name, float(score), *map(float, box), pixels_of(mask)) for i, ((name, score, box), mask) in enumerate(zip(found, masks, strict=True))]
            yield pd.DataFrame(rows, columns=["image_id", "tile_id", "det", "class_name", "score", "x0", "y0", "x1", "y1", "pixels"])

    return tiles.mapInPandas(stage, f"image_id {dict(tiles.dtypes)['image_id']}, {FOUND}")


def det_id() -> Column:
    """A number for a detection within its image, from its tile and place there."""
    return F.shiftleft(F.col("tile_id").cast("long"), 24) + F.col("det")


def everything(tiles: DataFrame, model: Callable[[], Everything], fill: str | float = "max") -> DataFrame:
    """Masks without classes: (image_id, tile_id, det, area, pixels)."""

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = model()
        for frame in frames:
            rows = []
            for t in frame.itertuples():
                rows += [(t.image_id, t.tile_id, i, len(mask), pixels_of(mask)) for i, mask in enumerate(generate(picture(t, fill)))]
            yield pd.DataFrame(rows, columns=["image_id", "tile_id", "det", "area", "pixels"])

    return tiles.mapInPandas(stage, f"image_id {dict(tiles.dtypes)['image_id']}, tile_id int, det int, area long, {MASK}")
