"""The whole run, from points and models to labelled points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import settings as S
from ..functions.lineage import cut
from ..functions.settings import DetectionSettings, ImageSettings, PointSettings
from ..operators import detections as D
from ..operators import images as I
from ..operators import models as M
from ..operators import points as P
from ..operators import spacing as G


def prepared(points: DataFrame, settings: PointSettings, transform: np.ndarray | None = None) -> DataFrame:
    """Cuts to range and region and adds spherical coordinates."""
    cut_ = P.roi_cut(P.range_cut(points, settings.range_limits), settings.roi_limits, np.eye(4) if transform is None else transform)
    return P.spherical(cut_)


def turned(points: DataFrame, settings: ImageSettings) -> DataFrame:
    """Spherical points turned about z: by the angle that puts the emptiest azimuth on the image border (auto), by degrees, or not at all."""
    said = settings.rotate.strip().lower()
    if said == "false":
        return points
    if said == "auto":
        angles = G.gap_rotation(G.azimuth_histogram(points))
        return P.spherical(P.rotated(points.join(angles, "station_id"), F.col("theta")).drop("theta"))
    return P.spherical(P.rotated(points, float(said)))


def sized(points: DataFrame, settings: ImageSettings, resolution: float) -> DataFrame:
    """A row for each station: its view, spacing (radians, null where nothing asks for it), width, height and factor of resizing."""
    view = P.field_of_view(points)
    said = str(settings.width).strip().lower()
    angle = S.scan_resolution(F.lit(settings.scan_resolution))
    out = view.withColumn("spacing", angle)
    if settings.scan_resolution.strip().lower() == "auto" and (settings.reduce or not said.isdigit()):
        out = view.join(G.spacing(points, view, settings.patches).select("station_id", "spacing"), "station_id", "left")
    out = out.withColumn("width", S.image_width(F.lit(said), F.col("az_max") - F.col("az_min"), F.col("spacing")).cast("int"))
    height = P.image_height(F.col("width")) if settings.height is None else F.lit(settings.height) if settings.height else P.default_height(F.col("width"))
    out = out.withColumn("height", height.cast("int")).withColumn("factor", F.lit(1.0))
    if settings.reduce:
        out = out.join(P.max_range(points), "station_id").withColumn("factor", G.gate(G.reduction(F.col("r_max"), F.degrees("spacing"), resolution))).drop("r_max")
    return cut(out)


def image_id(feature: Column) -> Column:
    return F.concat_ws("/", F.col("station_id").cast("string"), feature)


def rendered(points: DataFrame, sizes: DataFrame, settings: ImageSettings) -> DataFrame:
    """Points to normalised image cells, an image for each station and feature: (image_id, width, height, v, u, value), resized where the factor says so."""
    at = P.pixels(points.join(sizes, "station_id"), F.col("width"), F.col("height"))
    cells = I.raster(at, list(settings.features)).join(sizes.select("station_id", "width", "height", "factor"), "station_id")
    cells = cells.withColumn("image_id", image_id(F.col("feature"))).select("image_id", "width", "height", "factor", "v", "u", "value")
    images = cells.select("image_id", "width", "height", "factor").distinct()
    if settings.method == "nanconv":
        cells = I.spread_to_neighbours(cells, F.col("width"), F.col("height")).join(images, "image_id")
    cells = I.percentile_scaled(cells, *settings.percentiles)
    if not settings.reduce:
        return cells.drop("factor")
    dense = F.explode(F.sequence(F.lit(0), F.col("height") - 1))
    grid = images.filter("factor < 1").select("image_id", "width", "height", "factor", dense.alias("v")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("u"))
    full = grid.join(cells.select("image_id", "v", "u", "value"), ["image_id", "v", "u"], "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    small = I.resized(full, F.col("width"), F.col("height"), F.col("factor")).join(images.select("image_id", I.shrunk(F.col("width"), F.col("factor")).alias("width"), I.shrunk(F.col("height"), F.col("factor")).alias("height")), "image_id")
    keep = cells.filter("factor = 1").drop("factor")
    return keep.unionByName(small.select(*keep.columns))


def detected(cells: DataFrame, models: Callable[[], tuple[M.Detector, M.Segmenter]], settings: DetectionSettings, fill: str | float = "max") -> tuple[DataFrame, DataFrame]:
    """Image cells to detections and mask pixels in image pixels, both by (image_id, det_id), suppressed across tiles.

    Tiles go to the models, and what they find goes back to its image; border tiles are left out unless process_edges.
    """
    images = cells.select("image_id", "width", "height").distinct()
    tiles = D.tiles(images, settings.tile, settings.overlap)
    tiles = cut(tiles if settings.process_edges else D.whole_tiles(tiles, settings.tile))
    raw = M.inferred(M.tile_cells(cells, tiles, settings.tile, settings.overlap), models, settings.prompt, settings.batch, settings.large_share, settings.box_threshold, fill)
    raw = cut(raw.withColumn("det_id", M.det_id()))  # models run once
    names = D.class_map(images.sparkSession.range(1).select(F.lit(settings.prompt).alias("prompt")))
    found = D.boxes_to_image(raw.drop("pixels", "det"), tiles).join(F.broadcast(names), "class_name")  # as many rows as the prompt has classes
    found = cut(D.suppressed(found, settings.iou_threshold))
    pixels = raw.select("image_id", "tile_id", "det_id", F.explode("pixels").alias("p")).select("image_id", "tile_id", "det_id", "p.r", "p.c")
    pixels = pixels.join(found.select("image_id", "det_id"), ["image_id", "det_id"], "left_semi").join(images, "image_id")
    return found, D.masks_to_image(pixels, tiles, F.col("width"), F.col("height")).select("image_id", "det_id", "r", "c")


def labelled(points: DataFrame, found: DataFrame, pixels: DataFrame, by: str = "station_id") -> DataFrame:
    """Points with their pixels, with the labels of the masks over them."""
    return D.lifted(points, D.painted(pixels, found), by)


def run(points: DataFrame, models: Callable[[], tuple[M.Detector, M.Segmenter]], point_settings: PointSettings = PointSettings(), image_settings: ImageSettings = ImageSettings(), detection_settings: DetectionSettings = DetectionSettings(), transform: np.ndarray | None = None) -> DataFrame:
    """points -> images -> tiles -> models -> masks -> labelled points: a row for each point and feature, with image_id, u, v, instance, class_id and confidence."""
    at = cut(turned(prepared(points, point_settings, transform), image_settings))
    sizes = sized(at, image_settings, point_settings.output_resolution)
    found, pixels = detected(cut(rendered(at, sizes, image_settings)), models, detection_settings, image_settings.fill)
    small = sizes.withColumns({"width": I.shrunk(F.col("width"), F.col("factor")), "height": I.shrunk(F.col("height"), F.col("factor"))})
    seen = P.pixels(at.join(small, "station_id"), F.col("width"), F.col("height"))
    features = F.explode(F.array(*[F.lit(f) for f in image_settings.features]))
    seen = seen.withColumn("_feature", features).withColumn("image_id", image_id(F.col("_feature"))).drop("_feature", "factor", "spacing")
    return labelled(seen, found, pixels, "image_id")
