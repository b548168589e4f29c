"""Points: spherical coordinates, rigid transforms, range and region cuts, fields of view, pixels.

A point table has station_id, point_id, x, y, z and any feature columns. Conventions: elevation is
asin(z / r) above the horizon, azimuth atan2(y, x); limits are inclusive.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



#: What pi has beyond its double.
PI_REST = 1.2246467991473532e-16


def azimuth(y: Column, x: Column, near: float = 1e-9) -> Column:
    """atan2, to the last digit beside the axes and diagonals, where histograms have borders and atan2 differs between libraries.

    There it is an eighth of a turn and a tangent so small that it is its own angle; differences of near equals are exact.
    """
    a, b = F.abs(y), F.abs(x)
    beside = lambda eighths, rest: F.signum(y) * (F.lit(eighths * math.pi / 4) + (F.lit(eighths * PI_REST / 4) + rest))
    diagonal = F.try_divide(a - b, a + b)
    axis = F.when((a <= b * near) & (x < 0) & (y != 0), beside(4, -a / b)).when((b <= a * near) & (a > 0), beside(2, -x / a))
    return axis.when((F.abs(diagonal) <= near) & (x > 0), beside(1, diagonal)).when((F.abs(diagonal) <= near) & (x < 0), beside(3, -diagonal)).otherwise(F.atan2(y, x))


def spherical(points: DataFrame) -> DataFrame:
    """Adds r, elev, azim (radians). A point at the origin has null elevation."""
    x, y, z = (F.col(k) for k in "xyz")
    r = F.sqrt(x * x + y * y + z * z)
    return points.withColumns({"r": r, "elev": F.asin(F.try_divide(z, r)), "azim": azimuth(y, x)})


def range_cut(points: DataFrame, limits: tuple[float, float] | None) -> DataFrame:
    """Keeps low <= r <= high. The redundant box lets the cut reach the scan, which holds no r."""
    if limits is None:
        return points
    low, high = limits
    box = [F.col(k).between(-high, high) for k in "xyz"]
    r = F.sqrt(sum((F.col(k) * F.col(k) for k in "xyz"), F.lit(0.0)))
    return points.filter(box[0] & box[1] & box[2] & r.between(low, high))


def corners(low: Sequence[float], high: Sequence[float]) -> np.ndarray:
    """The eight corners of a box."""
    return np.array(list(itertools.product(*zip(low, high, strict=True))), float)


def box_in_scanner(roi: Sequence[float], transform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axis-aligned bounds, in the scanner's frame, of a project-frame box: a superset of the rotated box."""
    back = np.linalg.inv(np.asarray(transform, float))
    eight = np.c_[corners(roi[:3], roi[3:]), np.ones(8)] @ back.T
    return eight[:, :3].min(0), eight[:, :3].max(0)


def roi_cut(points: DataFrame, roi: Sequence[float] | None, transform: np.ndarray) -> DataFrame:
    """Keeps the points in the scanner-frame bounds of [xmin, ymin, zmin, xmax, ymax, zmax]."""
    if roi is None:
        return points
    low, high = box_in_scanner(roi, transform)
    inside = [F.col(k).between(float(a), float(b)) for k, a, b in zip("xyz", low, high, strict=True)]
    return points.filter(inside[0] & inside[1] & inside[2])


def transformed(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Applies a 4x4 matrix to x, y, z."""
    m = np.asarray(matrix, float)
    row = lambda i: sum((F.col(k) * float(m[i, j]) for j, k in enumerate("xyz")), F.lit(float(m[i, 3])))
    return points.withColumns({k: row(i) for i, k in enumerate("xyz")})


def rotated(points: DataFrame, degrees: float | Column) -> DataFrame:
    """Rotates about z, counter-clockwise."""
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    x, y = F.col("x"), F.col("y")
    return points.withColumns({"x": x * F.cos(a) - y * F.sin(a), "y": x * F.sin(a) + y * F.cos(a)})


def bounds(points: DataFrame, by: str = "station_id") -> DataFrame:
    """Axis-aligned bounds of each station."""
    return points.groupBy(by).agg(*[f(k).alias(f"{k}_{n}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def box_corners(boxes: DataFrame) -> DataFrame:
    """bounds() to eight rows a box."""
    pick = lambda k: F.explode(F.array(f"{k}_min", f"{k}_max")).alias(k)
    keys = [c for c in boxes.columns if not c.endswith(("_min", "_max"))]
    rest = lambda *done: [f"{k}_{n}" for k in "xyz" if k not in done for n in ("min", "max")]
    return boxes.select(*keys, *rest("x"), pick("x")).select(*keys, "x", *rest("x", "y"), pick("y")).select(*keys, "x", "y", pick("z"))


def field_of_view(points: DataFrame, by: str = "station_id") -> DataFrame:
    """Least and largest azimuth and elevation of each station, from spherical points."""
    return points.groupBy(by).agg(F.min("azim").alias("az_min"), F.max("azim").alias("az_max"), F.min("elev").alias("el_min"), F.max("elev").alias("el_max"))


def with_view(points: DataFrame, fov: DataFrame, by: str = "station_id") -> DataFrame:
    """A row for each station meets its points; Spark broadcasts it while its measured size allows.

    An outer join never broadcasts its left side: Spark takes a table of few columns to be smaller than the view made of
    it and would broadcast the points. Points of no station go; those of a station without a view have nulls in its place.
    """
    return points.filter(F.col(by).isNotNull()).join(fov, by, "left")


def pixels(points: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Adds valid, u, v from azim, elev and the view's bounds; -1 outside of the view. Row 0 is the lowest elevation."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    na = F.try_divide(F.col("azim") - F.col("az_min"), F.col("az_max") - F.col("az_min"))
    ne = F.try_divide(F.col("elev") - F.col("el_min"), F.col("el_max") - F.col("el_min"))
    valid = F.coalesce(na.between(0, 1) & ne.between(0, 1), F.lit(False))
    place = lambda n, size: F.when(F.col("valid"), F.greatest(F.lit(0), F.least(size - 1, F.rint(n * (size - 1)).cast("int")))).otherwise(-1)
    return points.withColumn("valid", valid).withColumns({"u": place(na, w).cast("int"), "v": place(ne, h).cast("int")})


def max_range(points: DataFrame, by: str = "station_id") -> DataFrame:
    return points.groupBy(by).agg(F.max("r").alias("r_max"))


def thinned(points: DataFrame, size: float, features: Sequence[str] = (), by: str = "station_id") -> DataFrame:
    """One row a voxel: counts and means."""
    cell = {f"v{k}": F.floor(F.col(k) / size) for k in "xyz"}
    means = [F.avg(k).alias(k) for k in ("x", "y", "z", *features)]
    return points.withColumns(cell).groupBy(by, *cell).agg(F.count(F.lit(1)).alias("n"), *means)


def image_height(width: Column) -> Column:
    """Rows of an image of square pixels, from the view's spans, rounded up."""
    span = lambda a: F.col(f"{a}_max") - F.col(f"{a}_min")
    return F.ceil(width * F.try_divide(span("el"), span("az"))).cast("int")


def default_height(width: Column) -> Column:
    """Rows where none are asked for: the width over the view's ratio of azimuth to elevation, rounded down."""
    span = lambda a: F.col(f"{a}_max") - F.col(f"{a}_min")
    return F.floor(F.try_divide(width, F.try_divide(span("az"), span("el")))).cast("int")
