"""Scan spacing, the azimuth gap and exact samples: what a run decides before it draws an image.

All use every point; histograms and minima are partial aggregates, so one pass with little shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .quantiles import quantiles

#: Multiplier and modulus of the arithmetic hash that orders samples alike on every engine.
HASH, MODULUS = 2654435761, 4294967296


def bin_of(value: str, low: str, high: str, n: int) -> Column:
    """0..n-1 over [low, high], the last bin closed on the right."""
    width = (F.col(high) - F.col(low)) / F.lit(float(n))
    return F.least(F.lit(n - 1), F.floor(F.try_divide(F.col(value) - F.col(low), width)).cast("int"))


def view_histogram(points: DataFrame, fov: DataFrame, n: int) -> DataFrame:
    """Counts over n x n elevation and azimuth bins of each station's view; empty bins count 0."""
    dealt = points.join(fov, "station_id").select("station_id", bin_of("elev", "el_min", "el_max", n).alias("bin_e"), bin_of("azim", "az_min", "az_max", n).alias("bin_a"))
    counts = dealt.groupBy("station_id", "bin_e", "bin_a").agg(F.count(F.lit(1)).alias("n"))
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    grid = fov.select("station_id", F.explode(axis).alias("bin_e")).select("station_id", "bin_e", F.explode(axis).alias("bin_a"))
    return grid.join(counts, ["station_id", "bin_e", "bin_a"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def median_bin(histogram: DataFrame) -> DataFrame:
    """The bin whose count is nearest the exact median of all bins, first in row-major order; one a station."""
    middle = histogram.groupBy("station_id").agg(F.median("n").alias("median_n"))
    away = F.abs(F.col("n") - F.col("median_n"))
    return histogram.join(middle, "station_id").groupBy("station_id").agg(F.min(F.struct(away.alias("away"), "bin_e", "bin_a", "n", "median_n")).alias("b")).select("station_id", "b.bin_e", "b.bin_a", "b.n", "b.median_n")


def patch(points: DataFrame, fov: DataFrame, bins: DataFrame, n: int) -> DataFrame:
    """The points in the closed bin of their station."""
    edge = lambda low, high, i: F.col(low) + (F.col(high) - F.col(low)) / F.lit(float(n)) * i
    edges = bins.join(fov, "station_id").select(
        "station_id", edge("el_min", "el_max", F.col("bin_e")).alias("e0"), edge("el_min", "el_max", F.col("bin_e") + 1).alias("e1"),
        edge("az_min", "az_max", F.col("bin_a")).alias("a0"), edge("az_min", "az_max", F.col("bin_a") + 1).alias("a1"),
    )
    return points.join(edges, "station_id").filter(F.col("elev").between(F.col("e0"), F.col("e1")) & F.col("azim").between(F.col("a0"), F.col("a1"))).drop("e0", "e1", "a0", "a1")


def nearest(points: DataFrame, cell: float | str) -> DataFrame:
    """(station_id, point_id, d): distance in (elev, azim) to the nearest other point of the station, null for none.

    Points meet those of the 3 x 3 cells around them by an equi-join. A neighbour within one cell
    width is the nearest; points without one go on with cells of four times the width, which only the
    few lonely points reach. Once cells are wider than any view, what is left has no other point. cell: a
    width, or the name of a column that holds the station's.
    """
    own = F.col(cell) if isinstance(cell, str) else F.lit(float(cell))
    everything = cut(points.select("station_id", "point_id", "elev", "azim", own.alias("cell")))
    todo, done, wider = everything, None, 1.0
    least = everything.agg(F.min("cell")).first()[0] or 1.0
    while True:
        width = F.col("cell") * wider
        near = lambda k: F.floor(F.col(k) / width)  # noqa: B023, E731
        fixed = everything.select("station_id", F.col("point_id").alias("q"), F.col("elev").alias("qe"), F.col("azim").alias("qa"), near("elev").alias("ce"), near("azim").alias("ca"))
        around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        asked = todo.select("*", F.explode(F.transform(around, lambda i: near("elev") + i)).alias("ce")).select("*", F.explode(F.transform(around, lambda i: near("azim") + i)).alias("ca"))
        d = F.sqrt(F.pow(F.col("elev") - F.col("qe"), 2) + F.pow(F.col("azim") - F.col("qa"), 2))
        met = asked.join(fixed, ["station_id", "ce", "ca"]).filter("point_id <> q").groupBy("station_id", "point_id").agg(F.min(d).alias("d"))
        found = cut(todo.join(met, ["station_id", "point_id"], "left"))
        settled = found.filter(F.col("d") <= width).select("station_id", "point_id", "d")
        done = settled if done is None else done.unionByName(settled)
        todo = found.filter(F.col("d").isNull() | (F.col("d") > width)).select("station_id", "point_id", "elev", "azim", "cell")
        if least * wider > 4 * math.pi or todo.isEmpty():
            break
        wider *= 4
    return done.unionByName(todo.select("station_id", "point_id", F.lit(None).cast("double").alias("d")))


def spacing(points: DataFrame, fov: DataFrame, n: int) -> DataFrame:
    """(station_id, n_patch, spacing): median distance of the patch's points to their nearest neighbour; null below two points."""
    bins = median_bin(view_histogram(points, fov, n))
    inside = patch(points, fov, bins, n)
    area = (F.max("elev") - F.min("elev")) * (F.max("azim") - F.min("azim"))
    sizes = inside.groupBy("station_id").agg(F.greatest(F.sqrt(F.greatest(area, F.lit(1e-12)) / F.count(F.lit(1))), F.lit(1e-6)).alias("cell"))
    far = nearest(inside.join(sizes, "station_id"), "cell")
    counts = far.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_patch"))
    return counts.join(quantiles(far, "station_id", F.col("d"), {"spacing": 0.5}), "station_id")


def edge_and_least(histogram: DataFrame, width: float = 1.0) -> DataFrame:
    """(station_id, edge_n, min_n): points in the bins on the image border, and in the emptiest bin."""
    last = math.ceil(360 / width) - 1
    return histogram.groupBy("station_id").agg(F.sum(F.when(F.col("bin").isin(0, last), F.col("n"))).alias("edge_n"), F.min("n").alias("min_n"))


def azimuth_histogram(points: DataFrame, width: float = 1.0) -> DataFrame:
    """Counts over [-pi, pi] in bins of `width` degrees; empty bins count 0."""
    n = math.ceil(360 / width)
    bin_ = F.least(F.lit(n - 1), F.floor((F.col("azim") + math.pi) / F.radians(F.lit(width))).cast("int"))
    counts = points.groupBy("station_id", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return grid.join(counts, ["station_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def emptiest_run(histogram: DataFrame) -> DataFrame:
    """(station_id, start, len, centre): the longest run of bins at the minimum count, the first of equals; no wrap-around."""
    by = Window.partitionBy("station_id")
    least = histogram.withColumn("least", F.min("n").over(by)).filter("n = least")
    island = F.col("bin") - F.row_number().over(by.orderBy("bin"))
    runs = least.withColumn("island", island).groupBy("station_id", "island").agg(F.min("bin").alias("start"), F.count(F.lit(1)).alias("len"))
    best = runs.groupBy("station_id").agg(F.min(F.struct((-F.col("len")).alias("k"), "start", "len")).alias("b")).select("station_id", "b.start", "b.len")
    return best.withColumn("centre", (F.col("start") + F.floor(F.col("len") / 2)).cast("int"))


def gap_rotation(histogram: DataFrame, width: float = 1.0) -> DataFrame:
    """(station_id, theta): degrees that take the emptiest azimuth to the image border; 0 where the border is empty."""
    n = math.ceil(360 / width)
    edge = histogram.groupBy("station_id").agg(F.sum(F.when(F.col("bin").isin(0, n - 1), F.col("n")).otherwise(0)).alias("edge"))
    centre = -180.0 + (F.col("centre") + 0.5) * width
    return emptiest_run(histogram).join(edge, "station_id").select("station_id", F.when(F.col("edge") == 0, 0.0).otherwise(-180.0 - centre).alias("theta"))


def sampled(points: DataFrame, share: float, key: str = "point_id", buckets: int = 64) -> DataFrame:
    """Exactly int(N * share) rows of each station, those of the smallest hash; same rows at each run.

    Ranks are taken in buckets of the hash's range and offset by the counts of the buckets before.
    """
    h = F.pmod(F.col(key) * F.lit(HASH), F.lit(MODULUS))
    dealt = points.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / (MODULUS // buckets)).cast("int"))
    counts = dealt.groupBy("station_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("station_id")
    starts = counts.select("station_id", "_b", F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.floor(F.sum("_n").over(by) * share).alias("_m"))
    ranked = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("station_id", "_b").orderBy("_h", key)))
    return ranked.join(starts, ["station_id", "_b"]).filter("_start + _i <= _m").select(*points.columns)


def reduction(r_max: Column, spacing_degrees: float | Column, resolution: float) -> Column:
    """The factor by which an image may shrink at the wanted resolution; NaN where that is beyond the range."""
    angle = F.asin(F.try_divide(F.lit(resolution), r_max))
    return F.bround(F.try_divide(F.radians(spacing_degrees if isinstance(spacing_degrees, Column) else F.lit(spacing_degrees)), angle), 2)


def gate(coefficient: Column) -> Column:
    """The factor that an image is resized by: only one below 1 shrinks it; none else, NaN or null included, changes it."""
    return F.when((coefficient < 1) & (coefficient > 0), coefficient).otherwise(F.lit(1.0))
