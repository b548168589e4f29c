"""Exact quantiles of any number of values a group, without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges that a group is counted in.
RANGES = 1024


def quantiles(df: DataFrame, by: str, value: Column, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): linear between neighbours; NaN and null left out; null for a group of no value.

    Values are counted in RANGES between the group's limits. Only the few ranges that hold a wanted rank go on:
    their distinct values are counted and ranked.
    """
    real = df.select(by, value.cast("double").alias("x")).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    span = real.groupBy(by).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    at = F.least(F.lit(RANGES - 1), F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * RANGES), F.lit(0)))
    dealt = real.filter("x is not null").join(span, by).select(by, "x", at.cast("int").alias("range"))
    order = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(by, "range").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.coalesce(F.sum("k").over(order), F.lit(0)))
    place = F.create_map(*[x for name, share in shares.items() for x in (F.lit(name), F.lit(float(share)) * (F.col("n") - 1))])
    asked = span.filter("n > 0").select(by, F.explode(place).alias("name", "place"))
    ranks = asked.select(by, "name", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    inside = ranks.join(counts, by).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k")))
    few = dealt.join(inside.select(by, "range").distinct(), [by, "range"], "left_semi").groupBy(by, "range", "x").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy(by, "range").orderBy("x")
    few = few.withColumn("upto", F.sum("k").over(upto)).select(by, "range", "x", (F.col("upto") - F.col("k")).alias("from"), "upto")
    found = inside.join(few, [by, "range"]).filter((F.col("rank") - F.col("before") >= F.col("from")) & (F.col("rank") - F.col("before") < F.col("upto")))
    weight = F.when(F.floor("place") == F.ceil("place"), 1.0).otherwise(1 - F.abs(F.col("place") - F.col("rank")))
    values = found.groupBy(by, "name").agg(F.sum(weight * F.col("x")).alias("q"))
    wide = values.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares])
    return span.select(by).join(wide, by, "left")
