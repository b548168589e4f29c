"""Detections: tiles, class names, cuts, non-maximum suppression, masks, merging, run lengths, lifting."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


# Tiles

def tiles(images: DataFrame, size: tuple[int, int], overlap: tuple[int, int]) -> DataFrame:
    """(image_id, tile_id, x0, y0, x1, y1) over images of (image_id, width, height); border tiles are clipped."""
    (w, h), (ow, oh) = size, overlap
    out = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(h - oh))).alias("y0"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(w - ow))).alias("x0"))
    across = F.floor((F.col("width") - 1) / (w - ow)) + 1
    number = (F.col("y0") / (h - oh) * across + F.col("x0") / (w - ow)).cast("int")
    return out.select("image_id", number.alias("tile_id"), "x0", "y0", F.least(F.col("x0") + w, "width").alias("x1"), F.least(F.col("y0") + h, "height").alias("y1"))


def whole_tiles(cut: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Drops clipped tiles."""
    return cut.filter((F.col("x1") - F.col("x0") == size[0]) & (F.col("y1") - F.col("y0") == size[1]))


def boxes_to_image(found: DataFrame, cut: DataFrame) -> DataFrame:
    """Boxes in tile pixels to image pixels."""
    at = cut.select("image_id", "tile_id", F.col("x0").alias("tx"), F.col("y0").alias("ty"))
    moved = {k: F.col(k) + F.col("tx" if k[0] == "x" else "ty") for k in ("x0", "y0", "x1", "y1")}
    return found.join(at, ["image_id", "tile_id"]).withColumns(moved).drop("tx", "ty")


def masks_to_image(pixels: DataFrame, cut: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Mask pixels in tile pixels to image pixels; what falls outside of the image goes. Fails on a tile that starts below 0."""
    offset = lambda k, to: F.when(F.col(k) < 0, F.raise_error(F.lit("a tile starts outside of its image"))).otherwise(F.col(k)).alias(to)
    at = cut.select("image_id", "tile_id", offset("x0", "tx"), offset("y0", "ty"))
    moved = pixels.join(at, ["image_id", "tile_id"]).withColumns({"r": F.col("r") + F.col("ty"), "c": F.col("c") + F.col("tx")}).drop("tx", "ty")
    return moved.filter(F.col("r").between(F.lit(0), height - F.lit(1)) & F.col("c").between(F.lit(0), width - F.lit(1)))


# Classes and cuts

def class_names(prompt: Column) -> Column:
    """The classes of a prompt, in order; empty names and spaces stay."""
    return F.split(prompt, r"\.")


def class_map(prompts: DataFrame) -> DataFrame:
    """(class_id, class_name) of a one-prompt table: ids from 1 by place; of equal names the last id."""
    named = prompts.select(F.posexplode(class_names(F.col("prompt"))).alias("p", "class_name"))
    return named.groupBy("class_name").agg((F.max("p") + 1).alias("class_id")).select("class_id", "class_name")


def resolved(label: Column, prompt: Column) -> Column:
    """The label itself where it is a class, else the first class that is part of it, else null."""
    names = class_names(prompt)
    return F.coalesce(F.when(F.array_contains(names, label), label), F.get(F.filter(names, lambda k: F.contains(label, k)), 0))


def box_area() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def without_large(found: DataFrame, share: float, width: int, height: int) -> DataFrame:
    """Keeps boxes below a share of the tile's or image's area."""
    return found.filter(box_area() < share * width * height)


def scoring_over(found: DataFrame, least: float) -> DataFrame:
    return found.filter(F.col("score") > least)


def score_label(name: Column, score: Column) -> Column:
    return F.concat(name, F.lit(" "), F.regexp_replace(F.format_number(score, 2), ",", ""))


# Non-maximum suppression

def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    both = side("x0", "x1") * side("y0", "y1")
    return F.try_divide(both, area(a) + area(b) - both)


def in_cells(boxes: DataFrame, sides: tuple[float, float], home: bool) -> DataFrame:
    """Adds cx, cy of a grid whose cells no box outgrows: a box's own cell by its lower corner, or all own cells of boxes that may meet it."""
    at = lambda k, side: F.floor(F.col(k) / F.lit(side))
    (w, h), out = sides, boxes
    for lo, hi, side, name in (("x0", "x1", w, "cx"), ("y0", "y1", h, "cy")):
        out = out.withColumn(name, at(lo, side) if home else F.explode(F.sequence(at(lo, side) - 1, at(hi, side))))
    return out


def folded(top: DataFrame, threshold: float, keys: Sequence[str], sides: tuple[float, float]) -> DataFrame:
    """The rows of ranked boxes (_rank) that no better kept box of their group suppresses."""
    a, b = in_cells(top, sides, False).alias("a"), in_cells(top, sides, True).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.cx") == F.col("b.cx"), F.col("a.cy") == F.col("b.cy"), F.col("a._rank") < F.col("b._rank"), overlap("a", "b") > threshold]
    over = a.join(b, on=same).groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b._rank").alias("_rank")).agg(F.collect_set("a._rank").alias("better"))
    none = F.array().cast("array<int>")
    listed = top.select(*keys, "_rank", none.alias("better")).unionByName(over).groupBy(*keys, "_rank").agg(F.flatten(F.collect_list("better")).alias("better"))
    boxes = F.sort_array(F.collect_list(F.struct("_rank", "better")))
    step = lambda s, x: F.when(F.arrays_overlap(s, x["better"]), s).otherwise(F.array_append(s, x["_rank"]))
    kept = listed.groupBy(*keys).agg(boxes.alias("boxes")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.explode(F.aggregate("boxes", none, step)).alias("_k"))
    return top.join(kept, [top[k].eqNullSafe(kept[f"_k_{k}"]) for k in keys] + [top["_rank"] == kept["_k"]], "left_semi").drop("_rank")


def suppressed(found: DataFrame, threshold: float, keys: Sequence[str] = ("image_id", "class_id"), first: int = 1000, most: int = 16000, small: int = 50000) -> DataFrame:
    """Greedy non-maximum suppression by descending score (ties by det_id), within each image and class.

    In rounds: the best boxes left of each group (`first`, up to `most` where few of them overlap) are folded by rank, and what
    they keep suppresses all others in one join on grid cells. So boxes meet kept boxes, not each other; every box is kept or
    suppressed in some round. Boxes without area overlap nothing and stay. What a round keeps is broadcast up to `small` rows,
    else joined by shuffle. A det_id names a box within its image only.
    """
    if threshold < 0:
        raise ValueError("a threshold below 0 lets boxes suppress others that they do not touch")
    if threshold >= 1:
        return found  # no overlap is above 1
    keys, cols = list(keys), found.columns
    x, y = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    solid = F.coalesce((x > 0) & (x < math.inf) & (y > 0) & (y < math.inf), F.lit(False))
    left, out, n, late = found.filter(solid), found.filter(~solid), first, False
    sides = left.agg(F.max(x).cast("double"), F.max(y).cast("double")).first()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "det_id"))
    while sides[0] is not None:
        top = cut(left.withColumn("_rank", rank).filter(F.col("_rank") <= n))
        new = cut(folded(top, threshold, keys, tuple(sides)))
        took, kept = top.count(), new.count()
        if not took:
            break
        out = out.unionByName(new)
        met = in_cells(new.select(*keys, "det_id", "score", "x0", "y0", "x1", "y1"), tuple(sides), False)
        a, b = in_cells(left, tuple(sides), True).alias("a"), (F.broadcast(met) if kept <= small else met).alias("b")
        itself = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("det_id", "score", "x0", "y0", "x1", "y1")]
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.cx") == F.col("b.cx"), F.col("a.cy") == F.col("b.cy"), (overlap("a", "b") > threshold) | functools.reduce(Column.__and__, itself)]
        left = a.join(b, functools.reduce(Column.__and__, same), "left_anti").select(*cols)
        left, late, n = cut(left) if late else left, True, min(most, 4 * n) if 4 * kept > took else n
    return out


def area_ranked(found: DataFrame) -> DataFrame:
    """Adds place: boxes of an image by area, largest first, ties by det_id."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(box_area().desc(), "det_id")))


def of_all_tiles(tables: Sequence[DataFrame]) -> DataFrame:
    """Detections of several tiles in one table, nothing dropped."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# Masks

def whole_masks(found: DataFrame, least: int = 64) -> DataFrame:
    """Rows dealt by (image_id, det_id), before they become pixels: what follows mask by mask then moves boxes, not pixels."""
    return found.repartition(max(least, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "image_id", "det_id")


def mask_pixels(found: DataFrame) -> DataFrame:
    """Every pixel of the boxes: (det_id, image_id, r, c)."""
    return whole_masks(found.select("det_id", "image_id", "x0", "x1", "y0", "y1")).select("det_id", "image_id", "x0", "x1", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("r")).select("det_id", "image_id", "r", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("c"))


def distinct_pixels(pixels: DataFrame) -> DataFrame:
    """Each pixel of a mask once."""
    return pixels.dropDuplicates(["det_id", "image_id", "r", "c"])


def set_pixels(dense: DataFrame, values: str, width: int) -> DataFrame:
    """(image_id, r, c) of what is above zero in row-major arrays; NaN is not."""
    cells = dense.select("image_id", F.posexplode(values).alias("p", "e")).filter((F.col("e") > 0) & ~F.isnan("e"))
    return cells.select("image_id", F.floor(F.col("p") / width).cast("int").alias("r"), (F.col("p") % width).cast("int").alias("c"))


def words(rows: DataFrame, keys: Sequence[str], place: Column, by: str) -> DataFrame:
    """(keys, by, w): bit i of word `by` is set where a row has the place 64 * by + i."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return rows.groupBy(*keys, F.floor(place / 64).alias(by)).agg(F.bit_or(bit).alias("w"))


def set_bits(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """(keys, p): the places that words() was given; bytes without a bit are not opened."""
    part = lambda k, most: F.call_function("shiftright", F.col("w"), k).bitwiseAND(F.lit(most))
    eight, j = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"), F.col("j")
    bytes_ = rows.select(*keys, by, "w", eight).select(*keys, (F.col(by) * 64 + j * 8).alias("p"), part(j * 8, 255).alias("w")).filter("w <> 0")
    return bytes_.select(*keys, "p", "w", eight).filter(part(j, 1) != 0).select(*keys, (F.col("p") + j).alias("p"))


def contours(pixels: DataFrame) -> DataFrame:
    """The pixels of each mask with a side on the outside of it: (image_id, det_id, r, c).

    Rows of a mask become words of 64 bits. A word meets the words above and below, and the nearest bit of the words
    beside it, in one aggregation; what has all four sides goes. Null names no mask: its pixels are all on the outside.
    """
    mask = ["image_id", "det_id"]
    w, zero = F.col("w"), F.lit(0).cast("long")
    to = lambda kind, r, b, bits: F.struct(F.lit(kind).alias("kind"), (F.col("r") + r).alias("r"), (F.col("b") + b).alias("b"), bits.alias("w"))
    met = F.array(to(0, 0, 0, w), to(1, 1, 0, w), to(2, -1, 0, w), to(3, 0, 1, F.shiftrightunsigned(w, 63)), to(4, 0, -1, F.shiftleft(w, 63)))
    seen = words(pixels, [*mask, "r"], F.col("c"), "b").select(*mask, F.explode(met).alias("s")).select(*mask, "s.*").filter(w != 0)
    own, up, down, left, right = (F.bit_or(F.when(F.col("kind") == k, w).otherwise(zero)).alias(n) for k, n in enumerate(("own", "up", "down", "left", "right")))
    all_ = seen.groupBy(*mask, "r", "b").agg(own, up, down, left, right)
    sides = F.shiftleft("own", 1).bitwiseOR(F.col("left")).bitwiseAND(F.shiftrightunsigned("own", 1).bitwiseOR(F.col("right")))
    inner = F.when(F.col("image_id").isNull() | F.col("det_id").isNull(), zero).otherwise(sides.bitwiseAND(F.col("up")).bitwiseAND(F.col("down")))
    edge = all_.select(*mask, "r", "b", F.col("own").bitwiseAND(F.bitwise_not(inner)).alias("w")).filter(w != 0)
    return set_bits(edge, [*mask, "r"], "b").withColumn("c", F.col("p").cast(pixels.schema["c"].dataType)).drop("p")


def ranked_by_size(pixels: DataFrame, distinct: bool = False) -> DataFrame:
    """(image_id, det_id, n, instance): masks from 1 by pixel count, largest first, ties by the later det_id."""
    n = F.count_distinct("r", "c") if distinct else F.count(F.lit(1))
    counts = pixels.groupBy("image_id", "det_id").agg(n.alias("n"))
    order = Window.partitionBy("image_id").orderBy(F.col("n").desc(), F.col("det_id").desc())
    return counts.withColumn("instance", F.row_number().over(order))


def painted(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, r, c, instance, class_id, confidence): the smallest mask over a pixel wins; background has no row.

    Painting from large to small leaves the mask of the largest rank, so a maximum says it all. The joins are by shuffled
    hash: Spark takes exploded pixels to be as small as their boxes and would broadcast them.
    """
    ranks = ranked_by_size(pixels).join(whole_masks(found.select("image_id", "det_id", "class_id", "score")).hint("shuffle_hash"), ["image_id", "det_id"])
    by = pixels.join(ranks.select("image_id", "det_id", "instance", "class_id", "score").hint("shuffle_hash"), ["image_id", "det_id"])
    top = by.groupBy("image_id", "r", "c").agg(F.max("instance").alias("instance"), F.max_by("class_id", "instance").alias("class_id"), F.max_by("score", "instance").alias("confidence"))
    return top.withColumn("confidence", F.col("confidence").cast("float"))


def lifted(points: DataFrame, labels: DataFrame, by: str = "station_id") -> DataFrame:
    """Points with instance, class_id and confidence of their pixel in the image that `by` names: 0 on background, -1 out of view. One join for all."""
    at = labels.select(F.col("image_id").alias(by), F.col("r").alias("v"), F.col("c").alias("u"), "instance", "class_id", "confidence")
    got = lambda k: F.when(F.col("valid"), F.coalesce(k, F.lit(0))).otherwise(-1).alias(k)
    return points.join(at, [by, "v", "u"], "left").select(*points.columns, got("instance"), got("class_id"), got("confidence").cast("float").alias("confidence"))


# Run lengths

def run_lengths(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(image_id, det_id, counts): alternating lengths of empty and set runs in column-major order, empty first.

    A run turns where a bit differs from the one before it; the lengths lie between the turns.
    """
    mask, w, zero = ["image_id", "det_id"], F.col("w"), F.lit(0).cast("long")
    met = F.array(F.struct(F.lit(0).alias("kind"), F.col("b"), w.alias("w")), F.struct(F.lit(1).alias("kind"), (F.col("b") + 1).alias("b"), F.shiftrightunsigned(w, 63).alias("w")))
    seen = words(pixels, mask, F.col("c") * height + F.col("r"), "b").select(*mask, F.explode(met).alias("s")).select(*mask, "s.*").filter(w != 0)
    own, before = (F.bit_or(F.when(F.col("kind") == k, w).otherwise(zero)).alias(n) for k, n in enumerate(("own", "before")))
    turns = seen.groupBy(*mask, "b").agg(own, before).select(*mask, "b", F.col("own").bitwiseXOR(F.shiftleft("own", 1).bitwiseOR(F.col("before"))).alias("w"))
    listed = set_bits(turns, mask, "b").groupBy(*mask).agg(F.sort_array(F.collect_list(F.col("p").cast("int"))).alias("t"))
    lengths = F.transform("t", lambda x, i: x - F.when(i > 0, F.get("t", i - 1)).otherwise(0))
    rest = F.lit(height * width) - F.element_at("t", -1)
    return listed.select(*mask, F.when(rest > 0, F.array_append(lengths, rest)).otherwise(lengths).alias("counts"))


def from_run_lengths(encoded: DataFrame, height: int) -> DataFrame:
    """The inverse: (image_id, det_id, r, c)."""
    by = Window.partitionBy("image_id", "det_id").orderBy("i")
    runs = encoded.select("image_id", "det_id", F.posexplode("counts").alias("i", "n")).withColumn("end", F.sum("n").over(by))
    inside = runs.filter("i % 2 = 1 AND n > 0").select("image_id", "det_id", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("p"))
    return inside.select("image_id", "det_id", (F.col("p") % height).cast("int").alias("r"), F.floor(F.col("p") / height).cast("int").alias("c"))


# Lists and documents

def first_by_hash(found: DataFrame, n: int, by: str = "image_id") -> DataFrame:
    """n detections of each image, chosen by a hash; all where there are no more. For pictures only: a top-n report."""
    h = F.pmod(F.col("det_id") * F.lit(2654435761), F.lit(4294967296))
    return found.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(h, "det_id"))).filter(F.col("_i") <= n).drop("_i")


def batches(found: DataFrame, n: int, by: str = "image_id") -> DataFrame:
    """Adds batch: n detections of an image go to a segmenter at once."""
    return found.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy("det_id")) - 1) / n).cast("int"))


def documents(found: DataFrame, encoded: DataFrame, names: DataFrame, width: int, height: int, pieces: int = 256) -> DataFrame:
    """(image_id, json): one annotation document an image, detections in order of det_id.

    Annotations become text at once and pieces of a document over ranges of det_id, so that its last task joins a few hundred
    texts. That task and the writer hold the document several times.
    """
    rows = whole_masks(found).join(encoded.hint("shuffle_hash"), ["image_id", "det_id"]).join(F.broadcast(names), "class_id")  # as many names as the prompt has classes
    low, high = found.agg(F.min("det_id"), F.max("det_id")).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // pieces))
    one = F.to_json(F.struct(F.col("class_name"), F.array("x0", "y0", "x1", "y1").alias("bbox"), F.struct(F.array(F.lit(height), F.lit(width)).alias("size"), F.col("counts")).alias("segmentation"), "score"))
    joined = lambda c, t: F.array_join(F.transform(F.sort_array(F.collect_list(c)), t), ",")
    dealt = rows.select("image_id", F.floor((F.col("det_id") - F.lit(low or 0)) / step).alias("piece"), F.struct("det_id", one.alias("t")).alias("a"))
    texts = dealt.groupBy("image_id", "piece").agg(joined("a", lambda x: x["t"]).alias("t"))
    path = F.to_json(F.struct(F.concat(F.lit("images/"), F.col("image_id"), F.lit(".png")).alias("image_path")))
    head, tail = F.concat(F.substr(path, F.lit(1), F.length(path) - 1), F.lit(',"annotations":[')), f'],"box_format":"xyxy","img_width":{width},"img_height":{height}}}'
    listed = texts.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("piece", "t"))).alias("l"))
    ends = lambda x, i: F.concat(F.when(i == 0, head).otherwise(""), x["t"], F.when(i == F.size("l") - 1, tail).otherwise(""))
    return listed.select("image_id", F.array_join(F.transform("l", ends), ",").alias("json"))


def class_document(names: DataFrame) -> DataFrame:
    """One row: the map of ids to names, with 0 for background, as a JSON text."""
    every = names.select("class_id", "class_name").unionByName(names.sparkSession.range(1).select(F.lit(0).alias("class_id"), F.lit("background").alias("class_name")))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("class_id", "class_name"))), lambda x: F.struct(x["class_id"].cast("string").alias("k"), x["class_name"].alias("v")))
    return every.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))
