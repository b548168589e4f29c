"""Hand-made images, properties, parsers, plans, files, models and streams."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import settings as S
from lumenfold.operators import detections as D
from lumenfold.operators import images as I
from lumenfold.operators import models as M
from lumenfold.operators import points as P
from lumenfold.operators import spacing as G
from lumenfold.plans import fixtures as X
from lumenfold.plans import labelling as L
from lumenfold.plans import queries as Q
from lumenfold.sources import files
from lumenfold.streaming import stations

# Masks of a 4 x 5 image: A 12 pixels, B 6, C 1, partly over each other
A = [(r, c) for r in range(3) for c in range(4)]
B = [(r, c) for r in (1, 2) for c in (2, 3, 4)]
C = [(1, 2)]


@pytest.fixture
def golden(spark):
    pixels = spark.createDataFrame([(d, 0, r, c) for d, m in ((10, A), (11, B), (12, C)) for r, c in m], "det_id long, image_id int, r int, c int")
    found = spark.createDataFrame([(10, 0, 1, 0.5), (11, 0, 2, 0.75), (12, 0, 3, 0.25)], "det_id long, image_id int, class_id int, score double")
    return pixels, found


def test_painter(golden):
    got = {(x.r, x.c): (x.instance, x.class_id, x.confidence) for x in D.painted(*golden).collect()}
    assert got[1, 2] == (3, 3, 0.25) and got[2, 3] == (2, 2, 0.75) and got[0, 0] == (1, 1, 0.5)
    assert (3, 4) not in got and len(got) == len(set(A) | set(B))


def test_painter_ignores_row_order(golden):
    pixels, found = golden
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(D.painted(pixels, found)) == key(D.painted(pixels.orderBy(F.rand(1)), found.orderBy(F.rand(2))))


def test_lift(spark, golden):
    points = spark.createDataFrame([(0, 1, 1, 2, True), (0, 2, 3, 4, True), (0, 3, -1, -1, False)], "station_id int, point_id long, v int, u int, valid boolean")
    got = {x.point_id: (x.instance, x.class_id, round(x.confidence, 2)) for x in D.lifted(points, D.painted(*golden)).collect()}
    assert got == {1: (3, 3, 0.25), 2: (0, 0, 0.0), 3: (-1, -1, -1.0)}


def test_run_lengths_by_hand(golden):
    got = {x.det_id: x.counts for x in D.run_lengths(golden[0], 4, 5).collect()}
    assert got[12] == [9, 1, 10]  # column-major: (1, 2) is at 2 * 4 + 1
    assert got[10] == [0, 3, 1, 3, 1, 3, 1, 3, 5]


def test_run_lengths_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(d, 0, int(r), int(c)) for d in range(6) for r, c in zip(*np.nonzero(rng.random((9, 7)) < 0.15 * (d + 1)), strict=True)]
    df = spark.createDataFrame(rows, "det_id long, image_id int, r int, c int")
    back = D.from_run_lengths(D.run_lengths(df, 9, 7), 9)
    assert sorted((x.det_id, x.image_id, x.r, x.c) for x in back.collect()) == sorted(rows)


def greedy(boxes, threshold):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b.score, b.det_id)):
        def iou(k):
            w, h = min(k.x1, b.x1) - max(k.x0, b.x0), min(k.y1, b.y1) - max(k.y0, b.y0)
            i = max(0, w) * max(0, h)
            return i / ((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i)

        if all((k.image_id, k.class_id) != (b.image_id, b.class_id) or iou(k) <= threshold for k in kept):
            kept.append(b)
    return {b.det_id for b in kept}


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.8])
def test_suppression_against_a_plain_loop(spark, small, threshold):
    found = X.detections(spark, small)
    assert {x.det_id for x in D.suppressed(found, threshold).collect()} == greedy(found.collect(), threshold)


def test_suppression_of_nothing(spark, small):
    assert D.suppressed(X.detections(spark, small).limit(0), 0.3).count() == 0


@pytest.mark.parametrize(("first", "small"), [(1, 50000), (3, 0)])
def test_suppression_in_rounds(spark, first, small):
    """Few boxes a round; crowds, boxes of all sizes, some without area, a det_id twice in a group, scores that tie or are null."""
    rng = np.random.default_rng(8)
    boxes = [(0, d, 1, float(rng.integers(9)), x, y, x + int(rng.integers(1, 30) ** (1 + d % 2)), y + int(rng.integers(1, 30))) for d, (x, y) in enumerate(rng.integers(-20, 40, (60, 2)).tolist())]
    boxes += [(1, d, 2, 0.5, 5, 5, 25, 25) for d in range(40)] + [(1, 77, 2, 0.9, 70, 0, 71, 9), (1, 77, 2, 0.8, 70, 0, 71, 9), (1, 78, 2, 0.9, 5, 5, 5, 25), (1, 79, 2, None, 90, 0, 91, 1), (1, 80, 2, 0.1, None, 0, 9, 9)]
    found = spark.createDataFrame(boxes, "image_id int, det_id long, class_id int, score double, x0 int, y0 int, x1 int, y1 int")
    got = D.suppressed(found, 0.3, first=first, small=small)
    assert got.columns == found.columns
    rows = got.collect()
    assert {r.det_id for r in rows if r.image_id == 0} == greedy(found.filter("image_id = 0").collect(), 0.3)
    assert sorted((r.det_id, r.score) for r in rows if r.image_id == 1 and r.det_id != 79) == [(0, 0.5), (77, 0.9), (78, 0.9), (80, 0.1)]
    assert [r.score for r in rows if r.det_id == 79] == [None]
    assert D.suppressed(found, 1.0).count() == len(boxes)
    with pytest.raises(ValueError, match="threshold"):
        D.suppressed(found, -0.1)


def test_azimuth_to_the_last_digit_beside_axes_and_diagonals(spark):
    """Sums of hundredths lie beside them by rounding alone; a histogram of 1 degree has its borders there."""
    near = [(i, i / 100 - 10.01, s * ((i + 4) / 100 - 9.97 - 0.08)) for i in range(2003) for s in (1, -1)]
    rows = near + [(i, x, -y) for i, x, y in near] + [(i, a * 3.7, b * 1.3e-15) for i, a in enumerate((1, -1)) for b in (1, -1)] + [(9, b * 1.3e-15, 3.7) for b in (1, -1)] + [(9, 0.0, 0.0), (9, -2.0, 0.0), (9, 0.0, -2.0), (9, 3.0, 4.0)]
    got = P.spherical(spark.createDataFrame([(*r, 1.0) for r in rows], "i int, x double, y double, z double")).select("x", "y", "azim").collect()
    assert len(got) == len(rows) and [r for r in got if r.azim != math.atan2(r.y, r.x)] == []


def test_rotation_and_back(spark, small):
    p = X.points(spark, small)
    there = P.rotated(P.rotated(p, 37.5), -37.5).select("point_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    far = p.join(there, "point_id").agg(F.max(F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2")))).first()[0]
    assert far < 1e-9


def test_pixels_of_broken_points(spark):
    rows = [(0, i, x, x, x) for i, x in enumerate((None, float("nan"), 0.0, 1.0))]
    p = P.spherical(spark.createDataFrame(rows, "station_id int, point_id long, x double, y double, z double"))
    view = {"az_min": F.lit(0.0), "az_max": F.lit(1.0), "el_min": F.lit(0.0), "el_max": F.lit(1.0)}
    got = {r.point_id: (r.valid, r.u, r.v) for r in P.pixels(p.withColumns(view), 11, 11).collect()}
    assert got == {0: (False, -1, -1), 1: (False, -1, -1), 2: (False, -1, -1), 3: (True, 8, 6)}


def test_nearest_of_lonely_points(spark):
    rows = [(0, 1, 0.0, 0.0), (0, 2, 0.0, 1.0), (0, 3, 0.3, 0.0), (1, 4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "station_id int, point_id long, elev double, azim double")
    got = {x.point_id: x.d for x in G.nearest(df, 0.1).collect()}
    assert got == {1: 0.3, 2: 1.0, 3: 0.3, 4: None}


def test_exact_samples(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("station_id"), F.col("id").alias("point_id"))
    assert sorted(x["count"] for x in G.sampled(df, 0.1).groupBy("station_id").count().collect()) == [33, 33, 33]
    assert G.sampled(df.limit(30), 0.01).count() == 0


def test_parsers(spark):
    df = spark.createDataFrame([("12",), ("scan_resolution",), ("0.5 scan_resolution",), ("0.5e3",), ("1_0",), ("1d",), (None,)], "s string")
    got = [r[0] for r in df.select(S.image_width(F.col("s"), F.lit(10.0), F.lit(0.1))).collect()]
    assert got == [12, 100, 50, None, None, None, None]
    deg = [r[0] for r in df.select(S.rotation(F.col("s"))).collect()]
    assert deg == [12.0, None, None, 500.0, None, None, None]


@pytest.mark.parametrize(("limits", "error"), [((0, 0, 0, 1, 1), ValueError), ((0, 0, 0, 1, 1, "1"), TypeError), ((0, 0, 2, 1, 1, 1), ValueError)])
def test_region_settings(limits, error):
    with pytest.raises(error):
        S.PointSettings(roi_limits=limits)
    assert S.PointSettings(roi_limits=(0, 0, 0, 1, 1, 1))


@pytest.mark.parametrize(("limits", "error"), [((1,), ValueError), ((1, "2"), TypeError), ((3, 2), ValueError)])
def test_settings(limits, error):
    with pytest.raises(error):
        S.PointSettings(range_limits=limits)


def test_more_settings():
    for bad in ({"strategy": "merge"}, {"prompt": "tree.background"}, {"tile": (100, 100), "overlap": (100, 10)}):
        with pytest.raises(ValueError, match="."):
            S.DetectionSettings(**bad)
    assert S.DetectionSettings(strategy="NMS")


def test_prompt_quirks(spark):
    df = spark.createDataFrame([("pine tree", "tree.pine"), ("tree", "pine.tree"), ("car", "tree."), ("car", "tree"), (None, "tree")], "label string, prompt string")
    assert [r[0] for r in df.select(D.resolved(F.col("label"), F.col("prompt"))).collect()] == ["tree", "tree", "", None, None]
    twice = spark.createDataFrame([("a.b.a",)], "prompt string")
    assert {r.class_name: r.class_id for r in D.class_map(twice).collect()} == {"a": 3, "b": 2}


def test_fills(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, float("nan")), (1, 0, 2, 4.0), (2, 0, 0, 5.0)], "image_id long, v int, u int, value double")
    at = lambda fill: {(x.image_id, x.u): x.value for x in I.filled(cells, fill).collect()}[1, 1]
    assert (at("max"), at("min"), at("zero"), at(9)) == (4.0, 2.0, 0.0, 9.0)
    assert 2 <= at("random") <= 4
    with pytest.raises(ValueError, match="fill"):
        I.filled(cells, "mean")
    assert {x.value for x in I.scaled(I.filled(cells, "max"), 1.0).filter("image_id = 2").collect()} == {0.0}


def test_random_fill_against_a_plain_loop(spark, small):
    """The share of a cell is the hash of seed, image, row and column, each hashed with the hash so far as its seed."""
    import xxhash

    cells = {(r.image_id, r.v, r.u): r.value for r in X.image_cells(spark, small).collect()}
    low, high = {}, {}
    for (i, _, _), x in cells.items():
        if not math.isnan(x):
            low[i], high[i] = min(x, low.get(i, x)), max(x, high.get(i, x))
    filled = 0
    for r in Q.nan_fill_random(spark, small).collect():
        x = cells[r.image_id, r.v, r.u]
        if math.isnan(x):
            h = 42
            for n, size in ((3, 4), (r.image_id, 8), (r.v, 4), (r.u, 4)):
                h = xxhash.xxh64_intdigest(n.to_bytes(size, "little", signed=True), h)
            x = low[r.image_id] + h % (1 << 30) / (1 << 30) * (high[r.image_id] - low[r.image_id])
            filled += 1
        assert abs(r.value - x) < 1e-12
    assert filled > 1000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lift_labels", "painter_merge", "nms", "pixel_map", "raster_raw", "rle_encode"])
def test_plans(spark, small, name):
    plan = plan_of(Q.QUERIES[name](spark, small))
    for bad in ("CartesianProduct", "SinglePartition", "Python", "Arrow", "SortAggregate"):
        assert bad not in plan, bad


def under(plan, node):
    """The lines of a plan below each node of this name."""
    lines, out = plan.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith(node):
            out += itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :])  # noqa: B023
    return out


@pytest.mark.parametrize("name", ["painter_merge", "lift_labels", "lift_confidence", "mask_picture"])
def test_pixels_are_never_broadcast(spark, small, name):
    plan = plan_of(Q.QUERIES[name](spark, small))
    assert "Generate" in plan and not [x for x in under(plan, "BroadcastExchange") if "Generate" in x]


@pytest.mark.parametrize("name", ["lift_labels", "lift_confidence"])
def test_views_are_broadcast_not_points(spark, small, name):
    plan = plan_of(Q.QUERIES[name](spark, small))
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin [station_id" in line]
    assert sides and all("LeftOuter, BuildRight" in line for line in sides)


def test_points_without_a_station_or_a_view(spark):
    points = spark.createDataFrame([(0, 1, 0.5, 0.5), (1, None, 0.0, 0.0), (2, 2, 1.0, 1.0), (3, 1, 0.0, 0.0), (4, 1, 1.0, 1.0)], "point_id long, station_id int, azim double, elev double")
    at = P.pixels(P.with_view(points, P.field_of_view(points.filter("station_id = 1 OR station_id IS NULL"))), 3, 5)
    assert sorted((r.point_id, r.valid, r.u, r.v) for r in at.collect()) == [(0, True, 1, 2), (2, False, -1, -1), (3, True, 0, 0), (4, True, 2, 4)]


@pytest.mark.parametrize("name", ["mask_contours", "rle_encode"])
def test_boxes_move_instead_of_pixels(spark, small, name):
    """No mask's pixels, and no rows made of them, are shuffled."""
    plan = plan_of(Q.QUERIES[name](spark, small))
    assert "Generate" in plan and not [x for x in under(plan, "Exchange") if "Generate" in x]


def test_run_lengths_sort_no_pixels(spark, small):
    assert "Window" not in plan_of(Q.annotations_json(spark, small))


def test_documents_in_pieces(spark):
    """More pieces than ids, and one for all; ids far apart, an id without a mask, a class without a name, signs that JSON escapes."""
    boxes = [("a/\"b", d, 1 + d % 3, d / 7, d % 50, 0, d % 50 + 2, 3) for d in (-5, 0, 3, 4, 10**12)] + [("c", 3, 2, 0.5, 0, 0, 1, 1), ("c", 4, 1, 0.5, 0, 0, 1, 1)]
    found = spark.createDataFrame(boxes, "image_id string, det_id long, class_id int, score double, x0 int, y0 int, x1 int, y1 int")
    encoded = spark.createDataFrame([(b[0], b[1], [1, 2, 3]) for b in boxes if b[:2] != ("c", 4)], "image_id string, det_id long, counts array<int>")
    names = spark.createDataFrame([(1, 'one "1"'), (2, "two")], "class_id int, class_name string")
    docs = [{r.image_id: r.json for r in D.documents(found, encoded, names, 6, 4, pieces).collect()} for pieces in (1, 3, 256)]
    assert docs[0] == docs[1] == docs[2] and set(docs[0]) == {'a/"b', "c"}
    for image, text in docs[0].items():
        want = [{"class_name": {1: 'one "1"', 2: "two"}[b[2]], "bbox": list(b[4:]), "segmentation": {"size": [4, 6], "counts": [1, 2, 3]}, "score": b[3]} for b in boxes if b[0] == image and b[2] < 3 and b[:2] != ("c", 4)]
        assert json.loads(text) == {"image_path": f"images/{image}.png", "annotations": want, "box_format": "xyxy", "img_width": 6, "img_height": 4}
    assert D.documents(found.limit(0), encoded, names, 6, 4).count() == 0


def test_contours_of_any_mask(spark):
    rng = np.random.default_rng(4)
    own = {(d, int(r), int(c)) for d in range(4) for r, c in zip(rng.integers(-3, 20, 1900), rng.integers(-70, 140, 1900), strict=True)} | {(9, r, c) for r in range(6) for c in range(-66, 131)}
    rows = [(0, d, r, c) for d, r, c in own]
    got = sorted(map(tuple, D.contours(spark.createDataFrame(rows + rows[:50], "image_id int, det_id long, r int, c int")).collect()))
    assert got == sorted((0, d, r, c) for d, r, c in own if not {(d, r + 1, c), (d, r - 1, c), (d, r, c + 1), (d, r, c - 1)} <= own)


def test_range_cut_reaches_the_scan(spark, tmp_path):
    files.write_points(spark.createDataFrame([(0, 1, 1.0, 2.0, 3.0, 7.0)], "station_id int, point_id long, x double, y double, z double, i double"), str(tmp_path / "p"))
    plan = plan_of(P.range_cut(files.read_points(spark, str(tmp_path / "p")), (0, 10)))
    assert "GreaterThanOrEqual(x,-10.0)" in plan and "i:double" not in plan
    with pytest.raises(ValueError, match="colour"):
        files.read_points(spark, str(tmp_path / "p"), ["colour"])


def test_ply(spark, tmp_path):
    p = spark.createDataFrame([(0, 0.5, -1.0, 2.25, 3), (1, 1.5, 0.0, 1e-3, 4)], "point_id long, x double, y double, z double, k int")
    files.write_ply(p, str(tmp_path / "ply"), ["x", "y", "z", "k"])
    text = "".join(f.read_text() for f in sorted((tmp_path / "ply").glob("part-*")))
    (tmp_path / "one.ply").write_text(text)
    back = files.read_ply(spark, str(tmp_path / "one.ply"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))
    (tmp_path / "bad.ply").write_text("ply\nformat binary\n")
    with pytest.raises(ValueError, match="PLY"):
        files.read_ply(spark, str(tmp_path / "bad.ply"))


def test_documents_are_json(spark, small):
    for row in Q.annotations_json(spark, small).limit(2).collect():
        doc = json.loads(row.json)
        assert doc["img_width"] == X.WIDTH and all(sum(a["segmentation"]["counts"]) == X.WIDTH * X.HEIGHT for a in doc["annotations"])
    assert json.loads(Q.class_map_json(spark, small).first().json)["0"] == "background"


def test_models_plug_in(spark):
    def bright(image, prompt):
        r, c = np.nonzero(np.nan_to_num(image) > 0.5)
        return [(prompt.split(".")[0], 0.9, (c.min(), r.min(), c.max() + 1, r.max() + 1))] if len(r) else []

    def filled_boxes(image, boxes):
        return [np.array([(r, c) for r in range(int(y0), int(y1)) for c in range(int(x0), int(x1))]) for x0, y0, x1, y1 in boxes]

    cells = spark.createDataFrame([(0, v, u, float(v in (3, 4) and u in (5, 6))) for v in range(8) for u in range(8)], "image_id int, v int, u int, value double")
    cut = D.tiles(spark.createDataFrame([(0, 8, 8)], "image_id int, width int, height int"), (4, 4), (0, 0))
    dealt = M.tile_cells(cells, D.whole_tiles(cut, (4, 4)), (4, 4), (0, 0))
    found = M.inferred(dealt, lambda: (bright, filled_boxes), "tree.car")
    whole = D.boxes_to_image(found, cut).select("x0", "y0", "x1", "y1", "class_name").collect()
    assert sorted(map(tuple, whole)) == [(5.0, 3.0, 7.0, 4.0, "tree"), (5.0, 4.0, 7.0, 5.0, "tree")]
    px = found.select("image_id", "tile_id", F.monotonically_increasing_id().alias("det_id"), F.explode("pixels").alias("p")).select("image_id", "tile_id", "det_id", "p.r", "p.c")
    assert {(x.r, x.c) for x in D.masks_to_image(px, cut, 8, 8).collect()} == {(3, 5), (3, 6), (4, 5), (4, 6)}
    with pytest.raises(Exception, match="one mask a box"):
        M.inferred(dealt, lambda: (bright, lambda image, boxes: []), "tree.car").collect()
    below = cut.withColumn("x0", F.col("x0") - 1)
    with pytest.raises(Exception, match="outside of its image"):
        D.masks_to_image(px, below, 8, 8).collect()


def test_a_cell_knows_its_tiles(spark):
    cells = spark.createDataFrame([("0/i", v, u, float(v * 23 + u)) for v in range(17) for u in range(23)], "image_id string, v int, u int, value double")
    cut = D.tiles(spark.createDataFrame([("0/i", 23, 17)], "image_id string, width int, height int"), (8, 6), (5, 2))
    got = {r.tile_id: r for r in M.tile_cells(cells, cut, (8, 6), (5, 2)).collect()}
    for t in cut.collect():
        r = got[t.tile_id]
        assert sorted(zip(r.v, r.u, r.value, strict=True)) == [(v - t.y0, u - t.x0, float(v * 23 + u)) for v in range(t.y0, t.y1) for u in range(t.x0, t.x1)]


def test_only_wanted_boxes_reach_the_segmenter():
    found = [("pine tree", 0.9, (0, 0, 2, 2)), ("house", 0.9, (0, 0, 2, 2)), ("car", 0.05, (0, 0, 2, 2)), ("car", 0.5, (0, 0, 10, 10))]
    assert M.wanted(found, ["tree", "car"], 0.5, (10, 10), 0.1) == [("tree", 0.9, (0, 0, 2, 2))]


def test_model_input():
    tile = np.array([[1, np.nan], [3, 2]])
    assert I.model_input(tile).tolist() == [[0, 1], [1, 0.5]] and I.model_input(tile, "min").tolist() == [[0, 0], [1, 0.5]] and I.model_input(tile, 5.0).tolist() == [[0, 1], [0.5, 0.25]]
    assert not I.model_input(np.full((2, 2), np.nan)).any() and not I.model_input(np.full((2, 2), 7)).any()
    with pytest.raises(ValueError, match="fill"):
        I.model_input(tile, "mean")


def test_det_ids_name_boxes_within_an_image(spark):
    """Two images use the same det_ids."""
    boxes = [(0, 1, 1, 0.9, 0, 0, 10, 10), (0, 2, 1, 0.8, 0, 0, 10, 10), (1, 2, 1, 0.7, 0, 0, 10, 10), (1, 1, 2, 0.6, 20, 20, 30, 30)]
    found = spark.createDataFrame(boxes, "image_id int, det_id long, class_id int, score double, x0 int, y0 int, x1 int, y1 int")
    assert sorted((r.image_id, r.det_id) for r in D.suppressed(found, 0.3).collect()) == [(0, 1), (1, 1), (1, 2)]
    pixels = spark.createDataFrame([(1, 0, 5, 5), (1, 1, 25, 25)], "det_id long, image_id int, r int, c int")
    assert sorted((r.image_id, r.class_id, round(r.confidence, 2)) for r in D.painted(pixels, found).collect()) == [(0, 1, 0.9), (1, 2, 0.6)]


def test_quantiles(spark):
    from lumenfold.operators.quantiles import quantiles

    rng = np.random.default_rng(5)
    groups = {0: rng.normal(size=5000), 1: np.full(40, 2.5), 2: np.array([7.0]), 3: np.concatenate([np.zeros(300), rng.random(20), [1e9]]), 4: rng.integers(0, 3, 500).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(0, float("nan")), (5, float("nan")), (2, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    got = {r.g: r for r in quantiles(df, "g", F.col("x"), {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    for g, xs in groups.items():
        assert np.allclose([got[g].a, got[g].b, got[g].c, got[g].d], np.quantile(xs, [0.05, 0.5, 0.95, 1]), rtol=1e-12), g
    assert got[5].a is None



def test_whole_run(spark, small):
    points = X.points(spark, small)
    out = Q.whole_run(spark, small)
    assert out.count() == points.count() and 0 < out.filter("instance > 0").count() < points.count()
    settings = S.DetectionSettings(prompt="tree.car", tile=Q.TILE, overlap=Q.OVERLAP, iou_threshold=0.3, process_edges=True, large_share=0.5)
    both = L.run(points, Q.stub_models, S.PointSettings(range_limits=(0, 12)), S.ImageSettings(width=80, height=None, rotate="auto", method="nanconv", features=("intensity", "z")), settings)
    inside = P.range_cut(points, (0, 12)).count()
    assert both.groupBy("image_id").count().count() == 6 and both.count() == 2 * inside and both.filter("instance > 0").count() > 0


def test_a_run_on_shrunk_images(spark, small):
    points = X.points(spark, small)
    at = P.spherical(points)
    settings = S.ImageSettings(width=120, height=None, scan_resolution="2.0", reduce=True, features=("intensity",))
    sizes = L.sized(at, settings, 1.0)
    for r in sizes.collect():
        assert 0 < r.factor < 1 and abs(r.spacing - math.radians(2)) < 1e-12
    cells = L.rendered(at, sizes, settings)
    for r in cells.groupBy("image_id", "width", "height").agg(F.max("u").alias("u"), F.max("v").alias("v"), F.count("*").alias("n")).collect():
        assert (r.u + 1, r.v + 1, r.n) == (r.width, r.height, r.width * r.height) and r.width < 120
    assert L.sized(at, S.ImageSettings(width=120, height=0, scan_resolution="2.0"), 1.0).filter("factor = 1").count() == 3
    out = L.run(points, Q.stub_models, S.PointSettings(output_resolution=1.0), settings, S.DetectionSettings(prompt="tree.car", tile=(20, 10), overlap=(5, 2), large_share=0.9))
    assert out.count() == points.count() and out.filter("u >= 0").count() == points.count() and out.filter("instance > 0").count() > 0
    with pytest.raises(ValueError, match="rasterise"):
        S.ImageSettings(method="bary_delaunay")


def test_spread_to_neighbours(spark):
    cells = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 2, 4.0)], "image_id string, v int, u int, value double")
    got = {(r.v, r.u): r.value for r in I.spread_to_neighbours(cells, F.lit(4), F.lit(2)).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 3.0, (0, 2): 4.0, (0, 3): 4.0, (1, 0): 2.0, (1, 1): 3.0, (1, 2): 4.0, (1, 3): 4.0}


def test_pictures(spark, golden):
    from lumenfold.operators import pictures

    pixels, found = golden
    found = found.withColumns({"x0": F.lit(1), "y0": F.lit(0), "x1": F.lit(4), "y1": F.lit(3)}).withColumn("class_name", F.lit("tree"))
    cells = spark.createDataFrame([(0, r, c, 0.5) for r in range(4) for c in range(5)], "image_id int, v int, u int, value double")
    at = lambda df: {(r.v, r.u): (r.red, r.green, r.blue) for r in df.collect()}
    ink = lambda k: tuple((k * m + 64) % 256 for m in pictures.COLOUR.values())
    got = at(pictures.drawn(cells, found, pixels))
    assert got[3, 4] == (127, 127, 127) and got[0, 0] == tuple((127 + x) // 2 for x in ink(1)) and got[0, 1] == ink(3)
    assert at(pictures.drawn(cells, found, pixels, outlines=True, boxes=False))[1, 1] == tuple((127 + x) // 2 for x in ink(1))
    file = pictures.files(pictures.drawn(cells, found, pixels), 5, 4, "sam2", "_sam2", pictures.captions(found)).collect()
    assert [(f.path, b"tree 0.50; tree 0.75; tree 0.25" in bytes(f.content)) for f in file] == [("sam2/0_sam2.png", True)]
    assert [f.path for f in pictures.files(pictures.grey(cells, "intensity"), 5, 4, "images").collect()] == ["images/0_intensity.png"]


def test_station_files(spark, tmp_path):
    p = spark.createDataFrame([(i, i * 0.5, -1.0, 2.25, i % 3) for i in range(500)], "point_id long, x double, y double, z double, instance int").repartition(5)
    ply, text = files.write_station(p, str(tmp_path / "out"), "scan", "intensity", Q.TO_PROJECT, ["x", "y", "z", "instance"])
    assert ply.endswith("out/scan_intensity_seg.ply") and (tmp_path / "out" / "scan_intensity_seg.ply").read_text().startswith("ply\nformat ascii 1.0\nelement vertex 500\n")
    assert sorted(map(tuple, files.read_ply(spark, ply).collect())) == sorted(map(tuple, p.collect()))
    assert (tmp_path / "out" / "scan_T.txt").read_text().split("\n")[0] == "0.86602540 -0.50000000 0.00000000 1.50000000" and text.endswith("scan_T.txt")
    long = "ply\nformat ascii 1.0\n" + "comment x\n" * 900 + "element vertex 1\nproperty float x\nend_header\n7\n"
    (tmp_path / "long.ply").write_text(long)
    assert [r.x for r in files.read_ply(spark, str(tmp_path / "long.ply")).collect()] == [7.0]


def test_image_files(spark, tmp_path):
    for name in ("a.png", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(I.png(np.zeros((2, 2), np.uint8)))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.read_images(spark, str(tmp_path)).collect()) == ["a.png", "b.png"]
    assert files.output_folders("r")["sam2"] == "r/intermediate/sam2"


def test_stream(spark, small, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    X.points(spark, small).write.parquet(src)
    stations.follow(spark, src, sink, str(tmp_path / "state"), P.spherical).awaitTermination(120)
    assert spark.read.parquet(sink).count() == X.points(spark, small).count()


def test_reduction_limits(spark):
    got = spark.createDataFrame([(10.0,), (0.1,)], "r_max double").select(G.reduction(F.col("r_max"), 1.0, 0.5)).collect()
    assert got[0][0] == 0.35 and math.isnan(got[1][0])


def test_png_and_guards(spark):
    import zlib

    cells = spark.createDataFrame([(1, v, u, (v * 40 + u) % 256) for v in range(3) for u in range(5)], "image_id int, v int, u int, value int")
    out = I.encoded(cells, 5, 3).collect()
    assert out[0].path == "images/1.png" and out[0].content.startswith(b"\x89PNG")
    data = bytes(out[0].content)
    at = data.index(b"IDAT") + 4
    raw = zlib.decompress(data[at : data.index(b"IEND") - 8])
    assert [list(raw[i * 6 + 1 : i * 6 + 6]) for i in range(3)] == [[80 + u for u in range(5)], [40 + u for u in range(5)], list(range(5))]
    assert I.passes_through((2, 2, 3), 0, 255) and not I.passes_through((2, 2), 0, 255) and not I.passes_through((2, 2, 3), -1, 9)
    assert I.three_channels(np.ones((2, 4))).shape == (2, 4, 3)
    for bad in (((2,), "uint8"), ((2, 2, 4), "uint8"), ((2, 2), "int64"), ((2, 2), "float64")):
        with pytest.raises(ValueError, match="image"):
            I.checked(*bad)


def test_everything_plugs_in(spark):
    cells = spark.createDataFrame([(0, v, u, 1.0) for v in range(4) for u in range(4)], "image_id int, v int, u int, value double")
    cut = D.tiles(spark.createDataFrame([(0, 4, 4)], "image_id int, width int, height int"), (4, 4), (0, 0))
    masks = M.everything(M.tile_cells(cells, cut, (4, 4), (0, 0)), lambda: lambda image: [np.argwhere(image == 0)])
    assert [r.area for r in masks.collect()] == [16]  # a constant tile is 0


def test_every_order_is_a_detection(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").count()
    assert orders > 1200
    for found in (X.detections(spark, small), Q.path_stem(spark, small), Q.box_batches(spark, small), Q.size_rank(spark, small)):
        assert found.select("det_id").distinct().count() == orders
