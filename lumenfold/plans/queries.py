"""One query for each operator, on the derived fixtures, with the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import settings as S
from ..operators import detections as D
from ..operators import images as I
from ..operators import pictures
from ..operators import points as P
from ..operators import spacing as G
from . import fixtures as X
from . import labelling

W, H = X.WIDTH, X.HEIGHT
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parts of the oracle queries
PTS = f"pts AS ({X.POINTS_SQL})"
SPH = f"{PTS}, sph AS (SELECT *, sqrt(x*x+y*y+z*z) r, asin(z/sqrt(x*x+y*y+z*z)) elev, atan2(y,x) azim FROM pts)"
FOV = f"{SPH}, fov AS (SELECT station_id, min(azim) az_min, max(azim) az_max, min(elev) el_min, max(elev) el_max FROM sph GROUP BY station_id)"
PIX = f"""{FOV}, nrm AS (SELECT s.*, (azim-az_min)/(az_max-az_min) na, (elev-el_min)/(el_max-el_min) ne FROM sph s JOIN fov USING (station_id)),
 pix AS (SELECT *, CAST(greatest(0, least({W - 1}, round_even(na*{W - 1}, 0))) AS INT) u, CAST(greatest(0, least({H - 1}, round_even(ne*{H - 1}, 0))) AS INT) v FROM nrm)"""
DET = f"det AS ({X.DETECTIONS_SQL})"
MSK = f"{DET}, msk AS (SELECT det_id, image_id, CAST(r AS INT) r, CAST(c AS INT) c FROM det, unnest(range(y0,y1)) a(r), unnest(range(x0,x1)) b(c))"
RNK = f"{MSK}, cnt AS (SELECT image_id, det_id, count(*) n FROM msk GROUP BY ALL), rnk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, det_id DESC) instance FROM cnt)"
PNT = f"""{RNK}, pnt AS (SELECT m.image_id, r, c, max(instance) instance, arg_max(class_id, instance) class_id, arg_max(score, instance) confidence
 FROM msk m JOIN rnk USING (image_id, det_id) JOIN (SELECT det_id, class_id, score FROM det) d USING (det_id) GROUP BY ALL)"""
CEL = """cel AS (SELECT vec_id image_id, CAST((pos-1)//8 AS INT) v, CAST((pos-1) % 8 AS INT) u,
 CASE WHEN (vec_id+pos-1) % 17 = 0 THEN 'NaN'::DOUBLE ELSE embedding[pos]::DOUBLE END AS value FROM embeddings, unnest(range(1,65)) t(pos))"""
LIM = f"{CEL}, lim AS (SELECT image_id, min(value) FILTER (NOT isnan(value)) low, max(value) FILTER (NOT isnan(value)) high FROM cel GROUP BY image_id)"
LAB = f"lab AS (SELECT p_partkey label_id, p_name raw_label, '{X.PROMPT}' prompt FROM part), cls AS (SELECT CAST(max(i) AS INT) class_id, n class_name FROM (SELECT unnest(string_split('{X.PROMPT}', '.')) n, unnest(range(1, 6)) i) GROUP BY n)"
PAR = "par AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in p) + ")" for p in X.PARAMS) + ") t(pid, image_width, scan_resolution, rotate))"


def r6(x: str | Column, n: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, n) + F.lit(0.0)


def o6(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0e0"


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def spherical_points(spark, d):
    return P.spherical(X.points(spark, d))


def placed_points(spark, d):
    p = spherical_points(spark, d)
    return P.pixels(P.with_view(p, P.field_of_view(p)), W, H)


# Points


@query(f"WITH {PIX}, {PNT} SELECT p.point_id, p.station_id, p.u, p.v, CAST(coalesce(q.instance, 0) AS INT) instance, CAST(coalesce(q.class_id, 0) AS INT) class_id, {o6('coalesce(q.confidence, 0)::FLOAT::DOUBLE')} confidence FROM pix p LEFT JOIN pnt q ON q.image_id = p.station_id AND q.r = p.v AND q.c = p.u")
def lift_labels(spark, d):
    """Flagship: points to pixels, masks to labels, labels back to points."""
    out = labelling.labelled(placed_points(spark, d), X.detections(spark, d), X.mask_pixels(spark, d))
    return out.select("point_id", "station_id", "u", "v", "instance", "class_id", r6(F.col("confidence").cast("double")).alias("confidence"))


@query(f"WITH {SPH} SELECT point_id, {o6('r')} r, {o6('elev')} elev, {o6('azim')} azim FROM sph")
def spherical(spark, d):
    return spherical_points(spark, d).select("point_id", *[r6(k).alias(k) for k in ("r", "elev", "azim")])


@query(f"WITH {FOV} SELECT station_id, {', '.join(o6(k) + ' ' + k for k in ('az_min', 'az_max', 'el_min', 'el_max'))} FROM fov")
def fov(spark, d):
    f = P.field_of_view(spherical_points(spark, d))
    return f.select("station_id", *[r6(k).alias(k) for k in f.columns[1:]])


@query(f"WITH {PIX} SELECT point_id, station_id, u, v FROM pix")
def pixel_map(spark, d):
    return placed_points(spark, d).select("point_id", "station_id", "u", "v")


@query(f"WITH {SPH} SELECT point_id, {o6('r')} r FROM sph WHERE r BETWEEN 5 AND 12")
def range_filter(spark, d):
    cut = P.range_cut(X.points(spark, d), (5, 12))
    return P.spherical(cut).select("point_id", r6("r").alias("r"))


ROI = (-3.0, -4.0, -0.5, 6.0, 5.0, 4.0)
TURN, SHIFT = math.radians(30), (1.5, -0.75, 0.25)
TO_PROJECT = np.array([[math.cos(TURN), -math.sin(TURN), 0, SHIFT[0]], [math.sin(TURN), math.cos(TURN), 0, SHIFT[1]], [0, 0, 1, SHIFT[2]], [0, 0, 0, 1]])
BACK = f"SELECT (a-({SHIFT[0]}e0))*cos(radians(30e0)) + (b-({SHIFT[1]}e0))*sin(radians(30e0)) x, (b-({SHIFT[1]}e0))*cos(radians(30e0)) - (a-({SHIFT[0]}e0))*sin(radians(30e0)) y, c-({SHIFT[2]}e0) z FROM (VALUES ({ROI[0]}e0), ({ROI[3]}e0)) p(a), (VALUES ({ROI[1]}e0), ({ROI[4]}e0)) q(b), (VALUES ({ROI[2]}e0), ({ROI[5]}e0)) s(c)"


@query(f"WITH {PTS}, box AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM ({BACK})) SELECT point_id FROM pts, box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def roi_filter(spark, d):
    return P.roi_cut(X.points(spark, d), ROI, TO_PROJECT).select("point_id")


@query(f"WITH {PTS} SELECT point_id, {o6('x')} x, {o6('z')} z FROM pts, (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM ({BACK})) WHERE sqrt(x*x+y*y+z*z) BETWEEN 2 AND 9 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def range_then_roi(spark, d):
    return P.roi_cut(P.range_cut(X.points(spark, d), (2, 9)), ROI, TO_PROJECT).select("point_id", r6("x").alias("x"), r6("z").alias("z"))


@query(f"WITH {PTS}, b AS (SELECT station_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM pts GROUP BY station_id) SELECT station_id, {o6('x')} x, {o6('y')} y, {o6('z')} z FROM b, unnest([x0, x1]) p(x), unnest([y0, y1]) q(y), unnest([z0, z1]) s(z)")
def bbox_corners(spark, d):
    return P.box_corners(P.bounds(X.points(spark, d))).select("station_id", *[r6(k).alias(k) for k in "xyz"])


@query(f"WITH {PTS} SELECT station_id, {', '.join(f'{o6(f"{f}({k})")} {k}_{f}' for k in 'xyz' for f in ('min', 'max'))} FROM pts GROUP BY station_id")
def corner_bounds(spark, d):
    """Bounds of the eight corners: those of the points."""
    b = P.bounds(P.box_corners(P.bounds(X.points(spark, d))))
    return b.select("station_id", *[r6(k).alias(k) for k in b.columns[1:]])


@query(f"WITH {PTS} SELECT point_id, {o6('x*cos(radians(30e0)) - y*sin(radians(30e0))')} x, {o6('x*sin(radians(30e0)) + y*cos(radians(30e0))')} y, {o6('z')} z FROM pts")
def rotate_z(spark, d):
    return P.rotated(X.points(spark, d), 30).select("point_id", *[r6(k).alias(k) for k in "xyz"])


@query(f"WITH {PTS} SELECT point_id, {o6('x*cos(radians(30e0)) - y*sin(radians(30e0)) + 1.5e0')} x, {o6('x*sin(radians(30e0)) + y*cos(radians(30e0)) - 0.75e0')} y, {o6('z + 0.25e0')} z FROM pts")
def apply_transform(spark, d):
    return P.transformed(X.points(spark, d), TO_PROJECT).select("point_id", *[r6(k).alias(k) for k in "xyz"])


NARROW = "azim BETWEEN -2e0 AND 2e0 AND elev BETWEEN -0.1e0 AND 0.4e0"


@query(f"WITH {SPH} SELECT point_id, {NARROW} valid, CASE WHEN {NARROW} THEN CAST(greatest(0, least({W - 1}, round_even((azim+2e0)/4e0*{W - 1}, 0))) AS INT) ELSE -1 END u, CASE WHEN {NARROW} THEN CAST(greatest(0, least({H - 1}, round_even((elev+0.1e0)/0.5e0*{H - 1}, 0))) AS INT) ELSE -1 END v FROM sph")
def fov_validity(spark, d):
    view = {"az_min": F.lit(-2.0), "az_max": F.lit(2.0), "el_min": F.lit(-0.1), "el_max": F.lit(0.4)}
    return P.pixels(spherical_points(spark, d).withColumns(view), W, H).select("point_id", "valid", "u", "v")


@query(f"WITH {SPH} SELECT station_id, {o6('max(r)')} r_max FROM sph GROUP BY station_id")
def max_range(spark, d):
    return P.max_range(spherical_points(spark, d)).select("station_id", r6("r_max").alias("r_max"))


@query(f"WITH {PTS} SELECT station_id, CAST(floor(x/2e0) AS BIGINT) vx, CAST(floor(y/2e0) AS BIGINT) vy, CAST(floor(z/2e0) AS BIGINT) vz, count(*) n, {o6('avg(intensity)', 10)} intensity FROM pts GROUP BY ALL")
def voxel_downsample(spark, d):
    return P.thinned(X.points(spark, d), 2.0, ["intensity"]).select("station_id", "vx", "vy", "vz", "n", r6("intensity", 10).alias("intensity"))


@query(f"WITH {PTS} SELECT point_id, f feature, {o6('val')} AS value FROM (SELECT point_id, unnest(['x', 'z', 'intensity']) f, unnest([x, z, intensity]) val FROM pts)")
def feature_columns(spark, d):
    """Named features to long form."""
    p = X.points(spark, d)
    return p.unpivot("point_id", ["x", "z", "intensity"], "feature", "value").select("point_id", "feature", r6("value").alias("value"))


# What a run decides

HST = lambda n: f"""{FOV}, bns AS (SELECT s.station_id, least({n - 1}, CAST(floor((elev-el_min)/((el_max-el_min)/{n}e0)) AS INT)) bin_e, least({n - 1}, CAST(floor((azim-az_min)/((az_max-az_min)/{n}e0)) AS INT)) bin_a FROM sph s JOIN fov USING (station_id)),
 grd AS (SELECT station_id, CAST(e AS INT) bin_e, CAST(a AS INT) bin_a FROM fov, range({n}) i(e), range({n}) j(a)),
 hst AS (SELECT g.station_id, g.bin_e, g.bin_a, count(b.station_id) n FROM grd g LEFT JOIN bns b ON b.station_id = g.station_id AND b.bin_e = g.bin_e AND b.bin_a = g.bin_a GROUP BY ALL)"""  # noqa: E731
MED = f"{HST(4)}, mid AS (SELECT station_id, median(n) m FROM hst GROUP BY station_id), med AS (SELECT * FROM (SELECT h.*, m, row_number() OVER (PARTITION BY h.station_id ORDER BY abs(n-m), bin_e, bin_a) k FROM hst h JOIN mid USING (station_id)) WHERE k = 1)"
PAT = f"""{MED}, pat AS (SELECT s.* FROM sph s JOIN fov f USING (station_id) JOIN med b USING (station_id)
 WHERE elev BETWEEN el_min + (el_max-el_min)/4e0*bin_e AND el_min + (el_max-el_min)/4e0*(bin_e+1) AND azim BETWEEN az_min + (az_max-az_min)/4e0*bin_a AND az_min + (az_max-az_min)/4e0*(bin_a+1))"""


def view_of(p):
    return p, P.field_of_view(p)


@query(f"WITH {HST(10)} SELECT station_id, bin_e, bin_a, n FROM hst")
def hist2d(spark, d):
    return G.view_histogram(*view_of(spherical_points(spark, d)), 10).select("station_id", "bin_e", "bin_a", "n")


@query(f"WITH {MED} SELECT station_id, bin_e, bin_a, n, m median_n FROM med")
def median_patch(spark, d):
    return G.median_bin(G.view_histogram(*view_of(spherical_points(spark, d)), 4))


@query(f"WITH {PAT} SELECT station_id, point_id FROM pat")
def patch_extract(spark, d):
    p, f = view_of(spherical_points(spark, d))
    return G.patch(p, f, G.median_bin(G.view_histogram(p, f, 4)), 4).select("station_id", "point_id")


@query(f"WITH {PAT}, nns AS (SELECT a.station_id, a.point_id, min(sqrt((a.elev-b.elev)**2 + (a.azim-b.azim)**2)) nd FROM pat a LEFT JOIN pat b ON a.station_id = b.station_id AND a.point_id <> b.point_id GROUP BY ALL) SELECT station_id, count(*) n_patch, {o6('median(nd)', 9)} spacing FROM nns GROUP BY station_id")
def nn_spacing(spark, d):
    p, f = view_of(spherical_points(spark, d))
    return G.spacing(p, f, 4).select("station_id", "n_patch", r6("spacing", 9).alias("spacing"))


AZH = f"""{SPH}, azb AS (SELECT station_id, least(359, CAST(floor((azim+pi())/radians(1e0)) AS INT)) bin FROM sph),
 azh AS (SELECT g.station_id, g.bin, count(a.bin) n FROM (SELECT DISTINCT station_id, CAST(b AS INT) bin FROM sph, range(360) t(b)) g LEFT JOIN azb a ON a.station_id = g.station_id AND a.bin = g.bin GROUP BY ALL)"""
RUN = f"""{AZH}, low AS (SELECT station_id, bin, bin - row_number() OVER (PARTITION BY station_id ORDER BY bin) k FROM azh WHERE n = (SELECT min(n) FROM azh z WHERE z.station_id = azh.station_id)),
 isl AS (SELECT station_id, min(bin) s, count(*) l FROM low GROUP BY station_id, k), run AS (SELECT station_id, s, l, CAST(s + l//2 AS INT) centre FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY l DESC, s) i FROM isl) WHERE i = 1)"""


@query(f"WITH {AZH} SELECT station_id, bin, n FROM azh")
def azimuth_hist(spark, d):
    return G.azimuth_histogram(spherical_points(spark, d))


@query(f"WITH {AZH} SELECT station_id, CAST(sum(n) FILTER (bin IN (0, 359)) AS BIGINT) edge_n, min(n) min_n FROM azh GROUP BY station_id")
def edge_zone(spark, d):
    return G.edge_and_least(G.azimuth_histogram(spherical_points(spark, d)))


@query(f"WITH {RUN} SELECT station_id, s AS start, l AS len, centre FROM run")
def gap_run(spark, d):
    return G.emptiest_run(G.azimuth_histogram(spherical_points(spark, d)))


@query(f"WITH {RUN} SELECT station_id, CASE WHEN (SELECT sum(n) FROM azh z WHERE z.station_id = run.station_id AND bin IN (0, 359)) = 0 THEN 0e0 ELSE -180e0 - (-180e0 + (centre + 0.5e0)) END theta FROM run")
def rotation_angle(spark, d):
    return G.gap_rotation(G.azimuth_histogram(spherical_points(spark, d)))


@query(f"WITH {RUN}, th AS (SELECT station_id, CASE WHEN (SELECT sum(n) FROM azh z WHERE z.station_id = run.station_id AND bin IN (0, 359)) = 0 THEN 0e0 ELSE -180e0 - (-180e0 + (centre + 0.5e0)) END theta FROM run) SELECT point_id, {o6('x*cos(radians(theta)) - y*sin(radians(theta))')} x, {o6('x*sin(radians(theta)) + y*cos(radians(theta))')} y FROM pts JOIN th USING (station_id)")
def rotate_to_gap(spark, d):
    p = spherical_points(spark, d)
    return P.rotated(p.join(G.gap_rotation(G.azimuth_histogram(p)), "station_id"), F.col("theta")).select("point_id", r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {PTS} SELECT station_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY (point_id*2654435761) % 4294967296, point_id) i, count(*) OVER (PARTITION BY station_id) n FROM pts) WHERE i <= floor(n*0.01e0)")
def det_sample(spark, d):
    return G.sampled(X.points(spark, d), 0.01).select("station_id", "point_id")


@query(f"WITH {SPH} SELECT station_id, CAST(round_even(radians(1e0)/asin(0.5e0/max(r)), 2) AS DOUBLE) coef FROM sph GROUP BY station_id")
def reduction_coef(spark, d):
    return P.max_range(spherical_points(spark, d)).select("station_id", G.reduction(F.col("r_max"), 1.0, 0.5).alias("coef"))


@query(f"WITH {FOV} SELECT station_id, 2048 width, CAST(ceil(2048*((el_max-el_min)/(az_max-az_min))) AS INT) height FROM fov")
def image_size(spark, d):
    f = P.field_of_view(spherical_points(spark, d)).withColumn("width", F.lit(2048))
    return f.select("station_id", "width", P.image_height(F.col("width")).alias("height"))


@query(f"WITH {FOV} SELECT station_id, 2048 width, CAST(floor(2048/((az_max-az_min)/(el_max-el_min))) AS INT) height FROM fov")
def default_image_size(spark, d):
    f = P.field_of_view(spherical_points(spark, d)).withColumn("width", F.lit(2048))
    return f.select("station_id", "width", P.default_height(F.col("width")).alias("height"))


@query(f"WITH {SPH}, m AS (SELECT station_id, max(r) r FROM sph GROUP BY station_id), c AS (SELECT station_id, s, CAST(round_even(radians(s)/asin(0.5e0/r), 2) AS DOUBLE) coef FROM m, (VALUES (1e0), (6e0)) t(s)) SELECT station_id, s spacing, CASE WHEN coef < 1 AND coef > 0 THEN coef ELSE 1e0 END factor FROM c")
def resize_gate(spark, d):
    """Fine scans shrink, coarse ones stay."""
    r = P.max_range(spherical_points(spark, d)).select("*", F.explode(F.array(F.lit(1.0), F.lit(6.0))).alias("spacing"))
    return r.select("station_id", "spacing", G.gate(G.reduction(F.col("r_max"), F.col("spacing"), 0.5)).alias("factor"))


@query(f"WITH {PAT}, nns AS (SELECT a.station_id, a.point_id, min(sqrt((a.elev-b.elev)**2 + (a.azim-b.azim)**2)) nd FROM pat a LEFT JOIN pat b ON a.station_id = b.station_id AND a.point_id <> b.point_id GROUP BY ALL), spc AS (SELECT station_id, median(nd) s FROM nns GROUP BY station_id), siz AS (SELECT station_id, s, CAST(ceil(ceil((az_max-az_min)/s)*0.5e0) AS INT) w, el_max-el_min e, az_max-az_min a FROM fov JOIN spc USING (station_id)) SELECT station_id, {o6('s', 9)} spacing, w width, CAST(ceil(w*(e/a)) AS INT) height FROM siz")
def auto_image_size(spark, d):
    """The spacing is estimated (auto), the width is half of the full resolution, the height keeps pixels square."""
    settings = S.ImageSettings(width="0.5-scan_resolution", height=None, scan_resolution="auto", patches=4)
    return labelling.sized(spherical_points(spark, d), settings, 0.5).select("station_id", r6("spacing", 9).alias("spacing"), "width", "height")


WID = r"lower(trim(image_width))"


@query(f"WITH {PAR} SELECT pid, CAST(CASE WHEN regexp_full_match({WID}, '[0-9]+') THEN TRY_CAST({WID} AS BIGINT) WHEN {WID} = 'scan_resolution' THEN ceil(360e0/0.09e0) WHEN regexp_full_match({WID}, '[0-9.]+[ \\t-]*scan_resolution') THEN ceil(ceil(360e0/0.09e0)*TRY_CAST(regexp_extract({WID}, '^[0-9.]+') AS DOUBLE)) END AS BIGINT) width FROM par")
def parse_width(spark, d):
    return X.params(spark).select("pid", S.image_width(F.col("image_width"), F.lit(360.0), F.lit(0.09)).alias("width"))


@query(f"WITH {PAR}, m AS (SELECT pid, lower(trim(scan_resolution)) s FROM par) SELECT pid, {o6(r'''CASE WHEN s = 'auto' THEN NULL WHEN s LIKE '%mm@%m' THEN asin(TRY_CAST(trim(split_part(s, 'mm@', 1)) AS DOUBLE)/1000/TRY_CAST(trim(replace(split_part(s, 'mm@', 2), 'm', '')) AS DOUBLE)) ELSE radians(TRY_CAST(s AS DOUBLE)) END''', 9)} radians FROM m")
def parse_scan_resolution(spark, d):
    return X.params(spark).select("pid", r6(S.scan_resolution(F.col("scan_resolution")), 9).alias("radians"))


@query(f"WITH {PAR} SELECT pid, CASE lower(rotate) WHEN 'auto' THEN NULL WHEN 'false' THEN 0e0 WHEN 'true' THEN 1e0 ELSE CASE WHEN rotate LIKE '%\\_%' ESCAPE '\\' THEN NULL ELSE TRY_CAST(rotate AS DOUBLE) END END degrees, lower(rotate) = 'auto' is_auto FROM par")
def parse_rotate(spark, d):
    deg = S.rotation(F.col("rotate"))
    return X.params(spark).select("pid", F.when(~F.isnan(deg), deg).alias("degrees"), (F.lower("rotate") == "auto").alias("is_auto"))


# Detections


@query(f"WITH {LAB} SELECT class_id, class_name FROM cls")
def class_map(spark, d):
    return D.class_map(X.prompts(spark))


RES = f"{LAB}, res AS (SELECT label_id, coalesce(CASE WHEN list_contains(string_split(prompt,'.'), raw_label) THEN raw_label END, list_filter(string_split(prompt,'.'), lambda k: contains(raw_label,k))[1]) class_name FROM lab)"


def resolved_labels(spark, d):
    return X.labels(spark, d).select("label_id", D.resolved(F.col("raw_label"), F.col("prompt")).alias("class_name"))


@query(f"WITH {RES} SELECT label_id, r.class_name, class_id FROM res r LEFT JOIN cls ON cls.class_name = r.class_name")
def resolve_class(spark, d):
    return resolved_labels(spark, d).join(D.class_map(X.prompts(spark)), "class_name", "left").select("label_id", "class_name", "class_id")


@query(f"WITH {RES} SELECT label_id, class_name, class_id FROM res JOIN cls USING (class_name)")
def drop_unresolved(spark, d):
    return resolved_labels(spark, d).filter("class_name IS NOT NULL").join(D.class_map(X.prompts(spark)), "class_name").select("label_id", "class_name", "class_id")


@query(f"WITH {DET} SELECT det_id, CAST((x1-x0)*(y1-y0) AS INT) area FROM det WHERE (x1-x0)*(y1-y0) < 0.01e0*{W * H}")
def large_object_filter(spark, d):
    return D.without_large(X.detections(spark, d), 0.01, W, H).select("det_id", D.box_area().cast("int").alias("area"))


@query(f"WITH {DET} SELECT det_id, {o6('score')} score FROM det WHERE score > 0.2e0")
def score_filter(spark, d):
    return D.scoring_over(X.detections(spark, d), 0.2).select("det_id", r6("score").alias("score"))


@query(f"WITH {DET}, {LAB} SELECT det_id, class_name || ' ' || printf('%.2f', score) AS label FROM det JOIN cls USING (class_id)")
def label_text(spark, d):
    return X.detections(spark, d).join(D.class_map(X.prompts(spark)), "class_id").select("det_id", D.score_label(F.col("class_name"), F.col("score")).alias("label"))


TIL = f"til AS (SELECT CAST(i AS INT) image_id, CAST(b*4 + a AS INT) tile_id, CAST(a*30 AS INT) x0, CAST(b*25 AS INT) y0, CAST(least(a*30+40, {W}) AS INT) x1, CAST(least(b*25+32, {H}) AS INT) y1 FROM range(8) t(i), range(4) p(a), range(3) q(b))"


def cut_tiles(spark):
    return D.tiles(X.images(spark), (40, 32), (10, 7))


@query(f"WITH {TIL} SELECT * FROM til")
def tiles(spark, d):
    return cut_tiles(spark)


@query(f"WITH {TIL} SELECT * FROM til WHERE x1-x0 = 40 AND y1-y0 = 32")
def tile_size_gate(spark, d):
    return D.whole_tiles(cut_tiles(spark), (40, 32))


TILED = f"{DET}, {TIL}, tdt AS (SELECT *, CAST(det_id % 12 AS INT) tile_id FROM det)"


def tiled_detections(spark, d):
    return X.detections(spark, d).withColumn("tile_id", (F.col("det_id") % 12).cast("int"))


@query(f"WITH {TILED} SELECT det_id, image_id, tile_id, t.x0 + l.x0 x0, t.y0 + l.y0 y0, t.x1 + l.x0 x1, t.y1 + l.y0 y1 FROM tdt t JOIN til l USING (image_id, tile_id)")
def shift_boxes(spark, d):
    return D.boxes_to_image(tiled_detections(spark, d), cut_tiles(spark)).select("det_id", "image_id", "tile_id", "x0", "y0", "x1", "y1")


@query(f"WITH {TILED} SELECT det_id, image_id, CAST(r + l.y0 AS INT) r, CAST(c + l.x0 AS INT) c FROM tdt t JOIN til l USING (image_id, tile_id), unnest(range(t.y0, t.y1)) a(r), unnest(range(t.x0, t.x1)) b(c) WHERE r + l.y0 < {H} AND c + l.x0 < {W}")
def shift_masks(spark, d):
    px = X.mask_pixels(spark, d).withColumn("tile_id", (F.col("det_id") % 12).cast("int"))
    return D.masks_to_image(px, cut_tiles(spark), W, H).select("det_id", "image_id", "r", "c")


@query(f"WITH {TILED} SELECT image_id, tile_id, count(*) n FROM tdt GROUP BY ALL")
def tile_union(spark, d):
    """Detections of all tiles in one table: even and odd tiles by UNION ALL."""
    t = tiled_detections(spark, d)
    return D.of_all_tiles([t.filter("tile_id % 2 = 0"), t.filter("tile_id % 2 = 1")]).groupBy("image_id", "tile_id").agg(F.count(F.lit(1)).alias("n"))


KEPT = """rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) k FROM det),
 iou AS (SELECT a.image_id, a.class_id, a.k ka, b.k kb, greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0)) * greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) i, (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) s
  FROM rk a JOIN rk b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.k < b.k),
 sup AS (SELECT image_id, class_id, kb, list(ka) l FROM iou WHERE i::DOUBLE/(s-i) > 0.3e0 GROUP BY ALL),
 nxt AS (SELECT rk.image_id, rk.class_id, rk.k, coalesce(l, []::BIGINT[]) l FROM rk LEFT JOIN sup ON sup.image_id = rk.image_id AND sup.class_id = rk.class_id AND sup.kb = rk.k),
 rec AS (SELECT DISTINCT image_id, class_id, 0::BIGINT k, []::BIGINT[] kept FROM rk
  UNION ALL SELECT n.image_id, n.class_id, n.k, CASE WHEN list_has_any(rec.kept, n.l) THEN rec.kept ELSE list_append(rec.kept, n.k) END FROM rec JOIN nxt n ON n.image_id = rec.image_id AND n.class_id = rec.class_id AND n.k = rec.k + 1),
 fin AS (SELECT image_id, class_id, unnest(kept) k FROM (SELECT *, max(k) OVER (PARTITION BY image_id, class_id) m FROM rec) WHERE k = m)"""
NMS = f"WITH RECURSIVE {DET}, {KEPT} SELECT det_id, image_id, class_id FROM rk JOIN fin USING (image_id, class_id, k)"


@query(NMS)
def nms(spark, d):
    return D.suppressed(X.detections(spark, d), 0.3).select("det_id", "image_id", "class_id")


@query(f"WITH {DET} SELECT det_id, image_id, CAST((row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1)//16 AS INT) batch FROM det")
def box_batches(spark, d):
    return D.batches(X.detections(spark, d), 16).select("det_id", "image_id", "batch")


@query(f"WITH {DET} SELECT det_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (det_id*2654435761) % 4294967296, det_id) i FROM det) WHERE i <= 16")
def picture_sample(spark, d):
    """The sixteen masks of a picture; documents keep all."""
    return D.first_by_hash(X.detections(spark, d), 16).select("det_id", "image_id")


@query(f"WITH {DET} SELECT det_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY (x1-x0)*(y1-y0) DESC, det_id) AS INT) place FROM det")
def area_order(spark, d):
    return D.area_ranked(X.detections(spark, d)).select("det_id", "place")


# The run

TILE, OVERLAP = (40, 32), (10, 7)
RAN = f"""WITH RECURSIVE {PIX}, ras AS (SELECT station_id image_id, v, u, avg(intensity) x FROM pix GROUP BY ALL),
 pct AS (SELECT image_id, quantile_cont(x, 0.05) a, quantile_cont(x, 0.95) b FROM ras GROUP BY image_id),
 nor AS (SELECT image_id, v, u, CASE WHEN a = b THEN 0 ELSE (greatest(a, least(b, x)) - a)/(b-a) END x FROM ras JOIN pct USING (image_id)),
 cor AS (SELECT CAST(q*4 + p AS INT) tile_id, CAST(p*30 AS INT) tx, CAST(q*25 AS INT) ty FROM range(3) a(p), range(2) b(q)),
 fst AS (SELECT image_id, tile_id, tx, ty, v-ty r, u-tx c, row_number() OVER (PARTITION BY image_id, tile_id ORDER BY x, v, u) k FROM nor JOIN cor ON u >= tx AND u < tx+40 AND v >= ty AND v < ty+32),
 det AS (SELECT image_id, tile_id::BIGINT*16777216 det_id, CAST((r+c) % 3 + 1 AS INT) class_id, 0.3e0 + 0.001e0*(r*40+c)/1.28e0 score,
   greatest(0, c-3) + tx x0, greatest(0, r-2) + ty y0, least(40, c+4) + tx x1, least(32, r+3) + ty y1 FROM fst WHERE k = 1 AND (r+c) % 3 <> 2), {KEPT},
 kpt AS (SELECT rk.* FROM rk JOIN fin USING (image_id, class_id, k)),
 msk AS (SELECT image_id, det_id, CAST(r AS INT) r, CAST(c AS INT) c FROM kpt, unnest(range(y0, y1)) a(r), unnest(range(x0, x1)) b(c)),
 rnk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, det_id DESC) instance FROM (SELECT image_id, det_id, count(*) n FROM msk GROUP BY ALL)),
 pnt AS (SELECT image_id, r, c, max(instance) instance, arg_max(class_id, instance) class_id, arg_max(score, instance) confidence FROM msk JOIN rnk USING (image_id, det_id) JOIN kpt USING (image_id, det_id) GROUP BY ALL)"""


def stub_models():
    """Models that need no weights: a box around a tile's darkest cell, named and scored by the cell's row and column; all of its cells."""

    def detect(image, prompt):
        r, c = (int(x) for x in np.argwhere(image == image.min())[0])
        label = ("pine tree", "car", "house")[(r + c) % 3]
        return [(label, 0.3 + 0.001 * (r * 40 + c) / 1.28, (max(0, c - 3), max(0, r - 2), min(image.shape[1], c + 4), min(image.shape[0], r + 3)))]

    return detect, lambda image, boxes: [box_cells(b) for b in boxes]


def box_cells(box):
    x0, y0, x1, y1 = map(int, box)
    return np.stack(np.meshgrid(np.arange(y0, y1), np.arange(x0, x1), indexing="ij"), -1).reshape(-1, 2)


@query(f"{RAN} SELECT p.point_id, p.station_id, p.u, p.v, CAST(coalesce(q.instance, 0) AS INT) instance, CAST(coalesce(q.class_id, 0) AS INT) class_id, {o6('coalesce(q.confidence, 0)::FLOAT::DOUBLE')} confidence FROM pix p LEFT JOIN pnt q ON q.image_id = p.station_id AND q.r = p.v AND q.c = p.u")
def whole_run(spark, d):
    """From points to labelled points: images, tiles, stub models, suppression across tiles, merging, lifting."""
    settings = S.DetectionSettings(prompt="tree.car", tile=TILE, overlap=OVERLAP, iou_threshold=0.3, large_share=0.5)
    out = labelling.run(X.points(spark, d), stub_models, detection_settings=settings)
    return out.select("point_id", "station_id", "u", "v", "instance", "class_id", r6(F.col("confidence").cast("double")).alias("confidence"))


# Masks


@query(f"WITH {RNK} SELECT image_id, det_id, n, CAST(instance AS INT) instance FROM rnk")
def size_rank(spark, d):
    return D.ranked_by_size(X.mask_pixels(spark, d))


@query(f"WITH {PNT} SELECT image_id, r, c, CAST(instance AS INT) instance, class_id, {o6('confidence::FLOAT::DOUBLE')} confidence FROM pnt")
def painter_merge(spark, d):
    p = D.painted(X.mask_pixels(spark, d), X.detections(spark, d))
    return p.select("image_id", "r", "c", "instance", "class_id", r6(F.col("confidence").cast("double")).alias("confidence"))


DUP = f"{MSK}, dup AS (SELECT * FROM msk WHERE (r+c) % 5 <> 0 UNION ALL SELECT * FROM msk WHERE (r*c) % 3 = 0)"


def doubled(spark, d):
    """Masks with holes and repeated pixels."""
    m = X.mask_pixels(spark, d)
    return m.filter("(r+c) % 5 <> 0").unionByName(m.filter("(r*c) % 3 = 0"))


@query(f"WITH {DUP} SELECT DISTINCT det_id, image_id, r, c FROM dup")
def mask_distinct(spark, d):
    return D.distinct_pixels(doubled(spark, d))


@query(f"WITH {DUP}, own AS (SELECT DISTINCT image_id, det_id, r, c FROM dup) SELECT image_id, det_id, r, c FROM own o WHERE (SELECT count(*) FROM own i WHERE i.det_id = o.det_id AND i.image_id = o.image_id AND abs(i.r-o.r) + abs(i.c-o.c) = 1) < 4")
def mask_contours(spark, d):
    return D.contours(doubled(spark, d))


FRM = f"""{DET}, lin AS (SELECT image_id, det_id, class_id, CAST(v AS INT) v, CAST(u AS INT) u FROM det, unnest(range(x0, x1)) a(u), unnest([y0, y1-1]) b(v)
 UNION ALL SELECT image_id, det_id, class_id, CAST(v AS INT), CAST(u AS INT) FROM det, unnest(range(y0, y1)) a(v), unnest([x0, x1-1]) b(u))"""


@query(f"WITH {FRM} SELECT image_id, v, u, arg_max(class_id, det_id) class_id FROM lin GROUP BY ALL")
def box_frames(spark, d):
    """What is drawn of boxes: their outlines."""
    return pictures.framed(X.detections(spark, d))


@query(f"WITH {PIX}, {PNT}, ras AS (SELECT station_id image_id, v, u, CAST(floor(least(255, greatest(0, avg(least(1, greatest(0, z/4))) * 255))) AS INT) g FROM pix GROUP BY ALL) SELECT x.image_id, x.v, x.u, " + ", ".join(f"CAST(CASE WHEN class_id IS NULL THEN g ELSE floor(g*0.5e0 + ((class_id*{k} + 64) % 256)*0.5e0) END AS INT) {c}" for c, k in pictures.COLOUR.items()) + " FROM ras x LEFT JOIN pnt q ON q.image_id = x.image_id AND q.r = x.v AND q.c = x.u")
def mask_picture(spark, d):
    """Masks blended over a raster of heights."""
    at = placed_points(spark, d)
    level = F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z") / 4))).alias("value")
    cells = at.groupBy(F.col("station_id").alias("image_id"), "v", "u").agg(level)
    found = X.detections(spark, d)
    return pictures.drawn(cells, found, X.mask_pixels(spark, d), boxes=False)


@query(f"WITH {DUP} SELECT det_id, count(*) n, count(DISTINCT (r, c)) n_distinct FROM dup GROUP BY det_id")
def mask_sizes(spark, d):
    return doubled(spark, d).groupBy("det_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("r", "c").alias("n_distinct"))


@query(f"WITH {DUP}, cnt AS (SELECT image_id, det_id, count(DISTINCT (r, c)) n FROM dup GROUP BY ALL) SELECT image_id, det_id, n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, det_id DESC) AS INT) instance FROM cnt")
def size_rank_distinct(spark, d):
    return D.ranked_by_size(doubled(spark, d), distinct=True)


ENC = f"""{DUP}, pos AS (SELECT DISTINCT image_id, det_id, c*{H} + r p FROM dup), isl AS (SELECT image_id, det_id, min(p) s, count(*) l FROM (SELECT *, p - row_number() OVER (PARTITION BY det_id ORDER BY p) k FROM pos) GROUP BY image_id, det_id, k),
 gap AS (SELECT *, s - coalesce(lag(s + l) OVER (PARTITION BY det_id ORDER BY s), 0) g FROM isl),
 enc AS (SELECT image_id, det_id, string_agg(g || ',' || l, ',' ORDER BY s) || CASE WHEN max(s+l) < {W * H} THEN ',' || ({W * H} - max(s+l)) ELSE '' END counts FROM gap GROUP BY ALL)"""


@query(f"WITH {ENC} SELECT image_id, det_id, counts FROM enc")
def rle_encode(spark, d):
    return D.run_lengths(doubled(spark, d), H, W).withColumn("counts", F.array_join("counts", ","))


@query(f"WITH {DUP} SELECT DISTINCT image_id, det_id, r, c FROM dup")
def rle_decode(spark, d):
    return D.from_run_lengths(D.run_lengths(doubled(spark, d), H, W), H)


@query(f"""WITH {ENC}, {LAB} SELECT image_id, '{{"image_path":"images/' || image_id || '.png","annotations":[' || string_agg('{{"class_name":"' || class_name || '","bbox":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || '],"segmentation":{{"size":[{H},{W}],"counts":[' || counts || ']}},"score":' || score || '}}', ',' ORDER BY det_id) || '],"box_format":"xyxy","img_width":{W},"img_height":{H}}}' json
 FROM det JOIN enc USING (image_id, det_id) JOIN cls USING (class_id) GROUP BY image_id""")
def annotations_json(spark, d):
    return D.documents(X.detections(spark, d), D.run_lengths(doubled(spark, d), H, W), D.class_map(X.prompts(spark)), W, H)


@query(f"""WITH {LAB} SELECT '{{' || string_agg('"' || class_id || '":"' || class_name || '"', ',' ORDER BY class_id) || '}}' json FROM (SELECT class_id, class_name FROM cls UNION ALL SELECT 0, 'background')""")
def class_map_json(spark, d):
    return D.class_document(D.class_map(X.prompts(spark)))


@query(f"WITH {PIX}, {PNT} SELECT point_id, CASE WHEN {NARROW} THEN coalesce({o6('q.confidence::FLOAT::DOUBLE')}, 0) ELSE -1 END confidence FROM pix p LEFT JOIN pnt q ON q.image_id = p.station_id AND q.r = p.v AND q.c = p.u")
def lift_confidence(spark, d):
    p = placed_points(spark, d).withColumn("valid", F.expr("azim BETWEEN -2 AND 2 AND elev BETWEEN -0.1 AND 0.4"))
    out = labelling.labelled(p, X.detections(spark, d), X.mask_pixels(spark, d))
    return out.select("point_id", r6(F.col("confidence").cast("double")).alias("confidence"))


@query(f"WITH {DET} SELECT det_id FROM det WHERE class_id IN (1, 2) AND image_id <> 3")
def keep_and_drop(spark, d):
    """Selection by list: a semi and an anti join."""
    f = X.detections(spark, d)
    keep = spark.createDataFrame([(1,), (2,)], "class_id int")
    drop = spark.createDataFrame([(3,)], "image_id int")
    return f.join(keep, "class_id", "left_semi").join(drop, "image_id", "left_anti").select("det_id")


# Images


@query(f"WITH {PIX} SELECT station_id, f feature, v, u, {o6('avg(val)', 10)} AS value, count(*) n FROM (SELECT station_id, v, u, unnest(['intensity', 'z']) f, unnest([intensity, z]) val FROM pix) GROUP BY ALL")
def raster_raw(spark, d):
    return I.raster(placed_points(spark, d), ["intensity", "z"]).withColumn("value", r6("value", 10))


@query(f"WITH {PTS}, c AS (SELECT station_id, min(x) x0, min(y) y0 FROM pts GROUP BY station_id) SELECT station_id, CAST(floor((y-y0)/0.5e0) AS INT) v, CAST(floor((x-x0)/0.5e0) AS INT) u, {o6('avg(intensity)', 10)} AS value, count(*) n FROM pts JOIN c USING (station_id) GROUP BY ALL")
def raster_ortho(spark, d):
    return I.top_down(X.points(spark, d), "intensity", 0.5).withColumn("value", r6("value", 10))


BW, BH = 28, 16
NEAR = f"""{FOV}, pos AS (SELECT s.station_id, point_id, intensity, (azim-az_min)/(az_max-az_min)*{BW - 1} pu, (elev-el_min)/(el_max-el_min)*{BH - 1} pv FROM sph s JOIN fov USING (station_id)),
 gri AS (SELECT station_id, CAST(v AS INT) v, CAST(u AS INT) u FROM fov, range({BH}) a(v), range({BW}) b(u)),
 tri AS (SELECT *, row_number() OVER (PARTITION BY station_id, v, u ORDER BY sqrt((pu-u)**2 + (pv-v)**2), point_id) i FROM gri JOIN pos USING (station_id) QUALIFY i <= 3),
 abc AS (SELECT station_id, v, u, {', '.join(f"max({k}) FILTER (i = {i}) {n}{i}" for i in (1, 2, 3) for k, n in (('pu', 'x'), ('pv', 'y'), ('intensity', 'f')))} FROM tri GROUP BY ALL HAVING count(*) = 3),
 wgt AS (SELECT *, (y2-y3)*(x1-x3) + (x3-x2)*(y1-y3) det FROM abc),
 bar AS (SELECT *, ((y2-y3)*(u-x3) + (x3-x2)*(v-y3))/det a, ((y3-y1)*(u-x3) + (x1-x3)*(v-y3))/det b FROM wgt)"""


@query(f"WITH {NEAR} SELECT station_id, v, u, {o6('CASE WHEN abs(det) < 1e-9 THEN f1 ELSE (greatest(0,a)*f1 + greatest(0,b)*f2 + greatest(0,1-a-b)*f3)/(greatest(0,a) + greatest(0,b) + greatest(0,1-a-b)) END')} AS value FROM bar")
def raster_bary_knn(spark, d):
    p = spherical_points(spark, d)
    p = P.with_view(p, P.field_of_view(p))
    across = lambda k, lo, hi, n: F.try_divide(F.col(k) - F.col(lo), F.col(hi) - F.col(lo)) * (n - 1)
    at = p.select("station_id", "point_id", across("azim", "az_min", "az_max", BW).alias("pu"), across("elev", "el_min", "el_max", BH).alias("pv"), F.col("intensity").alias("value"))
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = at.select("station_id").distinct().select("station_id", axis(BH).alias("v")).select("station_id", "v", axis(BW).alias("u"))
    return I.barycentric(I.nearest_three(grid, at, 1.0)).withColumn("value", r6("value"))


@query(f"WITH {CEL} SELECT c.image_id, c.v, c.u, CASE WHEN isnan(c.value) THEN coalesce({o6('avg(k.value)')}, any_value(c.value)) ELSE {o6('any_value(c.value)')} END AS value FROM cel c LEFT JOIN cel k ON isnan(c.value) AND NOT isnan(k.value) AND k.image_id = c.image_id AND abs(k.v-c.v) <= 1 AND abs(k.u-c.u) <= 1 GROUP BY c.image_id, c.v, c.u, c.value")
def raster_nanconv(spark, d):
    return I.filled_from_neighbours(X.image_cells(spark, d)).withColumn("value", r6("value"))


def _fill(kind, name, sql_fill, sql_high="high"):
    def f(spark, d):
        out = I.filled(X.image_cells(spark, d), kind)
        return out.select("image_id", "v", "u", r6("value").alias("value"), r6("high").alias("high"))

    f.__name__ = name
    return query(f"WITH {LIM} SELECT image_id, v, u, {o6(f'CASE WHEN isnan(value) THEN {sql_fill} ELSE value END')} AS value, {o6(sql_high)} high FROM cel JOIN lim USING (image_id)")(f)


nan_fill_max = _fill("max", "nan_fill_max", "high")
nan_fill_min = _fill("min", "nan_fill_min", "low")
nan_fill_zero = _fill("zero", "nan_fill_zero", "0e0")
nan_fill_const = _fill(0.25, "nan_fill_const", "0.25e0", "greatest(0.25e0, high)")


@query(None)
def nan_fill_random(spark, d):
    """Seeded random values between the image's limits: no SQL says the same."""
    return I.filled(X.image_cells(spark, d), "random", seed=3).select("image_id", "v", "u", "value")


FIL = f"{LIM}, fil AS (SELECT image_id, v, u, low, high, CASE WHEN isnan(value) THEN high ELSE value END x FROM cel JOIN lim USING (image_id))"


@query(f"WITH {FIL} SELECT image_id, v, u, {o6('CASE WHEN high = low THEN 0 ELSE (x-low)/(high-low) END')} AS value FROM fil")
def minmax_01(spark, d):
    return I.scaled(I.filled(X.image_cells(spark, d)), 1.0).select("image_id", "v", "u", r6("value").alias("value"))


@query(f"WITH {FIL} SELECT image_id, v, u, {o6('CASE WHEN high = low THEN 0 ELSE (x-low)/(high-low)*255 END')} AS value FROM fil")
def minmax_255(spark, d):
    return I.scaled(I.filled(X.image_cells(spark, d)), 255.0).select("image_id", "v", "u", r6("value").alias("value"))


@query(f"WITH {FIL} SELECT image_id, v, u, CAST(trunc(CASE WHEN high = low THEN 0 ELSE (x-low)/(high-low)*255 END) AS SMALLINT) AS value FROM fil")
def to_uint8(spark, d):
    return I.scaled(I.filled(X.image_cells(spark, d)), 255.0).select("image_id", "v", "u", I.as_bytes(F.col("value")).alias("value"))


@query(f"WITH {CEL}, pct AS (SELECT image_id, quantile_cont(value, 0.05) FILTER (NOT isnan(value)) a, quantile_cont(value, 0.95) FILTER (NOT isnan(value)) b FROM cel GROUP BY image_id) SELECT image_id, v, u, CASE WHEN isnan(value) THEN value ELSE {o6('CASE WHEN a = b THEN 0 ELSE (greatest(a, least(b, value)) - a)/(b-a) END')} END AS value FROM cel JOIN pct USING (image_id)")
def percentile_norm(spark, d):
    return I.percentile_scaled(X.image_cells(spark, d)).withColumn("value", r6("value"))


LZ = "CASE WHEN abs(t) < 1e-12 THEN 1e0 WHEN abs(t) >= 3 THEN 0e0 ELSE 3*sin(pi()*t)*sin(pi()*t/3)/(pi()*t*pi()*t) END"


@query(f"""WITH {FIL}, tap AS (SELECT i, greatest(0, least(7, j)) k, sum({LZ}) w FROM (SELECT i, j, (j - ((i+0.5e0)/0.5e0-0.5e0))*0.5e0 t FROM range(4) a(i), range(-8, 16) b(j) WHERE abs(j - ((i+0.5e0)/0.5e0-0.5e0)) <= 6) GROUP BY ALL),
 one AS (SELECT image_id, v, i u, sum(w*x)/sum(w) x FROM fil JOIN tap ON k = u GROUP BY ALL) SELECT image_id, CAST(i AS INT) v, CAST(u AS INT) u, {o6('sum(w*x)/sum(w)')} AS value FROM one JOIN tap ON k = v GROUP BY image_id, i, u""")
def lanczos_resize(spark, d):
    return I.resized(X.image_cells(spark, d), 8, 8, 0.5).select("image_id", "v", "u", r6("value").alias("value"))


@query(f"WITH {PTS}, m AS (SELECT *, sqrt(x*x+y*y) s FROM pts), c AS (SELECT station_id, quantile_cont(s, 0.95) q FROM m GROUP BY station_id) SELECT point_id, {o6('(atan2(y,x)+pi())/(2*pi())')} hue, {o6('least(1, s/q)')} strength FROM m JOIN c USING (station_id)")
def flow_colour(spark, d):
    return I.flow_colour(X.points(spark, d), "x", "y").select("point_id", r6("hue").alias("hue"), r6("strength").alias("strength"))


@query(f"WITH {FIL} SELECT image_id, count(*) n, bool_or(x > 0.2e0) any_over, {o6('min(x)')} low, {o6('max(x)')} high FROM fil GROUP BY image_id")
def image_range(spark, d):
    """Value range and any(): what decides whether an encoded image passes through unchanged."""
    x = I.filled(X.image_cells(spark, d)).groupBy("image_id")
    return x.agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("value") > 0.2).alias("any_over"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"))


@query("SELECT CAST(i AS INT) i, printf('%.8f %.8f %.8f %.8f', a, b, c, e) line FROM (VALUES (0, cos(radians(30e0)), -sin(radians(30e0)), 0e0, 1.5e0), (1, sin(radians(30e0)), cos(radians(30e0)), 0e0, -0.75e0), (2, 0e0, 0e0, 1e0, 0.25e0), (3, 0e0, 0e0, 0e0, 1e0)) t(i, a, b, c, e)")
def matrix_text(spark, d):
    from ..sources.files import matrix_lines

    return spark.createDataFrame([(i, line) for i, line in enumerate(matrix_lines(TO_PROJECT))], "i int, line string")


@query("SELECT o_orderkey det_id, 'scan_' || (o_custkey % 8) stem FROM orders")
def path_stem(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    path = F.concat(F.lit("/data/run.1/scan_"), F.col("o_custkey") % 8, F.lit(".png"))
    return o.select(F.col("o_orderkey").alias("det_id"), S.file_stem(path).alias("stem"))


@query(f"WITH {CEL} SELECT image_id, v r, u c FROM cel WHERE value > 0 AND NOT isnan(value)")
def nonzero(spark, d):
    """Dense rows to sparse pixels, row-major."""
    dense = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 17 == 0, F.lit(float("nan"))).otherwise(x.cast("double"))).alias("values"))
    return D.set_pixels(dense, "values", 8)
