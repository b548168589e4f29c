"""Point clouds, detections, masks, images and labels derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detections as D

WIDTH, HEIGHT = 112, 64
PROMPT = "widget.old.gear.bolt.red"
#: Setting forms: pid, image width, scan resolution, rotation.
PARAMS = (
    (1, "1024", "0.09", "False"), (2, "scan_resolution", "1.6mm@10m", "auto"), (3, "0.2-scan_resolution", "0.05", "12.5"),
    (4, "bogus", "auto", "x"), (5, " 0.5 Scan_Resolution", "3 MM@25 m", "-90"), (6, "-4", "1mm@", "0"), (7, "1.5.2-scan_resolution", "", "True"), (8, "", "1e-2", "1_0"),
)

# The same derivations as SQL text that both engines read.
POINTS_SQL = "SELECT event_id point_id, CAST(user_id % 3 AS INT) station_id, ((event_id*37) % 2003)/100e0 - 10.01e0 x, ((event_id*91) % 1999)/100e0 - 9.97e0 y, value/100e0 - 1e0 z, value intensity FROM events"
DETECTIONS_SQL = """SELECT o_orderkey det_id, CAST(o_custkey % 8 AS INT) image_id, CAST(substr(o_orderpriority,1,1) AS INT) class_id, o_totalprice/1e6 score,
 CAST(o_orderkey % 97 AS INT) x0, CAST((o_orderkey*7) % 53 AS INT) y0, CAST(o_orderkey % 97 + 3 + o_custkey % 11 AS INT) x1, CAST((o_orderkey*7) % 53 + 3 + o_custkey % 7 AS INT) y1
 FROM orders"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", POINTS_SQL)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box an order, on eight images."""
    return _view(spark, sf_dir, "orders", DETECTIONS_SQL)


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mask_pixels(detections(spark, sf_dir))


def image_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images, one for each embedding, with some NaN."""
    cells = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    value = F.when((F.col("image_id") + F.col("p")) % 17 == 0, F.lit(float("nan"))).otherwise(F.col("e").cast("double"))
    return cells.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("v"), (F.col("p") % 8).cast("int").alias("u"), value.alias("value"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("raw_label"), F.lit(PROMPT).alias("prompt"))


def prompts(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(PROMPT).alias("prompt"))


def params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARAMS), "pid int, image_width string, scan_resolution string, rotate string")


def images(spark: SparkSession, n: int = 8) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("image_id"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
