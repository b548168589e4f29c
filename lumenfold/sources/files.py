"""Sources and sinks: point tables, ASCII PLY, image files, matrices, class maps, annotation documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: PLY's scalar types.
PLY_TYPES = {"char": "int", "uchar": "int", "short": "int", "ushort": "int", "int": "int", "uint": "bigint", "float": "double", "double": "double", "int8": "int", "uint8": "int", "int16": "int", "uint16": "int", "int32": "int", "uint32": "bigint", "float32": "double", "float64": "double"}
FOLDERS = ("images", "object_detection", "sam2", "masks_json", "socs_point_clouds")


def read_points(spark: SparkSession, path: str, features: Sequence[str] = ()) -> DataFrame:
    """A Parquet point table, read only in the columns asked for; a missing feature fails before any job."""
    points = spark.read.parquet(path)
    if missing := {"station_id", "point_id", "x", "y", "z", *features} - set(points.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return points.select("station_id", "point_id", "x", "y", "z", *features)


def write_points(points: DataFrame, path: str, by: Sequence[str] = ("station_id",)) -> None:
    points.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of one ASCII PLY file, with point_id in file order and a column for each scalar field."""
    lines, n = spark.read.text(path), 200
    while True:
        header = [r[0].strip() for r in lines.limit(n).collect()]  # a header, never the points
        if "end_header" in header or len(header) < n or header[0] != "ply":
            break
        n *= 4
    if not header or header[0] != "ply" or "format ascii 1.0" not in header or "end_header" not in header:
        raise ValueError(f"not an ASCII PLY file: {path}")
    end = header.index("end_header")
    elements = [h.split() for h in header[:end] if h.startswith(("element ", "property "))]
    at = next((i for i, e in enumerate(elements) if e[:2] == ["element", "vertex"]), None)
    if at != 0:
        raise ValueError("vertices must be the first element")
    rest = [i for i, e in enumerate(elements[1:], 1) if e[0] == "element"]
    fields = [(e[2], PLY_TYPES[e[1]]) for e in elements[1 : rest[0] if rest else None]]
    n = int(elements[0][2])
    # A line's place: files are read whole, in order, and the place within each part is offset by the parts before.
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the file
    starts = cut(numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("k")).select(F.col("p").alias("_p"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_start")))
    numbered = numbered.join(starts, part == F.col("_p"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    body = numbered.select((place - (end + 1)).alias("point_id"), F.split(F.trim("value"), r"\s+").alias("v")).filter(F.col("point_id").between(0, n - 1))
    return body.select("point_id", *[F.get("v", i).try_cast(t).alias(name) for i, (name, t) in enumerate(fields)])


def ply_lines(points: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(place, value): the lines of an ASCII PLY file, header first, vertices by point_id."""
    spark, kinds = points.sparkSession, dict(points.dtypes)
    names = {"int": "int", "bigint": "int", "smallint": "short"}
    head = ["ply", "format ascii 1.0", f"element vertex {points.count()}", *[f"property {names.get(kinds[f], 'double')} {f}" for f in fields], "end_header"]
    top = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "place long, value string")
    return top.unionByName(points.select(F.col("point_id").cast("long").alias("place"), F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]).alias("value")))


def write_ply(points: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Writes a folder of text parts, in order."""
    ply_lines(points, fields).orderBy("place").select("value").write.mode("overwrite").text(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, wherever the path's file system is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_ply_file(points: DataFrame, path: str, fields: Sequence[str]) -> None:
    """One .ply file, as its format has it: the lines are sorted and written by one task, with spilling, and the part gets the file's name."""
    spark = points.sparkSession
    ply_lines(points, fields).repartition(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(f"{path}.parts")
    jvm = spark.sparkContext._jvm
    folder, to = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.parts", path))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")]
    fs.delete(to, False)
    if len(parts) != 1 or not fs.rename(parts[0], to):
        raise OSError(f"cannot write {path}")
    fs.delete(folder, True)


def write_station(points: DataFrame, folder: str, stem: str, feature: str, matrix: np.ndarray, fields: Sequence[str]) -> tuple[str, str]:
    """A labelled station as <stem>_<feature>_seg.ply and its 4x4 matrix as <stem>_T.txt; gives both paths."""
    ply, text = f"{folder}/{stem}_{feature}_seg.ply", f"{folder}/{stem}_T.txt"
    write_ply_file(points, ply, fields)
    write_text(points.sparkSession, text, "".join(f"{x}\n" for x in matrix_lines(matrix)))
    return ply, text


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, content) of image files; decoding is the model stage's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def matrix_lines(matrix: np.ndarray) -> list[str]:
    """A 4x4 matrix as text, eight decimals."""
    return [" ".join(f"{x + 0.0:.8f}" for x in row) for row in np.asarray(matrix, float)]


def write_lines(df: DataFrame, path: str) -> None:
    """Documents of one text column."""
    df.write.mode("overwrite").text(path)


def output_folders(root: str) -> dict[str, str]:
    return {name: f"{root}/intermediate/{name}" for name in FOLDERS}
