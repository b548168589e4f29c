"""Settings as texts: parsers on columns, and checks on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of a setting.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WIDTH = r"^([0-9.]+)[ \t-]*scan_resolution$"
AT = r"(?i)^\s*([0-9]+\.?[0-9]*|\.[0-9]+)\s*mm\s*@\s*([0-9]+\.?[0-9]*|\.[0-9]+)\s*m\s*$"


def number(text: Column) -> Column:
    """A text as a double, null where it isn't a plain number."""
    said = F.trim(text)
    return F.when(said.rlike(NUMBER), said.try_cast("double"))


def image_width(text: Column, span: Column, spacing: Column) -> Column:
    """Pixels: a whole number as it is, scan_resolution as span / spacing, f-scan_resolution as that share of it; else null."""
    said = F.lower(F.trim(text))
    full = F.ceil(F.try_divide(span, spacing))
    share = number(F.regexp_extract(said, WIDTH, 1))
    return F.when(said.rlike("^[0-9]+$"), said.try_cast("long")).when(said == "scan_resolution", full).when(said.rlike(WIDTH), F.ceil(full * share)).cast("long")


def scan_resolution(text: Column) -> Column:
    """Radians: of degrees, or of 'X mm@Y m' by the arc sine; null for auto and for what is no setting."""
    step = F.regexp_extract(text, AT, 1).try_cast("double") / 1000
    return F.when(F.lower(F.trim(text)) == "auto", F.lit(None)).when(text.rlike(AT), F.asin(F.try_divide(step, F.regexp_extract(text, AT, 2).try_cast("double")))).otherwise(F.radians(number(text)))


def rotation(text: Column) -> Column:
    """Degrees as given; NaN for auto; null where it isn't a setting. 'false' is 0: nothing turns."""
    said = F.lower(F.trim(text))
    return F.when(said == "auto", F.lit(float("nan"))).when(said == "false", 0.0).when(said == "true", 1.0).otherwise(number(text))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _numbers(name: str, values: Sequence | None, n: int) -> None:
    if values is None:
        return
    if len(values) != n:
        raise ValueError(f"{name} needs {n} numbers, not {len(values)}")
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values):
        raise TypeError(f"{name} needs numbers: {values!r}")
    half = n // 2
    if any(a > b for a, b in zip(values[:half], values[half:], strict=True)):
        raise ValueError(f"{name} has a lower limit above an upper one: {values!r}")


@dataclass(frozen=True)
class PointSettings:
    range_limits: Sequence[float] | None = None
    roi_limits: Sequence[float] | None = None
    output_resolution: float = 0.5

    def __post_init__(self):
        _numbers("range_limits", self.range_limits, 2)
        _numbers("roi_limits", self.roi_limits, 6)


@dataclass(frozen=True)
class ImageSettings:
    """width: as image_width() reads it. height: rows, 0 for the view's ratio rounded down, None for square pixels rounded up.
    scan_resolution and rotate: texts as their parsers read them, with auto. reduce: whether images finer than the output shrink."""

    width: int | str = 112
    height: int | None = 64
    scan_resolution: str = "auto"
    rotate: str = "False"
    method: str = "raw"
    features: Sequence[str] = ("intensity",)
    fill: str | float = "max"
    percentiles: tuple[float, float] = (0.05, 0.95)
    patches: int = 10
    reduce: bool = False

    def __post_init__(self):
        if self.method not in ("raw", "nanconv"):
            raise ValueError(f"no such way to rasterise in a run: {self.method!r}")


@dataclass(frozen=True)
class DetectionSettings:
    prompt: str = "tree.car"
    box_threshold: float = 0.1
    tile: tuple[int, int] = (400, 400)
    overlap: tuple[int, int] = (100, 100)
    process_edges: bool = False
    strategy: str = "nms"
    iou_threshold: float = 0.8
    large_share: float = 0.1
    batch: int = 16

    def __post_init__(self):
        if self.strategy.lower() != "nms":
            raise ValueError(f"unknown overlap strategy: {self.strategy!r}")
        if "background" in self.prompt.split("."):
            raise ValueError("background is class 0 and cannot be asked for")
        if any(o >= s for s, o in zip(self.tile, self.overlap, strict=True)):
            raise ValueError("tiles must be larger than their overlap")
