"""From coloured, classified points to sparse voxel tables.

Every table is keyed by ``keys`` (the cloud) and, once voxelised, by voxel_size and ix, iy, iz.  Points are
dealt by voxel, never by cloud, so one giant cloud spreads over all tasks.  Values of a whole cloud (minima,
class codes, largest counts) come from one aggregate that is written and joined back by ``attach``; the voxel
table is written once and is what all later operators read, so points are scanned three times in all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.shared import attach, written

KEYS = ("tree_id",)
AXES = {0: ("y", "z", "x"), 1: ("x", "z", "y"), 2: ("x", "y", "z")}
CELL = ("ix", "iy", "iz")


def permute_axes(points: DataFrame, vertical_axis: int = 2) -> DataFrame:
    """Name the vertical axis z; an unknown axis counts as 2."""
    a, b, c = AXES.get(vertical_axis, AXES[2])
    return points.withColumns({"x": F.col(a), "y": F.col(b), "z": F.col(c)})


def _codes() -> Column:
    """The distinct class codes of a cloud, ascending: a LAS file has at most 256."""
    return F.array_sort(F.collect_set("raw_class")).alias("codes")


def _lows(mask: Column | None = None) -> list[Column]:
    return [F.min(F.col(a) if mask is None else F.when(mask, F.col(a))).alias(f"min_{a}") for a in "xyz"]


def _coded(points: DataFrame) -> DataFrame:
    return points.withColumn("cls", (F.array_position("codes", F.col("raw_class")) - 1).cast("int")).drop("codes")


def _celled(points: DataFrame, sizes: Sequence[float]) -> DataFrame:
    p = points.withColumn("voxel_size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    return p.withColumns({f"i{a}": F.floor((F.col(a) - F.col(f"min_{a}")) * (1.0 / F.col("voxel_size"))).cast("long") for a in "xyz"}).drop("min_x", "min_y", "min_z")


def class_codes(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add cls: the dense rank from 0 of raw_class within the cloud."""
    return _coded(attach(points, points.groupBy(*keys).agg(_codes()), keys))


def voxel_index(points: DataFrame, sizes: Sequence[float] = (0.1,), keys: Sequence[str] = KEYS) -> DataFrame:
    """Add voxel_size and the cell of every point, truncating (p - min) / size; one copy of the points per size."""
    return _celled(attach(points, points.groupBy(*keys).agg(*_lows()), keys), sizes)


def indexed(points: DataFrame, sizes: Sequence[float] = (0.1,), keys: Sequence[str] = KEYS, mask: Column | None = None) -> DataFrame:
    """``class_codes`` of all points, then ``voxel_index`` of those that the mask keeps, from one aggregate."""
    p = attach(points if mask is None else points.where(mask), points.groupBy(*keys).agg(_codes(), *_lows(mask)), keys)
    return _celled(_coded(p), sizes)


def band_filter(points: DataFrame, percentage: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the points of a voxel whose three colours all lie within the voxel's own percentile bands, ends included.

    Ends are rounded to nine places, so that a colour that equals one is not lost to its last bit.
    """
    k = [*keys, "voxel_size", *CELL]
    ends = [percentage / 100.0, 1.0 - percentage / 100.0]
    band = points.groupBy(*k).agg(*[F.transform(F.percentile(c, ends), lambda q: F.round(q, 9)).alias(f"band_{c}") for c in ("red", "green", "blue")])
    inside = F.lit(True)
    for c in ("red", "green", "blue"):
        inside = inside & F.col(c).between(F.col(f"band_{c}")[0], F.col(f"band_{c}")[1])
    return points.join(band, k).where(inside).drop("band_red", "band_green", "band_blue")


def accumulate(points: DataFrame, percentage: float | None = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts and colour sums by voxel: n, sr, sg, sb, ground (class code 1), treeid.

    With a percentage the band filter comes first and treeid is that of the first point kept; without, that
    of the last.  A voxel that keeps no point has no row.
    """
    p = points if percentage is None else band_filter(points, percentage, keys)
    pick = F.max_by if percentage is None else F.min_by
    return p.groupBy(*keys, "voxel_size", *CELL).agg(
        F.count("*").alias("n"), F.sum("red").alias("sr"), F.sum("green").alias("sg"), F.sum("blue").alias("sb"),
        F.count_if(F.col("cls") == 1).alias("ground"), pick("treeid", "ord").alias("treeid"))


def finalise(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxel table: mean colours 0..1, density relative to the fullest voxel, class 2 (ground) or 4; a tie is 4."""
    v = attach(cells, cells.groupBy(*keys, "voxel_size").agg(F.max("n").alias("most")), [*keys, "voxel_size"])
    mean = {c: F.col(f"s{c}") / F.col("n") / 255.0 for c in "rgb"}
    v = v.withColumns(mean | {"density": F.least(F.col("n") / F.col("most"), F.lit(1.0)), "cls": F.when(F.col("ground") > F.col("n") - F.col("ground"), 2).otherwise(4)})
    return v.select(*keys, "voxel_size", *CELL, "n", "r", "g", "b", "density", "cls", "treeid")


def colour_rows(voxels: DataFrame, keys: Sequence[str] = KEYS, offset: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """(keys, x, y, z, r, g, b) of voxels that are not black: cells moved by an offset, colours to 255."""
    at = [(F.col(c) + F.lit(o)).alias(c[1]) for c, o in zip(CELL, offset, strict=True)]
    return voxels.where("r != 0 or g != 0 or b != 0").select(*keys, *at, *[(F.col(c) * 255).alias(c) for c in "rgb"])


def voxelise(points: DataFrame, sizes: Sequence[float] = (0.1,), percentage: float | None = 5, keys: Sequence[str] = KEYS, mask: Column | None = None) -> DataFrame:
    """Points with raw_class to the voxel table; cells are written once."""
    return finalise(written(accumulate(indexed(points, sizes, keys, mask), percentage, keys), "voxel-cells"), keys)
