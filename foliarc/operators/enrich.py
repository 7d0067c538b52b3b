"""Masks, trimming and index channels of voxel tables.

A voxel whose channels are all zero is the same as a row that is absent, so masks that zero a voxel drop it;
ground removal zeroes colours only, since the voxel's density still counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.functions import color
from foliarc.operators.components import connected_components
from foliarc.operators.voxel import CELL, KEYS
from foliarc.schema import ChannelLimit
from foliarc.shared import attach, kept, written

EPSILON = 2.0**-23  # of single precision


def coloured(floor: float = 0.0) -> Column:
    """Whether any colour of a voxel is above the floor."""
    return F.greatest("r", "g", "b") > floor


def remove_ground(voxels: DataFrame) -> DataFrame:
    """Black out voxels of class 2 or 0."""
    return voxels.withColumns({c: F.when(F.col("cls").isin(0, 2), 0.0).otherwise(F.col(c)) for c in "rgb"})


def colours_at(voxels: DataFrame, cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """r, g, b of the given cells (keys, voxel_size, ix, iy, iz), each once; black where there is no voxel."""
    k = [*keys, "voxel_size", *CELL]
    found = cells.select(*k).distinct().join(voxels.select(*k, "r", "g", "b"), k, "left")
    return found.select(*k, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgb"])


def recolour(voxels: DataFrame, cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxels with the colours that cells (keys, voxel_size, ix, iy, iz, r, g, b) gives for theirs.

    A cell without a voxel becomes a row whose other columns are null; of rows that repeat a cell the largest colours count.
    """
    k = [*keys, "voxel_size", *CELL]
    new = kept(cells.groupBy(*k).agg(F.max(F.struct("r", "g", "b")).alias("_new")), "cells")
    v = attach(voxels, new, k, "left").withColumns({c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) for c in "rgb"}).drop("_new")
    more = new.join(voxels.select(*k), k, "left_anti").select(*k, "_new.*")
    return v.unionByName(more, allowMissingColumns=True)


def density_mask(voxels: DataFrame, threshold: float = 0.25) -> DataFrame:
    return voxels.where(F.col("density") >= threshold)


def noise_floor(voxels: DataFrame, threshold: float) -> DataFrame:
    """Keep voxels whose colour sum is above the threshold."""
    return voxels.where(F.col("r") + F.col("g") + F.col("b") > threshold)


def at_least(voxels: DataFrame, channel: str, threshold: float) -> DataFrame:
    """Keep voxels whose channel is at least the threshold (NaN never is)."""
    return voxels.where((F.col(channel) >= threshold) & ~F.isnan(channel))


def bounding_box(voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, voxel_size, min and max of each index, nx, ny, nz) over voxels that are not black."""
    k = [*keys, "voxel_size"]
    box = voxels.where((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)).groupBy(*k)
    box = box.agg(*[f(c).alias(f"{n}_{c}") for c in CELL for n, f in (("lo", F.min), ("hi", F.max))])
    return box.withColumns({f"n{c[1]}": F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1 for c in CELL})


def trim(voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cut to the bounding box and count indices from its corner; adds nx, ny, nz.  All rows in the box stay, black ones too."""
    v = attach(voxels, bounding_box(voxels, keys), [*keys, "voxel_size"])
    for c in CELL:
        v = v.where(F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")))
    v = v.withColumns({c: F.col(c) - F.col(f"lo_{c}") for c in CELL})
    return v.drop(*[f"{n}_{c}" for c in CELL for n in ("lo", "hi")])


def density_norm(voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add density_norm: density scaled by its least and largest value over the whole box, empty cells being 0; NaN where both are equal."""
    k = [*keys, "voxel_size"]
    s = voxels.groupBy(*k).agg(F.count_if(F.col("density") > 0).alias("full"), F.min("density").alias("mn"), F.max("density").alias("mx"), F.first("nx").alias("x1"), F.first("ny").alias("y1"), F.first("nz").alias("z1"))
    s = s.select(*k, F.when(F.col("full") < F.col("x1") * F.col("y1") * F.col("z1"), 0.0).otherwise(F.col("mn")).alias("mn"), "mx")
    v = attach(voxels, s, k)
    return v.withColumn("density_norm", F.when(F.col("mx") == F.col("mn"), F.lit(float("nan"))).otherwise((F.col("density") - F.col("mn")) / (F.col("mx") - F.col("mn")))).drop("mn", "mx")


#: Channels by name: a function of the table's columns.  Callers add their own.
CHANNELS: dict[str, Callable[[], Column]] = {
    "gli": lambda: color.gli(F.col("r"), F.col("g"), F.col("b")),
    "ngrdi": lambda: color.ngrdi(F.col("r"), F.col("g")),
    "exr": lambda: color.exr(F.col("r"), F.col("g"), F.col("b")),
}


def enrich(voxels: DataFrame, threshold: float = 0.0, keys: Sequence[str] = KEYS, filters: Sequence[Callable[[DataFrame], DataFrame]] = (remove_ground,), masks: Sequence[Column] = (), post: Sequence[Callable[[DataFrame], DataFrame]] = (), channels: Mapping[str, Callable[[], Column]] = CHANNELS) -> DataFrame:
    """Filters, masks, post filters and trimming, then one column per channel; density_norm always."""
    v = voxels
    for f in filters:
        v = v.transform(f)
    v = density_mask(v, threshold)
    for m in masks:
        v = v.where(m)
    for f in post:
        v = v.transform(f)
    return density_norm(trim(v, keys), keys).withColumns({name: f() for name, f in channels.items()})


def limit_predicate(limit: ChannelLimit) -> Column:
    """Whether a voxel passes a limit.  Exclusive: inside the open range; inclusive: outside of it, ends included."""
    c, out = F.col(limit.name), F.lit(True)
    real = ~F.isnan(c)
    if limit.min is not None and limit.max is not None:
        out = ((c <= limit.min) | (c >= limit.max)) if limit.inclusive else ((c > limit.min) & (c < limit.max))
    elif limit.max is not None:
        out = (c >= limit.max) if limit.inclusive else (c < limit.max)
    elif limit.min is not None:
        out = (c <= limit.min) if limit.inclusive else (c > limit.min)
    compares = limit.min is not None or limit.max is not None
    return out & real if compares or limit.mask_na else out


def channel_limits(voxels: DataFrame, limits: Sequence[ChannelLimit]) -> DataFrame:
    """Keep the voxels that pass every limit."""
    for x in limits:
        voxels = voxels.where(limit_predicate(x))
    return voxels


def proportions(voxels: DataFrame) -> DataFrame:
    """Colour proportions, red-green and blue-green indices, luminosity and balance, in place of r, g, b."""
    s = F.col("r") + F.col("g") + F.col("b")
    part = {f"{c}_part": F.when(s != 0, F.col(c) / s).otherwise(0.0) for c in "rgb"}
    v = voxels.withColumns(part | {"rgri": (F.col("r") - F.col("g")) / (F.col("r") + F.col("g") + EPSILON), "bgri": (F.col("b") - F.col("g")) / (F.col("b") + F.col("g") + EPSILON), "luminosity": s / 3.0})
    return v.withColumn("balance", 1.0 - (F.greatest("r_part", "g_part", "b_part") - F.least("r_part", "g_part", "b_part")))


def dense_share(voxels: DataFrame, floor: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per cloud the percentage of occupied voxels denser than the floor."""
    return voxels.where("density > 0").groupBy(*keys, "voxel_size").agg((F.avg(F.when(F.col("density") > floor, 1.0).otherwise(0.0)) * 100.0).alias("dense_percent"))


def box_mean_mask(voxels: DataFrame, threshold: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells whose 3 x 3 x 3 mean of the mean colour, zeros outside, is above the threshold: (keys, voxel_size, cell, mean).

    The mean is compared at nine places, so a cell that equals the threshold is out in whatever order its parts are summed.
    """
    k = [*keys, "voxel_size"]
    v = voxels.select(*k, *CELL, ((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("m"), "nx", "ny", "nz")
    d = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for c in CELL:
        v = v.withColumn("d", F.explode(d)).withColumn(c, F.col(c) + F.col("d")).where((F.col(c) >= 0) & (F.col(c) < F.col(f"n{c[1]}")))
    return v.groupBy(*k, *CELL).agg((F.sum("m") / 27.0).alias("mean")).where(F.round("mean", 9) > threshold)


def trim_bottom(voxels: DataFrame, keys: Sequence[str] = KEYS, count: int = 10) -> DataFrame:
    """Cut the layers more than one below that in which the count-th coloured voxel lies, counting from the bottom; re-bases iz."""
    k = [*keys, "voxel_size"]
    layers = voxels.where(coloured()).groupBy(*k, "iz").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*k).orderBy("iz")
    cut = layers.withColumn("sum", F.sum("n").over(up)).where(F.col("sum") >= count).groupBy(*k).agg(F.min("iz").alias("at"))
    cut = cut.select(*k, F.when(F.col("at") - 1 > 0, F.col("at") - 1).otherwise(0).alias("cut"))
    v = attach(voxels, cut, k, "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return v.where(F.col("iz") >= F.col("cut")).withColumn("iz", F.col("iz") - F.col("cut")).drop("cut")


def layer(voxels: DataFrame, z: int) -> DataFrame:
    """One horizontal layer with zeros as nulls."""
    return voxels.where(F.col("iz") == z).withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in "rgb"})


def cell(voxels: DataFrame, ix: int, iy: int, iz: int) -> DataFrame:
    """The voxel at a place, in every cloud that has one there."""
    return voxels.where((F.col("ix") == ix) & (F.col("iy") == iy) & (F.col("iz") == iz))


def with_cell(voxels: DataFrame, ix: int, iy: int, iz: int, **channels: float) -> DataFrame:
    """The table with channels of the voxel at a place set, in every cloud that has one there."""
    here = (F.col("ix") == ix) & (F.col("iy") == iy) & (F.col("iz") == iz)
    return voxels.withColumns({c: F.when(here, F.lit(float(v))).otherwise(F.col(c)) for c, v in channels.items()})


def largest_component(voxels: DataFrame, size_threshold: int = 25, distance: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The largest 6-connected component of coloured voxels of each cloud, grown by components near it.

    Components of at least size_threshold voxels join the largest where any of their voxels lies within
    distance cells of it on every axis.  Of equally large components that with the first cell counts.
    """
    k = [*keys, "voxel_size"]
    v = written(voxels.where(coloured()).select(*k, *CELL, F.monotonically_increasing_id().alias("node")), "component-voxels")
    ahead = F.array(*[F.struct(*[F.lit(int(i == j)).alias(f"d{c}") for j, c in enumerate(CELL)]) for i in range(3)])
    out = v.withColumn("d", F.explode(ahead)).select(*k, *[(F.col(c) + F.col(f"d.d{c}")).alias(c) for c in CELL], F.col("node").alias("a"))
    labels = connected_components(out.join(v.withColumnRenamed("node", "b"), [*k, *CELL]).select("a", "b")).withColumnRenamed("node", "of")
    v = written(v.join(labels, F.col("node") == F.col("of"), "left").select(*k, *CELL, F.coalesce("component", "node").alias("label")), "component-labels")
    sizes = written(v.groupBy(*k, "label").agg(F.count("*").alias("n"), F.min(F.struct(*CELL)).alias("first")), "component-sizes")
    largest = sizes.groupBy(*k).agg(F.min_by("label", F.struct(-F.col("n"), "first")).alias("most"))
    v = attach(v, largest, k)
    main, others = v.where("label = most").select(*k, *CELL), v.where("label != most").join(sizes.where(F.col("n") >= size_threshold).select(F.col("label").alias("large")), F.col("label") == F.col("large"))
    bin_ = lambda t, d=None: [F.floor(F.col(f"{t}.{c}") / max(1, distance)) + (F.col(f"{t}.d{c}") if d else 0) for c in CELL]
    grid = main
    for c in CELL:
        grid = grid.withColumn(f"d{c}", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    on = [F.col(f"m.{x}") == F.col(f"o.{x}") for x in k]
    on += [a == b for a, b in zip(bin_("m", True), bin_("o"))]
    on += [F.abs(F.col(f"m.{c}") - F.col(f"o.{c}")) <= distance for c in CELL]
    near = grid.alias("m").join(others.alias("o"), on).select(F.col("o.label").alias("close")).distinct()
    return main.union(others.join(near, F.col("label") == F.col("close")).select(*k, *CELL))
