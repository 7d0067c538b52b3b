"""Light transmission: rays from a sphere through the canopy's voxels.

A hull and a grid box are convex, so the steps of a ray inside either are one run of step numbers, found in
closed form from the planes.  Voxels are bits of bricks of 8 x 8 x 8 cells; a ray is matched with the bricks it
enters, so empty space costs no join, and the bits of a brick tell which of its steps meet a voxel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.operators.voxel import CELL, KEYS
from foliarc.shared import attach

GOLDEN = 2 * math.pi * (1 - 2 / (1 + math.sqrt(5)))
STEPS = 3000
RUN = 256
TOLERANCE = 1e-12


def sphere(n: int, i: Column, exclusion: float = 0.0) -> tuple[Column, Column, Column]:
    """The i-th of n points of a Fibonacci sphere; exclusion: degrees left out around the poles."""
    if n < 1:
        raise ValueError("at least one ray is needed")
    top = math.cos(math.radians(exclusion)) if exclusion > 0 else 1.0
    z = top + (-2 * top) * (i + 0.5) / n
    r = F.sqrt(1 - z * z)
    return F.cos(GOLDEN * i) * r, F.sin(GOLDEN * i) * r, z


def hashed(i: Column, axis: int) -> Column:
    """A repeatable number in 0..1 from a ray's number, by integer arithmetic alone."""
    x = (i * 1103515 + 12345 + axis * 7919) % 2147483
    return ((x * 48271 + axis * 104729) % 2147483) / 2147483.0


def rays(extents: DataFrame, n: int = 15_000, heading: str = "antipodal", exclusion: float = 0.0) -> DataFrame:
    """n rays for each row of extents (with nx, ny, nz): adds ray_id, ox, oy, oz and the unit direction dx, dy, dz."""
    spark = extents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(RUN).cast("long")))
    e = extents.withColumn("first", first).repartition(tasks)  # runs of rays are what is dealt, so few clouds make many tasks
    e = e.withColumn("ray_id", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + RUN - 1, F.lit(n - 1))))).drop("first")
    e = e.withColumn("radius", math.sqrt(3) * F.greatest("nx", "ny", "nz") / 2)
    e = e.withColumns({f"o{a}": F.col(f"n{a}") / 2 + F.col("radius") * s for a, s in zip("xyz", sphere(n, F.col("ray_id"), exclusion))})
    if heading == "antipodal":
        to = {a: F.col(f"n{a}") - F.col(f"o{a}") for a in "xyz"}
    else:
        to = {a: hashed(F.col("ray_id"), j) * F.col(f"n{a}") for j, a in enumerate("xyz")}
    e = e.withColumns({f"v{a}": to[a] - F.col(f"o{a}") for a in "xyz"})
    e = e.withColumn("len", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2))
    return e.withColumns({f"d{a}": F.col(f"v{a}") / F.col("len") for a in "xyz"}).drop("vx", "vy", "vz", "len", "radius")


def kept_rays(r: DataFrame, planes: DataFrame, keys: Sequence[str] = KEYS, step: float = 0.5) -> DataFrame:
    """Rays with a step inside the hull; planes: (keys, voxel_size, planes: array of a, b, c, d), at most a hull per cloud.  No planes: no rays."""
    k = [*keys, "voxel_size"]
    j = attach(r, planes.where(F.size("planes") > 0), k)
    term = lambda p: F.struct((p.a * F.col("dx") + p.b * F.col("dy") + p.c * F.col("dz")).alias("speed"), (p.a * F.col("ox") + p.b * F.col("oy") + p.c * F.col("oz") + p.d - TOLERANCE).alias("side"))
    j = j.withColumn("planes", F.transform("planes", term))
    enter = F.array_max(F.transform(F.filter("planes", lambda p: p.speed < 0), lambda p: -p.side / p.speed))
    leave = F.array_min(F.transform(F.filter("planes", lambda p: p.speed > 0), lambda p: -p.side / p.speed))
    miss = F.exists("planes", lambda p: (p.speed == 0) & (p.side > 0))
    first = F.greatest(F.lit(1.0), F.ceil(F.coalesce(enter, F.lit(-math.inf)) / step))
    last = F.least(F.lit(float(STEPS)), F.floor(F.coalesce(leave, F.lit(math.inf)) / step))
    return j.where(~miss & (first <= last)).drop("planes")


def _ranged(kept: DataFrame, step: float) -> DataFrame:
    """Add lo and hi: the first and last step number that can lie in the grid box, one more on either side; rays without any are left out."""
    axes = F.array(*[F.struct(F.col(f"o{a}").alias("o"), F.col(f"d{a}").alias("d"), F.col(f"n{a}").cast("double").alias("n")) for a in "xyz"])
    ends = lambda x: F.struct(F.when(x.d > 0, -x.o / x.d).when(x.d < 0, (x.n - x.o) / x.d).otherwise(-1e9).alias("near"), F.when(x.d > 0, (x.n - x.o) / x.d).when(x.d < 0, -x.o / x.d).otherwise(1e9).alias("far"))
    m = kept.withColumn("ends", F.transform(axes, ends))
    near, far = F.array_max(F.transform("ends", lambda e: e.near)), F.array_min(F.transform("ends", lambda e: e.far))
    lo, hi = F.greatest(F.lit(1.0), F.floor(near / step) - 1), F.least(F.lit(float(STEPS)), F.ceil(far / step) + 1)
    return m.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long")}).where("lo <= hi").drop("ends")


def _cell(a: str, k: Column, step: float) -> Column:
    """The cell along an axis of step k.  Half of 1e-9 is added, so that a step that close below a border counts as beyond it, as if positions were rounded to nine places."""
    return F.floor(F.col(f"o{a}") + F.col(f"d{a}") * (k * step) + 5e-10).cast("long")


def _boxed(cells: Sequence[Column]) -> Column:
    x, y, z = (c.between(0, F.col(f"n{a}") - 1) for a, c in zip("xyz", cells, strict=True))
    return x & y & z


def march(kept: DataFrame, step: float = 0.5) -> DataFrame:
    """A row for every step inside the grid box: adds k, ix, iy, iz."""
    m = _ranged(kept, step).withColumn("k", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    m = m.withColumns({f"i{a}": _cell(a, F.col("k"), step) for a in "xyz"})
    return m.where(_boxed([F.col(c) for c in CELL]))


def occupancy(voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, voxel_size, bx, by, bz, bits): a row per brick of 8 x 8 x 8 cells that holds a voxel, with a bit for each of its cells, a long per layer."""
    bit = F.expr("shiftleft(1L, cast((iy & 7) * 8 + (ix & 7) as int))")
    layer = lambda s: F.bit_or(F.when(F.col("iz").bitwiseAND(7) == s, bit).otherwise(F.lit(0).cast("long")))
    b = voxels.groupBy(*keys, "voxel_size", *[F.expr(f"shiftright(i{a}, 3)").alias(f"b{a}") for a in "xyz"])
    return b.agg(F.array(*[layer(s) for s in range(8)]).alias("bits"))


def entries(kept: DataFrame, step: float = 0.5) -> DataFrame:
    """A row for every brick that a ray's steps enter: adds k, the first step in it, last, the number of no earlier than its last one, and bx, by, bz.

    Cells along an axis rise or fall with k, so a brick is entered once.
    """
    m = _ranged(kept, step).withColumn("k", F.explode(F.sequence("lo", "hi")))
    m = m.withColumns({f"i{a}": _cell(a, F.col("k"), step) for a in "xyz"}).where(_boxed([F.col(c) for c in CELL]))
    before = [_cell(a, F.col("k") - 1, step) for a in "xyz"]
    same = _boxed(before)
    for a, c in zip("xyz", before, strict=True):
        same = same & (F.shiftright(c, 3) == F.shiftright(f"i{a}", 3))
    m = m.where((F.col("k") == F.col("lo")) | ~same).withColumns({f"b{a}": F.shiftright(f"i{a}", 3) for a in "xyz"})
    last = F.col("hi")
    for a in "xyz":
        border = F.when(F.col(f"d{a}") > 0, F.col(f"b{a}") * 8 + 8).when(F.col(f"d{a}") < 0, F.col(f"b{a}") * 8)
        last = F.least(last, (F.ceil((border - F.col(f"o{a}")) / F.col(f"d{a}") / step) + 1).cast("long"))
    return m.withColumn("last", F.greatest(F.col("k"), last)).drop("lo", "hi", *CELL)


def hits(kept: DataFrame, voxels: DataFrame, keys: Sequence[str] = KEYS, step: float = 0.5) -> DataFrame:
    """(keys, voxel_size, ray_id, k, cell) for every step in a voxel with density_norm above 0.

    Bricks that a ray enters are matched with those that hold a voxel, by broadcast where these are few; only
    within them steps are made into rows, which a bit keeps or drops.  Steps through empty bricks meet nothing.
    """
    k = [*keys, "voxel_size"]
    full = occupancy(voxels.where((F.col("density_norm") > 0) & ~F.isnan("density_norm")), keys)
    ray = [*k, "ray_id", *[f"{c}{a}" for c in "odn" for a in "xyz"]]
    e = attach(entries(kept.select(*ray), step), full, [*k, "bx", "by", "bz"])
    e = e.withColumn("k", F.explode(F.sequence("k", "last"))).withColumns({f"i{a}": _cell(a, F.col("k"), step) for a in "xyz"})
    for a in "xyz":
        e = e.where(F.shiftright(f"i{a}", 3) == F.col(f"b{a}"))
    at = F.expr("cast((iy & 7) * 8 + (ix & 7) as int)")
    e = e.where(_boxed([F.col(c) for c in CELL]) & (F.getbit(F.get("bits", F.col("iz").bitwiseAND(7).cast("int")), at) == 1))
    return e.select(*k, "ray_id", "k", *CELL)


def transmission(kept: DataFrame, hit: DataFrame, keys: Sequence[str] = KEYS, energy: float = 1.0, required: int = 2, threshold: float = 0.1, dissipation: float = 0.5) -> DataFrame:
    """Per cloud valid rays, unobstructed ones and transparency in percent; -100 where no ray is valid is left to the caller.

    A hit counts where its voxel has at least ``required`` hits in all; each takes a share of the ray's energy.
    """
    k = [*keys, "voxel_size"]
    lit = lambda hits: energy * F.pow(F.lit(1.0 - dissipation), hits.cast("double")) > threshold
    per = hit.groupBy(*k, *CELL, "ray_id").agg(F.count("*").alias("n"))
    per = per.withColumn("support", F.sum("n").over(Window.partitionBy(*k, *CELL))).where(F.col("support") >= required)
    per = per.groupBy(*k, "ray_id").agg(F.sum("n").alias("hits")).groupBy(*k).agg(F.count("*").alias("met"), F.count_if(lit(F.col("hits"))).alias("through"))
    out = kept.groupBy(*k).agg(F.count("*").alias("valid")).join(per, k, "left")
    free = F.col("valid") - F.coalesce("met", F.lit(0))
    out = out.select(*k, "valid", (F.coalesce("through", F.lit(0)) + F.when(lit(F.lit(0)), free).otherwise(0)).alias("unobstructed"))
    return out.withColumn("transparency", 100.0 * F.col("unobstructed") / F.col("valid"))


def ray_lines(r: DataFrame) -> DataFrame:
    """Text of rays: origin and the direction as a colour."""
    colour = [((F.col(f"d{a}") + 1) / 2 * 255).cast("int") for a in "xyz"]
    return r.select(*[c for c in r.columns if c in ("tree_id", "voxel_size", "ray_id")], F.format_string("%.6f %.6f %.6f %d %d %d", "ox", "oy", "oz", *colour).alias("line"))
