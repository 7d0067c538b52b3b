"""Sizes of trees, camera boxes, thresholds and scale factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.operators.enrich import bounding_box
from foliarc.operators.voxel import KEYS
from foliarc.shared import attach, forget, kept, written


def height_of(box: DataFrame) -> Column:
    """From a bounding box: extent along z, less one, in units of length."""
    return (box["nz"] - 1) * box["voxel_size"]


def dimensions_of(box: DataFrame) -> tuple[Column, Column]:
    """From a bounding box: larger and smaller horizontal extent, less one."""
    a, b = (box["nx"] - 1) * box["voxel_size"], (box["ny"] - 1) * box["voxel_size"]
    return F.greatest(a, b), F.least(a, b)


def height(voxels: DataFrame, keys: Sequence[str] = KEYS, percentile: float | None = None) -> DataFrame:
    """Extent of the coloured voxels along z, less one, in units of length; with a percentile, that of the layers of their colour values above 0, counted from the lowest."""
    if percentile is None:
        box = bounding_box(voxels, keys)
        return box.select(*keys, "voxel_size", height_of(box).alias("height"))
    values = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in "rgb"), F.lit(0))
    v = voxels.withColumn("values", values).where("values > 0").groupBy(*keys, "voxel_size", "iz").agg(F.sum("values").alias("values"))
    top = (F.percentile("iz", percentile / 100.0, F.col("values")) - F.min("iz")) * F.col("voxel_size")
    return v.groupBy(*keys, "voxel_size").agg(top.alias("height"))


def canopy_dimensions(voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Larger and smaller horizontal extent, less one."""
    box = bounding_box(voxels, keys)
    a, b = dimensions_of(box)
    return box.select(*keys, "voxel_size", a.alias("width"), b.alias("length"))


BINS = 4096  # of a round of exact_percentiles
SORTED = 200_000  # values that a group may sort at the end


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], most: int = SORTED) -> DataFrame:
    """(keys, p: array) equal to Spark's ``percentile``, for groups of any size in bounded memory.

    ``percentile`` holds all distinct values of a group.  Here every rank that a share needs has an interval of
    values, at first all of them; each round counts its values in BINS bins, of which one holds the rank and is
    the next interval.  Once an interval has at most ``most`` values, or one value, they are sorted for the
    rank.  Nulls and nan are left out; a group without values has no row.
    """
    k = list(keys)
    v = rows.select(*k, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = kept(v.groupBy(*k).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "percentile-ends")
    place = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares])))
    open_ = ends.select(*k, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "lo", "hi")
    done = None
    while True:
        open_ = kept(open_, "percentile-ranks")
        ready = open_.where((F.col("inside") <= most) | (F.col("lo") == F.col("hi")))
        done = ready if done is None else done.union(ready)
        wide = kept(open_.where((F.col("inside") > most) & (F.col("lo") < F.col("hi"))), "percentile-wide")
        if not wide.rows:
            break
        # halves before the difference, which then cannot overflow
        part = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
        hit = attach(v, wide, k).where(F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("bin", F.least(part, F.lit(BINS - 1)))
        bins = hit.groupBy(*k, "rank", "below", "bin").agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("m").over(Window.partitionBy(*k, "rank").orderBy("bin")) - F.col("m")
        bins = bins.withColumn("below", F.col("below") + before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("m")))
        open_ = bins.select(*k, "rank", "below", F.col("m").alias("inside"), "lo", "hi")
    done = kept(done, "percentile-found")
    equal = done.where("lo = hi").select(*k, "rank", F.col("lo").alias("v"))
    rest = kept(done.where("lo < hi"), "percentile-rest")
    near = attach(v, rest, k).where(F.col("v").between(F.col("lo"), F.col("hi")))
    nth = F.row_number().over(Window.partitionBy(*k, "rank").orderBy("v")) - 1
    found = near.withColumn("nth", nth).where(F.col("nth") == F.col("rank") - F.col("below")).select(*k, "rank", "v")
    got = equal.union(found).groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    at = lambda s, f: F.element_at("at", f(place(s)))
    between = [F.when(F.floor(place(s)) == F.ceil(place(s)), at(s, F.floor)).otherwise((F.ceil(place(s)) - place(s)) * at(s, F.floor) + (place(s) - F.floor(place(s))) * at(s, F.ceil)) for s in shares]
    return attach(got, ends.select(*k, "n"), k).select(*k, F.array(*between).alias("p"))


def percentile_box(cameras: DataFrame, quantile: float = 0.0, buffer_ratio: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per cloud lo_ and hi_ of each axis: the quantile and its complement, padded by a share of the range.

    Clouds of many cameras have exact quantiles in bounded memory; with quantile 0 these are the ends.
    """
    if quantile == 0:
        q = cameras.groupBy(*keys).agg(*[F.array(F.min(a), F.max(a)).alias(a) for a in "xyz"])
    else:
        sizes = kept(cameras.groupBy(*keys).agg(F.count("*").alias("cameras")), "camera-counts")
        few = attach(cameras, sizes.where(F.col("cameras") <= SORTED), keys, "left_semi")
        q = few.groupBy(*keys).agg(*[F.percentile(a, [quantile, 1.0 - quantile]).alias(a) for a in "xyz"])
        if not sizes.where(F.col("cameras") > SORTED).isEmpty():
            large = attach(cameras, sizes.where(F.col("cameras") > SORTED), keys, "left_semi")
            axes = [exact_percentiles(large, keys, a, [quantile, 1.0 - quantile]).withColumnRenamed("p", a) for a in "xyz"]
            q = q.unionByName(axes[0].join(axes[1], list(keys)).join(axes[2], list(keys)))
    pad = {a: (F.col(a)[1] - F.col(a)[0]) * buffer_ratio for a in "xyz"}
    return q.select(*keys, *[c for a in "xyz" for c in ((F.col(a)[0] - pad[a]).alias(f"lo_{a}"), (F.col(a)[1] + pad[a]).alias(f"hi_{a}"))])


def within_box(points: DataFrame, box: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points inside the box of their cloud, ends included."""
    p = attach(points, box, keys)
    for a in "xyz":
        p = p.where(F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")))
    return p.drop(*[f"{n}_{a}" for a in "xyz" for n in ("lo", "hi")])


def largest_distance(vertices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest distance between two vertices of a cloud; meant for the few vertices of a hull."""
    n = vertices.select(*keys, "x", "y", "z").distinct()
    far = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    pairs = n.alias("a").join(n.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.max(far).alias("max_distance"))


def adaptive_threshold(mean: Column, std: Column, threshold: float, strictness: float = 0.5) -> Column:
    """A quality threshold that follows the data: between mean + k (mean - std) and the middle of threshold and mean."""
    a, b = mean + strictness * (mean - std), (threshold + mean) / 2.0
    w = F.when(mean + std != 0, mean / (mean + std)).otherwise(0.0)
    return F.greatest(F.lit(0.0), (1.0 - w) * a + w * b)


def quality_thresholds(frames: DataFrame, threshold: float = 0.5, strictness: float = 0.5, key: str = "chunk_id") -> DataFrame:
    s = frames.groupBy(key).agg(F.avg("quality").alias("mean"), F.stddev_pop("quality").alias("std"))
    return s.withColumn("threshold", adaptive_threshold(F.col("mean"), F.col("std"), threshold, strictness))


def low_quality(frames: DataFrame, threshold: float = 0.5, strictness: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """Frames below their chunk's adaptive threshold."""
    return frames.join(quality_thresholds(frames, threshold, strictness, key).select(key, "threshold"), key).where("quality < threshold")


def image_scale(frames: DataFrame, width: int = 3840, height: int = 2160, key: str = "chunk_id") -> DataFrame:
    """Power of two by which the mean image exceeds the wanted size, 1 where equal, 0 below."""
    r = frames.groupBy(key).agg(F.least(F.avg("width") / float(width), F.avg("height") / float(height)).alias("ratio"))
    scale = F.when(F.col("ratio") > 1, F.pow(F.lit(2.0), F.bround(F.log2("ratio")))).when(F.col("ratio") == 1, 1.0).otherwise(0.0)
    return r.select(key, "ratio", scale.cast("long").alias("scale"))


def error_filter_step(tiepoints: DataFrame, goals: dict[str, float], reduction: float = 0.75, key: str = "chunk_id") -> DataFrame:
    """Tie points left after one step: per criterion those above max(largest error * reduction, goal) go."""
    top = tiepoints.where("valid").groupBy(key).agg(*[F.greatest(F.max(c) * reduction, F.lit(float(g))).alias(f"most_{c}") for c, g in goals.items()])
    t = tiepoints.where("valid").join(top, key)
    for c in goals:
        t = t.where(F.col(c) <= F.col(f"most_{c}"))
    return t.drop(*[f"most_{c}" for c in goals])


def filter_errors(tiepoints: DataFrame, goals: dict[str, float], reduction: float = 0.75, passes: Sequence[int] = (4, 3, 2), steps: int = 10, least: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """Passes with goals times 4, 3 and 2, each of steps in which the chunks that miss a criterion lose points, until all meet them.

    A chunk of which fewer than least of its valid points would be left stays as it is from then on.  Each
    step is written, so lineage does not grow; one row a chunk is what is joined back.
    """
    now = written(tiepoints.where("valid").join(tiepoints.where("valid").groupBy(key).agg(F.count("*").alias("_start")), key), "tie-points")
    first = now
    for times in passes:
        want = {c: g * times for c, g in goals.items()}
        for _ in range(steps):
            most = {c: F.greatest(F.max(c) * reduction, F.lit(float(g))).alias(f"_most_{c}") for c, g in want.items()}
            missed = [F.max(c) > g for c, g in want.items()]
            top = now.groupBy(key).agg(*most.values(), F.array_max(F.array(*missed)).alias("_missed"))
            marked = attach(now, top, [key]).withColumn("_stay", ~F.col("_missed") | F.forall(F.array(*[F.col(c) <= F.col(f"_most_{c}") for c in want]), lambda x: x))
            left = marked.groupBy(key).agg(F.count_if("_stay").alias("_left"), F.count("*").alias("_now"), F.first("_start").alias("_of"))
            left = kept(left.select(key, ((F.col("_left") >= least * F.col("_of")) & (F.col("_left") < F.col("_now"))).alias("_cut")), "tie-counts")
            if left.where("_cut").isEmpty():
                break
            then = written(attach(marked, left, [key]).where("_stay or not _cut").select(*first.columns), "tie-points")
            forget(now)
            now = then
    return now.drop("_start")


def camera_counts(frames: DataFrame, key: str = "chunk_id") -> DataFrame:
    return frames.groupBy(key).agg(F.count("*").alias("cameras"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("aligned")).alias("unaligned"))


def camera_positions(cameras: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Aligned cameras with x, y, z carried over by a 4 x 4 transform; projecting to a reference system is left to the program that knows it."""
    at = [sum((float(m) * F.col(a) for m, a in zip(row, "xyz")), F.lit(float(row[3]))) for row in matrix]
    return cameras.where("aligned").withColumns({a: at[i] / at[3] for i, a in enumerate("xyz")})


def alignment_version(version: int | None) -> int:
    """0 none, 1 and 2 the two ways to form batches of cameras; what is missing or neither is 0."""
    return version if version in (1, 2) else 0
