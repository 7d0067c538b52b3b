"""Convex hulls as planes, and clipping against them.

Only hull construction needs a grouped Python function.  It runs over tiles of a cloud, of which only the corners
of each tile's own hull go on, then over squares of MERGE by MERGE tiles, round by round, until one more square
is the cloud as a whole.  Voxel hulls
are built from the lowest and highest cell of each column, since no other cell can be a vertex.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.operators.enrich import coloured
from foliarc.operators.metrics import largest_distance, percentile_box, within_box
from foliarc.operators.voxel import CELL, KEYS
from foliarc.shared import attach, kept, quoted, written

TILE = 20_000  # points of a tile, about, where points are spread evenly
MERGE = 3  # tiles along a side that a round joins
FACE = "a double, b double, c double, d double, v0 array<double>, v1 array<double>, v2 array<double>"


def facets(p: np.ndarray) -> np.ndarray:
    """Corners, as rows of p, of the triangles of the convex hull, turned outwards; none for fewer than 4 points or a flat set."""
    p = np.unique(np.asarray(p, float), axis=0)
    if len(p) < 4:
        return np.zeros((0, 3, 3))
    eps = 1e-9 * max(1.0, np.ptp(p, axis=0).max())
    a = int(np.lexsort(p.T[::-1])[0])
    b = int(np.linalg.norm(p - p[a], axis=1).argmax())
    line = np.cross(p - p[a], p[b] - p[a])
    c = int((line**2).sum(1).argmax())
    n = np.cross(p[b] - p[a], p[c] - p[a])
    if np.linalg.norm(n) <= eps:
        return np.zeros((0, 3, 3))
    side = (p - p[a]) @ n / np.linalg.norm(n)
    d = int(np.abs(side).argmax())
    if abs(side[d]) <= eps:
        return np.zeros((0, 3, 3))
    middle = p[[a, b, c, d]].mean(0)

    def outward(f):
        x, y, z = p[f[0]], p[f[1]], p[f[2]]
        return f if np.cross(y - x, z - x) @ (x - middle) > 0 else (f[0], f[2], f[1])

    verts = np.zeros((64, 3), np.int64)
    normal, offset, alive = np.zeros((64, 3)), np.zeros(64), np.zeros(64, bool)
    outside: dict[int, np.ndarray] = {}  # points a face has in front of it, each point with one face
    n = 0

    def add(new: list, pool: np.ndarray) -> None:
        """Append faces and deal the points in front of any of them."""
        nonlocal verts, normal, offset, alive, n
        while n + len(new) > len(verts):
            verts, normal, offset, alive = (np.concatenate([x, np.zeros_like(x)]) for x in (verts, normal, offset, alive))
        at = slice(n, n + len(new))
        verts[at] = new
        q = p[verts[at]]
        m = np.cross(q[:, 1] - q[:, 0], q[:, 2] - q[:, 0])
        normal[at] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        offset[at] = -(normal[at] * q[:, 0]).sum(1)
        alive[at] = True
        for i in range(0, len(pool), 100_000):
            part = pool[i : i + 100_000]
            far = p[part] @ normal[at].T + offset[at]
            best = far.argmax(1)
            part, best = part[far.max(1) > eps], best[far.max(1) > eps]
            for j in np.unique(best):
                f = n + int(j)
                outside[f] = np.concatenate([outside.get(f, part[:0]), part[best == j]])
        n += len(new)

    add([outward(f) for f in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))], np.arange(len(p)))
    while outside:
        f, pool = next(iter(outside.items()))
        i = int(pool[(p[pool] @ normal[f] + offset[f]).argmax()])
        seen = np.flatnonzero(alive[:n] & (normal[:n] @ p[i] + offset[:n] > eps))
        edges = {(int(u), int(v)) for x in verts[seen] for u, v in zip(x, np.roll(x, -1))}
        pool = np.concatenate([outside.pop(int(x), pool[:0]) for x in seen])
        alive[seen] = False
        add([(u, v, i) for u, v in edges if (v, u) not in edges], pool[pool != i])
        if n > 256 and alive[:n].sum() * 2 < n:  # drop the faces that are gone
            stay = np.flatnonzero(alive[:n])
            number = {int(x): k for k, x in enumerate(stay)}
            verts, normal, offset, alive = (x[stay].copy() for x in (verts, normal, offset, alive))
            outside = {number[x]: y for x, y in outside.items()}
            n = len(stay)
    q = p[verts[:n][alive[:n]]]
    return q[np.linalg.norm(np.cross(q[:, 1] - q[:, 0], q[:, 2] - q[:, 0]), axis=1) > 0]


def facets_2d(p: np.ndarray) -> np.ndarray:
    """Edges, as vertical planes through (x, y), of the hull of points in the plane: rows of two points, counter-clockwise."""
    p = np.unique(np.asarray(p, float)[:, :2], axis=0)
    if len(p) < 3:
        return np.zeros((0, 2, 2))

    def chain(q):
        out: list = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    ring = np.array(chain(p) + chain(p[::-1]))
    return np.stack([ring, np.roll(ring, -1, axis=0)], axis=1) if len(ring) > 2 else np.zeros((0, 2, 2))


def hull_faces(points: DataFrame, keys: Sequence[str], flat: bool = False) -> DataFrame:
    """(keys, a, b, c, d, v0, v1, v2): a row per face with unit outward normal (a, b, c); inside is a x + b y + c z + d <= 0.

    Clouds without a hull (fewer than 4 points, flat ones, or such as ``hull_outcomes`` has an error for) have
    no rows.  flat: hull of x and y only, c = 0.
    """
    return hull_outcomes(points, keys, flat).where("error is null").drop("error")


def hull_outcomes(points: DataFrame, keys: Sequence[str], flat: bool = False) -> DataFrame:
    """The rows of ``hull_faces`` with error, which is null there.

    A cloud that fails is one row of nulls with its error, and does not stop the others: one with a non-finite
    coordinate, which no task sees, or one whose hull cannot be built.  Points with a null coordinate are left out.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def faces_of(q):
        rows = []
        if flat:
            for s, e in facets_2d(q):
                n = np.array([e[1] - s[1], s[0] - e[0], 0.0])
                n /= np.linalg.norm(n)
                rows.append((*n, -n[:2] @ s, [*s, 0.0], [*e, 0.0], None, None))
        else:
            for f in facets(q):
                n = np.cross(f[1] - f[0], f[2] - f[0])
                n /= np.linalg.norm(n)
                rows.append((*n, -n @ f[0], *[v.tolist() for v in f], None))
        return rows

    def work(pdf):
        import pandas as pd

        try:
            rows = faces_of(pdf[["x", "y", "z"]].to_numpy(float))
        except Exception as e:
            rows = [(*[None] * 7, f"{type(e).__name__}: {e}"[:1000])]
        out = pd.DataFrame(rows, columns=["a", "b", "c", "d", "v0", "v1", "v2", "error"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    def tile_corners(pdf):
        """The points of a tile that can be corners of the whole; all of them where the tile is flat, or its hull fails."""
        import pandas as pd

        points = pdf[[*keys, "tx", "ty", "x", "y", "z"]]
        try:
            got = facets_2d(pdf[["x", "y"]].to_numpy(float)) if flat else facets(pdf[["x", "y", "z"]].to_numpy(float))
        except Exception:
            return points
        if not len(got):
            return points
        ends = np.unique(got.reshape(-1, got.shape[-1]), axis=0)
        axes = ["x", "y", "z"][: ends.shape[1]]
        return points.merge(pd.DataFrame(ends, columns=axes), on=axes)

    p = points.select(*keys, "x", "y", "z").where("x is not null and y is not null and z is not null")
    finite = " and ".join(f"cast({a} as double) * 0 = 0" for a in "xyz")
    box = p.groupBy(*keys).agg(*[f(a).cast("double").alias(f"{n}_{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))], F.ceil(F.pow(F.count("*") / TILE, 0.5)).alias("side"), F.bool_and(F.expr(finite)).alias("finite"))
    box = kept(box, "hull-tiles")
    side = int(box.where("finite").agg(F.max("side")).first()[0] or 1)
    tile = lambda a: F.least(F.floor((F.col(a) - F.col(f"lo_{a}")) / F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(1e-9)) * F.col("side")), F.col("side") - 1)
    p = attach(p, box, keys).where("finite").withColumns({"tx": tile("x"), "ty": tile("y")})
    axes = ", tx long, ty long, x {}, y {}, z {}".format(*[points.schema[a].dataType.simpleString() for a in "xyz"])
    p = p.groupBy(*keys, "tx", "ty").applyInPandas(tile_corners, f"{schema}{axes}")
    while side > MERGE:
        side = -(-side // MERGE)
        p = p.withColumns({t: F.floor(F.col(t) / MERGE).cast("long") for t in ("tx", "ty")})
        p = p.groupBy(*keys, "tx", "ty").applyInPandas(tile_corners, f"{schema}{axes}")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in FACE.split(", "))]
    failed = box.where("not finite").select(*keys, *none, F.lit("a coordinate is not finite").alias("error"))
    return p.groupBy(*keys).applyInPandas(work, f"{schema}, {FACE}, error string").union(failed)


def voxel_hull(voxels: DataFrame, floor: float = 0.0, keys: Sequence[str] = KEYS, outcomes: bool = False) -> DataFrame:
    """Hull of the cells of voxels with a colour above the floor; outcomes: as ``hull_outcomes`` has it, error included."""
    k = [*keys, "voxel_size"]
    ends = voxels.where(coloured(floor)).groupBy(*k, "ix", "iy").agg(F.array(F.min("iz"), F.max("iz")).alias("z"))
    return (hull_outcomes if outcomes else hull_faces)(ends.select(*k, F.col("ix").alias("x"), F.col("iy").alias("y"), F.explode("z").alias("z")).distinct(), k)


def plane_arrays(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cloud with its planes as an array: bounded by the hull's faces."""
    return faces.groupBy(*keys).agg(F.collect_set(F.struct("a", "b", "c", "d")).alias("planes"))


def hull_volume(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Volume as the sum of signed tetrahedra."""
    x, y, z = (lambda v: F.col(v)[0]), (lambda v: F.col(v)[1]), (lambda v: F.col(v)[2])
    t = x("v0") * (y("v1") * z("v2") - z("v1") * y("v2")) - y("v0") * (x("v1") * z("v2") - z("v1") * x("v2")) + z("v0") * (x("v1") * y("v2") - y("v1") * x("v2"))
    return faces.groupBy(*keys).agg((F.sum(t) / 6.0).alias("volume"))


def inside(planes: Column, x: Column, y: Column, z: Column, buffer: Column | float = 0.0) -> Column:
    """Whether a point lies within buffer of every plane; never without planes."""
    b = buffer if isinstance(buffer, Column) else F.lit(buffer)
    return (F.size(planes) > 0) & F.forall(planes, lambda p: p.a * x + p.b * y + p.c * z + p.d <= b)


def corners(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The vertices of each cloud's hull, each once."""
    return faces.select(*keys, F.explode(F.array("v0", "v1", "v2")).alias("v")).where("v is not null").select(*keys, *[F.col("v")[i].alias(a) for i, a in enumerate("xyz")]).distinct()


def flat_ends(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, x, y, z = 0): of clouds whose points lie in a plane or on a line, the points that can be furthest apart, in coordinates of that plane.

    The plane of a cloud is found by three aggregates: its first point, the one furthest from it, and the one
    furthest from the line through both.  Its hull is then that of two coordinates, built in tiles.
    """
    k = list(keys)
    p = points.select(*k, *[F.col(a).cast("double").alias(a) for a in "xyz"]).where("x is not null and y is not null and z is not null")
    at = F.struct("x", "y", "z")
    less = lambda c, a: F.array(*[F.col(f"{c}.{i}") - F.col(f"{a}.{i}") for i in "xyz"])
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    scaled = lambda u, by: F.transform(u, lambda x: F.coalesce(F.try_divide(x, by), F.lit(0.0)))

    first = kept(p.groupBy(*k).agg(F.min(at).alias("a")), "flat-first")
    q = attach(p.withColumn("p", at), first, k)
    far = dot(less("p", "a"), less("p", "a"))
    second = kept(q.groupBy(*k, "a").agg(F.max_by("p", F.struct(far, F.col("p"))).alias("b")).select(*k, "a", F.sqrt(dot(less("b", "a"), less("b", "a"))).alias("long"), scaled(less("b", "a"), F.sqrt(dot(less("b", "a"), less("b", "a")))).alias("u")), "flat-lines")
    q = attach(p.withColumn("p", at), second, k)
    away = F.transform(less("p", "a"), lambda x, i: x - dot(less("p", "a"), F.col("u")) * F.get(F.col("u"), i))
    q = q.withColumn("w", away)
    # a cloud narrower than a ten-millionth of its length is a line: its width changes no distance by more than rounding does
    wide = F.sqrt(dot(F.col("w"), F.col("w")))
    third = q.groupBy(*k, "a", "u", "long").agg(F.max_by("w", F.struct(dot(F.col("w"), F.col("w")), F.col("p"))).alias("w"))
    third = kept(third.select(*k, "a", "u", scaled(F.col("w"), F.when(wide > F.col("long") * 1e-7, wide)).alias("w")), "flat-planes")
    q = attach(p.withColumn("p", at), third, k)
    flat = written(q.select(*k, dot(less("p", "a"), F.col("u")).alias("x"), dot(less("p", "a"), F.col("w")).alias("y"), F.lit(0.0).alias("z")), "flat-points")
    ring = hull_faces(flat, k, flat=True).select(*k, *[F.col("v0")[i].alias(a) for i, a in enumerate("xyz")])
    line = flat.groupBy(*k).agg(F.array(F.min_by(at, "x"), F.max_by(at, "x")).alias("e")).select(*k, F.explode("e").alias("e")).select(*k, "e.*")
    return ring.union(line).distinct()


def spread(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest distance between two points of a cloud, of which only vertices of its hull are paired.

    A cloud without a hull in space is flat: there the vertices are those of its hull in its plane, or the ends
    of its line.  A single point, or points that repeat it, have distance 0.
    """
    k = list(keys)
    ends = written(corners(written(hull_faces(points, k), "hull"), k), "hull-ends")
    flat = points.select(*k, "x", "y", "z").join(ends.select(*k).distinct(), k, "left_anti")
    return largest_distance(ends.union(flat_ends(flat, k)), k)


def clip(points: DataFrame, cameras: DataFrame, quantile: float = 0.0, buffer_percent: float = 0.1, ignore_z: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points of each cloud within the hull of its cameras, widened by a share of the cameras' largest distance.

    Cameras outside the quantile band of any axis are left out first.  Clouds without cameras or hull lose all points.
    """
    _, hulls, ends = camera_hulls(cameras, quantile, buffer_percent, ignore_z, keys)
    return within_hull(points, hulls, ends, keys)


def camera_hulls(cameras: DataFrame, quantile: float = 0.0, buffer_percent: float = 0.1, ignore_z: bool = False, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``within_hull`` takes for hulls of cameras: (keys, error) of clouds that failed, (keys, planes, buffer) and corners of the others'."""
    k = list(keys)
    cams = within_box(cameras, percentile_box(cameras, quantile, 0.0, keys), keys)
    outcomes = written(hull_outcomes(cams, k, flat=ignore_z), "hull")
    faces = outcomes.where("error is null").drop("error")
    ends = written(corners(faces, k), "hull-ends")
    hulls = plane_arrays(faces, k).join(largest_distance(ends, keys).select(*k, (F.col("max_distance") * buffer_percent).alias("buffer")), k)
    return outcomes.where("error is not null").select(*k, "error"), hulls, ends


def hull_bricks(hulls: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, brick_x, brick_y, brick_z, cut, buffer) of the bricks of a grid that are not wholly outside the widened hull.

    cut: the planes that pass through the brick; none where it lies inside.  A further layer of bricks around the
    grid, numbers -1 and n, reaches to infinity.  A plane counts as passing where rounding leaves that open, so what a brick says is never wrong.
    """
    k = list(keys)
    h = attach(hulls, grid, k)
    tasks = max(int(h.sparkSession.conf.get("spark.sql.shuffle.partitions")), h.sparkSession.sparkContext.defaultParallelism)
    for a in "xyz":
        h = h.withColumn(f"brick_{a}", F.explode(F.sequence(F.lit(-1).cast("long"), F.col(f"n_{a}"))))
        if a == "x":
            h = h.repartition(tasks, *k, "brick_x")  # layers of a cloud are dealt, so one large hull keeps many tasks busy
    lo = {a: F.when(F.col(f"brick_{a}") < 0, -1e300).otherwise(F.col(f"lo_{a}") + F.col(f"brick_{a}") * F.col(f"side_{a}")) for a in "xyz"}
    hi = {a: F.when(F.col(f"brick_{a}") == F.col(f"n_{a}"), 1e300).otherwise(F.col(f"lo_{a}") + (F.col(f"brick_{a}") + 1) * F.col(f"side_{a}")) for a in "xyz"}
    h = h.withColumns({f"from_{a}": lo[a] for a in "xyz"} | {f"to_{a}": hi[a] for a in "xyz"})

    def reach(p, pick):
        """Least or greatest signed distance of a brick's points from a plane."""
        return sum((pick(p[c] * F.col(f"from_{a}"), p[c] * F.col(f"to_{a}")) for c, a in zip("abc", "xyz", strict=True)), p.d)

    h = h.where(~F.exists("planes", lambda p: reach(p, F.least) > F.col("buffer") + F.col("slack")))
    return h.select(*k, "brick_x", "brick_y", "brick_z", F.filter("planes", lambda p: reach(p, F.greatest) > F.col("buffer") - F.col("slack")).alias("cut"), "buffer")


def within_hull(points: DataFrame, hulls: DataFrame, ends: DataFrame, keys: Sequence[str] = KEYS, bricks: int = 16) -> DataFrame:
    """Points within buffer of all planes of their cloud's hull.

    hulls: (keys, planes, buffer); ends: (keys, x, y, z), the corners of the hulls.  A point looks up its brick of
    a grid over the hull's box: outside bricks drop it, inside ones keep it, and in a cut one it meets only the
    planes that pass there.  Points with a null or non-finite coordinate, and clouds without a hull, are dropped.
    """
    k = list(keys)
    box = ends.groupBy(*k).agg(*[f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    n = {a: F.when(F.col(f"hi_{a}") > F.col(f"lo_{a}"), bricks).otherwise(1).cast("long") for a in "xyz"}
    far = F.greatest(*[F.abs(f"{e}_{a}") for e in ("lo", "hi") for a in "xyz"])
    side = {a: F.when(F.col(f"hi_{a}") > F.col(f"lo_{a}"), (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / bricks).otherwise(1.0) for a in "xyz"}
    grid = kept(box.select(*k, *[F.col(f"lo_{a}") for a in "xyz"], *[c.alias(f"{w}_{a}") for w, by in (("n", n), ("side", side)) for a, c in by.items()], ((far + 1) * 1e-12).alias("slack")), "hull-grid")
    table = kept(hull_bricks(hulls, grid, k), "hull-bricks")

    at = lambda a: F.least(F.greatest(F.floor((F.col(f"point.{a}") - F.col(f"lo_{a}")) / F.col(f"side_{a}")), F.lit(-1).cast("long")), F.col(f"n_{a}"))
    p = points.select(*k, F.struct(*[F.col(quoted(c)) for c in points.columns if c not in k]).alias("point"))
    p = p.where(" and ".join(f"point.{a} is not null and cast(point.{a} as double) * 0 = 0" for a in "xyz"))
    p = attach(p, grid, k).withColumns({f"brick_{a}": at(a) for a in "xyz"}).select(*k, "point", "brick_x", "brick_y", "brick_z")
    p = attach(p, table, [*k, "brick_x", "brick_y", "brick_z"])
    x, y, z = (F.col(f"point.{a}") for a in "xyz")
    p = p.where(F.forall("cut", lambda q: q.a * x + q.b * y + q.c * z + q.d <= F.col("buffer")))
    return p.select(*[F.col(c) if c in k else F.col(f"point.{quoted(c)}") for c in points.columns])


def obj_lines(faces: DataFrame, keys: Sequence[str], offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(keys, part, line) of a Wavefront OBJ: vertices, then faces by 1-based numbers; order by part and line's number n."""
    from pyspark.sql.window import Window

    k = list(keys)
    v = faces.select(*k, F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct()
    v = v.withColumn("n", F.row_number().over(Window.partitionBy(*k).orderBy("v")))
    lines = v.select(*k, F.lit(0).alias("part"), "n", F.concat_ws(" ", F.lit("v"), *[(F.col("v")[i] + offset[i]).cast("string") for i in range(3)]).alias("line"))
    f = faces
    for i in range(3):
        f = f.join(v.select(*k, F.col("v").alias(f"v{i}"), F.col("n").alias(f"n{i}")), [*k, f"v{i}"])
    f = f.withColumn("n", F.row_number().over(Window.partitionBy(*k).orderBy("n0", "n1", "n2")))
    return lines.union(f.select(*k, F.lit(1), "n", F.concat_ws(" ", F.lit("f"), *[F.col(f"n{i}").cast("string") for i in range(3)])))
