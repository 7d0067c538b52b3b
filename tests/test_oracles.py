"""Every query with an oracle gives the oracle's rows; the others are held against brute force in NumPy."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from foliarc.operators import crown, enrich, hull, rays
from foliarc.plans import features, registry
from foliarc.schema import AnalysisConfig

K = ["tree_id", "voxel_size"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, duck, same):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert same(got, duck.sql(registry.ORACLES[name]).df())


def on_events(spark, events, folder, name):
    """(query, SQL) over a table of events, as pandas frames."""
    import duckdb

    events.write.parquet(f"{folder}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return registry.QUERIES[name](spark, str(folder)).toPandas(), c.sql(registry.ORACLES[name]).df()


def seven_digits(spark):
    """Events with ids from 999,800 on, whose names the view cuts to six digits; five of them are there twice."""
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + 999_800)
    return e.unionByName(e.where("event_id between 999998 and 1000002"))


def test_frame_masks_where_names_repeat(spark, same, tmp_path):
    got, want = on_events(spark, seven_digits(spark), tmp_path, "frame_masks")
    assert len(set(want.name)) < len(set(want.event_id)) < len(want) and same(got, want)


def test_sort_key_has_all_digits(spark, same, tmp_path):
    e = seven_digits(spark)
    longer = e.limit(3).withColumn("event_id", F.col("event_id") + F.lit(9 * 10**14))
    nameless = e.limit(1).withColumn("event_id", F.lit(None).cast("long"))
    got, want = on_events(spark, e.unionByName(longer).unionByName(nameless), tmp_path, "numeric_sort_key")
    assert want.number.max() > 9 * 10**14 and want.number.isna().sum() == 1 and same(got, want)


def test_every_query_is_checked():
    here = {"hull3d_planes", "hull_volume", "hull_obj", "clip_hull", "clip_hull_flat", "largest_component", "features_full"}
    assert set(registry.QUERIES) - set(registry.ORACLES) == here and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def voxels(spark):
    return registry.enriched(spark, SF).toPandas()


def coloured(v):
    return v[(v.r > 0) | (v.g > 0) | (v.b > 0)]


def test_hulls_hold_all_cells(spark, voxels):
    planes = registry.QUERIES["hull3d_planes"](spark, SF).toPandas()
    volume = registry.QUERIES["hull_volume"](spark, SF).toPandas().set_index("tree_id").volume
    for tree, v in coloured(voxels).groupby("tree_id"):
        n, d = (planes[planes.tree_id == tree][c].to_numpy() for c in (["a", "b", "c"], "d"))
        cells = v[["ix", "iy", "iz"]].to_numpy(float)
        side = cells @ n.T + d
        assert side.max() < 1e-4 and ((np.abs(side) < 1e-4).sum(0) >= 3).all() and np.allclose((n**2).sum(1), 1, atol=1e-4)
        grid = [np.arange(cells[:, i].min(), cells[:, i].max(), 0.1) + 0.05 for i in range(3)]
        within = (np.stack(np.meshgrid(*grid), -1).reshape(-1, 3) @ n.T + d <= 0).all(1)
        assert np.isclose(within.sum() * 0.001, volume[tree], rtol=0.02)
    lines = registry.QUERIES["hull_obj"](spark, SF).toPandas()
    for tree, x in lines.groupby("tree_id"):
        corners = [np.array(y.split()[1:], float) for y in x[x.part == 0].sort_values("n").line]
        faces = np.array([[int(i) for i in y.split()[1:]] for y in x[x.part == 1].line])
        assert faces.min() == 1 and faces.max() == len(corners) and len(corners) - len(faces) * 3 / 2 + len(faces) == 2  # Euler


@pytest.mark.parametrize("flat", [False, True])
def test_clip_against_brute_force(spark, flat):
    got = registry.QUERIES["clip_hull_flat" if flat else "clip_hull"](spark, SF).toPandas()
    points, cameras = registry.points(spark, SF).drop("ord").toPandas(), registry.view(spark, SF, "cameras").toPandas()
    want = []
    for tree, p in points.groupby("tree_id"):
        c = cameras[cameras.tree_id == tree][["x", "y", "z"]].to_numpy()
        lo, hi = np.percentile(c, [2, 98], axis=0)
        c = c[((c >= lo) & (c <= hi)).all(1)]
        xyz = p[["x", "y", "z"]].to_numpy()
        if flat:
            e = hull.facets_2d(c)
            n = np.stack([e[:, 1, 1] - e[:, 0, 1], e[:, 0, 0] - e[:, 1, 0], 0 * e[:, 0, 0]], 1)
            at, corners = np.pad(e[:, 0], ((0, 0), (0, 1))), np.pad(e.reshape(-1, 2), ((0, 0), (0, 1)))
        else:
            f = hull.facets(c)
            n, at, corners = np.cross(f[:, 1] - f[:, 0], f[:, 2] - f[:, 0]), f[:, 0], f.reshape(-1, 3)
        n = n / np.linalg.norm(n, axis=1, keepdims=True)
        far = np.linalg.norm(corners[:, None] - corners[None], axis=2).max()
        want.append(p[(xyz @ n.T - (n * at).sum(1) <= 0.1 * far).all(1)])
    key = lambda d: sorted(map(tuple, d[registry.POINT].itertuples(index=False)))
    import pandas as pd

    assert key(got) == key(pd.concat(want)) and 0 < len(got) < len(points)


def main_component(cells, least, distance):
    """Cells of the largest component and of those near it, by flood filling."""
    left, parts = set(cells), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            c = todo.pop()
            part.add(c)
            for i in range(3):
                for s in (-1, 1):
                    n = tuple(x + s * (i == j) for j, x in enumerate(c))
                    if n in left:
                        left.remove(n)
                        todo.append(n)
        parts.append(part)
    parts.sort(key=lambda p: (-len(p), min(p)))
    near = lambda p: any(max(abs(a - b) for a, b in zip(x, y)) <= distance for x in p for y in parts[0])
    return set().union(parts[0], *[p for p in parts[1:] if len(p) >= least and near(p)])


def test_largest_component_against_flood_fill(spark):
    got = registry.QUERIES["largest_component"](spark, SF).toPandas()
    v = coloured(registry.trimmed(spark, SF).toPandas())
    for tree, x in v.groupby("tree_id"):
        cells = lambda d: list(map(tuple, d[["ix", "iy", "iz"]].to_numpy().tolist()))
        mine = cells(got[got.tree_id == tree])
        assert len(mine) == len(set(mine)) and set(mine) == main_component(cells(x), 5, 2)
    rng = np.random.default_rng(5)
    cells = sorted({tuple(c) for c in rng.integers(0, 14, (420, 3)).tolist()})
    d = spark.createDataFrame([(1, 0.5, *c, 0.1, 0.0, 0.0) for c in cells], "tree_id int, voxel_size double, ix long, iy long, iz long, r double, g double, b double")
    for least, distance in ((1, 1), (3, 2), (2, 4)):
        mine = {(r.ix, r.iy, r.iz) for r in enrich.largest_component(d, least, distance).collect()}
        assert mine == main_component(cells, least, distance), (least, distance)


def stepped(v, dims, planes, start, way, required=2):
    """(valid, unobstructed) by walking every ray step by step."""
    full = {tuple(c) for c in v[(v.density_norm > 0) & (v.ngrdi > 0.005) & (v.gli > 0)][["ix", "iy", "iz"]].to_numpy().tolist()}
    hits = []
    for o, d in zip(start, way):
        at = np.round(o + d * np.arange(1, 3001)[:, None] * 0.5, 9)
        if ((at @ planes[:, :3].T + planes[:, 3] <= 1e-12).all(1)).any():
            inside = ((at >= 0) & (at < dims)).all(1)
            hits.append([c for c in map(tuple, np.floor(at[inside]).astype(int).tolist()) if c in full])
    count = {}
    for h in hits:
        for c in h:
            count[c] = count.get(c, 0) + 1
    return len(hits), sum(0.5 ** sum(count[c] >= required for c in h) > 0.1 for h in hits)


def test_features_with_transparency(spark):
    """The flagship: the core features, and transparency with real hulls as stepped ray by ray."""
    full = registry.QUERIES["features_full"](spark, SF).toPandas()
    core = registry.QUERIES["features_core"](spark, SF).toPandas().set_index("tree_id")
    assert len(full) == len(core) and (full["Transparency Sample"].dropna() == 15000).all()
    for r in full.itertuples(index=False):
        c = core.loc[r[0]]
        assert np.allclose([r[1], r[2], r[3], r[4]], [c.voxel_size, c.height, c.cwidth, c.clength], equal_nan=True)
    config = AnalysisConfig(voxel_sizes=(0.5,), ray_sample_count=300)
    v = features.enriched(registry.points(spark, SF), config).cache()
    crowns = crown.live_crown(v)
    got = features.transparency(v, crowns, config).toPandas().set_index("tree_id").transparency
    canopy = features.canopy(v, crowns)
    ext = canopy.groupBy(*K).agg(*[F.max(f"n{a}").alias(f"n{a}") for a in "xyz"])
    aimed, cells = rays.rays(ext, 300).toPandas(), canopy.toPandas()
    assert len(got)
    for tree, x in cells.groupby("tree_id"):
        f = hull.facets(coloured(x)[["ix", "iy", "iz"]].to_numpy())
        n = np.cross(f[:, 1] - f[:, 0], f[:, 2] - f[:, 0])
        n = n / np.linalg.norm(n, axis=1, keepdims=True)
        planes = np.column_stack([n, -(n * f[:, 0]).sum(1)])
        r = aimed[aimed.tree_id == tree]
        dims = r[["nx", "ny", "nz"]].iloc[0].to_numpy() if len(r) else None
        valid, free = stepped(x, dims, planes, r[["ox", "oy", "oz"]].to_numpy(), r[["dx", "dy", "dz"]].to_numpy()) if len(f) else (0, 0)
        assert np.isclose(got[tree], 100 * free / valid if valid else -100)
    v.unpersist()


def test_points_are_scanned_three_times(spark, monkeypatch):
    """Plans do not double their input: what is read from the points, over all that is written and the result."""
    from foliarc import shared
    from foliarc.operators import components, enrich, hull, metrics, voxel

    plans, write = [], shared.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    for m in (shared, components, enrich, hull, metrics, voxel, features, registry):
        if hasattr(m, "written"):
            monkeypatch.setattr(m, "written", noted)
    out = features.features(registry.points(spark, SF), registry.CONFIG)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert 1 <= sum(p.count("Relation [l_") for p in plans) <= 3
