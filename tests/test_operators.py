"""Cases small enough to work out by hand, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliarc.functions import color, text
from foliarc.operators import batching, crown, enrich, files, hull, lineage, metrics, rays, results, voxel
from foliarc.plans import registry, tasks
from foliarc.schema import AnalysisConfig, ChannelLimit
from foliarc.sources import fixtures


def cloud(spark, rows):
    """Points of one tree from (x, y, z, r, g, b, class)."""
    d = [(1, *map(float, r[:6]), int(r[6]), i, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(d, "tree_id int, x double, y double, z double, red double, green double, blue double, raw_class int, treeid long, ord long")


def test_two_point_voxel_is_emptied(spark):
    p = cloud(spark, [(0, 0, 0, 10, 20, 30, 0), (0.1, 0, 0, 50, 60, 70, 0)])
    assert voxel.voxelise(p, [1.0], 5).count() == 0
    assert voxel.voxelise(p, [1.0], None).count() == 1


def test_class_tie_and_single_code(spark):
    p = cloud(spark, [(0, 0, 0, 10, 20, 30, 2), (0, 0, 0, 10, 20, 30, 0), (3, 0, 0, 1, 1, 1, 2), (3, 0, 0, 1, 1, 1, 2), (3, 0, 0, 1, 1, 1, 0)])
    assert {r.ix: r.cls for r in voxel.voxelise(p, [1.0], None).collect()} == {0: 4, 3: 2}
    p = cloud(spark, [(0, 0, 0, 10, 20, 30, 2)])
    assert voxel.voxelise(p, [1.0], None).first().cls == 4


def test_empty_cloud(spark):
    assert enrich.enrich(voxel.voxelise(cloud(spark, []), [1.0])).count() == 0


def test_grey_is_masked_and_indices_of_black(spark):
    d = spark.createDataFrame([(0.0, 0.0, 0.0), (90.0, 90.0, 90.0)], "r double, g double, b double")
    r = d.select(color.is_sky(F.col("r"), F.col("g"), F.col("b")).alias("sky"), color.gli(F.col("r"), F.col("g"), F.col("b")).alias("gli"), color.exr(F.col("r"), F.col("g"), F.col("b")).alias("exr")).collect()
    assert r[0].gli == 0 and math.isclose(r[0].exr, 1 / 2.4) and all(x.sky for x in r)


@pytest.mark.parametrize("limit, kept", [
    (ChannelLimit("c"), [1, 2, 3, None]), (ChannelLimit("c", mask_na=True), [1, 2, 3]), (ChannelLimit("c", max=2), [1]), (ChannelLimit("c", max=2, inclusive=True), [2, 3]),
    (ChannelLimit("c", min=2), [3]), (ChannelLimit("c", min=2, inclusive=True), [1, 2]), (ChannelLimit("c", min=1, max=3), [2]), (ChannelLimit("c", min=1, max=3, inclusive=True), [1, 3]),
])
def test_limits(spark, limit, kept):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "c double")
    assert [None if math.isnan(r.c) else r.c for r in d.where(enrich.limit_predicate(limit)).collect()] == kept


def test_equal_density_is_nan(spark):
    p = cloud(spark, [(0, 0, 0, 10, 200, 30, 0)])
    assert math.isnan(enrich.enrich(voxel.voxelise(p, [1.0], None)).first().density_norm)


def test_weighted_percentile_and_too_few_layers(spark):
    v = spark.createDataFrame([(1, 0.5, 0, 0, z, 0.5, 9) for z in (0, 1, 1, 2, 3)], "tree_id int, voxel_size double, ix long, iy long, iz long, gli double, nz long")
    assert crown.live_crown(v.withColumn("nz", F.lit(4).cast("long"))).first().status == "too_few_layers"  # five layers shorten the window to four
    d = spark.createDataFrame([(1.0, 2), (5.0, 7), (9.0, 1)], "z double, n long")
    got = d.agg(F.percentile("z", [0.05, 0.95], F.col("n"))).first()[0]
    assert got[0] == 1.0 and math.isclose(got[1], 7.2)


def test_smoothing_matrix():
    assert np.allclose(np.array(crown.smoothing_matrix(5)) * 35, [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]])


def test_hull_holds_all_points():
    rng = np.random.default_rng(1)
    for n in (4, 30, 200):
        p = rng.integers(0, 12, (n, 3)).astype(float)
        f = hull.facets(p)
        for a, b, c in f:
            m = np.cross(b - a, c - a)
            assert ((p - a) @ (m / np.linalg.norm(m))).max() < 1e-9
    assert len(hull.facets(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]]))) == 0 and len(hull.facets(p[:3])) == 0


def test_hull_volume_of_a_box(spark):
    p = spark.createDataFrame([(1, float(x), float(y), float(z)) for x in (0, 2) for y in (0, 3) for z in (0, 4)], "tree_id int, x double, y double, z double")
    assert math.isclose(hull.hull_volume(hull.hull_faces(p, ["tree_id"]), ["tree_id"]).first().volume, 24)
    assert hull.clip(p.withColumn("k", F.lit(1)), p, 0, 0.0).count() == 8
    assert hull.clip(p, p, 0, 0.0, ignore_z=True).count() == 8


def test_marching_equals_stepping(spark):
    n = (6, 5, 7)
    e = spark.createDataFrame([(1, 0.5, *n)], "tree_id int, voxel_size double, nx long, ny long, nz long")
    r = rays.rays(e, 60, "hashed")
    got = {}
    for x in rays.march(r).collect():
        got.setdefault(x.ray_id, []).append((x.k, x.ix, x.iy, x.iz))
    for x in r.collect():
        o, d, want = np.array([x.ox, x.oy, x.oz]), np.array([x.dx, x.dy, x.dz]), []
        for k in range(1, 200):
            q = np.round(o + d * (k * 0.5), 9)
            if (q >= 0).all() and (q < n).all():
                want.append((k, *np.floor(q).astype(int)))
        assert sorted(got.get(x.ray_id, [])) == want


@pytest.mark.parametrize("supported, through", [(3, 1), (4, 0)])
def test_three_hits_pass_and_four_do_not(spark, supported, through):
    kept = spark.createDataFrame([(1, 0.5, 0)], "tree_id int, voxel_size double, ray_id long")
    hit = spark.createDataFrame([(1, 0.5, 0, k, 0, 0, 0) for k in range(supported)], "tree_id int, voxel_size double, ray_id long, k long, ix long, iy long, iz long")
    assert rays.transmission(kept, hit).first().unobstructed == through


@pytest.mark.parametrize("n, starts", [(10, [0, 3, 6]), (11, [0, 3, 6]), (3, [0])])
def test_windows(spark, n, starts):
    f = spark.createDataFrame([(1, i) for i in range(n)], "chunk_id int, idx long")
    w = batching.sliding_windows(f, 4, 1).collect()
    assert sorted({x.idx for x in w if x.position == 0}) == starts and all(x.position < 4 for x in w)
    with pytest.raises(ValueError):
        batching.sliding_windows(f, 4, 4)


def test_text_functions(spark):
    d = spark.createDataFrame([("a1/b02.png", 0), ("none", 61), ("x", 3600), ("y", 7325)], "s string, t long")
    r = d.select(text.number_in(F.col("s")).alias("n"), text.elapsed(F.col("t")).alias("e")).collect()
    assert [int(x.n) for x in r[:2]] == [102, 0]
    assert [x.e for x in r] == ["0 second", "1 minute 1 second", "1 hour 0 second", "2 hours 2 minutes 5 seconds"]


def test_largest_component(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    cells = [(x, 0, 0) for x in range(8)] + [(20, 0, z) for z in range(3)] + [(9, 1, 0), (10, 1, 0)]
    v = spark.createDataFrame([(1, 0.5, *c, 0.5, 0.5, 0.5) for c in cells], "tree_id int, voxel_size double, ix long, iy long, iz long, r double, g double, b double")
    assert enrich.largest_component(v, 2, 2).count() == 10
    assert enrich.largest_component(v, 3, 2).count() == 8


def test_error_filter_stops(spark):
    t = spark.createDataFrame([(1, float(i), True) for i in range(100)], "chunk_id int, e double, valid boolean")
    assert metrics.filter_errors(t, {"e": 20}).where("valid").agg(F.max("e")).first()[0] <= 74


def test_names():
    assert lineage.pairs_needed(1000, 0.01, 1024) == math.ceil(math.log(1e6 / (-2 * math.log(0.99))) / math.log(1024))
    assert lineage.word_name("0a", ["red", "blue"], ["cat", "dog", "fox", "owl"], 2).count("-") == 3


def test_pipeline_resumes(tmp_path):
    seen, fail = [], [True]

    def one(state):
        seen.append("one")
        state["x"] = 1

    def two():
        seen.append("two")
        return not fail[0]

    p = tasks.Pipeline(max_retries=1).add(one).add(two)
    m = str(tmp_path / "manifest.json")
    assert not p.run(manifest=m) and seen == ["one", "two", "two"]
    fail[0] = False
    assert p.run(manifest=m) and seen == ["one", "two", "two", "two"]
    with pytest.raises(ValueError):
        tasks.Pipeline().add(one).run(manifest=m)


def test_las_round_trip(spark, tmp_path):
    from foliarc.sources import las

    las.register(spark)
    d = spark.createDataFrame([(1.25, 2.5, -3.125, 7, 100, 200, 300, 2, 9), (1000.5, 0.0, 1.0, 0, 1, 2, 3, 5, 11)], "x double, y double, z double, intensity int, red int, green int, blue int, raw_class int, treeid long")
    d.coalesce(1).write.format("las").option("path", str(tmp_path / "out")).mode("append").save()
    got = spark.read.format("las").load(str(tmp_path / "out")).orderBy("x")
    assert [tuple(r)[:9] for r in got.collect()] == [tuple(r) for r in d.orderBy("x").collect()]


def test_settings():
    with pytest.raises(ValueError):
        AnalysisConfig(voxel_sizes=())
    with pytest.raises(ValueError):
        AnalysisConfig(heading="random")


def test_cameras_are_all_orders(spark):
    from conftest import SF

    assert fixtures.view(spark, SF, "cameras").count() == fixtures.table(spark, SF, "orders").count()


def test_spread_against_brute_force(spark):
    rng = np.random.default_rng(6)
    clouds = {1: rng.normal(0, 1, (300, 3)), 2: rng.normal(0, 1, (40, 3)) * [1, 1, 0], 3: rng.normal(0, 1, (2, 3)), 4: np.ones((3, 3))}
    rows = [(k, *map(float, r)) for k, c in clouds.items() for r in c]
    got = {r.tree_id: r.max_distance for r in hull.spread(spark.createDataFrame(rows, "tree_id int, x double, y double, z double")).collect()}
    assert got == pytest.approx({k: np.linalg.norm(c[:, None] - c[None], axis=2).max() for k, c in clouds.items()}, abs=1e-9)


def test_file_pairs_are_whole_and_first_n_is_an_option(spark):
    from conftest import SF

    sf = SF.replace("0.001", "0.01")
    paths = [r.path for r in registry.paths(spark, sf).distinct().collect()]
    want = sorted(f"data/input/{p}" for p in paths if p.endswith(".html") and "/fr/" not in f"data/input/{p}")
    assert len(want) > 20 and sorted(r.path for r in registry.file_pairs(spark, sf).collect()) == want
    few = spark.createDataFrame([(f"data/input/{c}.las",) for c in "dbca"] + [("data/input/a.txt",)], "path string")
    assert [(r.path, r.output) for r in files.analysed(few, limit=2).collect()] == [(f"data/input/{c}.las", f"data/output/{c}/{c}.las") for c in "ab"]


def test_profiles_no_longer_than_the_window(spark):
    """Five layers: window four, ends from the first and last fit, the middle read halfway in the last."""
    c = [1.0, 4.0, 2.0, 7.0, 3.0]
    p = spark.createDataFrame([(1, 0.5, 5, [int(x) for x in c]), (2, 0.5, 4, [1, 2, 3, 4])], "tree_id int, voxel_size double, nz long, counts array<long>")
    got = {r.tree_id: r.smooth for r in crown.smoothed(p).collect()}
    a, b = np.polyfit(range(4), c[:4], 2), np.polyfit(range(4), c[1:], 2)
    assert np.allclose(got[1], [np.polyval(a, 0), np.polyval(a, 1), np.polyval(b, 1.5), np.polyval(b, 2), np.polyval(b, 3)]) and got[2] is None


def test_versions_and_requirements(spark):
    lines = ["a==1.2.9", "a==1.2.10", "a~=1.2.3", "A==2.0rc1", "a==2.0", "a==2.0.post1", "b", "b", "b>=3", "# c==1", "", "  ", None, "not a requirement", "d==1.10", "d~=1.9.9", "e[x]==1.0 ; python_version>'3'", "f==1.*"]
    got = {r.line for r in lineage.consolidate_requirements(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {"a==1.2.10", "a==2.0.post1", "b", "b>=3", "d==1.10", "e[x]==1.0 ; python_version>'3'", "f==1.*"}


def test_word_names(spark):
    import hashlib

    a, b = ["red", "old", "wet"], ["elm", "oak", "fir", "ash", "yew"]
    digests = [hashlib.md5(str(i).encode()).hexdigest() for i in range(30)] + ["f"]
    d = spark.createDataFrame([(x,) for x in digests], "d string").select("d", lineage.word_names(F.col("d"), a, b, 3).alias("w"))
    assert all(r.w == lineage.word_name(r.d, a, b, 3) for r in d.collect())


def test_tiled_hull_is_the_whole_hull(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 1, (3000, 3)), [[4, 0, 0], [4, 0, 0]]])
    d = spark.createDataFrame([(1, *map(float, r)) for r in p] + [(2, 0.0, 0.0, 0.0)], "tree_id int, x double, y double, z double")
    for flat in (False, True):
        monkeypatch.setattr(hull, "TILE", 100)
        small = sorted(tuple(np.round(r[1:5], 9)) for r in hull.hull_faces(d, ["tree_id"], flat).collect())
        monkeypatch.setattr(hull, "TILE", 10**9)
        whole = sorted(tuple(np.round(r[1:5], 9)) for r in hull.hull_faces(d, ["tree_id"], flat).collect())
        assert np.allclose(small, whole, atol=1e-8) and len(whole) > 5


def test_hull_of_half_a_million_cells():
    import time

    x, y = (a.ravel() for a in np.meshgrid(np.arange(500), np.arange(1000)))
    z = np.floor(400 * np.sqrt(np.maximum(0, 1 - ((x - 250) / 250) ** 2 - ((y - 500) / 500) ** 2)))
    start, p = time.time(), np.column_stack([x, y, z])
    f = hull.facets(p)
    assert time.time() - start < 30
    n = np.cross(f[:, 1] - f[:, 0], f[:, 2] - f[:, 0])
    n = n / np.linalg.norm(n, axis=1, keepdims=True)
    assert max((p[i : i + 50_000] @ n.T - (n * f[:, 0]).sum(1)).max() for i in range(0, len(p), 50_000)) < 1e-5


def test_error_filter_passes(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(i), float(e), True) for k, scale in ((1, 10), (2, 300)) for i, e in enumerate(rng.exponential(scale, 400))] + [(1, 999, 1e9, False)]
    t = spark.createDataFrame(rows, "chunk_id int, id int, err double, valid boolean")
    got = metrics.filter_errors(t, {"err": 10.0}, passes=(4, 3, 2)).toPandas()
    for k in (1, 2):
        e = now = np.array([r[2] for r in rows if r[0] == k and r[3]])
        for times in (4, 3, 2):
            for _ in range(10):
                if now.max() <= 10 * times:
                    break
                then = now[now <= max(now.max() * 0.75, 10 * times)]
                if len(then) < 0.5 * len(e):
                    break
                now = then
        assert sorted(got[got.chunk_id == k].err) == sorted(now)


def test_cells_cameras_and_pairs(spark):
    v = spark.createDataFrame([(1, 0.5, 0, 0, 0, 0.1), (1, 0.5, 1, 0, 0, 0.2)], "tree_id int, voxel_size double, ix long, iy long, iz long, r double")
    assert enrich.cell(v, 1, 0, 0).first().r == 0.2 and enrich.cell(enrich.with_cell(v, 1, 0, 0, r=0.7), 1, 0, 0).first().r == 0.7
    c = spark.createDataFrame([(1.0, 2.0, 3.0, True), (0.0, 0.0, 0.0, False)], "x double, y double, z double, aligned boolean")
    r = metrics.camera_positions(c, [[2, 0, 0, 1], [0, 2, 0, 1], [0, 0, 2, 1], [0, 0, 0, 2]]).collect()
    assert [(x.x, x.y, x.z) for x in r] == [(1.5, 2.5, 3.5)]
    assert [metrics.alignment_version(x) for x in (None, 0, 1, 2, 3)] == [0, 0, 1, 2, 0]
    f = spark.createDataFrame([("a/pointcloud.las",), ("a/camera_positions.las",), ("b/pointcloud.las",), ("c/camera_positions.las",), ("d/x.las",)], "path string")
    assert {r.folder: r.status for r in files.cloud_pairs(f).collect()} == {"a": "ok", "b": "no_cameras", "c": "no_cloud"}
    b = spark.createDataFrame([("u", "é".encode()), ("l", "é".encode("latin1")), ("m", b"\xff\xfe" + "é".encode("utf-16-le")), ("s", b"\xef\xbb\xbfx"), ("e", b"")], "path string, content binary")
    assert {r.path: r.text for r in files.decoded(b).collect()} == {"u": "é", "l": "é", "m": "é", "s": "x", "e": ""}


def test_results_from_files(spark, tmp_path):
    for name, body in {"a/t1.csv": "Height,DBH\n1.5,2\n", "b/t2.csv": "Height,DBH\n3.5,\n", "debug/t3.csv": "Height,DBH\n9,9\n", "a/t4.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    assert sorted((r.path[-8:], r.Height, r.DBH) for r in results.read_results(spark, str(tmp_path)).collect()) == [("a/t1.csv", 1.5, 2), ("b/t2.csv", 3.5, None)]
    for name, body in {"a/x.json": '{"k": 1,\n "m": "u"}', "b/y.json": '{"k": 2}', "b/z.json": "{broken", "b/e.json": ""}.items():
        (tmp_path / name).write_text(body)
    assert sorted((r.k, r.m) for r in results.read_json_records(spark, str(tmp_path)).collect()) == [(1, "u"), (2, None)]
    d = spark.createDataFrame([(1, '{"k": 1}'), (2, "{broken"), (3, None), (4, '{"m": "u"}'), (5, "{}")], "i int, j string")
    assert sorted(tuple(r) for r in results.json_records(d, "j", "k long, m string").collect()) == [(1, 1, None), (4, None, "u")]


def test_cells_by_colour(spark):
    v = spark.createDataFrame([(1, 1.0, 0, 0, 0, 0.1, 0.2, 0.3, 0.5)], "tree_id int, voxel_size double, ix int, iy int, iz int, r double, g double, b double, density double")
    c = v.drop("density").withColumn("r", F.lit(0.9))
    c = c.union(c).union(c.withColumn("ix", F.lit(7)))
    assert sorted((r.ix, r.r, r.density) for r in enrich.recolour(v, c).collect()) == [(0, 0.9, 0.5), (7, 0.9, None)]
    assert sorted((r.ix, r.r, r.b) for r in enrich.colours_at(v, c).collect()) == [(0, 0.1, 0.3), (7, 0.0, 0.0)]
    assert enrich.recolour(v, c.limit(0)).collect() == v.collect()


def test_largest_distance_of_flat_clouds(spark):
    import numpy as np

    from foliarc.operators import hull

    rng = np.random.default_rng(8)
    u, w = np.linalg.qr(rng.normal(0, 1, (3, 2)))[0].T
    clouds = {
        "plane": 5 + rng.normal(0, 2, (3000, 2)) @ np.array([u, w]),
        "level": np.column_stack([rng.integers(0, 40, (2000, 2)), np.full(2000, 7.0)]),
        "line": np.outer(rng.random(500), u + 2 * w) + 1,
        "point": np.tile([1.0, 2.0, 3.0], (50, 1)),
        "two": np.array([[0.0, 0, 0], [3, 4, 12]]),
        "full": rng.normal(0, 1, (800, 3)),
    }
    d = spark.createDataFrame([(k, *map(float, p)) for k, x in clouds.items() for p in x] + [("plane", None, 1.0, 1.0)], "tree_id string, x double, y double, z double")
    got = {r.tree_id: r.max_distance for r in hull.spread(d).collect()}
    for k, x in clouds.items():
        assert abs(got[k] - max(np.linalg.norm(x - p, axis=1).max() for p in x)) < 1e-9, k


def test_many_coplanar_points_are_not_paired(spark):
    from pyspark.sql import functions as F

    from foliarc.operators import hull

    d = spark.range(300_000).select(F.lit("a").alias("tree_id"), (F.rand(1) * 100).alias("x"), (F.rand(2) * 50).alias("y"), F.lit(2.0).alias("z")).union(spark.sql("select 'a', -1D, -1D, 2D union all select 'a', 101D, 51D, 2D"))
    assert abs(hull.spread(d).first().max_distance - (102**2 + 52**2) ** 0.5) < 1e-9


def test_exact_percentiles_equal_those_of_spark(spark):
    from pyspark.sql import functions as F

    from foliarc.operators.metrics import exact_percentiles

    x = F.xxhash64("id") % 1000
    d = spark.range(6000).select((F.col("id") % 5).alias("g"), "id", x.alias("x"))
    v = F.when(F.col("g") == 0, F.exp(F.col("x") / 100.0)).when(F.col("g") == 1, F.lit(3.5)).when(F.col("g") == 2, F.floor(F.col("x") / 300)).when(F.col("g") == 3, F.col("x") * 1e305).otherwise(F.col("x") / 7)
    d = d.withColumn("v", v).union(spark.sql("select 9L, 1L, 1L, 2.5D union all select 8L, 1L, 1L, cast(null as double) union all select 4L, 1L, 1L, cast('nan' as double)"))
    shares = [0.0, 0.013, 0.5, 0.977, 1.0]
    want = {r.g: r.p for r in d.where("not isnan(v)").groupBy("g").agg(F.percentile("v", shares).alias("p")).collect() if r.p}
    for most in (60, 10_000):
        got = {r.g: r.p for r in exact_percentiles(d, ["g"], "v", shares, most).collect()}
        assert got.keys() == want.keys() - {8}
        for g in got:
            assert all(a == b or abs(a - b) <= 1e-12 * abs(b) for a, b in zip(got[g], want[g])), (g, got[g], want[g])


@pytest.mark.parametrize("flat", [False, True])
def test_clip_by_bricks_equals_all_planes(spark, flat):
    rng = np.random.default_rng(11)
    cams = [(t, *(rng.normal(0, 1, 3) * (5, 2, 1) + t * 1e5).tolist()) for t in (1, 2) for _ in range(60)]
    pts = [(t, i, *(rng.normal(0, 1, 3) * (6, 3, 2) + t * 1e5).tolist()) for t in (1, 2, 3) for i in range(1500)]
    pts += [(*c[:1], -1 - i, *c[1:]) for i, c in enumerate(cams)]  # corners lie on the planes
    pts += [(1, -1000, None, 1e5, 1e5), (1, -1001, math.nan, 1e5, 1e5), (1, -1002, 1e5, 1e5, math.inf), (1, -1003, 1e9, 1e5, 1e5), (None, -1004, 1e5, 1e5, 1e5)]
    c = spark.createDataFrame(cams, "tree_id int, x double, y double, z double")
    p = spark.createDataFrame(pts, "tree_id int, i int, x double, y double, z double").withColumn("brick_x", F.lit("own")).withColumn("cut", F.lit(7)).withColumn("a.b", F.lit(1))
    for share in (0.0, 0.1):
        faces = hull.hull_faces(c, ["tree_id"], flat).select("tree_id", "a", "b", "c", "d").toPandas()
        far = metrics.largest_distance(hull.corners(hull.hull_faces(c, ["tree_id"], flat), ["tree_id"]), ["tree_id"]).toPandas().set_index("tree_id").max_distance
        want = set()
        for t, i, *q in pts:
            f = faces[faces.tree_id == t]
            if t in (1, 2) and all(v is not None and math.isfinite(v) for v in q) and all(a * q[0] + b * q[1] + e * q[2] + d <= far[t] * share for a, b, e, d in f[["a", "b", "c", "d"]].to_numpy()):
                want.add((t, i))
        got = hull.clip(p, c, 0.0, share, ignore_z=flat)
        assert got.columns == p.columns and {(r.tree_id, r.i) for r in got.collect()} == want and len(want) > 500


def test_an_inner_brick_meets_no_planes_and_none_meets_all(spark):
    rng = np.random.default_rng(12)
    q = rng.normal(0, 1, (300, 3))
    c = spark.createDataFrame([(1, *v.tolist()) for v in q / np.linalg.norm(q, axis=1, keepdims=True)], "tree_id int, x double, y double, z double")
    faces = hull.hull_faces(c, ["tree_id"])
    hulls = hull.plane_arrays(faces, ["tree_id"]).withColumn("buffer", F.lit(0.0))
    grid = spark.createDataFrame([(1, *[-1.0] * 3, *[16] * 3, *[0.125] * 3, 1e-12)], "tree_id int, lo_x double, lo_y double, lo_z double, n_x long, n_y long, n_z long, side_x double, side_y double, side_z double, slack double")
    b = hull.hull_bricks(hulls, grid, ["tree_id"]).where(" and ".join(f"brick_{a} between 0 and 15" for a in "xyz")).select(F.size("cut").alias("n")).toPandas().n
    assert faces.count() > 500 and (b == 0).sum() > 500 and b.max() < 100 and len(b) < 3500


def test_hits_by_bricks_equal_a_join_of_all_steps(spark):
    rng = np.random.default_rng(13)
    n = (37, 20, 29)
    cells = {tuple(int(v) for v in rng.integers(0, n)) for _ in range(700)} | {(x, y, z) for x in range(8, 12) for y in range(8) for z in range(20, 29)}
    v = spark.createDataFrame([(1, 0.5, *c, 0.5 if sum(c) % 5 else (0.0 if c[0] % 2 else math.nan)) for c in cells], "tree_id int, voxel_size double, ix long, iy long, iz long, density_norm double")
    e = spark.createDataFrame([(1, 0.5, *n), (2, 0.5, 0, 3, 3)], "tree_id int, voxel_size double, nx long, ny long, nz long")
    full = {c for c in cells if sum(c) % 5}
    for heading in ("antipodal", "hashed"):
        r = rays.rays(e, 300, heading)
        steps = rays.march(r).collect()
        want = sorted((x.ray_id, x.k, x.ix, x.iy, x.iz) for x in steps if x.tree_id == 1 and (x.ix, x.iy, x.iz) in full)
        got = sorted((x.ray_id, x.k, x.ix, x.iy, x.iz) for x in rays.hits(r, v).collect())
        assert got == want and len(got) > 300
        joined = [(x.tree_id, x.ray_id, x.bx, x.by, x.bz) for x in rays.entries(r).collect()]
        assert len(joined) == len(set(joined)) and len(joined) * 3 < len(steps)
    assert rays.hits(r, v.limit(0)).count() == 0
    bits = rays.occupancy(v.where("density_norm > 0 and not isnan(density_norm)")).select(F.aggregate("bits", F.lit(0), lambda a, b: a + F.bit_count(b)).alias("n")).agg(F.sum("n")).first()[0]
    assert bits == len(full)


def test_numbers_and_runs_over_ranges(spark):
    rng = np.random.default_rng(14)
    rows = [(c, int(i), bool(rng.random() < 0.3)) for c, n in ((1, 700), (2, 5), (3, 1), (4, 0)) for i in rng.permutation(n)]
    rows += [(None, 5, False)] + [(5, i, False) for i in range(300)]
    f = spark.createDataFrame(rows, "chunk_id int, idx int, aligned boolean").repartition(5)
    part = batching.numbered(f.where("chunk_id = 1"), "chunk_id", "idx")
    assert all(r.n0 == r.idx for r in part.collect()) and part.count() == 700
    runs, pairs = {}, set()
    for c in (1, 2, 3, 5):
        run, before = [], 0
        for _, i, aligned in sorted(r for r in rows if r[0] == c):
            run, before = ([], before + 1) if aligned else ([*run, i], before)
            if not aligned:
                runs[c, i] = (before, (len(run) - 1) // 4)
                pairs |= {(c, leader, i) for leader in run[-3:]}
    got = batching.unaligned_runs(f, 4)
    assert got.columns == ["chunk_id", "idx", "aligned", "run", "batch"] and {(r.chunk_id, r.idx): (r.run, r.batch) for r in got.collect()} == runs
    follow = [tuple(r) for r in batching.following_unaligned(f, 3).collect()]
    assert len(follow) == len(pairs) and set(follow) == pairs
    empty = f.limit(0)
    assert batching.unaligned_runs(empty, 4).count() == batching.following_unaligned(empty, 3).count() == batching.sliding_windows(empty, 4, 1).count() == 0


def test_hulls_merge_over_many_rounds(spark, monkeypatch):
    rng = np.random.default_rng(15)
    d = spark.createDataFrame([(t, *rng.integers(0, 40, 3).astype(float).tolist()) for t in (1, 2) for _ in range(1500)] + [(3, 1.0, 1.0, 1.0)], "tree_id int, x double, y double, z double")
    for flat in (False, True):
        planes = lambda: {tuple(np.round(r[:5], 9)) for r in hull.hull_faces(d, ["tree_id"], flat).collect()}
        whole = planes()  # a face of many points in one plane may be cut into other triangles, its plane is the same
        with monkeypatch.context() as m:
            m.setattr(hull, "TILE", 10)
            m.setattr(hull, "MERGE", 2)
            assert planes() == whole and len(whole) > 8


def test_stages_are_measured(spark):
    from foliarc import shared

    d = spark.range(100).withColumn("v", F.col("id") * 2)
    with shared.measured() as stages:
        shared.written(d.where("id < 30"), "few")
        shared.written(d.where("id < 0"), "none")
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            shared.written(d.select((F.col("v") / F.lit(0)).alias("w")), "broken")
    assert [(r["stage"], r["rows"], r["error"] is None) for r in stages] == [("few", 30, True), ("none", 0, True), ("broken", None, False)]
    assert stages[0]["bytes"] > 0 and all(r["seconds"] > 0 for r in stages)
    assert spark.createDataFrame(stages, shared.METRICS).count() == 3
    shared.written(d, "unmeasured")
    assert len(stages) == 3


def test_manifest_at_a_uri(tmp_path):
    from foliarc.plans.tasks import Pipeline, State

    runs = []
    p = Pipeline(max_retries=0).add(lambda: runs.append(1)).add(lambda state: state.get("go", False))
    at = f"file://{tmp_path}/deep/manifest.json"
    assert not p.run(State(), at) and p.run(State(go=True), at)  # the second run starts at the stage that failed
    assert runs == [1] and (tmp_path / "deep" / "manifest.json").exists()


def test_a_cloud_without_a_sound_hull_does_not_stop_the_others(spark, monkeypatch):
    corners = [(float(i), float(j), float(k)) for i in (0, 2) for j in (0, 3) for k in (0, 4)]
    clouds = {1: corners, 2: [*corners, (float("inf"), 0.0, 0.0)], 3: [*corners, (float("nan"), 0.0, 0.0)], 4: corners[:3], 5: corners * 2}
    p = spark.createDataFrame([(k, *x) for k, v in clouds.items() for x in v] + [(6, None, 0.0, 0.0)], "tree_id long, x double, y double, z double")
    usual = hull.facets

    def facets(q):
        if len(q) > 8:
            raise ArithmeticError("two of each")
        return usual(q)

    monkeypatch.setattr(hull, "facets", facets)
    got = hull.hull_outcomes(p, ["tree_id"]).toPandas()
    errors = got[got.error.notna()].set_index("tree_id").error.to_dict()
    assert errors == {2: "a coordinate is not finite", 3: "a coordinate is not finite", 5: "ArithmeticError: two of each"}
    assert set(got[got.error.isna()].tree_id) == {1} and {r.tree_id for r in hull.hull_faces(p, ["tree_id"]).collect()} == {1}


# sentences made up for this test
SENTENCES = {
    "cp1252": ["Der Förster prüft die Bäume am Fluß, größere Äste fallen später.", "La forêt brûlée repousse déjà, ça étonne les élèves près du ruisseau.", "El árbol más pequeño creció en otoño; mañana lo medirá la compañía."],
    "cp1250": ["Zażółć gęślą jaźń, a potem zmierz wysokość każdego świerka w lesie.", "Příliš žluťoučký kůň běžel k řece, kde rostou vysoké smrky a břízy."],
    "iso8859_2": ["Zażółć gęślą jaźń, a potem zmierz wysokość każdego świerka w lesie."],
    "cp1251": ["Лесник измеряет высоту каждого дерева и записывает её в журнал.", "Весной берёзы растут быстрее, чем старые сосны у реки."],
    "koi8_r": ["Лесник измеряет высоту каждого дерева и записывает её в журнал."],
    "cp866": ["Лесник измеряет высоту каждого дерева и записывает её в журнал."],
    "iso8859_5": ["Лесник измеряет высоту каждого дерева и записывает её в журнал."],
    "cp1253": ["Ο δασολόγος μετρά το ύψος κάθε δέντρου και το γράφει στο βιβλίο."],
    "utf_16_le": ["height of each tree"], "utf_16_be": ["height of each tree"], "utf_8": ["Лесник und Förster", ""],
}


def test_code_pages_are_told_apart(spark, monkeypatch):
    from foliarc.functions import charset

    rows = [(f"{page}/{i}", t.encode(page), page, t) for page, ts in SENTENCES.items() for i, t in enumerate(ts)]
    rows += [("mark/8", b"\xef\xbb\xbf" + "é".encode(), "utf_8", "é"), ("mark/16", b"\xff\xfe" + "é".encode("utf-16-le"), "utf_16_le", "é"), ("null", None, None, None), ("one", b"\xe9", "cp1252", "é"), ("nul", "a\0bé".encode(), "utf_8", "a\0bé")]
    long = "Лесник измеряет высоту. " * 100_000
    rows.append(("long", long.encode("cp1251"), "cp1251", long))
    got = files.detected(spark.createDataFrame([r[:2] for r in rows], "path string, content binary")).toPandas().set_index("path")
    for path, _, page, text in rows:
        assert got.charset[path] == page and got.text[path] == text, (path, got.charset[path])
    assert got.confidence.drop("null").between(0, 1).all() and np.isnan(got.confidence["null"])
    whole = charset.likeliest(rows[0][1])
    monkeypatch.setattr(charset, "CHUNK", 7)
    assert charset.likeliest(rows[0][1]) == whole and charset.likeliest(b"") == ("cp1252", 1.0)


def test_a_path_that_fails_is_a_row(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"f{i}.txt").write_text("7" * i)

    def work(path):
        n = int(open(path).read())  # the empty file has none
        return None if n == 7 else n

    p = spark.createDataFrame([(str(tmp_path / f"f{i}.txt"),) for i in range(9)] + [(str(tmp_path / "gone"),), (None,), (str(tmp_path / "f2.txt"),)], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.result, r.error) for r in files.on_each(p, work).collect()}
    assert len(got) == 10 and got["f2.txt"] == ("77", None) and got["f1.txt"] == (None, None)
    assert got["f0.txt"][1].startswith("ValueError") and got["gone"][1].startswith("FileNotFoundError")
    assert files.on_each(p.limit(0), work).count() == 0


def test_callables_of_users(spark):
    """Filters, masks and channels that callers bring stand beside the library's own."""
    v = spark.createDataFrame([(1, 0.5, i, 0, 0, 10, 0.1 * (i + 1), 0.4, 0.2, 0.1 * (i + 1), 4, 1) for i in range(6)], "tree_id long, voxel_size double, ix long, iy long, iz long, n long, r double, g double, b double, density double, cls int, treeid long")
    more = dict(enrich.CHANNELS) | {"warm": lambda: F.col("r") - F.col("b"), "column": lambda: F.col("ix") * 10}
    got = enrich.enrich(v, filters=(enrich.remove_ground, lambda d: d.where("ix != 1")), masks=(F.col("r") < 0.55,), post=(lambda d: d.withColumn("g", F.col("g") / 2),), channels=more).toPandas().sort_values("ix")
    assert got.r.round(6).tolist() == [0.1, 0.3, 0.4, 0.5] and got.g.tolist() == [0.2] * 4
    assert np.allclose(got.warm, got.r - 0.2) and got.column.tolist() == (got.ix * 10).tolist() and {"gli", "ngrdi", "exr", "density_norm"} <= set(got.columns)
    assert enrich.enrich(v, channels={}).columns == [*v.columns, "nx", "ny", "nz", "density_norm"]
