"""From files to results: LAS of several formats, broken files, prediction and clipping over folders."""

import struct

import numpy as np

from foliarc.plans import jobs
from foliarc.sources import las


def las_14(n, fmt=7, extra=b""):
    """A LAS 1.4 file of a format with all fields filled, and an extra-bytes record before the points."""
    rng = np.random.default_rng(fmt)
    dtype = np.dtype(las.FORMATS[fmt] + [("treeid", "<i4"), ("odd", "V3")])
    a = np.frombuffer(rng.integers(0, 256, n * dtype.itemsize, dtype=np.uint8).tobytes(), dtype).copy()
    for c in "XYZ":
        a[c] = rng.integers(0, 4000, n)
    a["treeid"] = np.arange(n)
    field = bytearray(192)
    field[2], field[4:10] = 6, b"treeid"
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, 192, b"extra") + bytes(field)
    head = bytearray(375)
    start = 375 + len(vlr) + len(extra)
    head[: las.HEADER.size] = las.HEADER.pack(b"LASF", 0, 0, 0, 0, 0, b"", 1, 4, b"sys", b"soft", 1, 1, 375, start, 1, fmt, dtype.itemsize, 0, 0, 0, 0, 0, 0, 0.001, 0.001, 0.001, 0, 0, 0, 4, 0, 4, 0, 4, 0)
    struct.pack_into("<Q", head, las.COUNT_14, n)
    return bytes(head) + vlr + extra + a.tobytes(), a


def tree(n=4000, seed=0):
    """A cone of green points over a patch of ground."""
    rng = np.random.default_rng(seed)
    h = rng.random(n) ** 0.5
    x, y = (rng.random((2, n)) - 0.5) * 2 * (1.02 - h)
    ground = np.arange(n) % 10 == 0
    z = np.where(ground, 0.0, 0.5 + 4 * h)
    return {"x": x, "y": y, "z": z, "red": rng.integers(60, 110, n), "green": rng.integers(120, 200, n), "blue": rng.integers(40, 90, n), "raw_class": np.where(ground, 2, 0), "treeid": np.ones(n)}


def test_formats_of_las_14(spark, tmp_path):
    las.register(spark)
    for fmt in (6, 7, 8, 10):
        data, a = las_14(70, fmt, b"xyz")
        p = tmp_path / f"f{fmt}.las"
        p.write_bytes(data)
        got = spark.read.format("las").option("records", 30).option("bytes", 700).option("raw", "true").load(str(p)).orderBy("ord").toPandas()
        assert np.allclose(got.x, a["X"] * 0.001) and (got.raw_class == a["raw"]).all() and (got.treeid == a["treeid"]).all()
        assert (got.red == (a["red"] if fmt > 6 and fmt != 9 else 0)).all() and b"".join(got.record) == a.tobytes() and got.error.isna().all()


def test_written_like_keeps_all_fields(spark, tmp_path):
    las.register(spark)
    data, a = las_14(90, 8)
    (tmp_path / "in.las").write_bytes(data)
    p = spark.read.format("las").option("raw", "true").load(str(tmp_path / "in.las"))
    out = spark.createDataFrame([(str(tmp_path / "in.las"), str(tmp_path / "out.las"))], "file string, output string")
    assert las.write_like(p.where("ord % 3 = 0"), out).first().points == 30
    new = (tmp_path / "out.las").read_bytes()
    assert new[las.layout(str(tmp_path / "out.las")).start :] == a[::3].tobytes() and new[24:26] == b"\x01\x04" and las.layout(str(tmp_path / "out.las")).count == 30


def test_predict_two_trees_and_a_broken_file(spark, tmp_path):
    for name, seed in (("site1/tree1.las", 1), ("site1/tree2.las", 2)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(las.las_bytes(tree(seed=seed)))
    (tmp_path / "in" / "site2").mkdir()
    (tmp_path / "in" / "site2" / "bad.las").write_bytes(b"LASF" + b"\0" * 40)
    (tmp_path / "in" / "site2" / "skipme.las").write_bytes(b"")
    ini = tmp_path / "predict.ini"
    (tmp_path / "out" / "site1" / "tree1").mkdir(parents=True)
    measured = tmp_path / "out" / "site1" / "tree1" / "tree1_dbh_and_heights.txt"
    measured.write_text("4.25 0.31 1 2\n9 9 9 9\n")
    ini.write_text(f"[data]\ninput_dir={tmp_path}/in\noutput_dir={tmp_path}/out\nfinal_output={tmp_path}/results\npaths_to_skip=skipme\n[voxelation]\nvoxel_size=0.25\n[transparency]\nray_sample_count=200\n")
    got = jobs.predict(spark, jobs.read_settings(str(ini)), metrics=f"{tmp_path}/metrics").toPandas().sort_values("file")
    stages = spark.read.parquet(f"{tmp_path}/metrics").toPandas().set_index("stage")
    assert stages.rows["chosen-files"] == 3 and stages.rows["results"] == 3 and stages.bytes["results"] > 0 and "final output" in stages.index and (stages.seconds > 0).all() and stages.error.isna().all()
    assert got.status.str.startswith("unreadable").sum() == 1 and (got.status == "ok").sum() == 2 and len(got) == 3
    good = got[got.status == "ok"]
    assert good.Height.between(3.5, 5).all() and good.Transparency.between(0, 100).all() and good.Tree.tolist() == ["tree1", "tree2"] and set(good.Site) == {"site1"}
    assert measured.exists() and good.DBH.tolist()[0] == 31.0 and np.isnan(good.DBH.tolist()[1]) and good["Height 3df"].tolist()[0] == 4.25
    (tmp_path / "in" / "site1" / "tree2.las").unlink()  # a second run replaces its own folders only
    assert jobs.predict(spark, jobs.read_settings(str(ini))).count() == 2 and (tmp_path / "out" / "Site=site1" / "Tree=tree2").is_dir() and measured.exists()
    assert spark.read.option("header", True).csv(f"{tmp_path}/results").count() == 2 and (tmp_path / "out" / "Site=site1" / "Tree=tree1").is_dir()


def test_clip_over_folders(spark, tmp_path):
    rng = np.random.default_rng(4)
    for name in ("a", "b", "c"):
        (tmp_path / "in" / name).mkdir(parents=True)
    data, a = las_14(500, 7)
    (tmp_path / "in/a/pointcloud.las").write_bytes(data)
    (tmp_path / "in/b/pointcloud.las").write_bytes(data)
    corners = np.array([[i, j, k] for i in (1.0, 3.0) for j in (1.0, 3.0) for k in (1.0, 3.0)])
    cams = np.concatenate([corners, rng.random((20, 3)) + 1.5])
    (tmp_path / "in/a/camera_positions.las").write_bytes(las.las_bytes({c: cams[:, i] for i, c in enumerate("xyz")}))
    got = {r.folder.rsplit("/", 1)[1]: r for r in jobs.clip_folders(spark, str(tmp_path / "in"), str(tmp_path / "out"), 0.0, 0.0).collect()}
    xyz = np.stack([a[c] * 0.001 for c in "XYZ"], 1)
    inside = ((xyz >= 1 - 1e-9) & (xyz <= 3 + 1e-9)).all(1)
    assert got["a"].points == inside.sum() > 0 and got["b"].status == "no_cameras" and set(got) == {"a", "b"}
    new = (tmp_path / "out/a.las").read_bytes()
    assert new[las.layout(str(tmp_path / "out/a.las")).start :] == a[inside].tobytes()


def test_a_folder_that_fails_does_not_stop_the_others(spark, tmp_path):
    data, a = las_14(300, 7)
    corners = np.array([[i, j, k] for i in (1.0, 3.0) for j in (1.0, 3.0) for k in (1.0, 3.0)])
    cameras = {"good": corners, "far": corners + 1000, "pair": corners[:2], "broken": None}
    for name, xyz in cameras.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / f"in/{name}/pointcloud.las").write_bytes(data)
        (tmp_path / f"in/{name}/camera_positions.las").write_bytes(b"LASF" + b"\0" * 40 if xyz is None else las.las_bytes({c: xyz[:, i] for i, c in enumerate("xyz")}))
    got = {r.folder.rsplit("/", 1)[1]: r for r in jobs.clip_folders(spark, str(tmp_path / "in"), str(tmp_path / "out"), 0.0, 0.0).collect()}
    assert {n: r.status.split(":")[0] for n, r in got.items()} == {"good": "ok", "far": "no_points", "pair": "no_hull", "broken": "unreadable"}
    assert got["good"].points > 0 and got["far"].points == 0 and got["pair"].output is None and got["broken"].output is None
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["far.las", "good.las"]


def test_a_hull_that_fails_is_a_status(spark, tmp_path, monkeypatch):
    for name, seed in (("tree1", 1), ("tree2", 2)):
        (tmp_path / "in/site").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"in/site/{name}.las").write_bytes(las.las_bytes(tree(seed=seed)))

    def facets(p):
        raise ValueError("no such hull")

    monkeypatch.setattr(jobs.hull, "facets", facets)
    ini = tmp_path / "predict.ini"
    ini.write_text(f"[data]\ninput_dir={tmp_path}/in\noutput_dir={tmp_path}/out\nfinal_output={tmp_path}/results\n[voxelation]\nvoxel_size=0.25\n[transparency]\nray_sample_count=50\n")
    got = jobs.predict(spark, jobs.read_settings(str(ini))).toPandas()
    assert got.status.tolist() == ["hull: ValueError: no such hull"] * 2 and got.Transparency.isna().all() and got.Height.notna().all() and got["Live Canopy Base"].notna().all()


def test_settings_and_sensor(tmp_path):
    s = jobs.read_settings()
    assert s.analysis == jobs.AnalysisConfig(heading="hashed") and s.input_dir == "data/input"
    sensor = jobs.read_sensor(str(tmp_path / "new"))
    assert sensor == jobs.SENSOR == jobs.read_sensor(str(tmp_path / "new"))


def opened(paths):
    """Which of the files were read since ``mark``; None where the file system does not say."""
    return {p for p in paths if p.stat().st_atime > 2_000}


def mark(paths):
    import os

    for p in paths:
        os.utime(p, (1_000, 1_500))


def test_only_chosen_files_are_opened(spark, tmp_path):
    paths = []
    for i in range(8):
        p = tmp_path / "in" / f"s{i}" / f"t{i}.las"
        p.parent.mkdir(parents=True)
        p.write_bytes(las.las_bytes(tree(400, i)))
        paths.append(p)
    mark(paths)
    paths[0].read_bytes()
    if not opened(paths[:1]):
        import pytest

        pytest.skip("reading a file leaves no trace here")
    mark(paths)
    files_ = jobs.found_files(spark, str(tmp_path / "in"))
    assert files_.count() == 8 and not opened(paths)
    s = jobs.Settings(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "results"), jobs.AnalysisConfig(voxel_sizes=(0.5,), paths_to_skip=("s0/",), file_count=1, calculate_transparency=False))
    assert [r.file for r in jobs.predict(spark, s).collect()] == [str(paths[1])] and opened(paths) == {paths[1]}
    mark(paths)
    las.register(spark)
    read = spark.read.format("las").load(str(tmp_path / "in"))
    assert read.where(f"file = '{paths[3]}'").count() == 400 and opened(paths) == {paths[3]}
    mark(paths)
    assert read.where("file like '%t5.las'").select("x").count() == 400 and opened(paths) == {paths[5]}
    mark(paths)
    assert read.where(read.file.isin(str(paths[1]), str(paths[2])) & (read.x > 100)).count() == 0 and opened(paths) == set(paths[1:3])


def test_small_files_share_tasks_and_large_ones_are_cut():
    got = las.ranges([("a", 10), ("b", 0), ("c", 250_000), ("d", 5)], 100_000)
    assert [p.parts for p in got] == [[("a", 0, 100_000)], [("b", 0, 100_000)], [("c", 0, 100_000)], [("c", 100_000, 200_000)], [("c", 200_000, 300_000)], [("d", 0, 100_000)]]
    assert len(las.ranges([(str(i), 1000) for i in range(1024)], 1 << 20)) == 64


def test_columns_are_what_is_asked_for(spark, tmp_path):
    import pytest

    p = tmp_path / "a.las"
    p.write_bytes(las.las_bytes(tree(50)))
    las.register(spark)
    assert spark.read.format("las").option("columns", "x, red").load(str(p)).columns == ["x", "red", "file", "ord", "error"]
    few = las.read_files(jobs.found_files(spark, str(tmp_path)), ["z"], size=500)
    assert few.columns == ["z", "file", "ord", "error"] and sorted(r.ord for r in few.collect()) == list(range(50))
    with pytest.raises(ValueError):
        las.schema_of(["colour"], False)


def test_every_format_is_written_and_read(spark, tmp_path):
    las.register(spark)
    n = 3000
    d = spark.range(n).selectExpr("id / 8D - 100 as x", "-id / 4D as y", "sqrt(id) as z", "cast(id % 9 as int) as intensity", "cast(id % 65536 as int) as red", "cast(7 as int) as green", "cast(null as int) as blue", "cast(id % 32 as int) as raw_class", "id + 5000000000 as treeid")
    d = d.union(d.limit(1).selectExpr("cast(null as double)", "y", "z", "intensity", "red", "green", "blue", "raw_class", "treeid"))
    for fmt in range(11):
        out = str(tmp_path / f"f{fmt}")
        d.repartition(3).write.format("las").option("path", out).option("point_format", fmt).mode("append").save()
        got = spark.read.format("las").option("bytes", 5000).load(out)
        rgb = "red" in dict(las.FORMATS[fmt])
        want = d.where("x is not null").selectExpr("round(x, 3) x", "round(y, 3) y", "round(z, 3) z", "intensity", f"{'red' if rgb else '0'} red", f"{'7' if rgb else '0'} green", "0 blue", "raw_class", "treeid")
        same = got.selectExpr("round(x, 3) x", "round(y, 3) y", "round(z, 3) z", "intensity", "red", "green", "blue", "raw_class", "treeid")
        assert got.where("error is not null").count() == 0 and same.exceptAll(want).count() == 0 and got.count() == n
        assert not [p for p in (tmp_path / f"f{fmt}").iterdir() if p.suffix != ".las" and not p.name.startswith(".")]
    out = str(tmp_path / "f3")
    d.where("x is not null").limit(10).write.format("las").option("path", out).mode("overwrite").save()
    assert spark.read.format("las").load(out).count() == 10 and d.limit(0).write.format("las").option("path", out).mode("append").save() is None


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    import pytest

    las.register(spark)
    d = spark.range(100).selectExpr("if(id = 99, raise_error('stop'), id * 1D) as x", "0D as y", "0D as z").repartition(2)
    with pytest.raises(Exception):
        d.write.format("las").option("path", str(tmp_path / "out")).mode("append").save()
    assert not list((tmp_path / "out").glob("**/*.las")) if (tmp_path / "out").exists() else True


def test_stream_takes_each_file_once(spark, tmp_path):
    from foliarc.streaming.clouds import watch_las

    place = tmp_path / "in"
    place.mkdir()
    config = jobs.AnalysisConfig(voxel_sizes=(0.5,), calculate_transparency=False)
    start = lambda: watch_las(spark, str(place), str(tmp_path / "out"), str(tmp_path / "check"), config).awaitTermination(120)
    (place / "a.las").write_bytes(las.las_bytes(tree(800, 1)))
    (place / "bad.las").write_bytes(b"LASF")
    assert start()
    (place / "b.las").write_bytes(las.las_bytes(tree(800, 2)))
    (place / "c.las.part").write_bytes(b"")
    assert start() and start()
    got = {r.file.rsplit("/", 1)[1]: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.pop("bad.las").startswith("unreadable") and got == {"a.las": "ok", "b.las": "ok"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_folders_below_a_root_with_odd_characters(spark):
    from foliarc.operators.files import subfolders

    p = spark.createDataFrame([("data.v1/a/x",), ("dataxv1/q/x",), ("a(b/c/d",), ("data.v1/file",)], "path string")
    assert [r.path for r in subfolders(p, "data.v1").collect()] == ["data.v1/a"] and [r.path for r in subfolders(p, "a(b").collect()] == ["a(b/c"]
