"""From settings and folders to results: the library's commands."""

from __future__ import annotations

import configparser
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliarc.functions.text import site_and_tree
from foliarc.operators import files, hull, results
from foliarc.plans.features import features
from foliarc.schema import AnalysisConfig, ChannelLimit
from foliarc.shared import METRICS, attach, exists, kept, measured, stage, written
from foliarc.sources import las

# Settings of a sensor where none are given.
SENSOR = {"sensor": {"shutter": "regularized", "type": "frame", "load_calibration_file": False, "calibration_file": "calibration.xml", "enable_sensor_correction": False, "pixel_height_mm": 0.0019, "pixel_width_mm": 0.0019}}


@dataclass(frozen=True)
class Settings:
    """Where data lie, and how they are analysed."""

    input_dir: str = "data/input"
    output_dir: str = "data/output"
    final_output: str = "data/results.csv"
    analysis: AnalysisConfig = AnalysisConfig()


def read_settings(path: str | None = None) -> Settings:
    """Settings from an INI file; what it leaves out, and all where there is no file, has its default."""
    ini = configparser.ConfigParser()
    if path:
        with open(path) as f:
            ini.read_file(f)
    yes = lambda section, key: ini.getboolean(section, key, fallback=True)
    number = lambda section, key, default: ini.getfloat(section, key, fallback=default)
    a = AnalysisConfig(
        voxel_sizes=tuple(float(x) for x in ini.get("voxelation", "voxel_size", fallback="0.1").split(",")),
        vertical_axis=ini.getint("data", "vertical_axis", fallback=2),
        file_count=ini.getint("data", "file_count", fallback=-1),
        paths_to_skip=tuple(x for x in ini.get("data", "paths_to_skip", fallback="").split(",") if x),
        calculate_dbh=yes("analyses", "calculate_dbh"), calculate_height=yes("analyses", "calculate_height"), calculate_dimensions=yes("analyses", "calculate_dimensions"),
        calculate_live_canopy=yes("analyses", "calculate_live_canopy_dims"), calculate_transparency=yes("analyses", "calculate_transparency"),
        mask_blue=yes("filtering", "mask_blue"), rgb_outlier_filter=yes("filtering", "rgb_outlier_filter"),
        rgb_outlier_percentage=number("filtering", "rgb_outlier_percentage", 5), density_threshold=number("filtering", "density_threshold", 0),
        smoothing_window=ini.getint("live_crown_id", "smoothing_window", fallback=5),
        ray_sample_count=ini.getint("transparency", "ray_sample_count", fallback=15_000),
        heading="hashed" if ini.getboolean("transparency", "randomize_ray_trajectory", fallback=True) else "antipodal",
        brightness_floor=number("transparency", "brightness_floor", 0), filter_non_photosynthetic_voxels=yes("transparency", "filter_non_photosynthetic_voxels"),
        limits=(ChannelLimit("ngrdi", min=number("transparency", "filter_channel_limit_grr", 0.005)), ChannelLimit("gli", min=number("transparency", "filter_channel_limit_gli", 0))),
        required_hits=ini.getint("transparency", "required_hits", fallback=2), energy_threshold=number("transparency", "energy_threshold", 0.1),
        ray_dissipation_factor=number("transparency", "ray_dissipation_factor", 0.5), initial_energy=number("transparency", "initial_energy", 1))
    place = lambda key: ini.get("data", key, fallback=getattr(Settings, key))
    return Settings(place("input_dir"), place("output_dir"), place("final_output"), a)


def read_sensor(folder: str) -> dict:
    """Settings of the sensor from sensor.json of a folder, which is written with the usual ones where it is missing."""
    path = os.path.join(folder, "sensor.json")
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        with open(path, "w") as f:
            json.dump(SENSOR, f, indent=4)
    with open(path) as f:
        return json.load(f)


def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the LAS files below a folder; nothing is opened."""
    return files.list_files(spark, folder, "*.las").select(files.plain(F.col("path")).alias("path"), "length")


def with_status(chosen: DataFrame, features: DataFrame) -> DataFrame:
    """Features of every chosen file (file, error), with a status: unreadable, what an analysis said, no_voxels or ok."""
    own = F.col("status") if "status" in features.columns else F.lit(None).cast("string")
    out = chosen.join(features, "file", "left")
    return out.withColumn("status", F.coalesce(F.concat(F.lit("unreadable: "), "error"), own, F.when(F.col("Voxel Size").isNull(), "no_voxels").otherwise("ok"))).drop("error")


def predict(spark: SparkSession, settings: Settings, dbh: DataFrame | None = None, metrics: str | None = None) -> DataFrame:
    """Features of every LAS file below the input folder, one row per file and voxel size, with Site, Tree and status.

    Files are listed and chosen first; only chosen ones are opened, their headers once for their errors.  A file
    that cannot be read, or has no coloured voxel, is a row with its status and no features.  dbh: (file, dbh,
    height) measured elsewhere; where it is not given and the settings ask for it, results that lie beside the
    inputs or in the output folder are taken.

    Rows are written as CSV to the output folder, by site and tree, and all together to the final output.  Of
    the output folder only the folders of these sites and trees are replaced, once all rows are there.

    metrics: a folder of Parquet to which the stages of this run are added, a failed one with its error: started,
    seconds, rows and bytes.  Rows are observed as they are written; nothing is read again for them.
    """
    with measured() as stages:
        try:
            return _predicted(spark, settings, dbh)
        finally:
            if metrics and stages:
                spark.createDataFrame(stages, METRICS).coalesce(1).write.mode("append").parquet(metrics)


def _predicted(spark: SparkSession, settings: Settings, dbh: DataFrame | None) -> DataFrame:
    las.register(spark)
    c = settings.analysis
    base = settings.input_dir.rstrip("/")
    found = found_files(spark, settings.input_dir)
    chosen = files.analysed(found, ".las", c.paths_to_skip, settings.output_dir, base, c.file_count).select("path")
    chosen = written(las.headers(found.join(chosen, "path")), "chosen-files")
    state = chosen.select(F.col("path").alias("file"), "error")
    good = chosen.where("error is null")
    if dbh is None and c.calculate_dbh:
        folders = [f for f in dict.fromkeys((settings.output_dir, settings.input_dir)) if exists(spark, f)]
        dbh = files.dbh_results(spark, state, folders, base)
    points = las.read_files(good, ["x", "y", "z", "red", "green", "blue", "raw_class", "treeid"]).where("error is null").drop("error")
    out = with_status(state, features(points, c, ("file",), dbh))
    site, tree = site_and_tree(F.concat(F.lit("data/output/"), F.substring("file", len(base) + 2, 1 << 30)))
    out = written(results.rounded(out.withColumns({"Site": site, "Tree": F.regexp_replace(tree, r"\.las$", "")})), "results")
    with stage("output by site and tree"):
        results.write_results(out, settings.output_dir, ["Site", "Tree"])
    with stage("final output"):
        results.write_results(out, settings.final_output)
    return out


def clip_folders(spark: SparkSession, cloud_path: str = "data/export", export_path: str = "data/clipped", quantile: float = 0.0, buffer_percent: float = 0.1, ignore_z: bool = False) -> DataFrame:
    """Clip the cloud of each folder to its cameras and write it, all fields kept, as one file named after the folder.

    Folders are paired from a listing; only the two files of complete ones are opened.  Returns (folder,
    status, output, points): ok, which of the two files a folder lacks, unreadable: and why, hull: and why the
    cameras' hull could not be built, no_hull where they have none, or no_points where nothing lies within
    and the file holds none.  A folder that fails has no file and does not stop the others.
    """
    las.register(spark)
    found = found_files(spark, cloud_path)
    pairs = files.cloud_pairs(found)
    pairs = pairs.withColumn("output", F.when(F.col("status") == "ok", F.concat(F.lit(export_path.rstrip("/") + "/"), F.regexp_extract("folder", "[^/]*$", 0), F.lit(".las"))))
    pairs = written(pairs, "folder-pairs")
    ok = pairs.where("status = 'ok'")

    heads = written(las.headers(found.join(ok.select(F.explode(F.array("cloud", "cameras")).alias("path")), "path")), "folder-files")
    unread = ok.join(heads.where("error is not null"), F.col("path").isin(F.col("cloud"), F.col("cameras"))).groupBy("folder").agg(F.min("error").alias("unreadable"))
    ok = kept(ok.join(unread, "folder", "left_anti"), "folders-read")

    def points(which: str, **options) -> DataFrame:
        files_ = found.join(ok.select(F.col(which).alias("path")), "path")
        return attach(las.read_files(files_, **options).where("error is null"), ok.select("folder", F.col(which).alias("file")), ["file"])

    failed, hulls, ends = hull.camera_hulls(points("cameras", columns=["x", "y", "z"]).select("folder", "x", "y", "z"), quantile, buffer_percent, ignore_z, ("folder",))
    clipped = hull.within_hull(points("cloud", raw=True), hulls, ends, ("folder",))
    whole = ok.join(hulls.select("folder"), "folder", "left_semi")
    made = written(las.write_like(clipped, whole.select(F.col("cloud").alias("file"), "output")), "clipped-files")
    out = pairs.join(made.select("output", "points"), "output", "left").join(unread, "folder", "left").join(failed, "folder", "left").join(hulls.select("folder", F.lit(True).alias("hull")), "folder", "left")
    why = F.when(F.col("status") != "ok", F.col("status")).when(F.col("unreadable").isNotNull(), F.concat(F.lit("unreadable: "), "unreadable")).when(F.col("error").isNotNull(), F.concat(F.lit("hull: "), "error"))
    why = why.when(F.col("hull").isNull(), "no_hull").when(F.coalesce("points", F.lit(0)) == 0, "no_points").otherwise("ok")
    return out.select("folder", why.alias("status"), F.when(why.isin("ok", "no_points"), F.col("output")).alias("output"), "points")
