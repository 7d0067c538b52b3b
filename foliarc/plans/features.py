"""Features of every tree as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.functions.color import is_sky
from foliarc.operators import crown, enrich, hull, metrics, rays, voxel
from foliarc.operators.voxel import KEYS
from foliarc.schema import AnalysisConfig
from foliarc.shared import attach, kept, written


def enriched(points: DataFrame, config: AnalysisConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class codes, colour mask, voxels, masks and index channels, for every voxel size of the settings."""
    sky = is_sky(F.col("red"), F.col("green"), F.col("blue"))
    p = voxel.permute_axes(points, config.vertical_axis)
    v = voxel.voxelise(p, config.voxel_sizes, config.rgb_outlier_percentage if config.rgb_outlier_filter else None, keys, ~sky if config.mask_blue else None)
    return enrich.enrich(v, config.density_threshold, keys)


def canopy(voxels: DataFrame, crowns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Voxels from the live base up, counted from there; nz is the depth that is left."""
    k = [*keys, "voxel_size"]
    base = crowns.where("status = 'ok'").select(*k, F.ceil("base").cast("long").alias("floor"))
    v = attach(voxels, base, k).where(F.col("iz") >= F.col("floor"))
    return v.withColumns({"iz": F.col("iz") - F.col("floor"), "nz": F.col("nz") - F.col("floor")}).drop("floor")


def transparency(voxels: DataFrame, crowns: DataFrame, config: AnalysisConfig, keys: Sequence[str] = KEYS, planes: DataFrame | None = None) -> DataFrame:
    """(keys, voxel_size, sample, transparency, error) of every cloud with a live crown; -100 where no ray meets the hull.

    A cloud whose hull fails has no transparency but its error; the others have theirs.
    """
    k = [*keys, "voxel_size"]
    v = canopy(voxels, crowns, keys)
    failed = None
    if planes is None:
        outcomes = written(hull.voxel_hull(v, config.brightness_floor, keys, outcomes=True), "hull")
        planes = hull.plane_arrays(outcomes.where("error is null"), k)
        failed = kept(outcomes.where("error is not null").select(*k, "error"), "hull-errors")
    full = enrich.channel_limits(v, config.limits) if config.filter_non_photosynthetic_voxels else v
    extents = kept(v.groupBy(*k).agg(*[F.max(f"n{a}").alias(f"n{a}") for a in "xyz"]), "extents")
    aimed = rays.kept_rays(rays.rays(extents, config.ray_sample_count, config.heading), kept(planes, "planes"), keys)
    t = rays.transmission(aimed, rays.hits(aimed, full, keys), keys, config.initial_energy, config.required_hits, config.energy_threshold, config.ray_dissipation_factor)
    out = attach(extents.select(*k), t, k, "left")
    out = out.withColumn("error", F.lit(None).cast("string")) if failed is None else attach(out, failed, k, "left")
    ok = F.col("error").isNull()
    return out.select(*k, F.when(ok, F.lit(config.ray_sample_count).cast("long")).alias("sample"), F.when(ok, F.coalesce("transparency", F.lit(-100.0))).alias("transparency"), "error")


def features(points: DataFrame, config: AnalysisConfig = AnalysisConfig(), keys: Sequence[str] = KEYS, dbh: DataFrame | None = None) -> DataFrame:
    """One row per cloud and voxel size; analyses that are off, or fail for a cloud, are null there with a status.

    dbh: (keys, dbh, height) measured elsewhere.  The enriched table and the crowns are written once, for all
    the analyses that share them; every analysis is a row per cloud, and those are what is joined.
    """
    k = [*keys, "voxel_size"]
    v = written(enriched(points, config, keys), "enriched")
    out = v.select(*k).distinct()
    if dbh is not None:
        out = attach(out, dbh.select(*keys, F.col("dbh").alias("DBH"), F.col("height").alias("Height 3df")), keys, "left")
    if config.calculate_height or config.calculate_dimensions:
        box = enrich.bounding_box(v, keys)
        sizes = []
        if config.calculate_height:
            sizes.append(metrics.height_of(box).alias("Height"))
        if config.calculate_dimensions:
            sizes += [c.alias(n) for c, n in zip(metrics.dimensions_of(box), ("CWidth", "CLength"))]
        out = attach(out, box.select(*k, *sizes), k, "left")
    if config.calculate_live_canopy or config.calculate_transparency:
        c = kept(crown.live_crown(v, keys, window=config.smoothing_window), "crowns")
        if config.calculate_live_canopy:
            size = F.col("voxel_size")
            live = c.select(*k, (F.col("base") * size).alias("Live Canopy Base"), (F.col("top") * size).alias("Live Canopy Top"), "status")
            live.rows = c.rows
            out = attach(out, live, k, "left")
        if config.calculate_transparency:
            t = transparency(v, c, config, keys).withColumnsRenamed({"sample": "Transparency Sample", "transparency": "Transparency"})
            out = attach(out, t, k, "left")
            failed = F.concat(F.lit("hull: "), "error")
            if "status" in out.columns:  # what the crown says comes first
                failed = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.coalesce(failed, "status"))
            out = out.withColumn("status", failed).drop("error")
    return out.withColumnRenamed("voxel_size", "Voxel Size")
