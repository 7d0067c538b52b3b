"""Live crown: where the vertical profile of green voxels begins and ends."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.operators.voxel import KEYS


def smoothing_matrix(window: int, order: int = 2) -> list[list[float]]:
    """Rows by output position in a block of ``window`` values: weights of the least-squares polynomial's value there."""
    x = np.vander(np.arange(window, dtype=float), order + 1)
    m = x @ np.linalg.pinv(x)
    if window == 5 and order == 2:
        m = np.round(m * 35) / 35
    return m.tolist()


def short_matrix(layers: int, window: int, order: int = 2) -> list[list[float]] | None:
    """Smoothing of a profile of no more layers than the window, as a matrix: the window shrinks to the even number below the layers.

    Ends are values of the polynomials fitted to the first and the last window; between them a window's
    polynomial is read halfway, since an even window has no middle.  None where the window gets too small.
    """
    w = layers - 1 if layers % 2 else layers - 2
    if w <= order or layers > window:
        return None
    fit = np.linalg.pinv(np.vander(np.arange(w, dtype=float), order + 1))
    out = np.zeros((layers, layers))
    for z in range(layers):
        start, at = (0, z) if z < w // 2 else (layers - w, z - layers + w) if z >= layers - w // 2 else (z - w // 2 + 1, w / 2 - 0.5)
        out[z, start : start + w] = np.vander([at], order + 1)[0] @ fit
    return out.tolist()


def profile(voxels: DataFrame, keys: Sequence[str] = KEYS, channel: str = "gli", threshold: float = 0.0) -> DataFrame:
    """(keys, voxel_size, nz, counts): voxels above the threshold in every layer, empty layers being 0; voxels need nz."""
    k = [*keys, "voxel_size"]
    some = (F.col(channel) > threshold) & ~F.isnan(channel)
    per = voxels.groupBy(*k, "nz", "iz").agg(F.count_if(some).alias("c"))
    m = per.groupBy(*k, "nz").agg(F.map_from_entries(F.collect_list(F.struct("iz", "c"))).alias("m"))
    return m.select(*k, "nz", F.transform(F.sequence(F.lit(0).cast("long"), F.col("nz") - 1), lambda z: F.coalesce(F.col("m")[z], F.lit(0))).alias("counts"))


def smoothed(prof: DataFrame, window: int = 5) -> DataFrame:
    """Add smooth, the Savitzky-Golay values of order 2 with fitted ends; see ``short_matrix`` for profiles no longer than the window, null where that has none."""
    window += 1 - window % 2
    exact = window == 5
    rows = smoothing_matrix(window)
    if exact:
        rows = [[round(v * 35) for v in r] for r in rows]
    w = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])
    start = lambda z: F.greatest(F.lit(0).cast("long"), F.least(z - window // 2, F.col("nz") - window))

    def at(z):
        total = F.lit(0.0)
        for j in range(window):
            total = total + F.element_at(F.element_at(F.col("w"), (z - start(z) + 1).cast("int")), j + 1) * F.element_at("counts", (start(z) + j + 1).cast("int"))
        return total / 35.0 if exact else total

    p = prof.withColumn("w", w)
    smooth = F.when(F.col("nz") > window, F.transform(F.sequence(F.lit(0).cast("long"), F.col("nz") - 1), at))
    for layers in range(1, window + 1):
        if m := short_matrix(layers, window):
            rows = [sum((F.element_at("counts", j + 1) * v for j, v in enumerate(r)), F.lit(0.0)) for r in m]
            smooth = smooth.when(F.col("nz") == layers, F.array(*rows))
    return p.withColumn("smooth", smooth).drop("w")


def slopes(prof: DataFrame) -> DataFrame:
    """Add slope, the differences of smooth, and its limits: a tenth of the largest and of the smallest."""
    d = F.zip_with(F.slice("smooth", 1, F.size("smooth") - 1), F.slice("smooth", 2, F.size("smooth") - 1), lambda a, b: b - a)
    return prof.withColumn("slope", F.when(F.col("smooth").isNotNull(), d))


def crown_range(prof: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Add base_index and top_index: first layer (from 1) that rises, and the one after the last that falls, by a fraction of the extreme slope."""
    i = F.sequence(F.lit(1).cast("long"), F.size("slope").cast("long") - 1)
    rise = F.filter(i, lambda z: F.element_at("slope", (z + 1).cast("int")) > F.array_max("slope") * fraction)
    fall = F.filter(i, lambda z: F.element_at("slope", (z + 1).cast("int")) < F.array_min("slope") * fraction)
    ok = F.col("slope").isNotNull() & (F.size("slope") > 1)
    return prof.withColumns({"base_index": F.when(ok, F.array_min(rise)), "top_index": F.when(ok, F.array_max(fall) + 1)})


def live_crown(voxels: DataFrame, keys: Sequence[str] = KEYS, channel: str = "gli", threshold: float = 0.0, base_percentile: float = 5, top_percentile: float = 95, window: int = 5, fraction: float = 0.1) -> DataFrame:
    """Per cloud base and top of the live crown in voxels and a status: ok, too_few_layers, no_base, no_top or no_voxels.

    The percentiles are over the layers of voxels at or above the base index, and at or below the top index.
    """
    k = [*keys, "voxel_size"]
    p = crown_range(slopes(smoothed(profile(voxels, keys, channel, threshold), window)), fraction)
    rows = p.select(*k, "base_index", "top_index", F.posexplode("counts").alias("z", "c"))
    low = F.percentile("z", base_percentile / 100.0, F.when(F.col("z") >= F.col("base_index"), F.col("c")).otherwise(0))
    high = F.percentile("z", top_percentile / 100.0, F.when(F.col("z") <= F.col("top_index"), F.col("c")).otherwise(0))
    r = rows.groupBy(*k).agg(low.alias("base"), high.alias("top"))
    p = p.join(r, k)
    status = F.when(F.col("slope").isNull(), "too_few_layers").when(F.col("base_index").isNull(), "no_base").when(F.col("top_index").isNull(), "no_top").when(F.col("base").isNull() | F.col("top").isNull(), "no_voxels").otherwise("ok")
    ok = status == "ok"
    return p.select(*k, "nz", "base_index", "top_index", F.when(ok, F.col("base")).alias("base"), F.when(ok, F.col("top")).alias("top"), status.alias("status"))
