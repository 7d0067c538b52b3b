"""DuckDB SQL that computes the same results as the queries, from the same views."""

from __future__ import annotations

from foliarc.sources.fixtures import VIEWS

ORACLES: dict[str, str] = {}
MIN, N = "0.5e0", 15000
POINT = "tree_id, l_orderkey, l_linenumber, l_partkey, l_suppkey"
K = "tree_id, voxel_size"
CELL = f"{K}, ix, iy, iz"
GOLDEN = "2.3999632297286535e0"

HSV = """SELECT *, CASE WHEN mx = mn THEN 0e0 WHEN mx = r1 THEN fmod(60e0 * ((g1 - b1) / (mx - mn)) + 360e0, 360e0)
    WHEN mx = g1 THEN 60e0 * ((b1 - r1) / (mx - mn)) + 120e0 ELSE 60e0 * ((r1 - g1) / (mx - mn)) + 240e0 END AS h,
  CASE WHEN mx = 0 THEN 0e0 ELSE (mx - mn) / mx END AS s, mx AS v
FROM (SELECT *, greatest(r1, g1, b1) AS mx, least(r1, g1, b1) AS mn FROM (SELECT *, red / 255e0 AS r1, green / 255e0 AS g1, blue / 255e0 AS b1 FROM cls))"""
SKY = "(h > 180 AND h < 250) OR s < 0.2e0 OR s > 0.8e0 OR v < 0.3e0"

CTES: dict[str, str] = {n: s.replace("STRING", "VARCHAR") for n, s in VIEWS.items()}
CTES |= {
    "cls": "SELECT *, dense_rank() OVER (PARTITION BY tree_id ORDER BY raw_class) - 1 AS cls FROM points",
    "hsv": HSV,
    "src": "SELECT * FROM cls",
    "idx": f"""SELECT *, {MIN} AS voxel_size, CAST(trunc((x - min(x) OVER w) * 2e0) AS BIGINT) AS ix, CAST(trunc((y - min(y) OVER w) * 2e0) AS BIGINT) AS iy,
  CAST(trunc((z - min(z) OVER w) * 2e0) AS BIGINT) AS iz FROM src WINDOW w AS (PARTITION BY tree_id)""",
    "band": f"SELECT {CELL}, " + ", ".join(f"[round(quantile_cont({c}, 0.05), 9), round(quantile_cont({c}, 0.95), 9)] AS q{c[0]}" for c in ("red", "green", "blue")) + " FROM idx GROUP BY ALL",
    "cells": f"""SELECT {CELL}, count(*) AS n, sum(red) AS sr, sum(green) AS sg, sum(blue) AS sb, count(*) FILTER (cls = 1) AS ground,
  arg_min(treeid, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS treeid
FROM idx JOIN band USING ({CELL}) WHERE red BETWEEN qr[1] AND qr[2] AND green BETWEEN qg[1] AND qg[2] AND blue BETWEEN qb[1] AND qb[2] GROUP BY ALL""",
    "vox": f"""SELECT {CELL}, n, sr / n / 255e0 AS r, sg / n / 255e0 AS g, sb / n / 255e0 AS b, least(n::DOUBLE / max(n) OVER (PARTITION BY tree_id), 1e0) AS density,
  CASE WHEN ground > n - ground THEN 2 ELSE 4 END AS cls, treeid FROM cells""",
    "bare": f"SELECT {CELL}, CASE WHEN cls = 2 THEN 0e0 ELSE r END AS r, CASE WHEN cls = 2 THEN 0e0 ELSE g END AS g, CASE WHEN cls = 2 THEN 0e0 ELSE b END AS b, density FROM vox",
    "box": f"""SELECT {K}, min(ix) AS x0, min(iy) AS y0, min(iz) AS z0, max(ix) AS x1, max(iy) AS y1, max(iz) AS z1,
  max(ix) - min(ix) + 1 AS nx, max(iy) - min(iy) + 1 AS ny, max(iz) - min(iz) + 1 AS nz FROM bare WHERE r <> 0 OR g <> 0 OR b <> 0 GROUP BY ALL""",
    "cut": f"""SELECT {K}, ix - x0 AS ix, iy - y0 AS iy, iz - z0 AS iz, r, g, b, density, nx, ny, nz FROM bare JOIN box USING ({K})
WHERE ix BETWEEN x0 AND x1 AND iy BETWEEN y0 AND y1 AND iz BETWEEN z0 AND z1""",
    "low": f"SELECT {K}, CASE WHEN count(*) FILTER (density > 0) < max(nx) * max(ny) * max(nz) THEN 0e0 ELSE min(density) END AS mn, max(density) AS mx FROM cut GROUP BY ALL",
    "enr": f"""SELECT {CELL}, r, g, b, density, nx, ny, nz, CASE WHEN 2e0 * g + r + b <> 0 THEN (2e0 * g - r - b) / (2e0 * g + r + b) ELSE 0e0 END AS gli,
  CASE WHEN mx = mn THEN 'NaN'::DOUBLE ELSE (density - mn) / (mx - mn) END AS density_norm, CASE WHEN g + r <> 0 THEN (g - r) / (g + r) ELSE 0e0 END AS ngrdi,
  ((1.4e0 * r - g) / CASE WHEN r + g + b = 0 THEN 1e0 ELSE r + g + b END + 1e0) / 2.4e0 AS exr FROM cut JOIN low USING ({K})""",
    "ext": f"SELECT {K}, max(nx) AS nx, max(ny) AS ny, max(nz) AS nz FROM enr GROUP BY ALL",
    "prof": f"""SELECT {K}, nz, z, coalesce(c, 0) AS c FROM (SELECT *, unnest(range(nz)) AS z FROM ext) e
LEFT JOIN (SELECT {K}, iz AS z, count(*) AS c FROM enr WHERE gli > 0 AND NOT isnan(gli) GROUP BY ALL) p USING ({K}, z)""",
    "lists": f"SELECT {K}, nz, list(c ORDER BY z) AS c FROM prof GROUP BY ALL",
    "smo": f"""SELECT {K}, nz, z, CASE WHEN z = 0 THEN 31 * c[1] + 9 * c[2] - 3 * c[3] - 5 * c[4] + 3 * c[5] WHEN z = 1 THEN 9 * c[1] + 13 * c[2] + 12 * c[3] + 6 * c[4] - 5 * c[5]
  WHEN z = nz - 2 THEN -5 * c[nz - 4] + 6 * c[nz - 3] + 12 * c[nz - 2] + 13 * c[nz - 1] + 9 * c[nz] WHEN z = nz - 1 THEN 3 * c[nz - 4] - 5 * c[nz - 3] - 3 * c[nz - 2] + 9 * c[nz - 1] + 31 * c[nz]
  ELSE -3 * c[z - 1] + 12 * c[z] + 17 * c[z + 1] + 12 * c[z + 2] - 3 * c[z + 3] END / 35e0 AS s
FROM (SELECT *, unnest(range(nz)) AS z FROM lists WHERE nz > 5)""",
    "der": f"SELECT * FROM (SELECT {K}, nz, z, lead(s) OVER (PARTITION BY {K} ORDER BY z) - s AS d FROM smo) WHERE d IS NOT NULL",
    "ends": f"SELECT {K}, max(d) AS rise, min(d) AS fall FROM der GROUP BY ALL",
    "crown": f"""SELECT {K}, min(z) FILTER (z >= 1 AND d > rise * 0.1e0) AS base_index, max(z) FILTER (z >= 1 AND d < fall * 0.1e0) + 1 AS top_index, any_value(rise) AS rise, any_value(fall) AS fall
FROM der JOIN ends USING ({K}) GROUP BY ALL""",
    "live": f"""SELECT {K}, any_value(base_index) AS base_index, any_value(top_index) AS top_index, quantile_cont(iz::DOUBLE, 0.05) FILTER (gli > 0 AND NOT isnan(gli) AND iz >= base_index) AS base,
  quantile_cont(iz::DOUBLE, 0.95) FILTER (gli > 0 AND NOT isnan(gli) AND iz <= top_index) AS top, any_value(nz) AS nz FROM enr LEFT JOIN crown USING ({K}) GROUP BY {K}""",
    "lim": "SELECT * FROM enr WHERE ngrdi > 0.005e0 AND NOT isnan(ngrdi) AND gli > 0 AND NOT isnan(gli)",
    "ray0": f"SELECT *, unnest(range({N})) AS ray_id, sqrt(3e0) * greatest(nx, ny, nz) / 2 AS radius FROM ext",
    "ray1": f"""SELECT *, nx / 2e0 + radius * (cos({GOLDEN} * ray_id) * sqrt(1 - zz * zz)) AS ox, ny / 2e0 + radius * (sin({GOLDEN} * ray_id) * sqrt(1 - zz * zz)) AS oy, nz / 2e0 + radius * zz AS oz
FROM (SELECT *, 1e0 + (-2e0) * (ray_id + 0.5e0) / {N} AS zz FROM ray0)""",
    "ray2": "SELECT *, ox - 2e0 * (ox - nx / 2e0) - ox AS vx, oy - 2e0 * (oy - ny / 2e0) - oy AS vy, oz - 2e0 * (oz - nz / 2e0) - oz AS vz FROM ray1",
    "ray": "SELECT *, vx / sqrt(vx * vx + vy * vy + vz * vz) AS dx, vy / sqrt(vx * vx + vy * vy + vz * vz) AS dy, vz / sqrt(vx * vx + vy * vy + vz * vz) AS dz FROM ray2",
    "pl": """SELECT *, p.a * dx + p.b * dy + p.c * dz AS sp, p.a * ox + p.b * oy + p.c * oz + p.d - 1e-12 AS side FROM (SELECT *, unnest([
  {'a': -1e0, 'b': 0e0, 'c': 0e0, 'd': 0e0}, {'a': 1e0, 'b': 0e0, 'c': 0e0, 'd': -(nx - 1)::DOUBLE}, {'a': 0e0, 'b': -1e0, 'c': 0e0, 'd': 0e0},
  {'a': 0e0, 'b': 1e0, 'c': 0e0, 'd': -(ny - 1)::DOUBLE}, {'a': 0e0, 'b': 0e0, 'c': -1e0, 'd': 0e0}, {'a': 0e0, 'b': 0e0, 'c': 1e0, 'd': -(nz - 1)::DOUBLE}]) AS p FROM ray)""",
    "kept": f"""SELECT {K}, ray_id FROM pl GROUP BY ALL HAVING NOT bool_or(sp = 0 AND side > 0)
  AND greatest(1, ceil(max(CASE WHEN sp < 0 THEN -side / sp END) / 0.5e0)) <= least(3000, floor(min(CASE WHEN sp > 0 THEN -side / sp END) / 0.5e0))""",
    "steps": f"""SELECT {K}, ray_id, k, floor(px)::BIGINT AS ix, floor(py)::BIGINT AS iy, floor(pz)::BIGINT AS iz FROM (
  SELECT *, round(ox + dx * (k * 0.5e0), 9) AS px, round(oy + dy * (k * 0.5e0), 9) AS py, round(oz + dz * (k * 0.5e0), 9) AS pz FROM (
    SELECT r.*, unnest(range(1, 301)) AS k FROM ray r SEMI JOIN kept USING ({K}, ray_id)))
WHERE px >= 0 AND px < nx AND py >= 0 AND py < ny AND pz >= 0 AND pz < nz""",
}


def sql(body: str, **over: str) -> str:
    """body with the named queries it builds on, in order; over replaces some of them."""
    import re

    ctes = CTES | over
    need: set[str] = set()

    def add(s: str) -> None:
        for n in ctes:
            if n not in need and re.search(rf"(FROM|JOIN)\s+{n}\b", s):
                need.add(n)
                add(ctes[n])

    add(body)
    order = [n for n in ctes if n in need]
    if "hsv" in need and "src" in need:
        order = [n for n in order if n not in ("src",)]
        order.insert(order.index("hsv") + 1, "src")
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in order) + "\n" + body if need else body


def six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def oracle(name: str, body: str, **over: str) -> None:
    ORACLES[name] = sql(body, **over)


oracle("class_dense_rank", f"SELECT {POINT}, raw_class, cls FROM cls")
oracle("hsv_convert", f"SELECT {POINT}, {six('h', 's', 'v')} FROM hsv")
oracle("mask_blue", f"SELECT {POINT}, red, green, blue FROM hsv WHERE NOT ({SKY})")
oracle("axis_permute", f"""SELECT {POINT}, 0::BIGINT AS axis, round(y, 6) AS x, round(z, 6) AS y, round(x, 6) AS z FROM points
UNION ALL SELECT {POINT}, 1, round(x, 6), round(z, 6), round(y, 6) FROM points UNION ALL SELECT {POINT}, 2, round(x, 6), round(y, 6), round(z, 6) FROM points""")
oracle("voxel_index", f"SELECT {POINT}, ix, iy, iz FROM idx")
oracle("voxelize_percentile", f"SELECT {CELL}, n, {six('sr', 'sg', 'sb')}, ground, treeid FROM cells")
oracle("voxelize_plain", f"""SELECT {CELL}, count(*) AS n, sum(red) AS sr, sum(green) AS sg, sum(blue) AS sb, count(*) FILTER (cls = 1) AS ground,
  arg_max(treeid, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS treeid FROM idx GROUP BY ALL""")
oracle("voxel_finalize", f"SELECT {CELL}, n, {six('r', 'g', 'b', 'density')}, cls::BIGINT AS cls, treeid FROM vox")
oracle("ground_removal", f"SELECT {CELL}, {six('r', 'g', 'b', 'density')} FROM bare")
oracle("density_mask", f"SELECT {CELL}, {six('density')} FROM vox WHERE density >= 0.25e0")
oracle("noise_floor", f"SELECT {CELL}, {six('r', 'g', 'b')} FROM vox WHERE r + g + b > 1.5e0")
oracle("channel_at_least", f"SELECT {CELL}, {six('density')} FROM vox WHERE density >= 0.5e0")
oracle("trim_bbox", f"SELECT {CELL}, nx, ny, nz, {six('r', 'density')} FROM cut")
oracle("gli", f"SELECT {CELL}, round(CASE WHEN 2e0 * g + r + b <> 0 THEN (2e0 * g - r - b) / (2e0 * g + r + b) ELSE 0e0 END, 6) AS gli FROM vox")
oracle("ngrdi", f"SELECT {CELL}, round(CASE WHEN g + r <> 0 THEN (g - r) / (g + r) ELSE 0e0 END, 6) AS ngrdi FROM vox")
oracle("exr", f"SELECT {CELL}, round(((1.4e0 * r - g) / CASE WHEN r + g + b = 0 THEN 1e0 ELSE r + g + b END + 1e0) / 2.4e0, 6) AS exr FROM vox")
oracle("density_norm", f"SELECT {CELL}, {six('density_norm')} FROM enr")
EPS = "1.1920928955078125e-7"
oracle("normalize_grid", f"""SELECT {CELL}, {six('r_part', 'g_part', 'b_part', 'rgri', 'bgri', 'luminosity')}, round(1e0 - (greatest(r_part, g_part, b_part) - least(r_part, g_part, b_part)), 6) AS balance
FROM (SELECT *, CASE WHEN s <> 0 THEN r / s ELSE 0e0 END AS r_part, CASE WHEN s <> 0 THEN g / s ELSE 0e0 END AS g_part, CASE WHEN s <> 0 THEN b / s ELSE 0e0 END AS b_part,
  (r - g) / (r + g + {EPS}) AS rgri, (b - g) / (b + g + {EPS}) AS bgri, s / 3e0 AS luminosity FROM (SELECT *, r + g + b AS s FROM vox))""")
oracle("dense_share", f"SELECT {K}, round(avg(CASE WHEN density > 0.5e0 THEN 1e0 ELSE 0e0 END) * 100e0, 6) AS dense_percent FROM vox WHERE density > 0 GROUP BY ALL")
CASES = {"max": "gli < 0.1e0", "max_inclusive": "gli >= 0.1e0", "min": "ngrdi > 0.005e0", "min_inclusive": "ngrdi <= 0.005e0", "both": "exr > 0.35e0 AND exr < 0.5e0", "both_inclusive": "(exr <= 0.35e0 OR exr >= 0.5e0)", "mask_na": "NOT isnan(density_norm)"}
ORACLES["channel_limits"] = sql(" UNION ALL ".join([f"SELECT {CELL}, '{n}' AS \"case\" FROM enr WHERE {c}" for n, c in CASES.items()] + [f"SELECT {CELL}, 'production' FROM lim"]))
oracle("tree_height", f"SELECT {K}, round((nz - 1) * voxel_size, 6) AS height FROM box")
oracle("canopy_dimensions", f"SELECT {K}, round(greatest(nx - 1, ny - 1) * voxel_size, 6) AS width, round(least(nx - 1, ny - 1) * voxel_size, 6) AS length FROM box")
oracle("z_histogram", f"SELECT {K}, nz, z, c FROM prof")
oracle("savgol_profile", f"SELECT {K}, z, {six('s')} FROM smo")
oracle("profile_derivative", f"SELECT {K}, base_index, top_index, {six('rise', 'fall')} FROM ext LEFT JOIN crown USING ({K})")
STATUS = "CASE WHEN nz <= 5 THEN 'too_few_layers' WHEN base_index IS NULL THEN 'no_base' WHEN top_index IS NULL THEN 'no_top' WHEN base IS NULL OR top IS NULL THEN 'no_voxels' ELSE 'ok' END"
oracle("live_crown", f"SELECT {K}, base_index, top_index, CASE WHEN status = 'ok' THEN round(base, 6) END AS base, CASE WHEN status = 'ok' THEN round(top, 6) END AS top, status FROM (SELECT *, {STATUS} AS status FROM live)")

CAMBOX = """SELECT tree_id, quantile_cont(x, 0.05) AS lx, quantile_cont(x, 0.95) AS hx, quantile_cont(y, 0.05) AS ly, quantile_cont(y, 0.95) AS hy,
  quantile_cont(z, 0.05) AS lz, quantile_cont(z, 0.95) AS hz FROM cameras GROUP BY ALL"""
PADDED = f"SELECT tree_id, {', '.join(f'l{a} - 0.15e0 * (h{a} - l{a}) AS lo_{a}, h{a} + 0.15e0 * (h{a} - l{a}) AS hi_{a}' for a in 'xyz')} FROM camq"
CTES |= {"camq": CAMBOX, "camb": PADDED, "camm": f"SELECT tree_id, {', '.join(f'min({a}) AS lo_{a}, max({a}) AS hi_{a}' for a in 'xyz')} FROM cameras GROUP BY ALL"}
oracle("camera_percentile_filter", f"SELECT tree_id, cam_id, {six('x', 'y', 'z')} FROM cameras JOIN camq USING (tree_id) WHERE x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz")
oracle("camera_bbox", f"SELECT tree_id, {six(*[f'{n}_{a}' for a in 'xyz' for n in ('lo', 'hi')])} FROM camb")
oracle("box_trim", f"""SELECT chunk_id AS tree_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, {six('x', 'y', 'z')} FROM tiepoints JOIN camb ON chunk_id = tree_id
WHERE x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z""")
oracle("max_pairwise_distance", "SELECT a.tree_id, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS max_distance FROM cameras a JOIN cameras b ON a.tree_id = b.tree_id GROUP BY ALL")
oracle("halfspace_clip", f"SELECT {POINT}, {six('x', 'y', 'z')} FROM points JOIN camm USING (tree_id) WHERE {' AND '.join(f'-{a} + lo_{a} <= 0.1e0 AND {a} - hi_{a} <= 0.1e0' for a in 'xyz')}")
RAY8 = ", ".join(f"round({c}, 8) AS {c}" for c in ("ox", "oy", "oz", "dx", "dy", "dz"))
oracle("fibonacci_rays", f"SELECT {K}, ray_id, {RAY8} FROM ray")
U = {a: f"(((ray_id * 1103515 + 12345 + {j * 7919}) % 2147483) * 48271 + {j * 104729}) % 2147483 / 2147483e0" for j, a in enumerate("xyz")}
oracle("hashed_rays", f"SELECT {K}, ray_id, round(vx / l, 8) AS dx, round(vy / l, 8) AS dy, round(vz / l, 8) AS dz FROM (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS l FROM ray2)",
       ray2="SELECT *, " + ", ".join(f"{U[a]} * n{a} - o{a} AS v{a}" for a in "xyz") + " FROM ray1")
NINE = {c: c if c[0] == "o" else f"round({c}, 9)" for c in ("ox", "oy", "oz", "dx", "dy", "dz")}
oracle("ray_lines", f"SELECT {K}, ray_id, printf('%.6f %.6f %.6f %d %d %d', {NINE['ox']}, {NINE['oy']}, {NINE['oz']}, " + ", ".join(f"trunc(({NINE[c]} + 1) / 2 * 255)::BIGINT" for c in ("dx", "dy", "dz")) + ") AS line FROM ray")
CTES["hit"] = f"SELECT {K}, ray_id, k, ix, iy, iz FROM steps SEMI JOIN (SELECT * FROM lim WHERE density_norm > 0 AND NOT isnan(density_norm)) USING ({CELL})"
oracle("ray_march_hits", f"SELECT {K}, ray_id, k, ix, iy, iz FROM steps SEMI JOIN (SELECT * FROM enr WHERE density_norm > 0 AND NOT isnan(density_norm)) USING ({CELL})")
oracle("ray_voxel_support", f"SELECT {CELL}, count(*) AS support FROM hit GROUP BY ALL")
oracle("transparency_boxhull", f"""SELECT {K}, count(*) AS valid, count(*) FILTER (0.5e0 ** coalesce(h, 0) > 0.1e0) AS unobstructed, round(100e0 * count(*) FILTER (0.5e0 ** coalesce(h, 0) > 0.1e0) / count(*), 6) AS transparency
FROM kept LEFT JOIN (SELECT {K}, ray_id, count(*) AS h FROM hit SEMI JOIN (SELECT {CELL} FROM hit GROUP BY ALL HAVING count(*) >= 2) USING ({CELL}) GROUP BY ALL) USING ({K}, ray_id) GROUP BY ALL""")

oracle("sliding_window_chunks", """SELECT chunk_id, w AS "window", idx - w * 70 AS position, event_id FROM (
  SELECT *, unnest(range(CASE WHEN n <= 100 THEN 1 ELSE (n - 100) // 70 + 1 END)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n FROM frames))
WHERE idx >= w * 70 AND idx < w * 70 + 100""")
oracle("match_batches", """SELECT chunk_id, b AS batch, greatest(0, b * size - o) AS start, least(n, b * size + size) AS stop FROM (
  SELECT *, greatest(floor(size * 0.3e0)::BIGINT, 25) AS o, unnest(range((n + size - 1) // size)) AS b FROM (SELECT chunk_id, count(*) AS n, least(150, count(*)) AS size FROM frames GROUP BY ALL))""")
RUNS = """SELECT chunk_id, event_id, idx, run, row_number() OVER (PARTITION BY chunk_id, run ORDER BY idx) - 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY idx) - row_number() OVER (PARTITION BY chunk_id, aligned ORDER BY idx) AS run FROM frames) WHERE NOT aligned"""
CTES["runs"] = RUNS
oracle("unaligned_runs", "SELECT chunk_id, event_id, run, pos // 2 AS batch FROM runs")
oracle("following_unaligned", "SELECT a.chunk_id, a.idx AS leader, b.idx AS member FROM runs a JOIN runs b ON a.chunk_id = b.chunk_id AND a.run = b.run AND b.pos BETWEEN a.pos AND a.pos + 2")
oracle("camera_counts", "SELECT chunk_id, count(*) AS cameras, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT aligned) AS unaligned FROM frames GROUP BY ALL")
oracle("frame_masks", "SELECT event_id, name, CASE WHEN event_id % 3 = 0 THEN 'masks/' || replace(name, '.png', '_mask.png') END AS mask FROM frames")
oracle("chosen_chunk", """SELECT project, coalesce(max(label) FILTER (label = 'Merged Chunk'), arg_min(label, idx)) AS label FROM (
  SELECT n_regionkey AS project, n_nationkey AS idx, CASE WHEN n_nationkey % 10 = 3 THEN 'Merged Chunk' ELSE n_name END AS label FROM nation) GROUP BY ALL""")
oracle("numeric_sort_key", "SELECT event_id, event_id AS number, 0::BIGINT AS none FROM frames")
ADAPT = "greatest(0, (1 - w) * (mean + 0.5e0 * (mean - std)) + w * ((0.5e0 + mean) / 2e0))"
CTES |= {"qual0": "SELECT chunk_id, avg(quality) AS mean, stddev_pop(quality) AS std FROM frames GROUP BY ALL", "qual": "SELECT *, CASE WHEN mean + std <> 0 THEN mean / (mean + std) ELSE 0e0 END AS w FROM qual0"}
oracle("quality_threshold", f"SELECT chunk_id, {six('mean', 'std')}, round({ADAPT}, 6) AS threshold FROM qual")
oracle("low_quality_filter", f"SELECT chunk_id, event_id, {six('quality')} FROM frames JOIN qual USING (chunk_id) WHERE quality < {ADAPT}")
oracle("image_scale_factor", """SELECT chunk_id, round(ratio, 6) AS ratio, CASE WHEN ratio > 1 THEN (2e0 ** round_even(log2(ratio), 0))::BIGINT WHEN ratio = 1 THEN 1 ELSE 0 END AS scale FROM (
  SELECT chunk_id, least(avg(width) / 1000e0, avg(height) / 700e0) AS ratio FROM frames GROUP BY ALL)""")
oracle("error_filter_step", """SELECT chunk_id, count(*) AS n, round(max(err_accuracy), 6) AS err_accuracy, round(max(err_reprojection), 6) AS err_reprojection, round(max(err_uncertainty), 6) AS err_uncertainty
FROM (SELECT *, max(err_accuracy) OVER w AS a, max(err_reprojection) OVER w AS r, max(err_uncertainty) OVER w AS u FROM tiepoints WHERE valid WINDOW w AS (PARTITION BY chunk_id))
WHERE err_accuracy <= greatest(a * 0.75e0, 48) AND err_reprojection <= greatest(r * 0.75e0, 1) AND err_uncertainty <= greatest(u * 0.75e0, 100) GROUP BY ALL""")
CTES["paths"] = "SELECT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages"
CTES["dirs"] = r"SELECT DISTINCT unnest([path, regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '/.*$', '')]) AS path FROM paths"
oracle("leaf_directories", r"SELECT path FROM dirs WHERE path NOT IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM dirs WHERE contains(path, '/')) AND NOT contains(path, 'en/1')")
oracle("file_patterns", "SELECT DISTINCT path FROM paths WHERE path ILIKE '%.html' OR path ILIKE 'm.%/de/%'")
oracle("file_pairs", r"""SELECT path, 'data/output/' || regexp_replace(rel, '\.[^./]*$', '') || '/' || regexp_extract(rel, '[^/]*$') AS output FROM (
  SELECT DISTINCT 'data/input/' || path AS path, path AS rel FROM paths WHERE ends_with(path, '.html') AND NOT contains('data/input/' || path, '/fr/'))""")
oracle("subfolders", "SELECT DISTINCT 'root/' || split_part(path, '/', 1) AS path FROM paths WHERE contains(path, '/') AND split_part(path, '/', 1) <> ''")
ORACLES["stale_outputs"] = "SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS hash, CASE WHEN doc_id % 3 = 2 THEN 'x' END AS made_from FROM documents WHERE doc_id % 3 <> 1"
ORACLES["first_record"] = "SELECT CAST(o_custkey AS VARCHAR) AS path, min(o_orderkey)::DOUBLE AS height, 25e0 AS dbh FROM orders GROUP BY ALL"
ORACLES["flat_folder_name"] = r"""SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]', '_', 'g') AS name FROM pages"""
ORACLES["elapsed_format"] = """SELECT event_id, concat_ws(' ', CASE WHEN h > 0 THEN h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END END,
  CASE WHEN m > 0 THEN m || ' minute' || CASE WHEN m > 1 THEN 's' ELSE '' END END, s || ' second' || CASE WHEN s > 1 THEN 's' ELSE '' END) AS elapsed
FROM (SELECT event_id, t // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s FROM (SELECT event_id, event_id * 7 % 20000 AS t FROM events))"""
ORACLES["without_characters"] = "SELECT page_id, replace(replace(replace(url, 'https', '-'), '/', '-'), '.', '-') AS text FROM pages"
oracle("site_and_tree", "SELECT path, split_part(path, '/', 3) AS site, split_part(path, '/', 4) AS tree FROM tree_results")
oracle("requirements_consolidate", r"""SELECT package, arg_max(line, (major, minor, patch, line)) AS line FROM (
  SELECT package, line, v[1] AS major, v[2] AS minor, v[3] AS patch FROM (SELECT *, list_transform(string_split(regexp_extract(line, '[=~]=(.*)', 1), '.'), lambda x: x::INT) AS v FROM requirements WHERE line NOT LIKE '#%'))
GROUP BY package, major""")
oracle("results_union", "SELECT path, CASE WHEN dbh >= 3 THEN round(height, 6) END AS height, round(dbh, 6) AS dbh FROM tree_results")
oracle("results_clean", """SELECT round(height, 3) AS "Height", round(dbh, 3) AS "DBH", replace(split_part(path, '/', 3), 'site', '') AS "Site", replace(split_part(path, '/', 4), 'tree', '') AS "Tree", round(height, 3) AS "Cwidth" FROM tree_results""")
ORACLES["json_records"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL"
ORACLES["content_hash"] = "SELECT doc_id, md5(text) AS hash FROM documents"
ORACLES["project_hash"] = "SELECT sha256(string_agg(h, '' ORDER BY g)) AS version FROM (SELECT substr(md5(p), 1, 3) AS g, sha256(string_agg(p || h, '' ORDER BY p, h)) AS h FROM (SELECT CAST(doc_id AS VARCHAR) AS p, sha256(text) AS h FROM documents) GROUP BY 1)"
ORACLES["pairs_needed"] = "SELECT n_nationkey, ceil(ln(n * n / (-2 * ln(0.99e0))) / ln(1024e0))::BIGINT AS pairs FROM (SELECT n_nationkey, (n_nationkey + 2) * 1000e0 AS n FROM nation)"
ORACLES["brightness_filter"] = "SELECT vec_id, round(l, 5) AS length FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings) WHERE l > 0.9e0"
oracle("voxel_brightness", f"SELECT {CELL}, round(s, 6) AS brightness FROM (SELECT *, sqrt(r * r + g * g + b * b + density * density) AS s FROM vox) WHERE s > 1")
oracle("voxel_csv", "SELECT tree_id, ix AS x, iy AS y, iz AS z, round(r * 255, 6) AS r, round(g * 255, 6) AS g, round(b * 255, 6) AS b FROM vox WHERE r <> 0 OR g <> 0 OR b <> 0")
oracle("cell_colours", f"""SELECT {CELL}, {six('r', 'g', 'b')} FROM vox WHERE ix = iy
UNION ALL SELECT {K}, -1, iy, iz, 0e0, 0e0, 0e0 FROM vox WHERE ix = 0 AND iy = 1""")
oracle("recolour", f"""SELECT {CELL}, round(CASE WHEN ix = iy THEN 1e0 - r ELSE r END, 6) AS r, round(CASE WHEN ix = iy THEN 0.5e0 ELSE g END, 6) AS g,
  round(CASE WHEN ix = iy THEN 1e0 ELSE b END, 6) AS b, round(density, 6) AS density FROM vox
UNION ALL SELECT {K}, -1, iy, iz, {six('r', 'g', 'b')}, NULL FROM vox WHERE ix = 0 AND iy = 1""")
oracle("camera_projection", """SELECT tree_id, cam_id, round((10e0 - 2e0 * y) / 4e0, 6) AS x, round((2e0 * x - 5e0) / 4e0, 6) AS y, round((y + 2e0 * z + 1e0) / 4e0, 6) AS z
FROM cameras WHERE cam_id % 10 <> 0""")
ORACLES["word_pair_names"] = "SELECT doc_id, " + " || '-' || ".join(f"""['calm', 'dry', 'old', 'red'][1 + x{i} // 4] || '-' || ['ash', 'elm', 'fir', 'oak'][1 + x{i} % 4]""" for i in (1, 2, 3)) + " AS name FROM (SELECT doc_id, " + ", ".join(f"strpos('0123456789abcdef', substr(md5(text), {i}, 1)) - 1 AS x{i}" for i in (1, 2, 3)) + " FROM documents)"
ORACLES["cloud_pairs"] = """SELECT folder, CASE WHEN a THEN folder || '/pointcloud.las' END AS cloud, CASE WHEN b THEN folder || '/camera_positions.las' END AS cameras,
  CASE WHEN NOT b THEN 'no_cameras' WHEN NOT a THEN 'no_cloud' ELSE 'ok' END AS status
FROM (SELECT 'data/' || c_custkey // 2 AS folder, bool_or(c_custkey % 5 <> 0 AND c_custkey % 2 = 0) AS a, bool_or(c_custkey % 5 <> 0 AND c_custkey % 2 = 1) AS b FROM customer GROUP BY 1) WHERE a OR b"""
oracle("layer", f"SELECT {CELL}, {', '.join(f'round(nullif({c}, 0), 6) AS {c}' for c in 'rgb')} FROM bare WHERE iz = 2")
oracle("box_mean_mask", f"""SELECT {CELL}, round(m, 6) AS mean FROM (SELECT {K}, ix + a AS ix, iy + b2 AS iy, iz + c AS iz, sum((r + g + b) / 3e0) / 27e0 AS m
  FROM cut, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b2), (SELECT unnest([-1, 0, 1]) AS c)
  WHERE ix + a >= 0 AND ix + a < nx AND iy + b2 >= 0 AND iy + b2 < ny AND iz + c >= 0 AND iz + c < nz GROUP BY ALL) WHERE round(m, 9) > 0.2e0""")
oracle("bottom_outlier_trim", f"""SELECT {K}, ix, iy, iz - cut_at AS iz, {six('r', 'g', 'b')} FROM cut JOIN (
  SELECT {K}, coalesce(min(CASE WHEN n >= 10 THEN greatest(iz - 1, 0) END), 0) AS cut_at FROM (
    SELECT {K}, iz, sum(c) OVER (PARTITION BY {K} ORDER BY iz) AS n FROM (SELECT {K}, iz, count(*) AS c FROM cut WHERE r > 0 OR g > 0 OR b > 0 GROUP BY ALL)) GROUP BY ALL) USING ({K}) WHERE iz >= cut_at""")
oracle("features_core", f"""SELECT tree_id, round(voxel_size, 3) AS voxel_size, round((b.nz - 1) * voxel_size, 3) AS height, round(greatest(b.nx - 1, b.ny - 1) * voxel_size, 3) AS cwidth,
  round(least(b.nx - 1, b.ny - 1) * voxel_size, 3) AS clength, CASE WHEN status = 'ok' THEN round(base * voxel_size, 3) END AS live_canopy_base,
  CASE WHEN status = 'ok' THEN round(top * voxel_size, 3) END AS live_canopy_top, status FROM box b JOIN (SELECT *, {STATUS} AS status FROM live) l USING ({K})""",
       src=f"SELECT * FROM hsv WHERE NOT ({SKY})")
