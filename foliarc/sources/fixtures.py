"""Views over the supplied tables that play the part of clouds, cameras, frames and results.

``VIEWS`` is SQL that Spark and DuckDB read alike, but for the name of the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {"points": "lineitem", "cameras": "orders", "frames": "events", "tiepoints": "lineitem", "tree_results": "nation", "requirements": "part"}
VIEWS = {
    "points": """SELECT l_suppkey % 4 AS tree_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       mod(l_extendedprice, 4.0e0) AS x, mod(l_extendedprice / 7.0e0, 4.0e0) AS y, mod(l_extendedprice / 13.0e0, 5.0e0) + l_discount AS z,
       CAST((l_partkey*7 + l_linenumber*31) % 256 AS DOUBLE) AS red, CAST((l_partkey*13 + l_orderkey*3) % 256 AS DOUBLE) AS green,
       CAST((l_orderkey*11 + l_suppkey) % 256 AS DOUBLE) AS blue,
       CASE WHEN l_returnflag = 'R' AND mod(l_extendedprice / 13.0e0, 5.0e0) < 1.0e0 THEN 2 ELSE 0 END AS raw_class, l_partkey % 10 AS treeid
FROM lineitem""",
    "cameras": """SELECT o_custkey % 4 AS tree_id, o_orderkey AS cam_id, 1.0e0 + mod(o_totalprice, 2.0e0) AS x,
       1.0e0 + mod(o_totalprice / 7.0e0, 2.0e0) AS y, 1.0e0 + mod(o_totalprice / 13.0e0, 3.0e0) AS z
FROM orders""",
    "frames": """SELECT user_id % 4 AS chunk_id, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS idx,
       concat('frame_', lpad(CAST(event_id AS STRING), 6, '0'), '.png') AS name,
       CASE WHEN event_type = 'error' THEN false ELSE true END AS aligned, CASE WHEN event_type = 'signup' THEN false ELSE true END AS enabled,
       value / 100.0e0 AS quality, 1920 + (event_id % 3) * 1920 AS width, 1080 + (event_id % 3) * 1080 AS height
FROM events""",
    "tiepoints": """SELECT l_suppkey % 4 AS chunk_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, mod(l_extendedprice, 4.0e0) AS x,
       mod(l_extendedprice / 7.0e0, 4.0e0) AS y, mod(l_extendedprice / 13.0e0, 5.0e0) AS z, l_quantity * 4.0e0 AS err_accuracy,
       l_discount * 40.0e0 AS err_reprojection, l_tax * 5000.0e0 AS err_uncertainty, l_linestatus = 'O' AS valid
FROM lineitem""",
    "tree_results": """SELECT concat('data/output/site', CAST(n_regionkey AS STRING), '/tree', CAST(n_nationkey AS STRING), '.csv') AS path,
       n_nationkey * 0.1e0 AS height, n_regionkey * 1.5e0 AS dbh
FROM nation""",
    "requirements": """SELECT replace(lower(p_brand), '#', '-') AS package, CASE WHEN p_partkey % 50 = 0 THEN concat('# ', p_brand) ELSE
       concat(replace(lower(p_brand), '#', '-'), CASE WHEN p_partkey % 3 = 0 THEN '~=' ELSE '==' END, CAST(p_size % 5 AS STRING), '.', CAST(p_size AS STRING), '.', CAST(p_partkey % 12 AS STRING)) END AS line
FROM part""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder; points get ord, their order within the cloud."""
    base = TABLES[name]
    df = spark.sql(VIEWS[name].replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: table(spark, sf_dir, base)})
    if name == "points":
        df = df.withColumn("ord", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return df
