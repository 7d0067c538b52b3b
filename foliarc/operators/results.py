"""Collation of per-tree results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliarc.functions.text import capitalised, site_and_tree


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns matched by name; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def named(results: DataFrame, path: str = "path") -> DataFrame:
    """Add Site and Tree from the path."""
    site, tree = site_and_tree(F.col(path))
    return results.withColumns({"Site": site, "Tree": tree})


def clean(results: DataFrame) -> DataFrame:
    """Strip the words tree and site from labels, drop Input and columns with DBH and more in their name, capitalise headings."""
    r = results.withColumns({"Tree": F.regexp_replace("Tree", "(?i)tree", ""), "Site": F.regexp_replace("Site", "(?i)site", "")})
    r = r.drop("Input", *[c for c in r.columns if "dbh" in c.lower() and not c.lower().endswith("dbh")])
    return r.toDF(*[capitalised(c) for c in r.columns])


def rounded(results: DataFrame, digits: int = 3, half_even: bool = False) -> DataFrame:
    """Round every fractional column."""
    f = F.bround if half_even else F.round
    return results.withColumns({c: f(F.col(c), digits) for c, t in results.dtypes if t in ("double", "float")})


def write_results(results: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One CSV table with a header, in a folder per value of ``by``.

    With ``by`` only the folders of these results are replaced, whatever else lies below path; without, path
    is the table and is replaced.
    """
    if by:
        results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).option("header", True).csv(path)
    else:
        results.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table as ``write_results`` wrote it, folders' values included, with the given schema."""
    r = spark.read.option("header", True).schema(schema).csv(path)
    return r.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All CSV results below a folder, with path; folders with debug in their name are skipped."""
    r = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    r = r.withColumn("path", F.col("_metadata.file_path"))
    return r.where(~F.regexp_replace("path", r"[^/]*$", "").contains("debug"))


def json_records(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of JSON objects held in a column in place of it; rows without any of them, malformed ones too, are left out."""
    r = rows.withColumn("_json", F.from_json(column, schema))
    fields = r.select("_json.*").columns
    return r.where(F.coalesce(*[F.col(f"_json.{f}").cast("string") for f in fields]).isNotNull()).drop(column).select(*[c for c in rows.columns if c != column], "_json.*")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file; malformed and empty files are skipped."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
