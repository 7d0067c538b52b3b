"""Listings of paths as tables: discovery, skipping and hierarchy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliarc.functions.charset import PAGES, guessed
from foliarc.shared import prepare


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modified, length) of all files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.col("modificationTime").alias("modified"), "length")


def matching(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Distinct paths that fit any of the shell patterns, whatever their case."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.lower("path").rlike("^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "/_-" else "\\" + c) for c in p.lower()) + "$")
    return files.where(fits).select("path").distinct()


def plain(path: Column) -> Column:
    """A listed path as one of the local file system, where it is that; other schemes stay."""
    return F.regexp_replace(path, "^file:/+", "/")


def dbh_results(spark: SparkSession, inputs: DataFrame, folders: Sequence[str], base: str) -> DataFrame:
    """(file, dbh in cm, height) measured for inputs (file) by an external program, whose results lie beside them.

    The result of base/a/b.las is b_dbh_and_heights.txt in a, a/b or a/b/b.las below any of the folders, the
    first that there is in that order; its first line counts.
    """
    name = F.regexp_extract("file", "[^/]*$", 0)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    within = F.regexp_replace(F.when(F.startswith("file", F.lit(f"{base}/")), F.substring("file", len(base) + 2, 1 << 30)).otherwise(F.col("file")), "[^/]*$", "")
    text = F.concat(stem, F.lit("_dbh_and_heights.txt"))
    places = [F.concat(F.lit(f.rstrip("/") + "/"), within, *below, text) for f in folders for below in ([], [stem, F.lit("/")], [stem, F.lit("/"), name, F.lit("/")])]
    wanted = inputs.select("file", F.posexplode(F.array(*places)).alias("nth", "path"))
    there = None
    for f in folders:
        some = list_files(spark, f, "*_dbh_and_heights.txt").select(plain(F.col("path")).alias("path"), F.col("path").alias("uri"))
        there = some if there is None else there.union(some)
    found = wanted.join(there, "path").groupBy("file").agg(F.min_by("path", "nth").alias("path"))
    lines = decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_dbh_and_heights.txt").load(list(folders)).select(plain(F.col("path")).alias("path"), "content"))
    lines = lines.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "value")).where(F.trim("value") != "")
    return found.join(first_record(lines), "path").select("file", "dbh", "height")


def analysed(files: DataFrame, extension: str = ".las", skip: Sequence[str] = (), out: str = "data/output", base: str = "data/input", limit: int = -1) -> DataFrame:
    """Paths with an extension (case counts) and without any of the skipped parts, with the folder their results go to; the first limit by path if that is above 0."""
    f = files.where(F.col("path").endswith(extension))
    for s in skip:
        f = f.where(~F.col("path").contains(s))
    rel = F.when(F.startswith("path", F.lit(f"{base}/")), F.substring("path", len(base) + 2, 1 << 30)).otherwise(F.col("path"))
    stem = F.regexp_replace(rel, r"\.[^./]*$", "")
    f = f.select("path", F.concat(F.lit(f"{out}/"), stem, F.lit("/"), F.regexp_extract(rel, "[^/]*$", 0)).alias("output"))
    return f.orderBy("path").limit(limit) if limit > 0 else f


def subfolders(paths: DataFrame, root: str) -> DataFrame:
    """Distinct folders directly below root."""
    top = F.lit(f"{root}/")
    rest = F.when(F.startswith("path", top), F.substring("path", len(root) + 2, 1 << 30))
    name = F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1))
    return paths.select(F.concat(top, F.nullif(name, F.lit(""))).alias("path")).where("path is not null").distinct()


def leaf_folders(folders: DataFrame, tag: str = "[skip]") -> DataFrame:
    """Folders that hold no other folder and whose path does not contain the tag."""
    parent = folders.select(F.regexp_replace("path", r"/[^/]*$", "").alias("p")).where(F.col("path").contains("/")).distinct()
    return folders.join(parent, folders.path == F.col("p"), "left_anti").where(~F.col("path").contains(tag))


def stale(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs (path, hash) whose output was made from other content, or not at all."""
    o = outputs.select("path", F.col("hash").alias("made_from"))
    return inputs.join(o, "path", "left").where(~F.col("hash").eqNullSafe(F.col("made_from")))


def first_record(lines: DataFrame) -> DataFrame:
    """(path, height, dbh in cm) from the first line of white-space separated text; lines: path, line_no, value."""
    f = lines.groupBy("path").agg(F.min_by("value", "line_no").alias("v"))
    part = F.split(F.trim("v"), r"\s+")
    return f.select("path", F.try_element_at(part, F.lit(1)).cast("double").alias("height"), (F.try_element_at(part, F.lit(2)).cast("double") * 100).alias("dbh"))


def decoded(files: DataFrame, charset: str | None = None, pages: Sequence[str] = PAGES) -> DataFrame:
    """(path, text) of binary files; without a charset as ``detected`` has it, pages being those it chooses among."""
    if charset:
        return files.select("path", F.decode("content", charset).alias("text"))
    return detected(files, pages).select("path", "text")


def detected(files: DataFrame, pages: Sequence[str] = PAGES) -> DataFrame:
    """(path, charset, confidence, text) of binary files (path, content).

    By byte order mark, else UTF-8 where the bytes are that; the rest is UTF-16 where most bytes at odd or even
    places are 0, else the code page of one byte a character that its pairs of bytes are likeliest in: a guess,
    with its lead over the next one as confidence.  An empty file is UTF-8, null content has nulls.  Code pages
    of several bytes a character are not told apart, name them as charset.
    """
    prepare(files.sparkSession)
    c = F.col("content")
    start = lambda x: F.hex(F.substring(c, 1, len(x) // 2)) == x
    rest = lambda n: F.substring(c, n + 1, F.octet_length(c))
    marked = {"EFBBBF": ("utf_8", rest(3).cast("string")), "FFFE": ("utf_16_le", F.decode(rest(2), "UTF-16LE")), "FEFF": ("utf_16_be", F.decode(rest(2), "UTF-16BE"))}
    plain_text = F.is_valid_utf8(c.cast("string")) & ~F.contains(c, F.lit(b"\0"))
    known = F.lit(None).cast("struct<charset: string, confidence: double, text: string>")
    for mark, (name, text) in reversed([*marked.items(), ("", ("utf_8", c.cast("string")))]):
        known = F.when(start(mark) if mark else plain_text, F.struct(F.lit(name).alias("charset"), F.lit(1.0).alias("confidence"), text.alias("text"))).otherwise(known)
    f = files.select("path", "content", known.alias("known"))
    f = f.withColumn("found", F.coalesce("known", guessed(F.when(F.col("known").isNull(), c), pages)))
    return f.select("path", "found.*")


def on_each(files: DataFrame, work: Callable[[str], object]) -> DataFrame:
    """(path, result, error) of a function called with every path of files in tasks; result is its value as text, error why it failed.

    A path that fails does not stop the others.  A lost task is run again, so work should bear being repeated.
    Null paths and repeated ones are left out; no files give no rows.
    """
    prepare(files.sparkSession)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    value = work(path)
                    rows.append((path, None if value is None else str(value), None))
                except Exception as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:1000]))
            yield pd.DataFrame(rows, columns=["path", "result", "error"]).astype(object)

    p = files.select("path").where("path is not null").distinct()
    tasks = max(1, min(-(-p.count() // 4), 10_000))  # files differ in cost, so tasks are small
    return p.repartition(tasks, "path").mapInPandas(run, "path string, result string, error string")


def cloud_pairs(files: DataFrame, cloud: str = "pointcloud.las", cameras: str = "camera_positions.las") -> DataFrame:
    """(folder, cloud, cameras, status) of the folders that hold either file: ok, or which of the two is missing."""
    f = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"))
    f = f.groupBy("folder").agg(*[F.max(F.when(F.col("name") == n, F.col("path"))).alias(c) for c, n in (("cloud", cloud), ("cameras", cameras))])
    status = F.when(F.col("cameras").isNull(), "no_cameras").when(F.col("cloud").isNull(), "no_cloud").otherwise("ok")
    return f.where("cloud is not null or cameras is not null").withColumn("status", status)
