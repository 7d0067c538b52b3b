"""The folder that driver and executors share: written intermediate tables, whole files, small tables joined by broadcast."""

from __future__ import annotations

import contextlib
import contextvars
import datetime
import os
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[1])
_OWN: dict[str, str] = {}
FEW = 200_000  # rows of a table that may be broadcast
LITTLE = 64 << 20  # bytes of its files, at most
METRICS = "stage string, started timestamp, seconds double, rows long, bytes long, error string"
_STAGES: contextvars.ContextVar[list | None] = contextvars.ContextVar("stages", default=None)


def prepare(spark: SparkSession) -> str:
    """Make the package importable on Python workers and return the shared folder's URI.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that is unset and the
    master is local (tests, one machine) a temporary one is made; elsewhere that is an error, since executors
    do not see the driver's folders.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = _OWN.get(sc.applicationId)
        if not place:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="foliarc-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def _hadoop(spark: SparkSession, place: str):
    """(file system, path) of a URI as Hadoop has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, place: str) -> bool:
    """Whether a file or folder is there."""
    system, path = _hadoop(spark, place)
    return system.exists(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder in the shared folder that nothing else uses; it is not created, and what it holds by then is deleted as the application ends."""
    place = f"{prepare(spark)}/{name}-{uuid.uuid4().hex}"
    system, path = _hadoop(spark, place)
    system.deleteOnExit(path)
    return place


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of each query run inside as that query ends; they are not read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


@contextlib.contextmanager
def measured() -> Iterator[list[dict]]:
    """A list that gets a row of METRICS for every stage that ends inside, tables that ``written`` writes among them."""
    stages: list[dict] = []
    token = _STAGES.set(stages)
    try:
        yield stages
    finally:
        _STAGES.reset(token)


@contextlib.contextmanager
def stage(name: str) -> Iterator[dict]:
    """Time what runs inside as a stage; rows and bytes are what the caller puts into the row.  A failed stage has its error."""
    row = {"stage": name, "started": datetime.datetime.now(), "rows": None, "bytes": None, "error": None}
    start = time.monotonic()
    try:
        yield row
    except Exception as e:
        row["error"] = f"{type(e).__name__}: {e}"[:1000]
        raise
    finally:
        row["seconds"] = time.monotonic() - start
        if (stages := _STAGES.get()) is not None:
            stages.append(row)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    Within ``measured`` its rows are counted as they are written, not in a pass of their own.
    """
    spark = df.sparkSession
    place = new_folder(spark, name)
    schema = df.schema
    with short_lived_shuffles(spark), stage(name) as row:
        seen = None
        if _STAGES.get() is not None:
            seen = Observation()
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        df.write.option("compression", "zstd").parquet(place)
        if seen is not None:
            row["rows"] = seen.get.get("rows", 0)
            system, path = _hadoop(spark, place)
            row["bytes"] = system.getContentSummary(path).getLength()
    return spark.read.schema(schema).parquet(place)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame):
    """All columns of df as one struct, so that their names clash with nothing."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for df in tables:
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            system, path = _hadoop(df.sparkSession, place)
            system.delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``written``, with the number of its rows as ``df.rows``, that of its files' bytes as ``df.bytes``."""
    out = written(df, name)
    out.rows = out.count()
    system, path = _hadoop(df.sparkSession, out.inputFiles()[0].rsplit("/", 1)[0]) if out.inputFiles() else (None, None)
    out.bytes = system.getContentSummary(path).getLength() if system else 0
    return out


def attach(rows: DataFrame, per: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of one row per key, which is written first so that nothing above it is done again.

    It is broadcast where it has at most FEW rows and its files at most LITTLE bytes; else its keys are joined
    in a shuffle, in which adaptive execution splits a hot key of rows.
    """
    if not hasattr(per, "rows"):
        per = kept(per, "per-key")
    little = per.rows <= FEW and getattr(per, "bytes", 0) <= LITTLE
    return rows.join(F.broadcast(per) if little else per, list(keys), how)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for whole files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_file(uri: str, write) -> None:
    """Call write(binary stream) on a temporary name beside uri, then move it there: a repeated or lost task leaves a whole file or none."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, path)
