"""Clouds that arrive as files, analysed batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliarc.operators.voxel import KEYS
from foliarc.plans.features import features
from foliarc.plans.jobs import with_status
from foliarc.schema import AnalysisConfig
from foliarc.shared import written
from foliarc.sources import las


def watch_clouds(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, config: AnalysisConfig = AnalysisConfig(), keys: Sequence[str] = KEYS) -> StreamingQuery:
    """Features of every Parquet cloud that arrives in folder, written to out in a folder per batch.

    A cloud must arrive within one batch.  A batch that is run again replaces its own folder.
    """

    def work(batch: DataFrame, number: int) -> None:
        features(batch, config, keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    points = spark.readStream.schema(schema).parquet(folder)
    return points.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_las(spark: SparkSession, folder: str, out: str, checkpoint: str, config: AnalysisConfig = AnalysisConfig()) -> StreamingQuery:
    """Features of every LAS file that arrives in folder, written to out in a folder per batch, with status.

    A file is taken once, by name and size, across restarts: the log of files lies beside the checkpoint.  One
    that cannot be read, or has no voxels, is a row with its status.  A batch run again replaces its folder.
    """
    las.register(spark)

    def work(batch: DataFrame, number: int) -> None:
        points = written(batch, "arrived")
        state = points.groupBy("file").agg(F.max("error").alias("error"))
        found = features(points.where("error is null").drop("error"), config, ("file",))
        with_status(state, found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    points = spark.readStream.format("las").option("log", f"{checkpoint.rstrip('/')}-files").load(folder)
    return points.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
