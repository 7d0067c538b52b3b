"""Windows, batches and runs over ordered frames.

Numbers within a chunk come from ``numbered``, so a chunk of any length spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.shared import attach, kept, written

KEY = "chunk_id"


def numbered(rows: DataFrame, key: str, order: str, name: str = "n0") -> DataFrame:
    """Add name: the number from 0 of each row within its key by order; ties are numbered in some order.

    Rows are dealt by ranges of key and order and numbered where they lie, in a written table, so numbers hold
    when tasks run again.  What lies before a range is a sum over a summary of one row per range and key.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(tasks, key, order).sortWithinPartitions(key, order)
    # a row's id is its task in the upper bits, its place in the lower 33
    table = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "numbered")
    own = table.groupBy(F.col(key).alias("_key"), "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = kept(own.select(F.struct("_key", "_part").alias("_range"), (before - F.col("_first")).alias("_shift")), "ranges")
    out = attach(table.withColumn("_range", F.struct(F.col(key).alias("_key"), F.col("_part"))), own, ["_range"])
    return out.withColumn(name, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_part", "_shift")


def sliding_windows(frames: DataFrame, size: int, overlap: int, key: str = KEY, order: str = "idx") -> DataFrame:
    """Add window and position: overlapping windows of size frames; a rest shorter than a window is dropped, a list that is not longer than one is one.

    A frame finds its windows by arithmetic on its number, so nothing is joined but the list's length.  Frames
    without a key are left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap lies in 0..size-1")
    step = size - overlap
    f = numbered(frames.where(F.col(key).isNotNull()), key, order)
    f = attach(f, f.groupBy(key).agg(F.count("*").alias("n")), [key])
    last = F.when(F.col("n") <= size, 0).otherwise(F.floor((F.col("n") - size) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("n0") - size + 1) / step))
    f = f.withColumns({"w0": first.cast("long"), "w1": F.least(last, F.floor(F.col("n0") / step)).cast("long")}).where("w0 <= w1")
    f = f.withColumn("window", F.explode(F.sequence("w0", "w1"))).withColumn("position", F.col("n0") - F.col("window") * step)
    return f.drop("n0", "n", "w0", "w1")


def match_batches(frames: DataFrame, size: int, overlap_share: float = 0.3, key: str = KEY) -> DataFrame:
    """(key, batch, start, stop): steps of size, each looking back by an overlap; size is at least 50 and at most the list."""
    n = frames.groupBy(key).agg(F.count("*").alias("n")).withColumn("size", F.least(F.greatest(F.lit(size), F.lit(50)), F.col("n")).cast("long"))
    n = n.withColumn("overlap", F.greatest(F.floor(F.col("size") * overlap_share), F.lit(25)).cast("long"))
    b = n.select("*", F.posexplode(F.expr("sequence(0L, n - 1, size)")).alias("batch", "i"))
    return b.select(key, "batch", F.greatest(F.lit(0), F.col("i") - F.col("overlap")).alias("start"), F.least("n", F.col("i") + F.col("size")).alias("stop"))


def _runs(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Unaligned frames with run, the number of aligned ones before, nth, their number among the chunk's unaligned ones, and start, that of their run's first."""
    f = numbered(frames.where(F.col(key).isNotNull()), key, order, "n0").where(~F.col("aligned"))
    f = written(numbered(f, key, "n0", "nth").withColumn("run", F.col("n0") - F.col("nth")).drop("n0"), "runs")
    return attach(f, f.groupBy(key, "run").agg(F.min("nth").alias("start")), [key, "run"])


def unaligned_runs(frames: DataFrame, size: int, key: str = KEY, order: str = "idx") -> DataFrame:
    """Add run and batch to unaligned frames: consecutive ones form a run, cut into batches of size.

    Frames without a key, or with a null for aligned, are left out, the latter counting as a break.
    """
    f = _runs(frames, key, order)
    return f.withColumn("batch", F.floor((F.col("nth") - F.col("start")) / size)).select(*frames.columns, "run", "batch")


def following_unaligned(frames: DataFrame, size: int, key: str = KEY, order: str = "idx") -> DataFrame:
    """(key, leader, member): every unaligned frame with itself and those that follow it in its run, size at most.

    A frame is sent to the numbers of the size frames up to itself and meets its leaders there: a join by chunk
    and number, which no chunk and no run can skew.
    """
    f = _runs(frames, key, order).select(key, "run", "nth", "start", F.col(order).alias("member"))
    leaders = f.select(key, "nth", F.col("member").alias("leader"))
    f = f.withColumn("nth", F.explode(F.sequence(F.greatest("start", F.col("nth") - (size - 1)), "nth")))
    return f.join(leaders, [key, "nth"]).select(key, "leader", "member")


def frame_masks(frames: DataFrame, masks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frames with the path of the mask named after them, null without one.

    Frames whose names repeat are told apart by keys, columns that frames and masks share.  A mask listed twice is one.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    m = masks.select(*keys, "mask").distinct()
    m = m.select(*keys, F.regexp_replace(F.regexp_replace("mask", r"^.*/", ""), r"_mask\.png$", "").alias("stem"), "mask")
    return frames.withColumn("stem", stem).join(m, [*keys, "stem"], "left").select(*frames.columns, "mask")


def chosen_chunk(chunks: DataFrame, key: str = "project", merged: str = "Merged Chunk") -> DataFrame:
    """Per project the merged chunk, else the first."""
    return chunks.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("label") == merged, F.col("label"))), F.min_by("label", "idx")).alias("label"))
