"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost.  Documents longer than the longest are cut into
whole sequences and a rest.  Pieces are packed longest first: a piece goes into the open bin that it leaves
with the least room; where none fits, a bin is opened of the length whose cost per word it can be expected to
hold is least.  At the end each bin is cut down to the shortest permitted length that holds its contents.

Shards of a bounded number of pieces are packed independently, so no task sees more than one shard.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.llm.common import prepare, quoted, written
from foliarc.llm.mixing import word_count

LENGTHS = (512, 1024, 2048, 4096)


def cost(length: int) -> float:
    """Training cost of a sequence in arbitrary units: linear layers, attention, and an overhead for each sequence."""
    return 32.0 + length + length * length / 16384.0


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each size, all of which lie in 1..max(lengths).

    Deterministic: ties go to the earlier piece and to the bin that came to its room last.  The length of a
    new bin is the one with the least cost per word among those that hold the piece, each counted as filled
    by as many of the remaining pieces, from the longest that fits on, as it can take; it is decided as the
    first bin for a size is opened and holds for that size.
    """
    lengths = sorted(lengths)
    top = lengths[-1]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = [0] * (top + 1)  # pieces not yet placed, by size
    for s in sizes:
        left[s] += 1
    present = [s for s in range(1, top + 1) if left[s]]
    open_at: dict[int, list[int]] = {}  # room -> bins
    rooms: list[int] = []  # rooms that have bins, ascending
    used: list[int] = []
    start: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)

    def filled(room: int) -> int:
        """Words that the remaining pieces put into this room, greedily from the longest."""
        total, i = 0, bisect.bisect_right(present, room) - 1
        while i >= 0 and room > 0:
            s = present[i]
            if n := min(left[s], room // s):
                total, room = total + n * s, room - n * s
            i = min(i - 1, bisect.bisect_right(present, room) - 1)
        return total

    last, best = None, top
    for i in order:
        s = sizes[i]
        left[s] -= 1
        at = bisect.bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
        else:
            if last != s:
                best = min((x for x in lengths if x >= s), key=lambda x: (cost(x) / (s + filled(x - s)), x))
                last = s
            b, room = len(used), best
            used.append(0)
            start.append(room)
        place[i] = (b, used[b])
        used[b] += s
        room -= s
        if room:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append(b)
    cap = [lengths[bisect.bisect_left(lengths, u)] for u in used]
    return [(b, cap[b], o) for b, o in place]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, shard_pieces: int = 50_000) -> DataFrame:
    """Pack the words of all rows of docs into sequences of the permitted lengths.

    Returns one row per piece: ``id_col``, piece (0, 1, ... of a row), first_word, length, shard, bin (within
    the shard), capacity (of the bin after cutting down), bin_offset.  Every word of every row is in exactly
    one piece; the pieces of a bin do not overlap.  Rows with a null or empty text have no words and no
    pieces; rows that repeat an id are packed as separate rows; an empty table gives no rows.  Shards are
    cut by a hash of id, text, piece and, among rows alike in these, a count, so repeated or very long rows
    spread and the result does not depend on how docs is partitioned.  The number of shards follows from the
    number of pieces, about shard_pieces each.
    """
    prepare(docs.sparkSession)
    top = max(lengths)
    text = F.col(quoted(text_col))
    d = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("h"), word_count(text).alias("size")).where("size > 0")
    d = written(d, "pack-sizes")
    d = d.select("id", "h", "size", F.row_number().over(Window.partitionBy("id", "h").orderBy("size")).alias("nth"))
    d = d.select("id", "h", "size", "nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / top))).alias("piece"))
    d = d.select("id", "piece", (F.col("piece") * top).alias("first_word"), F.least(F.lit(top), F.col("size") - F.col("piece") * top).cast("int").alias("length"), F.xxhash64("id", "h", "piece", "nth").alias("row"))
    d = written(d, "pack-pieces")
    shards = max(1, math.ceil(d.count() / shard_pieces))
    d = d.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    # ids reach pandas without nulls, which would make them doubles
    d = d.select(F.coalesce("id", F.lit(0).cast(kind)).alias("id"), F.col("id").isNull().alias("no_id"), "piece", "first_word", "length", "shard", "row")

    def one(pdf):
        pdf = pdf.sort_values(["no_id", "id", "piece", "row"], kind="stable").reset_index(drop=True)
        got = best_fit(pdf["length"].tolist(), lengths)
        pdf["bin"], pdf["capacity"], pdf["bin_offset"] = zip(*got)
        return pdf[["id", "no_id", "piece", "first_word", "length", "shard", "bin", "capacity", "bin_offset"]]

    out = d.groupBy("shard").applyInPandas(one, f"id {kind}, no_id boolean, piece long, first_word long, length int, shard int, bin long, capacity int, bin_offset int")
    return out.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id").withColumnRenamed("id", id_col)
