"""What the operators share, beside the library's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.shared import file_system, forget, new_folder, prepare, put_file, quoted, whole_row, written

__all__ = ["file_system", "forget", "likely", "new_folder", "prepare", "put_file", "quoted", "whole_row", "written"]


def likely(rows: DataFrame, keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """The rows whose ``key`` is in keys, and few others: a filter ahead of an exact join, so that less is shuffled.

    A hash of a key names one of 2**bits bits; 64 of them are a row of the table that is broadcast, which so
    has at most 2**(bits - 6) rows (262,144, about 8 MB) however many keys there are.  With far more keys than
    bits it lets most rows pass, and the exact join does the work.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    word, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    set_ = keys.select(word.alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({key}), {1 << bits}L), 64L) as int))").alias("_bit"))
    table = set_.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.join(F.broadcast(table), word == F.col("_word")).where(F.getbit("_bits", bit) == 1).select(*rows.columns)
