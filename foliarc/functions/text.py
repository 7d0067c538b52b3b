"""Columns on paths, names and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_in(s: Column) -> Column:
    """All digits of a string read as one number, 0 without any; the sort key of frames."""
    return F.coalesce(F.nullif(F.regexp_replace(s, "[^0-9]", ""), F.lit("")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def flat_name(path: Column) -> Column:
    """A relative path as one folder name."""
    return F.regexp_replace(path, r'[\\/:*?"<>|]', "_")


def site_and_tree(path: Column, base: str = "data/output/") -> tuple[Column, Column]:
    """First two parts of a path below base; null where there are fewer."""
    parts = F.split(F.regexp_replace(path, f"^{base}", ""), "/")
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def elapsed(seconds: Column) -> Column:
    """Seconds as words; hours and minutes that are zero are left out, except minutes before seconds of an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    unit = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n > 1, "s").otherwise(""))
    return F.concat_ws(" ", F.when(h > 0, unit(h, "hour")), F.when(m > 0, unit(m, "minute")), unit(s, "second"))


def without(text: Column, olds: list[str], new: str = "") -> Column:
    """text with each of olds replaced."""
    for o in olds:
        text = F.replace(text, F.lit(o), F.lit(new))
    return text


def capitalised(name: str) -> str:
    """A column's heading: first letter upper, the rest lower, DBH as it is."""
    out = name.capitalize()
    return "DBH" if out == "Dbh" else out
