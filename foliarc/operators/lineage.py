"""Content hashes, version names and requirement lists."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    return files.select(key, F.md5(F.col(content)).alias("hash"))


def project_hash(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """One SHA-256 that names a set of files by paths and contents: of 4,096 groups by hash of the path, each hashed over path and digest in order of path, then all groups in order."""
    d = files.select(F.col(key).cast("string").alias("p"), F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    d = d.groupBy(F.substring(F.md5("p"), 1, 3).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: F.concat(s.p, s.h)), ""), 256).alias("h"))
    return d.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda s: s.h), ""), 256).alias("version"))


def digits_per_pair(adjectives: int, nouns: int) -> int:
    """Hex digits of a hash that one word pair stands for."""
    return math.ceil(math.floor(math.log2(adjectives * nouns)) / 4)


def word_name(digest: str, adjectives: Sequence[str], nouns: Sequence[str], pairs: int = 2) -> str:
    """A digest's first digits as adjective-noun pairs; a short digest is filled with zeros."""
    n, size = digits_per_pair(len(adjectives), len(nouns)), len(adjectives) * len(nouns)
    out = []
    for i in range(pairs):
        x = int(digest[i * n : (i + 1) * n].ljust(n, "0"), 16) % size
        out.append(f"{adjectives[x // len(nouns)]}-{nouns[x % len(nouns)]}")
    return "-".join(out)


def word_names(digest: Column, adjectives: Sequence[str], nouns: Sequence[str], pairs: int = 2) -> Column:
    """``word_name`` as a column."""
    n, size = digits_per_pair(len(adjectives), len(nouns)), len(adjectives) * len(nouns)
    a, b = (F.array(*[F.lit(w) for w in words]) for words in (adjectives, nouns))
    each = []
    for i in range(pairs):
        x = F.conv(F.rpad(F.substring(digest, i * n + 1, n), n, "0"), 16, 10).cast("long") % size
        each.append(F.concat_ws("-", F.element_at(a, (F.floor(x / len(nouns)) + 1).cast("int")), F.element_at(b, (x % len(nouns) + 1).cast("int"))))
    return F.concat_ws("-", *each)


def pairs_needed(n, p: float, words: int):
    """Word pairs that keep the chance of two equal names among n at p; a column or a number."""
    if isinstance(n, (int, float)):
        return math.ceil(math.log(n * n / (-2 * math.log(1 - p))) / math.log(words))
    return F.ceil(F.log(n * n / (-2 * math.log(1 - p))) / math.log(words))


# Order of pre- and post-releases of one release.
PHASES = {"dev": -4, "a": -3, "alpha": -3, "b": -2, "beta": -2, "c": -1, "rc": -1, "": 0, "post": 1, "rev": 1, "r": 1}


def version_key(version: Column) -> Column:
    """Versions in their order: release numbers (1.2 is 1.2.0), phase, its number; null where the text is no version."""
    release = F.transform(F.split(F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.try_cast("long"))
    tail = F.lower(F.regexp_extract(version, r"^v?\d+(?:\.\d+)*[._-]?([A-Za-z]*)", 1))
    phase = F.lit(None).cast("int")
    for word, rank in PHASES.items():
        phase = F.when(tail == word, rank).otherwise(phase)
    number = F.regexp_extract(version, r"[A-Za-z][._-]?(\d+)", 1).try_cast("long")
    whole = version.rlike(r"^v?\d+(\.\d+)*([._-]?[A-Za-z]+[._-]?\d*)?$") & phase.isNotNull()
    padded = F.slice(F.concat(release, F.array_repeat(F.lit(0).cast("long"), 8)), 1, 8)
    return F.when(whole, F.struct(padded.alias("release"), phase.alias("phase"), F.coalesce(number, F.lit(0)).alias("number")))


def consolidate_requirements(requirements: DataFrame) -> DataFrame:
    """Per package and major version the line of the highest version pinned by == or ~=; lines without one stay, each once.

    Comments, blank lines and lines that are no requirement are left out; equal versions: the later line in order of text.
    """
    line = F.trim("line")
    r = requirements.select(line.alias("line")).where("line is not null").where(line.rlike(r"^[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?\s*(\[[^\]]*\])?\s*(\(?\s*(===|==|~=|!=|<=|>=|<|>)[^#]*)?(;.*)?$"))
    r = r.select("line", F.lower(F.regexp_extract("line", r"^([A-Za-z0-9._-]+)", 1)).alias("package"), version_key(F.regexp_extract("line", r"(?<!=)(?:==|~=)\s*([^\s,;)=]+)", 1)).alias("v"))
    best = r.where("v is not null").groupBy("package", F.col("v.release")[0].alias("major")).agg(F.max_by("line", F.struct("v", "line")).alias("line"))
    return best.select("package", "line").union(r.where("v is null").select("package", "line")).distinct()
