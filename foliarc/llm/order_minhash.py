"""Near-duplicates by Order MinHash and banded alignment.

A text is its words in lower case; its k-mers are runs of five words, each labelled with its occurrence, so
repeats count.  For each of m hash functions a sketch takes the ``length`` labelled k-mers of least hash and
keeps them in text order: two texts share a sketch about as often as their k-mers agree in what they are and
in how they follow each other, which is what edit similarity asks for.

Texts that share a sketch are candidates.  A short text has too few k-mers for that: one word more can change
all its sketches.  So texts of fewer than ``SHORT`` k-mers get their candidates exactly, by prefix filtering:
in one order of all k-mers, two texts that agree enough share one of the first few of each, where "few" is
one more than a text can lack.  Texts long enough to link with a short one take part.

A candidate pair is a link where at least 0.8 of its labelled five-word shingles are common (of those in
either text) and an alignment of its words within a band of 0.2 of the longer text succeeds.  Classes are the
components of the links.  Equal texts are collapsed first, so any number of copies is one text.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.llm.common import forget, likely, prepare, quoted, whole_row, written
from foliarc.llm.graph import connected_components

K = 5
SKETCHES = 16
LENGTH = 4
SHORT = 50  # k-mers: below, candidates are exact
SIMILARITY = 0.8
CELLS = 64
CACHE = 400_000
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits look independent of the input's."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Words:
    """32-bit codes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        except KeyError:
            new = {w: zlib.crc32(w.encode()) for w in set(words) if w not in known}
        if len(known) + len(new) <= CACHE:
            known |= new
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        return np.fromiter((known[w] if w in known else new[w] for w in words), np.uint32, len(words))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mers in text order; a shorter text is one k-mer, an empty one none."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    c, out = codes.astype(np.uint64), np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * GOLD + c[i : n - k + 1 + i] + np.uint64(1)) if i else c[: n - k + 1] + np.uint64(1)
    order = np.argsort(out, kind="stable")
    s = out[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    if first.all():
        return out
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    label = np.empty(len(s), np.uint64)
    label[order] = nth.astype(np.uint64)
    return np.where(label == 0, out, mixed(out + label * GOLD))


_RNG = np.random.default_rng(11)
FACTOR = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
OFFSET = _RNG.integers(0, 2**63, 256, dtype=np.uint64)


def sketch(keys: np.ndarray, m: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """m order-minhash values of labelled k-mers, each of the ``length`` least under one hash, in text order."""
    if not len(keys):
        return np.zeros(0, np.int64)
    n, out = min(length, len(keys)), np.zeros(m, np.uint64)
    base = mixed(keys)
    step = max(1, 2_000_000 // len(keys))  # bounded memory on very long texts
    for i in range(0, m, step):
        h = base[None, :] * FACTOR[i : min(m, i + step), None] + OFFSET[i : min(m, i + step), None]
        h ^= h >> np.uint64(32)
        at = np.sort(np.argpartition(h, n - 1, axis=1)[:, :n], axis=1) if n < len(keys) else np.tile(np.arange(n), (len(h), 1))
        got = np.zeros(len(h), np.uint64)
        for j in range(n):
            got = mixed(got * GOLD + keys[at[:, j]] + np.uint64(j + 1))
        out[i : i + len(h)] = got
    return out.view(np.int64)


def buckets(keys: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Values of which two texts' labelled k-mers share one if they may link: certainly if either has fewer than SHORT, else as sketches go."""
    n, out = len(keys), []
    if n >= SHORT:
        out.append(mixed(sketch(keys).view(np.uint64) + np.arange(SKETCHES, dtype=np.uint64) * GOLD))
    if n and n * similarity < SHORT:  # a text of fewer than SHORT links with none longer
        few = n - max(1, math.ceil(similarity * n - 1e-6)) + 1
        out.append(np.sort(mixed(keys ^ MIX2))[:few])
    return np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Word edits between a and b where at most band, else band + 1; bit-parallel over a band of 2 * band + 1 diagonals."""
    n = min(len(a), len(b))
    i = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    i = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    a, b = a[: len(a) - i], b[: len(b) - i]
    m, n = len(a), len(b)
    if abs(m - n) > band:
        return band + 1
    if not m or not n:
        return max(m, n)
    k, x, y = band, a.tolist(), b.tolist()
    if m < k:  # a common start of no word's code changes no distance, and lets the band begin inside
        x, y, m = [-1] * (k - m) + x, [-1] * (k - m) + y, k
    where: dict[int, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | (1 << i)
    width = 2 * k + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, d = ((1 << (k + 1)) - 1) << k, 0, k
    row = top
    for j, w in enumerate(y, 1):
        eq, s = where.get(w, 0), j - k - 1
        eq = ((eq >> s) if s >= 0 else (eq << -s)) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j <= m - k:
            d += not d0 & top
        else:
            row >>= 1
            d += bool(hp & row) - bool(hn & row)
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
    return d if d <= band else band + 1


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, k: int = K) -> bool:
    """Whether two texts' word codes link: common labelled shingles first, then the banded alignment."""
    x, y = kmers(a, k), kmers(b, k)
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    if common < similarity * (len(x) + len(y) - common):
        return False
    band = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return edit_distance(a, b, band) <= band


def _sketched(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(rid, doc_id, h, key, kmers, words, buckets) of every row, written: rid numbers rows, h is a hash of the text as it is, key is equal for texts of equal words.

    words are 32-bit codes, on which pairs are verified: two different words have one code once in 2**32.  Texts of fewer than
    five words have no buckets, since they link only where their keys are equal.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("h"), F.col(quoted(text_col)).alias("text"))

    def work(batches):
        import pyarrow as pa

        words = Words()
        for batch in batches:
            keys, sizes, coded, places = [], [], [], []
            for text in batch["text"].to_pylist():
                w = (text or "").lower().split()
                keys.append(hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest())
                c = words.codes(w)
                x = kmers(c)
                sizes.append(len(x))
                coded.append(c.astype("<u4").tobytes())
                places.append(buckets(x, similarity) if len(w) >= K else x[:0].view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(s) for s in places])]).astype(np.int32)
            flat = np.concatenate([*places, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], batch["h"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(coded, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["rid", "doc_id", "h", "key", "kmers", "words", "buckets"])

    return written(rows.mapInArrow(work, "rid long, doc_id long, h long, key binary, kmers int, words binary, buckets array<long>"), "omh-rows")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rid that link; texts holds (rid, words) of all of them."""
    t = texts.select(F.col("rid").alias("a"), F.col("words").alias("x"))
    u = texts.select(F.col("rid").alias("b"), F.col("words").alias("y"))
    full = pairs.join(u, "b").join(t, "a").select("a", "b", "x", "y")

    def work(batches):
        for batch in batches:
            x, y = batch["x"], batch["y"]
            ok = [similar(np.frombuffer(x[i].as_buffer(), "<u4"), np.frombuffer(y[i].as_buffer(), "<u4"), similarity) for i in range(len(x))]
            import pyarrow as pa

            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(full.mapInArrow(work, "a long, b long"), "omh-links")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, rid, kmers, label, most): members of the buckets that hold several labels, most being the commonest."""
    m = members.join(labels, F.col("rid") == F.col("node"), "left").select("bucket", "rid", "kmers", F.coalesce("component", "rid").alias("label"))
    m = written(m, "omh-labelled")
    n = m.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("of"))
    return m.join(n.where("of > 1").select("bucket", "most"), "bucket")


def _shared(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(rid, shared, cells): how many of a text's labelled k-mers a text of another label in members has too, in all and by cell of their hash.

    Two texts of different labels cannot have more in common than that, so a text that passes on a common
    passage but is otherwise its own, a copy with many edits of its own, or a member of a family that
    differs from all others, needs no comparisons.  Nor can they have more in common in any cell than the
    lesser of their counts, which tells apart copies whose edits lie in different places.
    """
    some = texts.join(members.select(F.col("rid").alias("r"), "label").distinct(), F.col("rid") == F.col("r")).select("rid", "label", "words")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for rid, label, w in zip(batch["rid"].to_pylist(), batch["label"].to_pylist(), batch["words"], strict=True):
                x = kmers(np.frombuffer(w.as_buffer(), "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), rid, np.int64)), pa.array(np.full(len(x), label, np.int64)), pa.array(x.view(np.int64))], ["rid", "label", "kmer"])

    each = some.mapInArrow(work, "rid long, label long, kmer long")
    known = each.groupBy("kmer").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select(F.col("kmer").bitwiseXOR(F.lit(0)).alias("k2"))
    cells = each.join(known, F.col("kmer") == F.col("k2"), "left_semi").groupBy("rid", F.pmod("kmer", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").cast("int").alias("n"))
    cells = cells.groupBy("rid").agg(F.sum("n").alias("shared"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("at"))
    return cells.select("rid", "shared", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.col("at")[i], F.lit(0))).alias("cells"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Class of every row of docs: ``id_col``, class_id (the smallest id in the class), class_size (rows), kept.

    kept marks the row whose id is class_id.  Texts are compared by their words in lower case; a null text is
    empty, and all texts without words are one class; texts of fewer than five words link only where equal.
    Rows that repeat an id are rows of their own; a null id never names a class that has another id.  An
    empty table gives no rows; other columns are not read.
    """
    out = _classes(docs, id_col, text_col, similarity)
    return out.select(F.col("doc_id").alias(id_col), "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of every class, with its columns: that of the smallest id, and of least text hash where rows repeat it."""
    c = _classes(docs, id_col, text_col, similarity)
    stay = c.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("m")).select("m.doc_id", "m.h")
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(id_col)).cast("long").alias("id1"), F.xxhash64(quoted(text_col)).alias("h1"))
    rows = rows.join(stay.distinct(), F.col("id1").eqNullSafe(F.col("doc_id")) & (F.col("h1") == F.col("h")))
    once = Window.partitionBy("doc_id", "h").orderBy(F.xxhash64("row"))
    return rows.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(doc_id, h, label, class_id, class_size) of every row of docs."""
    prepare(docs.sparkSession)
    rows = _sketched(docs, id_col, text_col, similarity)
    classes = written(rows.groupBy("key").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("low"), F.count("*").alias("n")), "omh-classes")
    ids = written(rows.select("doc_id", "h", "key"), "omh-ids")
    each = rows.select("rid", "kmers", "buckets").join(classes.select("rid"), "rid", "left_semi")
    each = each.select("rid", "kmers", F.explode("buckets").alias("bucket"))
    each = written(each, "omh-each")
    buckets = written(each.groupBy("bucket").agg(F.count("*").alias("g")).where("g > 1"), "omh-buckets")
    full = buckets.select(F.col("bucket").bitwiseXOR(F.lit(0)).alias("b2"), "g")
    members = likely(each, buckets, "bucket").join(full, F.col("bucket") == F.col("b2"))
    members = written(members.select("bucket", "rid", "kmers", "g"), "omh-members")
    some = likely(rows.select("rid", "words"), members, "rid").join(members.select("rid").distinct(), "rid")  # inner: a semi join would be moved ahead of the filter
    some = written(some, "omh-texts")
    forget(rows, each, buckets)

    central = members.groupBy("rid").agg(F.sum("g").alias("central")).select(F.col("rid").bitwiseXOR(F.lit(0)).alias("r2"), "central")
    lead = members.join(central, F.col("rid") == F.col("r2")).groupBy("bucket").agg(F.max_by(F.struct("rid", "kmers"), F.struct("central", "rid")).alias("lead"))
    star = members.join(lead.select(F.col("bucket").bitwiseXOR(F.lit(0)).alias("b2"), "lead"), F.col("bucket") == F.col("b2"))
    star = star.where((F.col("rid") != F.col("lead.rid")) & (F.least("kmers", "lead.kmers") >= similarity * F.greatest("kmers", "lead.kmers")))
    links = _verified(star.select(F.least("lead.rid", "rid").alias("a"), F.greatest("lead.rid", "rid").alias("b")).distinct(), some, similarity)

    m = _mixed(members, connected_components(links))
    m = written(m.join(_shared(some, m), "rid").where(F.col("shared") >= similarity * F.col("kmers")), "omh-residue")
    x, y = m.where("label != most").alias("x"), m.alias("y")
    once = (F.col("y.label") == F.col("y.most")) | (F.col("x.rid") < F.col("y.rid"))
    enough = F.least("x.shared", "y.shared") * (1 + similarity) >= similarity * (F.col("x.kmers") + F.col("y.kmers")) - 1e-6
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & once & enough)
    rest = rest.where(f"aggregate(zip_with(x.cells, y.cells, (p, q) -> least(p, q)), 0, (p, q) -> p + q) * {1 + similarity} >= {similarity} * (x.kmers + y.kmers) - 1e-6")
    rest = rest.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()
    links = links.union(_verified(rest, some, similarity))
    labels = connected_components(links)
    forget(members, some, m, links)

    c = classes.join(labels, F.col("rid") == F.col("node"), "left").select("key", "low", "n", F.coalesce("component", "rid").alias("label"))
    whole = c.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size")).select(F.col("label").bitwiseXOR(F.lit(0)).alias("l2"), "class_id", "class_size")
    c = c.join(whole, F.col("label") == F.col("l2")).select(F.concat("key", F.lit(b"")).alias("k2"), "label", "class_id", "class_size")
    return ids.join(c, F.col("key") == F.col("k2")).select("doc_id", "h", "label", "class_id", "class_size")
