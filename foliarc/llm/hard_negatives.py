"""Hard negatives by a Voronoi-partition distributed kNN join over inner products.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the greatest length, and an anchor a zero; then
|a' - x'|^2 = |a|^2 + M^2 - 2 a.x, so the greatest inner products are the nearest neighbours.  Vectors fall into
the Voronoi cells of pivots and are written, sorted by cell and distance to its pivot, to files of the shared
folder; a piece is a run of one cell in one file, with the range of its distances.  Anchors are cut likewise,
by fewer pivots, into groups.

A join runs in two rounds.  First a group meets pieces of the cells next to its anchors: the score that each
anchor has found by then bounds how far its answers can lie.  By the triangle inequality the bound gives, for
every cell, the distances to the pivot that the group might still need; only pieces in that range go to the
group, where an exact join over the pieces' vectors keeps the best.  Positives are one such join (among rows of
the anchor's label); negatives are another (among other labels, between two scores for each positive).
Pieces are read from their files by the tasks that need them, so replication costs reads and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliarc.llm.common import file_system, new_folder, prepare, put_file, quoted, written
from foliarc.llm.whitening import LARGEST, sound

ROWS_A_CELL = 256
MOST_CELLS = 2048  # pivots, at most: their vectors reach the driver and every task
PIVOT_ENTRIES = 1 << 22  # of all pivots together, about
PIECE = 2048  # rows
FILE = 16_384  # rows
GROUP = 512  # anchors
HOME = 4  # cells next to an anchor from which its first bound comes
HOME_PIECES = 4  # of each
EXACT = 1 << 53  # squared length below which products are whole numbers in doubles
TOP = 1 << 60  # scores saturate here
SLACK = 1e-6  # of M, for rounding of distances

PIECES = "number long, file string, at long, rows long, d int, width int, cell int, low double, high double"
REF = "file string, at long, rows long, d int, width int"
FOUND = "grp long, node long, slot int, id long, score long"


@dataclass
class Space:
    """Pivots by vector length, and M."""

    cells: dict[int, np.ndarray]
    pivots: dict[int, np.ndarray]  # augmented
    most: float  # M^2

    @classmethod
    def of(cls, vectors: list[list[int]], most: float) -> Space:
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        raw = {d: np.array([vectors[i] for i in ids], np.float64).reshape(-1, d) for d, ids in by.items()}
        return cls({d: np.array(ids) for d, ids in by.items()}, {d: augmented(x, most) for d, x in raw.items()}, most)

    def at(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells and pivots for vectors of d entries; where no pivot has that length one cell, -1, around the origin."""
        return (self.cells[d], self.pivots[d]) if d in self.cells else (np.array([-1]), np.zeros((1, d + 1)))

    @property
    def slack(self) -> float:
        return SLACK * math.sqrt(self.most) + 1e-9


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most - np.einsum("ij,ij->i", x, x)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def record(d: int, width: int) -> np.dtype:
    """A row in a file; entries take the fewest bytes that hold all of a piece's."""
    return np.dtype([("node", "<i8"), ("id", "<i8"), ("label", "<i8"), ("x", f"<i{width}", (d,))])


class Pieces:
    """Reads pieces, a file kept open until another is asked for."""

    def __init__(self):
        self.file, self.stream = None, None

    def read(self, file: str, at: int, rows: int, d: int, width: int) -> np.ndarray:
        if file != self.file:
            self.close()
            system, path = file_system(file)
            self.file, self.stream = file, system.open_input_file(path)
        kind = record(d, width)
        self.stream.seek(at)
        return np.frombuffer(self.stream.read(rows * kind.itemsize), kind)

    def close(self) -> None:
        if self.stream:
            self.stream.close()
            self.file, self.stream = None, None


def assigned(rows: DataFrame, space: Space) -> DataFrame:
    """Rows (node, id, label, x) with the cell of the nearest pivot and the distance to it; entries packed in as few bytes as hold a row's."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            x, n = b.column("x"), len(b)
            size = np.diff(x.offsets.to_numpy())
            flat, start = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            cell, dist, width, packed = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32), [b""] * n
            for d in np.unique(size):
                i = np.flatnonzero(size == d)
                own = flat[start[i][:, None] + np.arange(d)].reshape(len(i), d)
                cells, pivots = space.at(int(d))
                for k in range(0, len(i), 4096):
                    far = distances(augmented(own[k : k + 4096].astype(np.float64), space.most), pivots)
                    near = far.argmin(1)
                    cell[i[k : k + 4096]], dist[i[k : k + 4096]] = cells[near], far[np.arange(len(near)), near]
                big = np.abs(own).max(axis=1, initial=0)
                bytes_ = np.where(big < 1 << 15, 2, np.where(big < 1 << 31, 4, 8))
                width[i] = bytes_
                for w in np.unique(bytes_):
                    at = np.flatnonzero(bytes_ == w)
                    for j, row in zip(i[at], own[at].astype(f"<i{w}")):
                        packed[j] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "id", "label")), pa.array(size.astype(np.int32)), pa.array(width), pa.array(cell), pa.array(dist), pa.array(packed, pa.binary())], ["node", "id", "label", "d", "width", "cell", "dist", "x"])

    return rows.select("node", "id", "label", "x").mapInArrow(work, "node long, id long, label long, d int, width int, cell int, dist double, x binary")


def filed(cells: DataFrame, rows: int, each: int, piece: int, folder: str) -> DataFrame:
    """Write the rows of ``assigned`` to files of about ``each`` rows and return their pieces, of at most ``piece`` rows.

    Rows are dealt by range of cell, distance and number, so that a cell of any size fills as many files as it
    needs, and every file has as many rows.
    """
    order = ["d", "width", "cell", "dist", "node"]
    dealt = cells.repartitionByRange(max(1, math.ceil(rows / each)), *order).sortWithinPartitions(*order)

    def save(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, made, at = TaskContext.get().partitionId(), [], 0
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        file = f"{folder}/{part:08d}"

        def write(out):
            nonlocal at
            for b in _chain(first, batches):
                key = [b.column(c).to_numpy() for c in ("d", "width", "cell")]
                dist = b.column("dist").to_numpy()
                turn = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
                for a, e in zip([0, *turn.tolist()], [*turn.tolist(), len(b)]):
                    d, width, cell = (int(k[a]) for k in key)
                    kind = record(d, width)
                    for i in range(a, e, piece):
                        j = min(e, i + piece)
                        got = np.zeros(j - i, kind)
                        for c in ("node", "id", "label"):
                            got[c] = b.column(c)[i:j].to_numpy()
                        got["x"] = np.frombuffer(b"".join(b.column("x")[i:j].to_pylist()), f"<i{width}").reshape(j - i, d)
                        out.write(got.tobytes())
                        made.append(((part << 24) + len(made), file, at, j - i, d, width, cell, float(dist[i]), float(dist[j - 1])))
                        at += got.nbytes

        put_file(file, write)
        import pyarrow as pa

        table = pd.DataFrame(made, columns=[x.split()[0] for x in PIECES.split(", ")])
        yield pa.RecordBatch.from_pandas(table.astype({"d": "int32", "width": "int32", "cell": "int32"}), preserve_index=False)

    made = written(dealt.mapInArrow(save, PIECES), "negative-made")
    return made.withColumn("nth", F.row_number().over(Window.partitionBy("d", "cell").orderBy("low", "number")))


def _chain(first, rest):
    yield first
    yield from rest


class Wants:
    """What a group's anchors still look for: entries of an anchor's index, slot, least and greatest score."""

    def __init__(self, anchors: np.ndarray, d: int, wants: tuple | None, most: float):
        """wants: nodes, slots, least and greatest scores; None: any score, once for each anchor."""
        self.node, self.label = anchors["node"], anchors["label"]
        self.x = anchors["x"].astype(np.float64).reshape(len(anchors), d)
        n = len(anchors)
        node, slot, low, top = (self.node, np.zeros(n), np.full(n, -TOP), np.full(n, TOP)) if wants is None else wants
        slot, low, top = (np.asarray(v, np.int64) for v in (slot, low, top))
        by = np.argsort(self.node, kind="stable")
        anchor = by[np.searchsorted(self.node[by], np.asarray(node, np.int64))]
        order = np.lexsort((slot, anchor))
        self.anchor, self.slot, self.low, self.top = anchor[order], slot[order], low[order], top[order]
        self.reach = np.einsum("ij,ij->i", self.x, self.x) + most  # |a|^2 + M^2
        self.zero = np.concatenate([self.x, np.zeros((len(self.x), 1))], axis=1)

    def radii(self) -> tuple[np.ndarray, np.ndarray]:
        """Between which distances an entry's answers lie."""
        reach = self.reach[self.anchor]
        outer = np.where(self.low <= -TOP, np.inf, np.sqrt(np.maximum(0, reach - 2.0 * self.low)))
        inner = np.where(self.top >= TOP, 0.0, np.sqrt(np.maximum(0, reach - 2.0 * self.top)))
        return inner, outer

    def range(self, to: np.ndarray, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """For entries x pivots, the distances to the pivot that an answer can have; to: distances of anchors to pivots."""
        inner, outer = (r[part] for r in self.radii())
        far = to[self.anchor[part]]
        return np.maximum(far - outer[:, None], inner[:, None] - far), far + outer[:, None]


def scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; saturated where doubles would not hold them exactly."""
    if exact:
        return np.rint(a @ x.astype(np.float64).T).astype(np.int64)
    whole = a.astype(np.int64).astype(object) @ x.astype(object).T if a.shape[1] else np.zeros((len(a), len(x)), object)
    return np.clip(whole, -TOP, TOP).astype(np.int64)


def best(entry: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the first k of each entry, by greatest score, then smallest id."""
    order = np.lexsort((ids, -score, entry))
    e = entry[order]
    new = np.concatenate([[True], e[1:] != e[:-1]]) if len(e) else np.zeros(0, bool)
    rank = np.arange(len(e)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[rank < k]


def local_join(w: Wants, pieces: Iterator[tuple[np.ndarray, np.ndarray, float, float]], k: int, same: bool, space: Space) -> tuple[np.ndarray, ...]:
    """The first k rows of each entry among pieces (rows, pivot, least and greatest distance): entries, ids, scores.

    An entry's own bound rises as it finds rows, and later pieces are skipped by it.
    """
    start = np.searchsorted(w.anchor, np.arange(len(w.node) + 1))
    entry, ids, score = (np.zeros(0, np.int64) for _ in range(3))
    exact = space.most < EXACT
    for rows, pivot, near, far in pieces:
        lo, hi = w.range(distances(w.zero, pivot[None, :]))
        open_ = (lo[:, 0] - space.slack <= far) & (hi[:, 0] + space.slack >= near)
        if not open_.any():
            continue
        use = np.unique(w.anchor[open_])
        least, most = np.full(len(w.node), TOP), np.full(len(w.node), -TOP)
        np.minimum.at(least, w.anchor[open_], w.low[open_])
        np.maximum.at(most, w.anchor[open_], w.top[open_])
        new = []
        for c in range(0, len(use), 128):
            i = use[c : c + 128]
            s = scores(w.x[i], rows["x"], exact)
            fits = (s >= least[i, None]) & (s <= most[i, None]) & ((w.label[i, None] == rows["label"]) == same) & (w.node[i, None] != rows["node"])
            p, q = np.nonzero(fits)
            n = (start[i + 1] - start[i])[p]
            e = np.repeat(start[i][p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # each with all entries of its anchor
            q, v = np.repeat(q, n), np.repeat(s[p, q], n)
            ok = (v >= w.low[e]) & (v <= w.top[e])
            e, q, v = e[ok], q[ok], v[ok]
            keep = best(e, v, rows["id"][q], k)
            new.append((e[keep], rows["id"][q[keep]], v[keep]))
        entry, ids, score = (np.concatenate([x, *y]) for x, y in zip((entry, ids, score), zip(*new)))
        keep = best(entry, score, ids, k)
        entry, ids, score = entry[keep], ids[keep], score[keep]
        full = np.bincount(entry, minlength=len(w.low)) == k
        kth = np.full(len(w.low), TOP)
        np.minimum.at(kth, entry, score)
        w.low = np.where(full, np.maximum(w.low, kth), w.low)
    return entry, ids, score


OWN = "grp long, file string, at long, rows long, d int, width int"
LISTS = "node array<long>, slot array<long>, low array<long>, top array<long>"


def join(groups: DataFrame, pieces: DataFrame, wants: DataFrame | None, k: int, same: bool, space: Space) -> DataFrame:
    """The first k rows of each entry of wants (grp, node, slot, low, top), by greatest score and smallest id, as FOUND.

    With ``same`` rows of the anchor's label count, without it all others.  wants None: every anchor, any score.
    """
    own = [x.split()[0] for x in OWN.split(", ")]
    each = groups.withColumnRenamed("number", "grp").select(*own)
    names = [x.split()[0] for x in LISTS.split(", ")]
    if wants is None:
        each = each.select(*own, *[F.lit(None).cast("array<long>").alias(c) for c in names])
    else:  # at most GROUP anchors a group, and k entries an anchor
        lists = wants.groupBy("grp").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in names])).alias("w"))
        each = each.join(lists, "grp").select(*own, *[F.col("w")[c].alias(c) for c in names])
    each = written(each, "negative-groups")
    each = written(_searched(each, pieces, k, same, space, home=True), "negative-bounds")
    found = _searched(each, pieces, k, same, space, home=False)
    return written(found.withColumn("n", F.row_number().over(_by())).where(F.col("n") <= k).drop("n"), "negative-found")


def _searched(each: DataFrame, pieces: DataFrame, k: int, same: bool, space: Space, home: bool) -> DataFrame:
    """A round: groups with their wants meet the pieces that they might need.

    The home round returns the groups again, with bounds that have risen; the other what was found, by task.
    """

    def wants(row, reader: Pieces) -> Wants:
        given = None if row.node is None else (row.node, row.slot, row.low, row.top)
        return Wants(reader.read(row.file, row.at, row.rows, row.d, row.width), row.d, given, space.most)

    def reach(batches):
        """(grp, d, cell, least, most): the distances to the cell's pivot at which the group needs rows."""
        import pandas as pd

        reader = Pieces()
        for pdf in batches:
            for row in pdf.itertuples():
                w = wants(row, reader)
                cells, pivots = space.at(row.d)
                to = distances(w.zero, pivots)
                if home:
                    near = np.unique(np.argsort(to, axis=1, kind="stable")[:, :HOME])
                    low, high = np.zeros(len(near)), np.full(len(near), np.inf)
                else:
                    near = np.arange(len(cells))
                    low, high = np.full(len(cells), np.inf), np.full(len(cells), -np.inf)
                    for c in range(0, len(w.anchor), 1024):
                        lo, hi = w.range(to, slice(c, c + 1024))
                        low, high = np.minimum(low, np.where(lo <= hi, lo, np.inf).min(0)), np.maximum(high, np.where(lo <= hi, hi, -np.inf).max(0))
                yield pd.DataFrame({"grp": row.grp, "d": np.int32(row.d), "cell": cells[near].astype(np.int32), "least": low - space.slack, "most": high + space.slack})
        reader.close()

    need = each.mapInPandas(reach, "grp long, d int, cell int, least double, most double")
    have = pieces.where(F.col("nth") <= HOME_PIECES) if home else pieces
    pairs = need.join(have, ["d", "cell"]).where((F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least")))
    by = ["grp"] if home else ["grp", "file"]
    lists = pairs.groupBy(*by).agg(F.collect_list(F.struct("file", "at", "rows", "d", "width", "cell", "low", "high")).alias("pieces")).select("grp", "pieces")
    work = written(each.join(lists, "grp", "left" if home else "inner"), "negative-work")

    def search(batches):
        import pandas as pd

        anchors, reader = Pieces(), Pieces()
        for pdf in batches:
            for row in pdf.itertuples():
                w = wants(row, anchors)
                cells, pivots = space.at(row.d)
                number = dict(zip(cells.tolist(), range(len(cells))))
                refs = [] if row.pieces is None else sorted(row.pieces, key=lambda r: (r["file"], r["at"]))
                got = ((reader.read(*(r[c] for c in ("file", "at", "rows", "d", "width"))), pivots[number[r["cell"]]], r["low"], r["high"]) for r in refs)
                entry, ids, score = local_join(w, got, k, same, space)
                if home:
                    lists = {"node": w.node[w.anchor], "slot": w.slot, "low": w.low, "top": w.top}
                    yield pd.DataFrame({c: [getattr(row, c)] for c in ("grp", "file", "at", "rows", "d", "width")} | {c: [v] for c, v in lists.items()})
                else:
                    yield pd.DataFrame({"grp": row.grp, "node": w.node[w.anchor[entry]], "slot": w.slot[entry].astype(np.int32), "id": ids, "score": score})
        anchors.close()
        reader.close()

    tasks = max(1, min(work.count(), 100_000))
    return work.repartition(tasks).mapInPandas(search, f"{OWN}, {LISTS}" if home else FOUND)


def _by():
    return Window.partitionBy("grp", "node", "slot").orderBy(F.desc("score"), "id")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, of: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of anchors, the rows whose id is divisible by ``every``.

    An entry c counts as floor(scale * c), saturating at 2^52; a score is the inner product with the anchor,
    exact, saturating at 2^60.  An anchor's positives are its first ``positives`` other rows of its label, by
    greatest score, then smallest id; for each, the first ``negatives`` rows of other labels whose score is at
    most the positive's and at least least / of of it (so none where that score is negative) are returned:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id or label, or a vector that is null or holds a null or an entry that is not finite, take
    no part.  Vectors of different lengths do not meet; empty ones score 0 with each other.  Rows that repeat
    an id are rows of their own, anchors as well.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("v")
    own = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).cast("long").alias("label"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(v))
    own = own.select("id", "label", F.transform("v", lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-LARGEST)), F.lit(LARGEST))).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, most, wide, anchors = own.agg(F.count("*"), F.max(square), F.max(F.size("x")), F.count_if(F.col("id") % every == 0)).first()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    pivots = max(1, min(MOST_CELLS, math.ceil(n / ROWS_A_CELL), PIVOT_ENTRIES // max(1, wide)))
    chosen = own.orderBy(F.xxhash64("x", "id", "label"), "id").select("x").limit(pivots).collect()
    chosen = [list(x) for x in dict.fromkeys(tuple(r["x"]) for r in chosen)]
    space, coarse = Space.of(chosen, most), Space.of(chosen[: math.ceil(anchors / GROUP)], most)
    rows = written(assigned(own.withColumn("node", F.monotonically_increasing_id()), space), "negative-cells")
    pieces = written(filed(rows, n, FILE, PIECE, new_folder(spark, "negative-files")), "negative-pieces")
    some = _unpacked(rows.where(F.col("id") % every == 0))
    groups = filed(assigned(some, coarse), anchors, GROUP * 16, GROUP, new_folder(spark, "negative-anchors"))

    same = join(groups, pieces, None, positives, True, space)
    slots = same.withColumn("slot", F.row_number().over(Window.partitionBy("grp", "node").orderBy(F.desc("score"), "id"))).where("score >= 0")
    divisor = math.gcd(least, of)
    a, b = least // divisor, of // divisor
    low = F.expr(f"({a} * score + {b - 1}) div {b}")
    slots = written(slots.select("grp", "node", "slot", F.col("id").alias("positive_id"), "score", low.alias("low")), "negative-positives")
    other = join(groups, pieces, slots.select("grp", "node", "slot", "low", F.col("score").alias("top")), negatives, False, space)
    other = other.withColumn("rank", F.row_number().over(_by()))
    out = other.select("grp", "node", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(slots, ["grp", "node", "slot"])
    ids = rows.where(F.col("id") % every == 0).select("node", F.col("id").alias("anchor_id"))
    return out.join(ids, "node").select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score").toDF(*names)


def _unpacked(rows: DataFrame) -> DataFrame:
    """Rows of ``assigned`` with x as an array again."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            x = [np.frombuffer(p, f"<i{w}").astype(np.int64) for p, w in zip(b.column("x").to_pylist(), b.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "id", "label")), pa.array(x, pa.list_(pa.int64()))], ["node", "id", "label", "x"])

    return rows.mapInArrow(work, "node long, id long, label long, x array<long>")
