"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are normalised in double precision; two link where their cosine is at least the threshold, that is,
where they lie within t = sqrt(2 - 2 * threshold) of each other.  Vectors are dealt to blocks by the nearest
of a bounded number of pivots (a cell that holds too many is cut further by hash).  Each block is a cover
tree, built once and written to the shared folder: nested levels of centres with halving radii, down to where
two members of a node must link, each node knowing its true covering radius.  Two blocks are compared only if
their own radii allow it, by descending both trees at once: a pair of nodes whose centres are further apart
than both radii plus t is pruned, one whose radii fit within t links wholesale, and only what lies between is
decided vector by vector.

A traversal returns per vector the number of links found and a member of its local component, never the
pairs, so a dense group of g vectors costs g rows and not g squared.
"""

from __future__ import annotations

import io
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import file_system, new_folder, prepare, put_file, quoted, written
from foliarc.llm.graph import connected_components, smallest_reached

BLOCK = 8192  # vectors of a block, about
BLOCK_BYTES = 1 << 25  # of a block's vectors, about, where they are long
MOST_CELLS = 4096  # pivots, at most: their vectors, radii and counts reach the driver
CHUNK = 1024
SLACK = 1e-5  # of single-precision products, which only propose


def levels(threshold: float) -> list[float]:
    """Covering radii below the root's: halved until any two members of a node link."""
    t, out = math.sqrt(max(0.0, 2 - 2 * threshold)), [1.0]
    while 2 * out[-1] > t and len(out) < 24:
        out.append(out[-1] / 2)
    return out


def unit(raw: list | np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.asarray(raw, np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cover(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row the number of its centre: rows taken in order, a row further than radius from all centres is one."""
    near = 1 - radius * radius / 2  # as a cosine
    centres, owner = [0], np.zeros(len(x), np.int64)
    for i in range(1, len(x), CHUNK):
        part = x[i : i + CHUNK]
        dots = part @ x[centres].T
        best = dots.argmax(1)
        owner[i : i + CHUNK] = best
        free = np.flatnonzero(dots[np.arange(len(part)), best] < near)
        if len(free):
            among = part[free] @ part[free].T
            new: list[int] = []
            for k, j in enumerate(free):
                if new:
                    to = among[k, new]
                    b = int(to.argmax())
                    if to[b] >= near:
                        owner[i + j] = len(centres) - len(new) + b
                        continue
                owner[i + j] = len(centres)
                centres.append(i + int(j))
                new.append(k)
    return owner


class Tree:
    """A block's vectors in tree order with its levels, each a list of runs of them: start, end, centre, true radius."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, threshold: float = 0.9):
        runs, order = [(0, len(x))], np.arange(len(x))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for radius in levels(threshold):
            out = []
            for a, b in runs:
                if b - a == 1:
                    out.append((a, b))
                    continue
                rows = order[a:b]
                owner = cover(x[rows], radius)
                by = np.argsort(owner, kind="stable")  # the centre of a run stays its first row: levels are nested
                order[a:b] = rows[by]
                cuts = np.flatnonzero(np.diff(owner[by])) + 1
                ends = [0, *cuts.tolist(), b - a]
                out += [(a + p, a + q) for p, q in zip(ends, ends[1:])]
            runs = out
            self.levels.append((np.array([r[0] for r in runs]), np.array([r[1] for r in runs])))
        self.order, self.x, self.weight = order, x[order], weight[order]
        self.x32 = self.x.astype(np.float32)
        # a level that hardly gathers anything is not worth a visit
        keep = [lv for lv, nxt in zip(self.levels, self.levels[1:]) if 2 * len(lv[0]) <= len(nxt[0])]
        self.levels = [(a, b, self._radius(a, b)) for a, b in [*keep, self.levels[-1]]]

    def _radius(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", self.x, np.repeat(self.x[a], b - a, axis=0))
        far = np.minimum.reduceat(dots, a)
        return np.where(b - a == 1, 0.0, np.sqrt(np.maximum(0, 2 - 2 * far)) + 1e-9)


    def save(self, out, node: np.ndarray) -> None:
        """Write the tree and the numbers of its vectors, given in the order of the rows it was made of."""
        runs = {f"{k}{i}": v for i, lv in enumerate(self.levels) for k, v in zip("abr", lv)}
        np.savez(out, x=self.x, weight=self.weight, node=node[self.order], **runs)

    @classmethod
    def load(cls, uri: str) -> "Tree":
        """A tree as written, with the numbers of its vectors as ``node``."""
        system, path = file_system(uri)
        with system.open_input_stream(path, compression=None) as f:
            got = np.load(io.BytesIO(f.read()))
        self = cls.__new__(cls)
        self.x, self.weight, self.node = got["x"], got["weight"], got["node"]
        self.x32 = self.x.astype(np.float32)
        self.levels = [tuple(got[f"{k}{i}"] for k in "abr") for i in range(sum(k.startswith("a") for k in got.files))]
        return self


def ragged(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with a[k] <= i < b[k] and c[k] <= j < d[k], for every k."""
    n, m = b - a, d - c
    size = n * m
    k = np.repeat(np.arange(len(a)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return a[k] + at // m[k], c[k] + at % m[k]


class Links:
    """What a traversal finds: weighted link counts, and components over both trees' vectors."""

    def __init__(self, p: Tree, q: Tree, own: bool):
        self.p, self.q, self.own = p, q, own
        self.count = [np.zeros(len(p.x), np.int64), np.zeros(len(q.x), np.int64)]
        self.a, self.b = [], []  # joined vectors, the second tree's after the first's

    def wholesale(self, a, b, c, d) -> None:
        """Runs a:b of the first tree link with runs c:d of the second, entirely."""
        wp, wq = np.concatenate([[0], np.cumsum(self.p.weight)]), np.concatenate([[0], np.cumsum(self.q.weight)])
        for i, j, give, which in ((a, b, wq[d] - wq[c], 0), (c, d, wp[b] - wp[a], 1)):
            if self.own and which:
                other = ~((a == c) & (b == d))
                i, j, give = i[other], j[other], give[other]
            step = np.zeros(len(self.count[which]) + 1, np.int64)
            np.add.at(step, i, give)
            np.subtract.at(step, j, give)
            self.count[0 if self.own else which] += np.cumsum(step)[:-1]
        shift = 0 if self.own else len(self.p.x)
        same = (a == c) & (b == d) if self.own else np.zeros(len(a), bool)
        if self.own and same.any():
            for i, j in zip(a[same], b[same]):
                self.count[0][i:j] -= self.p.weight[i:j]  # not with themselves
        for i, j, k, n in zip(a, b, c, d):
            self.a.append(np.arange(i, j))
            self.b.append(np.full(j - i, shift + k))
            self.a.append(np.arange(k, n) + shift)
            self.b.append(np.full(n - k, i))

    def single(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count[0], i, self.q.weight[j])
        np.add.at(self.count[0] if self.own else self.count[1], j, self.p.weight[i])
        self.a.append(i)
        self.b.append(j + (0 if self.own else len(self.p.x)))

    def components(self) -> np.ndarray:
        n = len(self.p.x) + (0 if self.own else len(self.q.x))
        return smallest_reached(np.concatenate(self.a), np.concatenate(self.b), n) if self.a else np.arange(n)


def traverse(p: Tree, q: Tree, threshold: float, own: bool) -> Links:
    """Descend two trees (own: one tree against itself) and find every link exactly."""
    t = math.sqrt(max(0.0, 2 - 2 * threshold))
    out = Links(p, q, own)
    pairs = None
    for depth in range(max(len(p.levels), len(q.levels))):
        (pa, pb, pr), (qa, qb, qr) = p.levels[min(depth, len(p.levels) - 1)], q.levels[min(depth, len(q.levels) - 1)]
        if pairs is not None:  # the children of pairs that are left
            (fa, fb, _), (ga, gb, _) = p.levels[min(depth - 1, len(p.levels) - 1)], q.levels[min(depth - 1, len(q.levels) - 1)]
            i, j = pairs
            c = np.searchsorted(pa, fa[i]), np.searchsorted(pa, fb[i])
            d = np.searchsorted(qa, ga[j]), np.searchsorted(qa, gb[j])
            many = int(((c[1] - c[0]) * (d[1] - d[0])).sum())
        if pairs is None or many > 0.05 * len(pa) * len(qa):
            found = []
            if pairs is not None:  # what linked or was pruned above stays so
                up, uq = np.searchsorted(fa, pa, "right") - 1, np.searchsorted(ga, qa, "right") - 1
                open_ = np.zeros((len(fa), len(ga)), bool)
                open_[pairs] = True
            least = 1 - (t + pr.max() + qr.max()) ** 2 / 2 - SLACK
            cp, cq = p.x32[pa], np.ascontiguousarray(q.x32[qa].T)
            for k in range(0, len(pa), CHUNK):
                near = cp[k : k + CHUNK] @ cq >= least
                if pairs is not None:
                    near &= open_[up[k : k + CHUNK]][:, uq]
                i, j = np.nonzero(near)
                found.append((i + k, j))
            i, j = (np.concatenate(x) for x in zip(*found))
        else:
            i, j = ragged(c[0], c[1], d[0], d[1])
        if own:
            i, j = i[i <= j], j[i <= j]
        keep, whole = np.zeros(len(i), bool), np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 17):
            u, v = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", p.x[pa[u]], q.x[qa[v]])))
            keep[k : k + len(u)] = far <= t + pr[u] + qr[v] + 1e-9
            whole[k : k + len(u)] = far + pr[u] + qr[v] <= t - 1e-7
        if own:  # a node with itself: any two of its members lie within its radius twice
            diagonal = i == j
            keep |= diagonal
            whole = np.where(diagonal, 2 * pr[i] <= t - 1e-7, whole)
        w = whole & keep
        if w.any():
            out.wholesale(pa[i[w]], pb[i[w]], qa[j[w]], qb[j[w]])
        pairs = i[keep & ~w], j[keep & ~w]
    i, j = pairs
    size = (pb[i] - pa[i]) * (qb[j] - qa[j])
    cuts = np.searchsorted(np.cumsum(size), np.arange(1, size.sum() // (1 << 17) + 2) * (1 << 17))
    for a, b in zip([0, *cuts], [*cuts, len(i)]):
        b = min(max(a, b + 1), len(i)) if b < len(i) else len(i)
        u, v = ragged(pa[i[a:b]], pb[i[a:b]], qa[j[a:b]], qb[j[a:b]])
        if own:
            u, v = u[u < v], v[u < v]
        for k in range(0, len(u), 1 << 17):
            x, y = u[k : k + (1 << 17)], v[k : k + (1 << 17)]
            ok = np.einsum("ij,ij->i", p.x[x], q.x[y]) >= threshold
            out.single(x[ok], y[ok])
    return out


def _pivots(x: DataFrame, n: int, block: int) -> np.ndarray:
    """Cells' pivots: the first of a hash order, at most MOST_CELLS."""
    k = min(MOST_CELLS, max(1, math.ceil(n / block)))
    got = x.orderBy(F.xxhash64("v"), "v").limit(k).select("v").collect()
    return unit([np.frombuffer(r.v, np.float64) for r in got])


def link(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link every two vectors whose cosine is at least threshold and label components.

    Returns one row per row of vectors: ``id_col``, n_links (other rows linked directly), component_id (the
    smallest id reachable by links, its own included), kept (id is component_id).  A vector that is null,
    empty, zero, or holds a null or a component that is not finite links with nothing and is its own
    component; vectors of different lengths do not link; rows that repeat an id or a vector are vectors of
    their own, and links are between vectors, so a repeated id joins nothing; a null id has a component but
    never names one, save where all its ids are null.  Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v")).withColumn("ok", F.coalesce(fine, F.lit(False)))

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            v, ok = b.column("v"), b.column("ok").to_pylist()
            ends, flat = v.offsets.to_pylist(), v.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([flat[x:y].tobytes() if k else None for x, y, k in zip(ends, ends[1:], ok)], pa.binary())], ["id", "v"])

    rows = written(rows.mapInArrow(packed, "id long, v binary").withColumn("key", F.unhex(F.sha2("v", 256))), "vectors")
    same = rows.where("v is not null").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("w"), F.first("v").alias("v"))
    same = written(same.select("key", "low", "w", "v", F.monotonically_increasing_id().alias("node")), "vector-classes")
    found = spark.createDataFrame([], "node long, links long, to long")
    for d in [r[0] for r in same.select((F.octet_length("v") / 8).cast("int").alias("d")).distinct().collect()]:
        found = found.union(_traversed(same.where(F.octet_length("v") == 8 * d), threshold, d))
    found = written(found, "vector-links")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "n1")
    each = same.select("key", "low", "w", "node").join(links, F.col("node") == F.col("n1"), "left").drop("n1")
    each = each.join(comps.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left")
    each = each.select("key", "low", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "node").alias("label"))
    names = each.groupBy("label").agg(F.min("low").alias("component")).withColumnRenamed("label", "l2")
    each = each.join(names, F.col("label") == F.col("l2")).select(F.concat("key", F.lit(b"")).alias("k2"), "links", "component")
    out = rows.select("id", "key").join(each, F.col("key") == F.col("k2"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(quoted(id_col)).eqNullSafe(F.col("component_id")))


def _traversed(x: DataFrame, threshold: float, d: int) -> DataFrame:
    """(node, links, to) of distinct vectors (node, w: how many rows have it, v) of d components, several rows a node: links found and a node of the same component.

    Cells are at most MOST_CELLS, so that what concerns cells fits the driver; blocks, of bounded size, and
    pairs of blocks are rows of tables.
    """
    spark = x.sparkSession
    block = max(256, min(BLOCK, BLOCK_BYTES // (8 * d)))
    pivots = _pivots(x, x.count(), block)

    def nearest(batches):
        for pdf in batches:
            dots = unit([np.frombuffer(b, np.float64) for b in pdf["v"]]) @ pivots.T
            pdf["cell"] = dots.argmax(1).astype(np.int32)
            pdf["dot"] = dots.max(1)
            yield pdf[["node", "w", "v", "cell", "dot"]]

    x = written(x.select("node", "w", "v").mapInPandas(nearest, "node long, w long, v binary, cell int, dot double"), "vector-cells")
    cells = x.groupBy("cell").agg(F.count("*").alias("n"), F.min("dot").alias("dot")).orderBy("cell").collect()
    number = np.array([c.cell for c in cells])
    cut = np.array([math.ceil(c.n / block) for c in cells])
    base = np.cumsum(cut) - cut
    far = np.array([math.sqrt(max(0.0, 2 - 2 * c.dot)) + 1e-9 for c in cells])
    t = math.sqrt(max(0.0, 2 - 2 * threshold))
    table = spark.createDataFrame([(int(c), int(b), int(k)) for c, b, k in zip(number, base, cut)], "cell int, base long, cut int")
    x = x.join(F.broadcast(table), "cell").select("node", "w", "v", (F.col("base") + F.pmod(F.xxhash64("v"), F.col("cut"))).alias("block"))
    folder = new_folder(spark, "vector-trees")

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("v", kind="stable")
        z = unit([np.frombuffer(b, np.float64) for b in pdf["v"]])
        tree = Tree(z, pdf["w"].to_numpy(np.int64), threshold)
        k = int(pdf["block"].iloc[0])
        put_file(f"{folder}/{k}.npz", lambda out: tree.save(out, pdf["node"].to_numpy(np.int64)))
        middle = z.mean(0)
        middle = middle / np.linalg.norm(middle) if np.linalg.norm(middle) > 1e-9 else z[0]
        radius = math.sqrt(max(0.0, 2 - 2 * float((z @ middle).min()))) + 1e-9
        return pd.DataFrame({"block": [k], "middle": [middle.tobytes()], "far": [radius]})

    blocks = written(x.groupBy("block").applyInPandas(build, "block long, middle binary, far double"), "vector-blocks")

    def near_cells(batches):
        """Pairs of blocks of cells whose pivots and radii allow a link, a cell at a time."""
        import pandas as pd

        for pdf in batches:
            for i in pdf["id"]:
                dist = np.sqrt(np.maximum(0, 2 - 2 * pivots[number[i:]] @ pivots[number[i]]))
                for j in i + np.flatnonzero(dist <= far[i] + far[i:] + t + 1e-9):
                    for a in range(base[i], base[i] + cut[i]):
                        q = np.arange(a if i == j else base[j], base[j] + cut[j])
                        yield pd.DataFrame({"p": np.full(len(q), a), "q": q})

    def near_blocks(batches):
        for pdf in batches:
            m, n = (np.array([np.frombuffer(b, np.float64) for b in pdf[c]]).reshape(-1, d) for c in ("mp", "mq"))
            dist = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", m, n)))
            yield pdf[dist <= pdf["fp"].to_numpy() + pdf["fq"].to_numpy() + t + 1e-9][["p", "q"]]

    pairs = spark.range(0, len(cells), 1, min(len(cells), spark.sparkContext.defaultParallelism) or 1).mapInPandas(near_cells, "p long, q long")
    for s in "pq":
        pairs = pairs.join(blocks.select(F.col("block").alias(s), F.col("middle").alias(f"m{s}"), F.col("far").alias(f"f{s}")), s)
    pairs = written(pairs.mapInPandas(near_blocks, "p long, q long"), "block-pairs")
    tasks = max(1, min(pairs.count(), 100_000))

    def compare(batches):
        import pandas as pd

        held: dict[int, Tree] = {}
        for pdf in batches:
            for k, j in pdf[["p", "q"]].itertuples(index=False):
                held = {b: held.get(b) or Tree.load(f"{folder}/{b}.npz") for b in {k, j}}
                p, q = held[k], held[j]
                got = traverse(p, q, threshold, k == j)
                nodes = p.node if k == j else np.concatenate([p.node, q.node])
                count, label = got.count[0] if k == j else np.concatenate(got.count), got.components()
                low = np.full(len(nodes), np.iinfo(np.int64).max)
                np.minimum.at(low, label, nodes)
                some = count > 0
                yield pd.DataFrame({"node": nodes[some], "links": count[some], "to": low[label][some]})

    return pairs.repartition(tasks).mapInPandas(compare, "node long, links long, to long")
