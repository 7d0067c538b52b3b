"""Connected components over an edge table, by contracting partition-wise forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from foliarc.shared import forget, prepare, written

CHUNK = 1_000_000  # edges of which a task holds the forest at once


def smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 .. n - 1 the smallest one it can reach by the edges (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b], a, b):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forests(batches: Iterator) -> Iterator:
    """(u, v): for runs of CHUNK edges every node u with the smallest node v that these edges reach from it, itself included."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def forest(held: list):
        t = pa.Table.from_batches(held)
        u, v = (pc.unique(t[c]) for c in ("u", "v"))
        nodes = pc.unique(pa.chunked_array([u, v]))
        nodes = nodes.take(pc.sort_indices(nodes))
        a, b = (pc.index_in(t[c], nodes).to_numpy() for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(smallest_reached(a, b, len(nodes))))], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield forest(held)
            held, n = [], 0
    if n:
        yield forest(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 200) -> DataFrame:
    """Label every node that has an edge to another node with the smallest node it can reach.

    edges: two columns of one orderable type; self loops, repeats, either direction and nulls are allowed
    (rows with a null are ignored).  Returns (node, component), one row per node with an edge.

    Each level replaces the edges of a partition by a forest of stars around their smallest nodes, so that a
    node, however many edges it has, is shuffled once a partition.  Grouped by node, a node that is no centre
    anywhere is assigned to its smallest centre and leaves; its other centres, and those of nodes that are
    centres, become the edges of the next level.  Assignments are then followed back, level by level.
    """
    prepare(edges.sparkSession)
    kind = dict(edges.dtypes)[a]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("ok")).where("ok").select("u", "v")
    assigned: list[DataFrame] = []
    for _ in range(most):
        more = Observation()
        stars = e.mapInArrow(_forests, f"u {kind}, v {kind}").groupBy("u").agg(F.collect_set("v").alias("centres"))
        stars = written(stars.observe(more, F.sum(F.size("centres") - 1).alias("edges")), "component-level")
        assigned.append(stars)
        if not more.get["edges"]:
            break
        hub = F.when(F.array_contains("centres", F.col("u")), F.col("u")).otherwise(F.array_min("centres"))
        e = stars.where("size(centres) > 1").select(hub.alias("hub"), F.explode("centres").alias("c")).where("hub != c").select(F.greatest("hub", "c").alias("u"), F.least("hub", "c").alias("v"))
    else:
        raise RuntimeError(f"components have not settled after {most} levels")
    labels = None
    while assigned:
        stars = assigned.pop()
        own = stars.where("not array_contains(centres, u)").select("u", F.array_min("centres").alias("v"))
        if labels is None:
            labels = own
        else:
            up = labels.select(F.col("u").alias("node"), F.col("v").alias("up"))
            below = labels
            labels = written(own.join(up, F.col("v") == F.col("node"), "left").select("u", F.coalesce("up", "v").alias("v")).union(labels), "components")
            forget(below, stars)
    return labels.select(F.col("u").alias("node"), F.col("v").alias("component")).union(labels.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
