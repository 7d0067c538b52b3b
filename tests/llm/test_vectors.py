"""Hard negatives and whitening against brute force and on awkward rows."""

import numpy as np
import pytest

from foliarc.llm import hard_negatives, whitening

COLUMNS = "vec_id long, embedding array<double>, label int, node string, cell string, x string, z string"


def table(spark, rows):
    """Vectors from (id, vector, label), with columns that clash with the operators' own."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], COLUMNS)


def mined(rows, every, scale=256, k=5):
    fine = [(i, [int(np.floor(scale * c)) for c in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for p, (i, a, y) in enumerate(fine):
        if i % every:
            continue
        scored = sorted((-sum(c * d for c, d in zip(a, v)), j, z == y) for q, (j, v, z) in enumerate(fine) if q != p and len(v) == len(a))
        for s, j, _ in [x for x in scored if x[2]][:k]:
            near = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cell, piece", [(256, 2048), (8, 5)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, cell, piece):
    monkeypatch.setattr(hard_negatives, "ROWS_A_CELL", cell)
    monkeypatch.setattr(hard_negatives, "PIECE", piece)
    monkeypatch.setattr(hard_negatives, "FILE", 60)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (6, 8))
    rows = [(i, (middle[i % 6] * (1 + i % 3) + rng.normal(0, 0.6, 8)).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25] * 4, i % 3) for i in range(120)]  # one vector makes a third of all rows
    got = rows_of(hard_negatives.mine(table(spark, rows), every=10))
    assert got == mined(rows, 10) and len(got) > 100


def test_hard_negatives_on_awkward_rows(spark):
    big = (1 << 53) + 2
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (big, [1.0, 1.9], 1), (big + 1, [1.0, 1.8], 2), ((1 << 62) + 1, [1.0, 1.8], 2), (None, [1.0, 1.8], 2), (7, None, 2), (8, [1.0, None], 2)]
    rows += [(9, [float("nan"), 1.0], 2), (11, [float("inf"), 1.0], 2), (12, [1.0, 1.8], None), (13, [1.0, 1.8, 3.0], 2), (100, [1.0, 1.7, 3.0], 2), (200, [], 1), (201, [], 1), (202, [], 3), (300, [-1.0, 0.5], 5)]
    rows += [(301, [1.0, -0.5], 5), (302, [-0.5, -1.0], 6)]
    got = rows_of(hard_negatives.mine(table(spark, rows)))
    assert got == mined(rows, 100)
    assert {r[3] for r in got} >= {big + 1, (1 << 62) + 1, 202}
    assert hard_negatives.mine(table(spark, rows).limit(0)).count() == 0
    assert hard_negatives.mine(table(spark, [(1, [1.0], 1)])).count() == 0
    huge = [(100, [1e9, 1.0], 1), (1, [1e9, 2.0], 1), (2, [1e9, 1.0], 2), (3, [0.0, 1e300], 2)]
    got = rows_of(hard_negatives.mine(table(spark, huge)))  # scores saturate, so that all of them tie
    assert [r[:4] for r in got] == [(100, 1, 1, 2), (100, 1, 2, 3)]


def test_hard_negatives_skip_pieces():
    """What bounds leave out holds no answer, and something is left out."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.05, (200, 3)) for m in rng.normal(0, 3, (20, 3))])
    x = np.floor(x * 256)
    space = hard_negatives.Space.of([v.tolist() for v in x[::50]], float((x**2).sum(1).max()))
    kind = hard_negatives.record(3, 4)
    rows = np.zeros(len(x), kind)
    rows["node"], rows["id"], rows["label"], rows["x"] = np.arange(len(x)), np.arange(len(x)), np.arange(len(x)) % 2, x
    pivots = space.pivots[3]
    far = hard_negatives.distances(hard_negatives.augmented(x, space.most), pivots)
    cell, seen = far.argmin(1), []
    w = hard_negatives.Wants(rows[:100], 3, None, space.most)

    def pieces():
        for c in np.argsort(hard_negatives.distances(w.zero[:1], pivots)[0]):
            own = np.flatnonzero(cell == c)
            if len(own):
                d = far[own, c]
                yield rows[own], pivots[c], d.min(), d.max()

    real = hard_negatives.scores
    hard_negatives.scores = lambda a, b, exact: (seen.append(a.shape[0] * len(b)), real(a, b, exact))[1]
    try:
        entry, ids, score = hard_negatives.local_join(w, pieces(), 5, True, space)
    finally:
        hard_negatives.scores = real
    want = {(i, j) for i in range(100) for j in sorted((j for j in range(len(x)) if j != i and j % 2 == i % 2), key=lambda j: (-(x[i] @ x[j]), j))[:5]}
    assert set(zip(w.node[w.anchor[entry]].tolist(), ids.tolist())) == want
    assert sum(seen) < 0.5 * 100 * len(x)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    c = rng.normal(0, 1, (400, 12)) @ rng.normal(0, 1, (12, 12)) / 5
    rows = [(i, v.tolist(), 0) for i, v in enumerate(c)]
    bad = [(900, None, 0), (901, [1.0] * 11 + [None], 0), (902, [float("nan")] * 12, 0), (903, [float("-inf")] * 12, 0)]
    got = whitening.whiten(table(spark, rows + bad)).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    y = x - total / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    z = y @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    mine = got.whitened.to_numpy(float).reshape(n, 8)
    assert got.vec_id.tolist() == np.repeat(np.arange(n), 8).tolist() and got.component.tolist() == list(range(1, 9)) * n
    assert np.abs(mine - z * np.sign((mine * z).sum(0))).max() < 1e-9
    assert [int(d) for d in got.deviation[::8]] == [int(sum(int(w) ** 2 for w in n * r - total)) for r in x]
    assert np.allclose(got.explained[:8], e[::-1][:8] / np.trace(v), rtol=1e-9) and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] < 1e-9


def test_whitening_on_awkward_rows(spark):
    rows = [(None, [1.0, 2.0, 3.0], 0), ((1 << 53) + 1, [2.0, 2.0, 1.0], 0), ((1 << 62) + 1, [2.0, 2.0, 1.0], 0), ((1 << 62) + 1, [0.0, 1e30, -1e30], 0), (5, [1.0], 0), (6, [], 0)]
    got = whitening.whiten(table(spark, rows), components=2).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(2 * [str(r[0]) for r in rows])
    assert {r.n for r in got} == {4}
    assert all((r.whitened is None) == (r.vec_id in (5, 6) or r.component == 2 and r.whitened is None) for r in got)
    same = whitening.whiten(table(spark, [(i, [3.0, 4.0], 0) for i in range(3)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and int(r.deviation) == 0 and r.identity_error is None for r in same)
    few = whitening.whiten(table(spark, [(1, [0.0, 1.0, 5.0], 0), (2, [1.0, 0.5, 2.0], 0)])).collect()  # two rows vary in one direction
    assert all((r.whitened is None) == (r.component > 1) for r in few) and abs(few[0].explained + few[1].explained - 1) < 1e-9
    assert whitening.whiten(table(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [], 0)])).count() == 0


def test_whitening_sums_stay_exact(spark):
    most = float(1 << 40)
    rows = [(i, [most if i % 2 else -most, i / 7], 0) for i in range(40)]
    got = {r.vec_id: r for r in whitening.whiten(table(spark, rows), components=1).collect()}
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in rows]
    total = [sum(c) for c in zip(*x)]
    assert all(int(got[i].deviation) == sum((40 * a - s) ** 2 for a, s in zip(x[i], total)) for i in range(40))
