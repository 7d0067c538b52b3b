"""Near-duplicate classes of whole tables against all links, found without sketches and without hashes of words."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from foliarc.llm import order_minhash, queries
from foliarc.llm.order_minhash import edit_distance

CLASSES = (50, 200, 1000, math.inf)  # upper bounds of the shorter text's shingles


def all_links(texts, similarity=0.8, k=5):
    """((a, b), shingles of the shorter) of every pair of places in texts that links; of texts of equal words only the first takes part.

    Shingles are numbered as they are, rarest first, so that any linking pair shares one of the first few of each.
    """
    first, words = {}, []
    for i, t in enumerate(texts):
        w = tuple((t or "").lower().split())
        if len(w) >= k and first.setdefault(w, i) == i:
            words.append((i, w))
    number, code, sets, codes = {}, {}, {}, {}
    for i, w in words:
        seen, out = Counter(), np.empty(len(w) - k + 1, np.int64)
        for j in range(len(out)):
            s = w[j : j + k]
            out[j] = number.setdefault((s, seen[s]), len(number))
            seen[s] += 1
        sets[i], codes[i] = out, np.array([code.setdefault(x, len(code)) for x in w], np.int64)
    often = np.bincount(np.concatenate([*sets.values(), np.zeros(0, np.int64)]), minlength=len(number))
    place = np.empty(len(number), np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(number))
    index = defaultdict(list)
    for i, s in sets.items():
        sets[i] = s = np.sort(place[s])
        for x in s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1].tolist():
            index[x].append(i)
    pairs = {(a, b) for group in index.values() if len(group) > 1 for n, b in enumerate(group) for a in group[:n]}
    for a, b in sorted(pairs):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            continue
        common = len(np.intersect1d(x, y, assume_unique=True))
        if common >= similarity * (len(x) + len(y) - common):
            band = int((1 - similarity) * max(len(codes[a]), len(codes[b])) + 1e-9)
            if edit_distance(codes[a], codes[b], band) <= band:
                yield (a, b), min(len(x), len(y))


def recall(spark, folder):
    """Per length class (links between texts that differ, those within one class), and the rows in classes that links and equal words do not make."""
    d = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = dict(queries.QUERIES["op10_order_minhash"](spark, folder).select("doc_id", "class_id").toPandas().itertuples(index=False))
    found, up, words = {c: [0, 0] for c in CLASSES}, list(range(len(d["text"]))), {}

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, t in enumerate(d["text"]):
        up[top(i)] = top(words.setdefault(tuple((t or "").lower().split()), i))
    for (a, b), n in all_links(d["text"]):
        up[top(b)] = top(a)
        c = next(c for c in CLASSES if n < c)
        found[c][0] += 1
        found[c][1] += got[d["doc_id"][a]] == got[d["doc_id"][b]]
    low = {}
    for i, x in enumerate(d["doc_id"]):
        low[top(i)] = min(x, low.get(top(i), x))
    return found, sum(got[x] != low[top(i)] for i, x in enumerate(d["doc_id"]))


def test_all_links_of_a_table(spark):
    found, other = recall(spark, SF)
    assert other == 0 and all(n == m for n, m in found.values())


def planted(rng, pairs):
    """Texts two by two, and per pair the number of shingles: substitutions, in one block or apart, leave 0.80 to 0.85 of labelled shingles."""
    texts, sizes = [], []
    for least, most, count in pairs:
        for k in range(count):
            n = int(rng.integers(least, most)) + 4
            a = rng.integers(0, 10**8, n)
            b = a.copy()
            gone = int((n - 4) * (1 - (s := rng.uniform(0.8, 0.85))) / (1 + s))  # shingles that differ on either side
            if k % 2:
                at = int(rng.integers(4, n - gone - 4))
                b[at : at + max(1, gone - 4)] = rng.integers(0, 10**8, max(1, gone - 4))
            else:
                at = np.sort(4 + 5 * rng.permutation((n - 8) // 5)[: max(1, gone // 5)])
                at = np.concatenate([at, at[-1] + 1 + np.arange(max(0, gone - 5 * len(at)))])
                b[at] = rng.integers(0, 10**8, len(at))
            texts += [" ".join(f"v{x}" for x in t) for t in (a, b)]
            sizes.append(n - 4)
    return texts, sizes


def test_planted_pairs_are_found_by_class(spark, tmp_path):
    """A thousand pairs just above the threshold, each of which links by the exact rule; recall by length."""
    texts, sizes = planted(np.random.default_rng(8), [(50, 200, 500), (200, 1000, 350), (1000, 2000, 150)])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_order_minhash(spark, str(tmp_path)).toPandas().set_index("doc_id").class_id.to_dict()
    words, all_of, found = order_minhash.Words(), Counter(), Counter()
    for i, n in enumerate(sizes):
        a, b = (words.codes(texts[j].split()) for j in (2 * i, 2 * i + 1))
        assert order_minhash.similar(a, b)
        c = next(c for c in CLASSES if n < c)
        all_of[c] += 1
        found[c] += got[2 * i] == got[2 * i + 1]
    print("planted pairs found", {c: (found[c], all_of[c]) for c in CLASSES})
    assert sum(all_of.values()) == 1000 and all(found[c] >= 0.99 * all_of[c] for c in all_of)
    assert len({*got.values()}) == 2000 - sum(found.values())


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_all_links_against_all_pairs(similarity):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 60, n) for n in (5, 8, 9, 30, 80) for _ in range(3)]
    texts = [" ".join(f"w{x}" for x in np.delete(b, rng.integers(0, len(b), e))) for b in base for e in (0, 0, 1, 2, 3)] + [None, "", "few words"]
    want = set()
    w = [(t or "").split() for t in texts]
    s = [Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in w]
    for b in range(len(w)):
        for a in range(b):
            if len(w[a]) >= 5 and len(w[b]) >= 5 and w.index(w[a]) == a and w.index(w[b]) == b:
                if (s[a] & s[b]).total() >= similarity * (s[a] | s[b]).total():
                    d = list(range(len(w[b]) + 1))
                    for i, x in enumerate(w[a], 1):
                        row = [i]
                        for j, y in enumerate(w[b], 1):
                            row.append(min(row[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
                        d = row
                    if d[-1] <= (1 - similarity) * max(len(w[a]), len(w[b])) + 1e-9:
                        want.add((a, b))
    assert {p for p, _ in all_links(texts, similarity)} == want and want
