"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Words and their shapes (runs of letters, digits and each other character) are hashed into a fixed number of
rows.  Random indexing gives each row a sparse random index vector; a row's word vector is the sum of the
index vectors seen near it in any document, which needs no labels.  A document is the mean and the spread of
its word vectors, those of its shapes and a few counts.  A two-layer network scores it; a temperature fitted
on labelled rows that the network has not seen makes its probabilities fit.

The network is fitted on at most ``sample`` labelled rows, those of least hash; word vectors are of all
documents, and every row is scored on its whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import forget, prepare, quoted, whole_row, written

ROWS = 1 << 14  # hashed words
WIDTH = 32  # of a word vector
NEAR = 2  # words to either side that count as context
SPARSE = 4  # entries of an index vector
CACHE = 400_000
CHUNK = 200_000  # words whose contexts are added at once
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each row's index vector; fixed by the seed."""
    rng = np.random.default_rng(20260)
    return rng.integers(0, WIDTH, (ROWS, SPARSE)), rng.choice([-1.0, 1.0], (ROWS, SPARSE))


def shape(word: str) -> str:
    return DIGITS.sub("0", LETTERS.sub("a", word))


def code(word: str) -> int:
    """The rows of a word and of its shape in one number."""
    return zlib.crc32(word.lower().encode()) % ROWS + zlib.crc32(b"\x00" + shape(word).encode()) % ROWS * ROWS


class Words:
    """Rows of words and of their shapes, remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def rows(self, text: str) -> np.ndarray:
        """(words, 2): the rows of each word and its shape, in order."""
        known, words = self.known, text.split()
        try:
            got = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = {w: code(w) for w in set(words) if w not in known}
            got = np.fromiter((known[w] if w in known else new[w] for w in words), np.int64, len(words))
            if len(known) + len(new) <= CACHE:
                known.update((w, c) for w, c in new.items() if len(w) <= 64)
        return np.stack([got % ROWS, got // ROWS], axis=1)


def context_sums(texts, words: Words) -> np.ndarray:
    """(ROWS * WIDTH,): for each row the sum of the index vectors near it in the texts; whole numbers, so their order does not matter."""
    place, sign = index_vectors()
    out, held, n = np.zeros(ROWS * WIDTH, np.int64), [], 0
    gap = np.full((NEAR, 2), -1)  # texts are no context of each other

    def add(r):
        for k in range(1, NEAR + 1):
            for c in (0, 1):
                a, b = r[:-k, c], r[k:, c]
                for i in range(0, len(a), CHUNK):
                    x, y = a[i : i + CHUNK], b[i : i + CHUNK]
                    real = (x >= 0) & (y >= 0)
                    for row, ctx in ((x[real], y[real]), (y[real], x[real])):
                        got = np.bincount((row[:, None] * WIDTH + place[ctx]).ravel(), sign[ctx].ravel(), ROWS * WIDTH)
                        np.add(out, got.astype(np.int64), out=out)

    for text in texts:
        held += [words.rows(text or ""), gap]
        n += len(held[-2])
        if n >= CHUNK:
            add(np.concatenate(held))
            held, n = [], 0
    if held:
        add(np.concatenate(held))
    return out


def corpus_vectors(docs: DataFrame, text_col: str = "text", fan: int = 8, rows_a_task: int = 50_000) -> np.ndarray:
    """Word vectors from all documents: a table of sums a task, added ``fan`` at a time until ``fan`` are left for the driver (at most 32 MB)."""
    texts = docs.select(F.col(quoted(text_col)).alias("text"))
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(docs.count() / rows_a_task))
    kind = "task long, sums binary"

    def pack(x: np.ndarray) -> bytes:
        return zlib.compress(x.tobytes(), 1)

    def unpack(x: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(x), np.int64)

    def sums(batches):
        import pandas as pd
        from pyspark import TaskContext

        words = Words()
        total = context_sums((t for pdf in batches for t in pdf["text"]), words)
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "sums": [pack(total)]})

    def add(pdf):
        import pandas as pd

        return pd.DataFrame({"task": [int(pdf["task"].iloc[0])], "sums": [pack(sum(map(unpack, pdf["sums"])))]})

    got = written(texts.coalesce(tasks).mapInPandas(sums, kind), "quality-sums")
    while got.count() > fan:
        below, got = got, written(got.withColumn("task", F.expr(f"task div {fan}")).groupBy("task").applyInPandas(add, kind), "quality-sums")
        forget(below)
    whole = sum((unpack(r.sums) for r in got.select("sums").collect()), np.zeros(ROWS * WIDTH, np.int64))
    return word_vectors(whole.reshape(ROWS, WIDTH).astype(np.float64)).astype(np.float32)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)


FEATURES = 4 * WIDTH + 7


def pooled(text: str | None, vectors: np.ndarray, words: Words) -> np.ndarray:
    """Features of a whole text; all zero where it has no words.  Words the fit has not seen have a zero vector."""
    out = np.zeros(FEATURES, np.float32)
    r = words.rows(text or "")
    if not len(r):
        return out
    n = len(r)
    which, count = np.unique(r[:, 0], return_counts=True)
    shapes, times = np.unique(r[:, 1], return_counts=True)
    for at, rows, c in ((0, which, count), (2 * WIDTH, shapes, times)):
        v, share = vectors[rows], (c / n).astype(np.float32)
        mean = share @ v
        out[at : at + WIDTH] = mean
        out[at + WIDTH : at + 2 * WIDTH] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    common = (count / n).max()
    seen = (np.abs(vectors[which]).sum(1) > 0) @ (count / n)
    out[4 * WIDTH :] = np.log1p(n) / 8, len(which) / n, common, seen, len(shapes) / n, len(text) / (n * 10), (r[1:, 0] == r[:-1, 0]).sum() / n
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 120, seed: int = 7) -> Model:
    """Full-batch Adam with weight decay on four fifths of the rows; the step with the least loss on the rest stays, and its temperature is fitted there.

    With fewer than two classes or ten rows the score is the share of label 1, one half without labels.
    """
    n, d = x.shape
    if n < 10 or len(set(y.tolist())) < 2:
        p = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
        return Model(vectors, np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    fit, rest = order[n // 5 :], order[: n // 5]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    loss = lambda t, s: float(np.mean(np.logaddexp(0, t) - s * t))
    best: tuple = (np.inf, None)
    for step in range(1, epochs * 4 + 1):
        h = np.tanh(z[fit] @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[fit]) / len(fit)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [z[fit].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if step % 5 == 0:
            now = loss(np.tanh(z[rest] @ p[0] + p[1]) @ p[2] + p[3], y[rest])
            if now < best[0]:
                best = (now, [a.copy() for a in p])
    p = best[1]
    raw = np.tanh(z[rest] @ p[0] + p[1]) @ p[2] + p[3]
    heat = min(np.geomspace(0.25, 8, 61), key=lambda t: loss(raw / t, y[rest]))
    return Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), float(heat))


def held_out(doc_id: Column) -> Column:
    """Whether the row's label is kept from the fit: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, tasks: int = 8) -> Model:
    """Fit on labelled rows whose id is not held out.

    At most ``sample`` ids are used, those of least hash, each with one row: of labels that repeat an id the
    greatest counts, of documents the text of least hash.  Documents are found by a join that broadcasts only
    these labels, so at most ``sample`` rows of features reach the driver, beside the sums of word contexts.
    Null ids, null labels and labels without a document are left out.
    """
    ids = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).where("id is not null and y is not null")
    ids = ids.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = written(rows.select("id", "text", "y").repartition(tasks, "id"), "quality-sample")
    vectors = corpus_vectors(docs, text_col)

    def features(batches):
        import pandas as pd

        words = Words()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "x": [pooled(t, vectors, words).tobytes() for t in pdf["text"]]})

    data = sorted(rows.mapInPandas(features, f"id {dict(rows.dtypes)['id']}, y int, x binary").collect())
    x = np.array([np.frombuffer(r.x, np.float32) for r in data], np.float64).reshape(-1, FEATURES)
    return fit_network(vectors, x, np.array([float(r.y > 0) for r in data]))


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns of every row of docs and ``score``, the probability of good quality, on the whole text."""
    keep = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)], F.col(quoted(text_col)).alias("text"))
    own = [f"c{i}" for i in range(len(columns))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        words, m = Words(), shared.value
        for b in batches:
            x = np.array([pooled(t, m.vectors, words) for t in b.column(len(own)).to_pylist()], np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.score(x), pa.float64())], [*own, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.schema.fields[:-1])
    return keep.mapInArrow(work, f"{schema}, score double").toDF(*columns, "score")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """Score every row of docs: ``id_col``, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    A null text is empty and is scored like any other; a null id counts as not held out; rows that repeat
    a text have equal scores; an empty table gives no rows.  Only the text enters a score.
    """
    prepare(docs.sparkSession)
    scored = score(docs, fit(docs, labels, id_col, text_col, **options), [id_col], text_col)
    own = F.col(quoted(id_col))
    return scored.select(own, held_out(own).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns, whatever their names.

    A null text is empty and is scored like any other; rows with a null id, and rows that repeat an id or a
    text, are each judged by their text; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, **options)
    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(text_col)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        words, m = Words(), shared.value
        return pd.Series(m.score(np.array([pooled(t, m.vectors, words) for t in texts], np.float64).reshape(-1, FEATURES)))

    return rows.where(probability("text") >= threshold).select("row.*")
