"""Language of texts: script ranges narrow the candidates, Viterbi over the words labels spans.

A word is a run of letters with the marks that combine with them.  A language scores it by the logarithms of
how common its n-grams of three and of five letters (word ends included) are in that language's texts.  A word
written in one script is scored only by languages that use that script.  Over the words of a text the path of
languages with the greatest sum of scores is found, less a penalty for each switch, so that mixed text falls
into spans.  Everything is done on arrays of code points, without a loop over words except where a text mixes.

What is learned is a table of counts by language, of fixed size whatever the corpus, from all labelled texts.
"""

from __future__ import annotations

import functools
import math
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import forget, prepare, quoted, written

BUCKETS = 1 << 15  # hashed n-grams of an order, a power of two
ORDERS = 2  # n-grams of three and of five letters
SMOOTH = 0.5
PENALTY = 12.0  # of a switch, in units of word scores
USED = 0.001  # share of a language's letters from which a script is one of its own
FOREIGN = -4.0  # score of a letter in a script that a language does not use
PIECE = 1 << 16  # code points worked on at once
FAN = 8  # tables of counts added at once
ROWS_A_TASK = 50_000
STRETCH = 64  # letters by which evidence for one language over another is full
UNKNOWN = "und"

#: First and last code point of the letters of each script; what is listed nowhere is script 0.
SCRIPTS = [
    ("Latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F), (0xA8E0, 0xA8FF)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Gurmukhi", [(0xA00, 0xA7F)]),
    ("Gujarati", [(0xA80, 0xAFF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Kannada", [(0xC80, 0xCFF)]),
    ("Malayalam", [(0xD00, 0xD7F)]),
    ("Sinhala", [(0xD80, 0xDFF)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]),
    ("Myanmar", [(0x1000, 0x109F)]),
    ("Georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Ethiopic", [(0x1200, 0x139F)]),
    ("Khmer", [(0x1780, 0x17FF)]),
    ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
KINDS = len(SCRIPTS) + 1


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: 2 a letter, 1 a combining mark, 0 neither; its lower case, where that is one code point; its script."""
    n = sys.maxunicode + 1
    kind, lower, script = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
    for c in range(n):
        s = chr(c)
        if s.isalpha():
            kind[c] = 2
            small = s.lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif c >= 0x300 and unicodedata.category(s)[0] == "M":
            kind[c] = 1
    for k, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return kind, lower, script


@dataclass
class Words:
    """The words of some code points, in order."""

    start: np.ndarray  # of each word
    end: np.ndarray
    letters: np.ndarray  # code points of each that are letters
    script: np.ndarray  # 0 where a word mixes scripts
    first: np.ndarray  # where each word's n-grams begin
    grams: np.ndarray  # (ORDERS, n): hashed n-grams around each code point of a word


def words_of(points: np.ndarray) -> Words:
    """A mark without a letter before it starts no word."""
    kind, lower, script = characters()
    k = kind[points]
    inside = k > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    many = np.concatenate([[0], np.cumsum(k == 2)])
    real = many[end] > many[start]
    start, end = start[real], end[real]
    at = np.flatnonzero(inside)
    if len(real) and not real.all():
        keep = np.zeros(len(points) + 1, np.int8)
        keep[start] += 1
        keep[end] -= 1
        at = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
    none = np.zeros(0, np.int64)
    if not len(start):
        return Words(none, none, none, none, none, np.zeros((ORDERS, 0), np.int64))
    size = end - start
    first = np.cumsum(size) - size
    # letters of all words in a row, two gaps between neighbours, so that n-grams never reach into another word
    room = np.zeros(len(at) + 2 * (len(start) + 1), np.uint64)
    place = np.arange(len(at)) + 2 * (np.repeat(np.arange(len(start)), size) + 1)
    room[place] = lower[points[at]]
    three = (room[place - 1] * np.uint64(0x9E3779B1) + room[place]) * np.uint64(0x85EBCA77) + room[place + 1]
    five = (three * np.uint64(0xC2B2AE3D) + room[place - 2]) * np.uint64(0x27D4EB2F) + room[place + 2]
    grams = np.stack([_mix(three), _mix(five)])
    s = script[points[at]]
    s = np.where(k[at] == 2, s, np.uint8(255))
    low = np.minimum.reduceat(s, first)
    high = np.maximum.reduceat(np.where(s == 255, np.uint8(0), s), first)
    return Words(start, end, many[end] - many[start], np.where(low == high, low, 0).astype(np.int64), first, grams)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, text of each, where in its text each stands) of the texts in turn, about PIECE code points at a time.

    Long texts are cut between words; a run of over PIECE letters counts as several words.
    """
    kind = characters()[0]
    held, size = [], 0
    for i, text in enumerate(texts):
        p = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = 0
        while at < len(p):
            cut = min(len(p), at + PIECE)
            if cut < len(p):
                gaps = np.flatnonzero(kind[p[at:cut]] == 0)
                cut = at + int(gaps[-1]) + 1 if len(gaps) else cut
            held.append((p[at:cut], i, at))
            size += cut - at + 1
            at = cut
            if size >= PIECE:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    gap = np.zeros(1, np.uint32)  # texts share no word
    points = np.concatenate([x for p, _, _ in held for x in (p, gap)])
    sizes = [len(p) + 1 for p, _, _ in held]
    text = np.repeat([i for _, i, _ in held], sizes)
    at = np.concatenate([np.arange(a, a + n) for (_, _, a), n in zip(held, sizes)])
    return points, text, at


@dataclass
class Model:
    names: list[str]  # of languages
    weight: np.ndarray  # (languages, ORDERS, BUCKETS): log of n-gram shares over the orders
    used: np.ndarray  # (KINDS, languages): whether a language uses a script; all may use words of mixed script
    penalty: float = PENALTY

    def scores(self, w: Words) -> np.ndarray:
        """(words, languages)."""
        s = np.empty((len(w.start), len(self.names)))
        for i, table in enumerate(self.weight):
            got = table[0].take(w.grams[0])
            for o in range(1, ORDERS):
                got += table[o].take(w.grams[o])
            s[:, i] = np.add.reduceat(got, w.first)
        if self.used[np.bincount(w.script, minlength=1).nonzero()].all():
            return s
        s[~self.used[w.script].any(1)] = 0
        known = self.used[w.script].any(1)
        away = known[:, None] & ~self.used[w.script]
        s = np.where(away, -np.inf, s)
        best = np.where(known[:, None] & ~away, s, -np.inf).max(1)
        return np.where(away, best[:, None] + FOREIGN * w.letters[:, None], s)


def path(s: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on a best path.

    A run of words outside the language of the greatest sum costs a switch at each of its ends within the
    text, so one that gains less is on no better path.  Only where runs that gain as much exist is the path
    searched; every other word has that language.
    """
    n, k = s.shape
    lead = int(s.sum(0).argmax())
    out = np.full(n, lead)
    if k == 1:
        return out
    rest = s.copy()
    rest[:, lead] = -np.inf
    gain = np.cumsum(functools.reduce(np.maximum, rest.T) - s[:, lead])
    most = np.maximum.accumulate(gain[::-1])[::-1]
    least = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    search = (most - least >= 2 * penalty) | (most >= penalty) | (gain[-1] - least >= penalty)
    if search.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[False], search, [False]]).astype(np.int8)))
        only = np.full((1, k), -np.inf)
        only[0, lead] = 0
        find = _path if k <= 16 else _path_wide
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # what is next to a stretch has the lead's language
            own = find(np.concatenate([only[: a > 0], s[a:b], only[: b < n]]), penalty)
            out[a:b] = own[int(a > 0) : int(a > 0) + b - a]
    return out


def _path(s: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi over all words; of equally good paths that which stays, then the first language."""
    back = []
    now = s[0].tolist()
    for row in s[1:].tolist():
        top = max(now)
        turn = top - penalty
        back.append((now.index(top), [x < turn for x in now]))
        now = [(x if x >= turn else turn) + y for x, y in zip(now, row)]
    out = np.empty(len(s), np.int64)
    j = out[-1] = now.index(max(now))
    for t in range(len(s) - 2, -1, -1):
        at, turned = back[t]
        if turned[j]:
            j = at
        out[t] = j
    return out


def _path_wide(s: np.ndarray, penalty: float) -> np.ndarray:
    """As _path, by arrays over the languages."""
    n = len(s)
    back = np.empty(s.shape, np.uint16)
    now, own = s[0].copy(), np.arange(s.shape[1], dtype=np.uint16)
    for t in range(1, n):
        at = int(now.argmax())
        turn = now[at] - penalty
        stay = now >= turn
        back[t] = np.where(stay, own, at)
        now = np.where(stay, now, turn) + s[t]
    out = np.empty(n, np.int64)
    j = out[-1] = int(now.argmax())
    for t in range(n - 1, 0, -1):
        j = out[t - 1] = back[t, j]
    return out


def label(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
    """Of each text its language, a score and its spans (start, end, language), all of whose neighbours differ."""
    k, spans = len(model.names), [[] for _ in texts]
    letters = np.zeros((len(texts), max(k, 1)), np.int64)
    evidence: list[dict[int, np.ndarray]] = [{} for _ in texts]  # sums of the scores of the words given to a language
    for points, text, at in pieces(texts) if k else ():
        w = words_of(points)
        if not len(w.start):
            continue
        s = model.scores(w)
        own = text[w.start]
        cuts = np.flatnonzero(np.diff(own)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
            i, p = int(own[a]), path(s[a:b], model.penalty)
            letters[i] += np.bincount(p, w.letters[a:b], k).astype(np.int64)
            turns = np.flatnonzero(np.diff(p)) + 1
            for c, d in zip([0, *turns.tolist()], [*turns.tolist(), b - a]):
                j = int(p[c])
                evidence[i][j] = evidence[i].get(j, 0) + s[a + c : a + d].sum(0)
                start, end = int(at[w.start[a + c]]), int(at[w.end[a + d - 1] - 1]) + 1
                if spans[i] and spans[i][-1][2] == model.names[j]:
                    start = spans[i].pop()[0]
                spans[i].append((start, end, model.names[j]))
    names, scores = [], []
    for n, e in zip(letters, evidence):
        if not e:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = max(e, key=lambda j: (n[j], e[j][j], -j))
        # evidence counts by letter, up to STRETCH of them, so that long texts are not all certain
        sure = e[best] * min(1.0, STRETCH / n[best])
        odds = np.exp(np.clip(sure - sure.max(), -60, 0))
        names.append(model.names[best])
        scores.append(float(n[best] / n.sum() * odds[best] / odds.sum()))
    return names, scores, spans


def held_out(doc_id: Column) -> Column:
    """Whether nothing is learned from the row: crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 256, penalty: float = PENALTY) -> Model:
    """The model of all rows with a language and a text.

    With more than ``most`` languages those of most rows are learned.  A task adds up a table by language of
    its rows, the tables are added FAN at a time, and the driver gets one for each language.
    """
    rows = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).alias("text")).where("lang is not null and text is not null")
    rank = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    names, seen = sorted(r["lang"] for r in rank), sum(r["count"] for r in rank)
    width = ORDERS * BUCKETS + KINDS
    if not names:
        return Model([], np.zeros((0, ORDERS, BUCKETS), np.float32), np.zeros((KINDS, 0), bool), penalty)
    number = {x: i for i, x in enumerate(names)}

    def count(batches):
        import pandas as pd
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                if lang in number:
                    sums = total.setdefault(number[lang], np.zeros(width, np.int64))
                    for points, _, _ in pieces(list(texts)):
                        w = words_of(points)
                        for o in range(ORDERS):
                            sums[o * BUCKETS : (o + 1) * BUCKETS] += np.bincount(w.grams[o], minlength=BUCKETS)
                        sums[ORDERS * BUCKETS :] += np.bincount(w.script, w.letters, KINDS).astype(np.int64)
        for i, sums in total.items():
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "lang": [i], "sums": [_pack(sums)]})

    def add(pdf):
        import pandas as pd

        return pd.DataFrame({"task": pdf["task"].iloc[:1], "lang": pdf["lang"].iloc[:1], "sums": [_pack(sum(map(_unpack, pdf["sums"])))]})

    kind = "task long, lang int, sums binary"
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(seen / ROWS_A_TASK))
    got = written(rows.coalesce(tasks).mapInPandas(count, kind), "language-counts")
    while tasks > 1:  # FAN tables at a time
        tasks = math.ceil(tasks / FAN)
        below, got = got, written(got.withColumn("task", F.expr(f"task div {FAN}")).groupBy("task", "lang").applyInPandas(add, kind), "language-counts")
        forget(below)
    table = np.zeros((len(names), width))
    for r in got.collect():
        table[r["lang"]] = _unpack(r["sums"])
    return _model(names, table, penalty)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.int64)


def _model(names: list[str], table: np.ndarray, penalty: float) -> Model:
    grams, scripts = table[:, : ORDERS * BUCKETS].reshape(-1, ORDERS, BUCKETS), table[:, ORDERS * BUCKETS :]
    shares = (grams + SMOOTH) / (grams.sum(2, keepdims=True) + SMOOTH * BUCKETS)
    used = scripts > USED * np.maximum(scripts.sum(1, keepdims=True), 1)
    used[:, 0] = True
    return Model(names, (np.log(shares) / ORDERS).astype(np.float32), np.ascontiguousarray(used.T), penalty)


def predict(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The given columns of every row of docs, and lang_pred, score, spans (array of start, end, lang; end exclusive)."""
    keep = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)], F.col(quoted(text_col)).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<start:long,end:long,lang:string>>"

    def work(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for b in batches:
            names, score, spans = label(b.column(len(columns)).to_pylist(), shared.value)
            spans = pa.array([[{"start": x, "end": y, "lang": z} for x, y, z in own] for own in spans], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64()), spans], [*b.schema.names[:-1], "lang_pred", "score", "spans"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.schema.fields[:-1])
    return keep.mapInArrow(work, f"{schema}, lang_pred string, score double, spans {span}").toDF(*columns, "lang_pred", "score", "spans")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Language of every row's whole text: ``id_col``, held_out, lang_pred, score, spans.

    Learned from the rows that are not held out and have a language and a text; only the text enters a
    prediction.  lang_pred is the language of most letters of the text's spans, of equals that which its words
    score higher, then the first by name; score is its share of the letters times how far its words favour it.  A text
    that is null, empty or has no letter is ``und`` with score 0 and no spans; so is every text where nothing
    was learned.  Words in scripts that no language uses say nothing, and take the language around them.  Rows
    that repeat a text have equal results; null and repeated ids are rows of their own; an empty table gives no
    rows; other columns are not read.  Options are those of ``learn``.
    """
    prepare(docs.sparkSession)
    model = learn(docs.where(~held_out(F.col(quoted(id_col)))), text_col, lang_col, **options)
    found = predict(docs, model, [id_col], text_col)
    return found.select(F.col(quoted(id_col)), held_out(F.col(quoted(id_col))).alias("held_out"), "lang_pred", "score", "spans")
