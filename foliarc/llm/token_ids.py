"""Token ids in a binary file format of fixed-width bit packing.

Every id takes the bits of the largest id of the vocabulary.  A file ("shard") holds the documents of one
range of ids in ascending order: a header, the documents' ids and ends, block offsets, then blocks of
BLOCK ids, each starting on a whole byte, so that a block or any run of ids is unpacked by numpy without
reading what lies before it.

Documents are dealt by ranges of doc_id that hold about as many characters each; an id with more than that
has several ranges.  A range is encoded and written in one pass, as one shard or, where its ids are more
than a task should hold, as several; a lost task writes its shards again.
"""

from __future__ import annotations

import functools
import json
import math
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.llm.common import file_system, new_folder, prepare, put_file, quoted

MAGIC = b"IDPACK01"
HEAD = struct.Struct("<8sIIQQQ")  # magic, bits, ids per block, documents, ids, blocks
BLOCK = 4096
END_ID = 2
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in SHOWN)}
CACHE = 1_000_000  # words whose ids a worker remembers, at most
HELD = 1 << 24  # ids a task gathers before it writes a shard
WEIGHT = 4096  # characters to a unit, when ranges are cut


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids as consecutive fields of ``bits`` bits, the least significant bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    field = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(field.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first count ids of a packed block."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype("<u4")
    field = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (field.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def shard_bytes(doc_ids: list, ends: np.ndarray, ids: np.ndarray, bits: int) -> list[bytes]:
    """A shard's parts in order; ends[i] is the number of ids up to the end of document i; a None id is kept as null."""
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    return [HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids), len(blocks)), null.tobytes(), keys.tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *blocks]


class Shard:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.file = system.open_input_file(path)
        magic, self.bits, self.block, n, self.n_ids, blocks = HEAD.unpack(self.file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a file of packed ids")
        null = np.frombuffer(self.file.read(n), np.uint8)
        keys = np.frombuffer(self.file.read(8 * n), "<i8")
        self.doc_ids = [None if x else int(k) for x, k in zip(null, keys, strict=True)]
        self.ends = np.frombuffer(self.file.read(8 * n), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.at = self.file.tell()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, reading only their blocks."""
        if stop <= start:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (stop - 1) // self.block
        self.file.seek(self.at + self.offsets[a])
        data = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        each = [data[self.offsets[i] - self.offsets[a] : self.offsets[i + 1] - self.offsets[a]] for i in range(a, b + 1)]
        out = np.concatenate([unpack_bits(x, min(self.block, self.n_ids - i * self.block), self.bits) for i, x in enumerate(each, a)])
        return out[start - a * self.block : stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, piece: int = 1 << 22) -> Iterable[tuple]:
        """(doc_id, start in the shard, ids) of all documents, read in long runs."""
        i = 0
        while i < len(self.ends):
            start = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, start + piece, "right")))
            run = self.ids(start, int(self.ends[j - 1]))
            for k in range(i, j):
                a = int(self.ends[k - 1]) if k else 0
                yield self.doc_ids[k], a, run[a - start : int(self.ends[k]) - start]
            i = j


class Encoder:
    """Whole-text encoding with a byte-level BPE of the tokenizers library, remembering words.

    Such an encoding cuts a text into words before it merges bytes, and a single space or newline between
    other characters always starts a word of its own or with what follows.  So each piece between them is
    encoded once by the library and then looked up.  Texts with other white space, those that contain a
    special token, and all texts where the vocabulary's pre-tokenizer is not exactly of that kind (it has
    a pattern of its own, adds a space before a text, or normalises), are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        pre = parts["pre_tokenizer"] or {}
        plain = parts["model"].get("dropout") is None and not parts["model"].get("ignore_merges")
        self.by_word = plain and parts["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.known: dict[str, bytes] = {x: self.whole(x) for x in ("\n", ".", ",")} if self.by_word else {}

    def whole(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, encoded in one piece."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word or not text or "\x00" in text or " ".join(text.split()) != text.replace("\n", " ") or any(s in text for s in self.special):
            return np.frombuffer(self.whole(text), "<u4")
        known = self.known
        words = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
        except KeyError:
            got = self.learn({w for w in words if w not in known})
        return np.frombuffer(b"".join([known[w] if w in known else got[w] for w in words]), "<u4")

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words, kept while there is room.  A full stop or comma that ends a word after a letter is a word of its own."""
        stem = {w: w[:-1] if w[-1] in ".," and w[-2:-1].isalpha() else w for w in words}
        new = {w for w in stem.values() if w not in self.known}
        plain = [w for w in new if w.removeprefix(" ").isalpha()]
        rest = [*new.difference(plain)]
        merge = self.tokenizer.model.tokenize  # letters alone are one word: only its bytes are to be merged
        got = {w: np.array([t.id for t in merge(w.encode().decode("latin1").translate(BYTES))], "<u4").tobytes() for w in plain}
        got |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        for w, s in stem.items():
            if s is not w:
                got[w] = (got.get(s) or self.known[s]) + self.known[w[-1]]
        if len(self.known) + len(got) <= CACHE:
            self.known |= got
        return got


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _ranges(d: DataFrame, shard_chars: int) -> tuple[list, int, int]:
    """(cuts, ranges of ids, ranges of null ids): ranges end at the cuts; a cut that repeats is an id that fills several."""
    tasks = d.sparkSession.sparkContext.defaultParallelism
    units = F.ceil((F.length("text") + 1) / WEIGHT).cast("long")
    s = d.agg(F.sum(F.when(F.col("doc_id").isNotNull(), units)).alias("ids"), F.sum(F.when(F.col("doc_id").isNull(), units)).alias("none")).first()
    size = max(1, min(shard_chars // WEIGHT, math.ceil(((s["ids"] or 0) + (s["none"] or 0)) / tasks)))
    n, none = max(1, math.ceil((s["ids"] or 0) / size)), max(1, math.ceil((s["none"] or 0) / size))
    if n == 1:
        return [], 1, none
    each = d.where("doc_id is not null").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), units)))
    return each.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0], n, none


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = 40_000_000, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text of docs, append end_id to each and write shards; returns (shard, part, path, documents, ids), in this order.

    tokenizer: path of a tokenizers file that exists on every worker.  Ranges of doc_id are cut for about
    shard_chars characters each; a null text is empty; null ids come last; rows that repeat an id follow each
    other, in as many ranges as they need.  A task holds at most HELD ids and one document more.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    cuts, n, none = _ranges(d, shard_chars)
    salt = lambda k: F.pmod(F.xxhash64("text"), k.cast("long") if isinstance(k, Column) else F.lit(k)).cast("int")
    shard = F.lit(0)
    if cuts:
        each = F.array(*[F.lit(x).cast("long") for x in cuts])
        own = F.size(F.filter(each, lambda x: x == F.col("doc_id")))
        shard = F.size(F.filter(each, lambda x: x < F.col("doc_id"))) + F.when(own > 1, salt(F.greatest(own, F.lit(1)))).otherwise(0)
    shard = F.when(F.col("doc_id").isNull(), n + salt(none)).otherwise(shard)
    dealt = d.withColumn("shard", shard.cast("int")).repartitionById(n + none, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last())

    def write(batches):
        import pyarrow as pa

        enc, now, part, keys, lengths, ids, held = encoder(tokenizer), None, 0, [], [], [], 0

        def put():
            path = f"{folder}/shard-{now:08d}-{part:04d}.ids"
            flat = np.concatenate(ids)
            ends = np.cumsum(np.array(lengths, np.int64))
            parts = shard_bytes(keys, ends, flat, enc.bits)
            put_file(path, lambda out: [out.write(x) for x in parts])
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "part": pa.array([part], pa.int32()), "path": [path], "documents": pa.array([len(keys)], pa.int64()), "ids": pa.array([len(flat)], pa.int64())})

        for batch in batches:
            for key, text, to in zip(batch["doc_id"], batch["text"], batch["shard"], strict=True):
                to = to.as_py()
                if to != now or held >= HELD:
                    if keys:
                        yield put()
                    now, part = to, part + 1 if to == now else 0
                    keys, lengths, ids, held = [], [], [], 0
                got = np.append(enc.ids(text.as_py()), np.uint32(end_id))
                keys.append(key.as_py())
                lengths.append(len(got))
                ids.append(got)
                held += len(got)
        if keys:
            yield put()

    kind = "shard int, part int, path string, documents long, ids long"
    dealt.mapInArrow(write, kind).write.parquet(f"{folder}/manifest")
    return spark.read.schema(kind).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the shards, start counting over all of them.

    The manifest has a row a shard; that is all that meets in one task to add up starts.
    """
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    m = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    m = m.repartition(max(1, manifest.count()))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
                cols: tuple = ([], [], [], [])
                for key, start, ids in Shard(path).documents():
                    for c, x in zip(cols, (key, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), (pa.array(c, pa.int64()) for c in cols), strict=True)))

    return m.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write docs as shards of packed ids and describe every document as read back from them.

    One row per row of docs: doc_id, start (ids of all documents before it), n_tokens (with the end id),
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers).  An empty table gives no shards and no
    rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    return read_shards(write_shards(docs, tokenizer, folder or new_folder(docs.sparkSession, "token-ids"), **options))
