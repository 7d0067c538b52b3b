"""LAS files as a Spark source, stream and sink, read in ranges of bytes and written one file per task.

    register(spark)
    spark.read.format("las").load(path)          # x, y, z, intensity, red, green, blue, raw_class, treeid, file, ord, error
    spark.readStream.format("las").option("log", folder).load(path)
    df.write.format("las").option("point_format", 7).option("path", folder).mode("append").save()
    read_files(list_files(spark, path, "*.las"), columns=["x", "y", "z"])     # from a table of files

Point formats 0 to 10 of LAS 1.0 to 1.4 are read and written (not their compressed form); an extra-bytes field
named treeid is found by its record.  Planning lists names and sizes only: a task opens the headers of the files
whose bytes it reads.  Filters on ``file`` are pushed down, which ``register`` switches on for Python sources;
option ``columns`` names the columns to make.  A file that cannot be read is one row with its error and
nothing else, unless option ``errors`` is ``raise``.  With option ``raw`` every point has its whole record as
well, which ``write_like`` puts into a file with the header of the one it came from.  Paths may be on any file
system that Arrow reads.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from foliarc.shared import attach, file_system, prepare, put_file

SCHEMA = "x double, y double, z double, intensity int, red int, green int, blue int, raw_class int, treeid long, file string, ord long, error string"
BYTES = 32 << 20  # of a read task
SMALL = 64 << 10  # bytes that opening a file counts as
RECORDS = 200_000  # of a batch

# Fields of the point formats.
CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("raw", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
CORE6 = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("raw", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
TIME = [("time", "<f8")]
RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
NIR = [("nir", "<u2")]
WAVE = [("wave", "V29")]
FORMATS = {0: CORE, 1: CORE + TIME, 2: CORE + RGB, 3: CORE + TIME + RGB, 4: CORE + TIME + WAVE, 5: CORE + TIME + RGB + WAVE, 6: CORE6, 7: CORE6 + RGB, 8: CORE6 + RGB + NIR, 9: CORE6 + WAVE, 10: CORE6 + RGB + NIR + WAVE}
EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
HEADER = struct.Struct("<4sHHIHH8sBB32s32sHHHIIBHI5I12d")  # LAS 1.2, 227 bytes
COUNT_14 = 247  # where LAS 1.4 has the number of points, eight bytes, followed by fifteen numbers by return


@dataclass
class Layout:
    """What a header says about the records."""

    start: int
    count: int
    dtype: np.dtype
    scale: tuple
    offset: tuple


def layout(uri: str) -> Layout:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        raw = f.read(HEADER.size)
        if len(raw) < HEADER.size or raw[:4] != b"LASF":
            raise ValueError("not a LAS file")
        h = HEADER.unpack(raw)
        size, start, vlrs, fmt, length, count = h[13], h[14], h[15], h[16], h[17], h[18]
        if fmt not in FORMATS:
            raise ValueError(f"point format {fmt} is not read; 0 to 10 without compression are")
        if h[8] >= 4:
            f.seek(COUNT_14)
            count = struct.unpack("<Q", f.read(8))[0]
        fields = list(FORMATS[fmt])
        f.seek(size)
        extra: list = []
        for _ in range(vlrs):
            head = f.read(54)
            user, record, n = head[2:18].rstrip(b"\0"), *struct.unpack("<HH", head[18:22])
            body = f.read(n)
            if user == b"LASF_Spec" and record == 4:
                extra = [(body[i + 4 : i + 36].rstrip(b"\0").decode(), EXTRA[body[i + 2]]) for i in range(0, n, 192) if body[i + 2] in EXTRA]
        taken = {name for name, _ in fields}
        extra = [(name if name and name not in taken else f"extra{i}", kind) for i, (name, kind) in enumerate(extra)]
        used = np.dtype(fields + extra).itemsize
        if used > length:
            raise ValueError(f"records of {length} bytes are shorter than their fields")
        fields += extra + ([("pad", f"V{length - used}")] if length > used else [])
        if f.size() < start + count * length:
            raise ValueError(f"the file ends before its {count} records do")
    return Layout(start, count, np.dtype(fields), h[24:27], h[27:30])


def columns_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def schema_of(columns: Sequence[str] | None, raw: bool) -> str:
    """The columns asked for, in the order of SCHEMA; file, ord and error are always among them."""
    every = SCHEMA.split(", ") + ["record binary"] * raw
    if columns is None:
        return ", ".join(every)
    if unknown := set(columns) - {x.split()[0] for x in every}:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return ", ".join(x for x in every if x.split()[0] in {*columns, "file", "ord", "error"} or x.startswith("record"))


def read_range(path: str, start: int, end: int, schema: str, step: int = RECORDS, strict: bool = False) -> Iterator:
    """Record batches of the records of a file that begin at bytes start to end; of a broken file the range from 0 has the error."""
    import pyarrow as pa

    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kind = {c: kinds[k] for c, k in (x.split() for x in schema.split(", "))}
    try:
        lay = layout(path)
    except Exception as e:
        if strict:
            raise ValueError(f"{path}: {e}") from e
        if start == 0:
            yield pa.RecordBatch.from_arrays([pa.array([{"file": path, "ord": 0, "error": str(e)}.get(c)], k) for c, k in kind.items()], list(kind))
        return
    size = lay.dtype.itemsize
    first, last = (min(lay.count, max(0, -(-(at - lay.start) // size))) for at in (start, end))
    if first >= last:
        return
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        f.seek(lay.start + first * size)
        for i in range(first, last, step):
            a = np.frombuffer(f.read(min(step, last - i) * size), lay.dtype)
            yield pa.RecordBatch.from_arrays([pa.array(_column(a, c, lay, path, i, pa), k) if c not in ("file", "error") else _column(a, c, lay, path, i, pa) for c, k in kind.items()], list(kind))


def _column(a: np.ndarray, c: str, lay: Layout, path: str, first: int, pa):
    n, names = len(a), a.dtype.names
    if c in ("x", "y", "z"):
        i = "xyz".index(c)
        return a[c.upper()].astype(np.float64) * lay.scale[i] + lay.offset[i]
    if c == "raw_class":
        return (a["raw"] & (255 if "returns" in names else 31)).astype(np.int32)
    if c == "ord":
        return np.arange(first, first + n)
    if c == "file":
        return pa.array([path]).take(pa.array(np.zeros(n, np.int32)))
    if c == "error":
        return pa.nulls(n, pa.string())
    if c == "record":
        return [r.tobytes() for r in a]
    kind = np.int64 if c == "treeid" else np.int32
    return a[c].astype(kind) if c in names else np.zeros(n, kind)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all .las files below a folder, by path."""
    from pyarrow import fs

    system, name = file_system(path)
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    return sorted((head + i.path, i.size) for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".las"))


class Ranges(InputPartition):
    """(path, start, end) of what a task reads; several small files make one task."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


def ranges(files: Sequence[tuple[str, int]], size: int = BYTES) -> list[Ranges]:
    out, held, used = [], [], 0
    for path, n in files:
        for start in range(0, max(n, 1), size):
            cost = max(SMALL, min(size, n - start))
            if held and used + cost > size:
                out.append(Ranges(held))
                held, used = [], 0
            held.append((path, start, start + size))
            used += cost
    return [*out, Ranges(held)] if held else out


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options):
        self.path = options["path"]
        self.size, self.step = int(options.get("bytes", BYTES)), int(options.get("records", RECORDS))
        self.strict = options.get("errors", "row") == "raise"
        self.schema = _schema(options)

    def read(self, partition):
        for path, start, end in partition.parts:
            yield from read_range(path, start, end, self.schema, self.step, self.strict)


def _schema(options) -> str:
    names = options.get("columns")
    return schema_of([x.strip() for x in names.split(",")] if names else None, options.get("raw", "false").lower() == "true")


class LasReader(_Reading, DataSourceReader):
    tests: Sequence = ()

    def partitions(self):
        return ranges([f for f in listed(self.path) if all(t(f[0]) for t in self.tests)], self.size) or [Ranges([])]


class FilteringReader(LasReader):
    """For sessions in which Spark pushes filters down to Python sources; in others it refuses a reader that takes them."""

    def pushFilters(self, filters):
        """Take filters on file; the others are Spark's."""
        for f in filters:
            test = None
            if getattr(f, "attribute", None) == ("file",):
                value = getattr(f, "value", None)
                if isinstance(f, (EqualTo, EqualNullSafe)):
                    test = lambda p, v=value: p == v
                elif isinstance(f, In):
                    test = lambda p, v=frozenset(value): p in v
                elif isinstance(f, StringStartsWith):
                    test = lambda p, v=value: p.startswith(v)
                elif isinstance(f, StringEndsWith):
                    test = lambda p, v=value: p.endswith(v)
                elif isinstance(f, StringContains):
                    test = lambda p, v=value: v in p
            if test:
                self.tests = [*self.tests, test]
            else:
                yield f


class LasStream(_Reading, DataSourceStreamReader):
    """Files as they arrive, each once: a log of what each offset added, by name and size, in a folder of its own.

    A file counts when its name ends in .las, so writers rename what is whole.  An entry of the log is written
    before its offset is used and never changed, so after a restart the offset means the same files.
    """

    def __init__(self, options):
        super().__init__(options)
        self.log = options.get("log") or f"{self.path.rstrip('/')}/_las_log"
        self.most = int(options.get("files", 0)) or None
        self.entries: list[list] = []

    def _known(self) -> int:
        """Number of entries; new ones are read."""
        system, name = file_system(self.log)
        from pyarrow import fs

        while system.get_file_info(entry := f"{name}/{len(self.entries) + 1:09d}.json").type == fs.FileType.File:
            with system.open_input_stream(entry) as f:
                self.entries.append(json.loads(f.read()))
        return len(self.entries)

    def initialOffset(self):
        return {"entries": 0}

    def latestOffset(self):
        n = self._known()
        seen = {tuple(f) for e in self.entries for f in e}
        new = [f for f in listed(self.path) if f not in seen][: self.most]
        if new:
            n += 1
            put_file(f"{self.log}/{n:09d}.json", lambda out: out.write(json.dumps(new).encode()))
        return {"entries": n}

    def partitions(self, start, end):
        self._known()
        return ranges([tuple(f) for e in self.entries[start["entries"] : end["entries"]] for f in e], self.size) or [Ranges([])]

    def commit(self, end):
        pass


def read_files(files: DataFrame, columns: Sequence[str] | None = None, raw: bool = False, size: int = BYTES) -> DataFrame:
    """Points of a table of files (path, length): ranges of bytes are rows, dealt to tasks of about ``size`` bytes."""
    prepare(files.sparkSession)
    schema = schema_of(columns, raw)
    total = files.agg(F.sum(F.greatest("length", F.lit(SMALL)))).first()[0] or 0
    parts = files.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size))).alias("start"))

    def work(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                yield from read_range(path, start, start + size, schema)

    return parts.repartition(max(1, math.ceil(total / size))).mapInArrow(work, schema)


def headers(files: DataFrame) -> DataFrame:
    """(path, length, count, start, record_length, error) of a table of files (path, length), opened by tasks of a thousand or so."""
    prepare(files.sparkSession)

    def work(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                try:
                    lay = layout(path)
                    rows.append((path, length, lay.count, lay.start, lay.dtype.itemsize, None))
                except Exception as e:
                    rows.append((path, length, None, None, None, str(e)))
            kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], columns_of(HEADERS))

    f = files.select("path", F.col("length").cast("long").alias("length"))
    return f.repartition(max(1, math.ceil(f.count() / 1000))).mapInArrow(work, HEADERS)


HEADERS = "path string, length long, count long, start long, record_length long, error string"
FIELDS = {"intensity": "intensity", "red": "red", "green": "green", "blue": "blue", "raw_class": "raw", "treeid": "treeid"}


@dataclass
class Written(WriterCommitMessage):
    part: str
    path: str
    count: int


class Encoder:
    """Points as records of a point format with treeid as an extra field; the first points set the offset of coordinates."""

    def __init__(self, fmt: int = 3, scale: float = 0.001):
        if fmt not in FORMATS:
            raise ValueError(f"point format {fmt} is not written; 0 to 10 are")
        self.fmt, self.scale = fmt, scale
        self.dtype = np.dtype([*FORMATS[fmt], ("treeid", "<i8")])
        self.offset: list[float] | None = None
        self.low, self.high, self.count = [math.inf] * 3, [-math.inf] * 3, 0

    def records(self, points: dict[str, np.ndarray]) -> bytes:
        """Colours, class, intensity and tree id that are missing or null are 0; points without coordinates are left out."""
        xyz = np.stack([np.asarray(points[c], np.float64) for c in "xyz"])
        there = np.isfinite(xyz).all(0)
        xyz = xyz[:, there]
        a = np.zeros(xyz.shape[1], self.dtype)
        if not len(a):
            return b""
        if self.offset is None:
            self.offset = [float(v) for v in np.floor(xyz.min(1))]
        for i, c in enumerate("XYZ"):
            whole = np.round((xyz[i] - self.offset[i]) / self.scale)
            if np.abs(whole).max() > 2**31 - 1:
                raise ValueError(f"{c.lower()} spans more than a LAS file holds at scale {self.scale}")
            a[c] = whole
            self.low[i], self.high[i] = min(self.low[i], float(xyz[i].min())), max(self.high[i], float(xyz[i].max()))
        for c, to in FIELDS.items():
            if c in points and to in self.dtype.names:
                v = points[c][there]
                if v.dtype.kind == "f":
                    v = np.nan_to_num(v)
                a[to] = v.astype(np.int64) & (31 if to == "raw" and self.fmt < 6 else -1)
        self.count += len(a)
        return a.tobytes()

    def header(self) -> bytes:
        field = bytearray(192)
        field[2] = 8
        field[4:10] = b"treeid"
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, 192, b"extra bytes") + bytes(field)
        new = self.fmt >= 4  # LAS 1.2 has formats 0 to 3
        size = 375 if new else HEADER.size
        n = self.count if self.fmt < 6 and self.count < 2**32 else 0
        ends = [v if self.count else 0.0 for i in range(3) for v in (self.high[i], self.low[i])]
        head = bytearray(size)
        scale = [self.scale] * 3
        head[: HEADER.size] = HEADER.pack(b"LASF", 0, 0, 0, 0, 0, b"", 1, 4 if new else 2, b"foliarc", b"foliarc", 1, 1, size, size + len(vlr), 1, self.fmt, self.dtype.itemsize, n, n, 0, 0, 0, 0, *scale, *(self.offset or [0.0] * 3), *ends)
        if new:
            struct.pack_into("<QQ", head, COUNT_14, self.count, self.count)
        return bytes(head) + vlr


def las_bytes(points: dict[str, np.ndarray], scale: float = 0.001, fmt: int = 3) -> bytes:
    """A whole LAS file of the given points."""
    made = Encoder(fmt, scale)
    body = made.records({k: np.asarray(v) for k, v in points.items()})
    return made.header() + body


class LasWriter(DataSourceArrowWriter):
    """A file per task: records go batch by batch to a file beside the target, which a header and they then make up.

    Nothing is held but a batch.  Files have their names only once all tasks are done, by a move each; what a
    failed or repeated task left lies in a folder that the commit removes.
    """

    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.fmt, self.scale = int(options.get("point_format", 3)), float(options.get("scale", 0.001))
        Encoder(self.fmt)
        self.run = uuid.uuid4().hex[:8]
        self.work = f"{self.path}/_temporary-{self.run}"

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        made, name = Encoder(self.fmt, self.scale), f"part-{task.partitionId():05d}-{self.run}.las"
        system, work = file_system(f"{self.work}/{task.taskAttemptId()}-{name}")
        system.create_dir(work.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{work}.body") as out:
            for b in iterator:
                names = [c for c in b.schema.names if c in ("x", "y", "z", *FIELDS)]
                out.write(made.records({c: _numbers(b.column(c)) for c in names}))
        if made.count:
            with system.open_output_stream(work) as out, system.open_input_stream(f"{work}.body") as body:
                out.write(made.header())
                while data := body.read(8 << 20):
                    out.write(data)
        system.delete_file(f"{work}.body")
        return Written(work if made.count else "", name, made.count)

    def commit(self, messages):
        system, path = file_system(self.path)
        done = [m for m in messages if m and m.part]
        system.create_dir(path, recursive=True)
        for m in done:
            system.move(m.part, f"{path}/{m.path}")
        if self.overwrite:
            new = {m.path for m in done}
            for file, _ in listed(self.path):
                if file.rsplit("/", 1)[1] not in new and file_system(file)[1].rsplit("/", 1)[0] == path:
                    system.delete_file(file_system(file)[1])
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        from pyarrow import fs

        system, work = file_system(self.work)
        if system.get_file_info(work).type == fs.FileType.Directory:
            system.delete_dir(work)


def _numbers(column) -> np.ndarray:
    """Numbers of an Arrow column; nulls are 0 in whole numbers, nan in others."""
    import pyarrow as pa

    if column.null_count and pa.types.is_integer(column.type):
        column = column.fill_null(0)
    return column.to_numpy(zero_copy_only=False)


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return _schema(self.options)

    def reader(self, schema):
        return LasReader(self.options)

    def streamReader(self, schema):
        return LasStream(self.options)

    def writer(self, schema, overwrite):
        return LasWriter(self.options, overwrite)


class FilteringSource(LasSource):
    def reader(self, schema):
        return FilteringReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and have Spark push filters on ``file`` down to it."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilteringSource)


def write_like(points: DataFrame, outputs: DataFrame) -> DataFrame:
    """Write points, read with option raw, to files with the header and all point fields of the ones they came from.

    outputs: (file, output), where the points of a file go; returns (file, output, points), one row per file
    of outputs, those without points included.  A file is written by one task, a batch of records at a time.
    """
    spark = points.sparkSession
    prepare(spark)
    ends = points.groupBy("file").agg(F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("hi", F.max), ("lo", F.min))])
    todo = outputs.select("file", "output").join(ends, "file", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = attach(points.select("file", "ord", "record"), todo, ["file"], "right").repartition("output").sortWithinPartitions("output", "ord")

    def work(batches):
        import pandas as pd

        def runs():
            for pdf in batches:
                for out, x in pdf.groupby("output", sort=False):
                    yield out, x

        held = None
        it = runs()
        nxt = next(it, None)
        while nxt is not None:
            held, first = nxt[0], nxt[1].iloc[0]

            def fill(to):
                nonlocal nxt
                to.write(header_like(first["file"], int(first["n"]), [float(first[f"{n}_{a}"]) if first["n"] else 0.0 for a in "xyz" for n in ("hi", "lo")]))
                while nxt is not None and nxt[0] == held:
                    for r in nxt[1]["record"]:
                        if r is not None:
                            to.write(r)
                    nxt = next(it, None)

            put_file(held, fill)
            yield pd.DataFrame({"file": [first["file"]], "output": [held], "points": [int(first["n"])]})

    return p.mapInPandas(work, "file string, output string, points long")


def header_like(uri: str, count: int, ends: list[float]) -> bytes:
    """All that lies before the points of a file, with another number of points and other bounds; numbers by return are left at 0."""
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        raw = bytearray(f.read(layout(uri).start))
    struct.pack_into("<I5I", raw, 107, count if count < 2**32 and raw[104] < 6 else 0, *[0] * 5)
    struct.pack_into("<6d", raw, 179, *ends)
    if raw[24] == 1 and raw[25] >= 3:
        struct.pack_into("<Q", raw, 227, 0)  # no waveforms are carried over
    if raw[24] == 1 and raw[25] >= 4:
        struct.pack_into("<QI", raw, 235, 0, 0)  # nor extended records
        struct.pack_into("<Q15Q", raw, COUNT_14, count, *[0] * 15)
    return bytes(raw)
