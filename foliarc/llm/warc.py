"""WARC archives: monolithic gzip files, and a normaliser that gives every record its own member.

Writing deals pages to tasks, each of which makes one archive as a single gzip stream.  Such a file can only
be read from its start, so the normaliser inflates it once, rewrites every record as a member of its own and
writes a sidecar index of offsets; readers then fetch single records.  Archives are whole files in the shared
folder, written under a temporary name and moved, so a repeated task leaves the same file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliarc.llm.common import file_system, new_folder, prepare, put_file, quoted

CHUNK = 1 << 20
END = b"\r\n\r\n"
INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
URN = "urn:foliarc:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(page_id) -> str:
    return f"<{URN}{'' if page_id is None else int(page_id)}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header with the payload's length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {_clean(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse(raw: bytes) -> dict:
    """Headers of a record in lower case, with its block under ``block``."""
    head, _, rest = raw.partition(END)
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return out | {"block": rest[: int(out["content-length"])]}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from an inflated stream, holding one record at a time."""
    chunks, buf = iter(chunks), bytearray()

    def more(n: int) -> bool:
        while len(buf) < n:
            x = next(chunks, None)
            if x is None:
                return False
            buf.extend(x)
        return True

    seen = 0
    while True:
        at = buf.find(END, max(0, seen - 3))
        if at < 0:
            seen = len(buf)
            if not more(seen + 1):
                if buf.strip():
                    raise ValueError("the archive ends within a record's header")
                return
            continue
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", bytes(buf[:at]))[1])
        whole = at + len(END) + length + len(END)
        if not more(whole):
            raise ValueError("the archive ends within a record")
        yield bytes(buf[:whole])
        del buf[:whole]
        seen = 0


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of bounded size."""
    d = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = d.decompress(data, CHUNK)
            if out:
                yield out
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)
            else:
                data = d.unconsumed_tail
    if out := d.flush():
        yield out


def normalise(source: str, target: str) -> int:
    """Rewrite archive source as target, a member per record, and target.idx, a JSON line per record; returns how many."""
    system, path = file_system(source)
    index: list[bytes] = []

    def write(out) -> None:
        at = 0
        with system.open_input_stream(path, compression=None) as f:
            for raw in split_records(inflate(f)):
                member = gzip.compress(raw, 6, mtime=0)
                out.write(member)
                index.append(json.dumps({"offset": at, "length": len(member), "id": parse(raw)["warc-record-id"]}).encode())
                at += len(member)

    put_file(target, write)
    put_file(f"{target}.idx", lambda out: out.write(b"\n".join(index) + b"\n" * bool(index)))
    return len(index)


def read_record(stream, offset: int, length: int) -> dict:
    """The record at an offset of a normalised archive."""
    stream.seek(offset)
    return parse(gzip.decompress(stream.read(length)))


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of pages to monolithic archives in folder; returns (path, records), one row per archive.

    The payload is the html in UTF-8, null being empty.  Of rows with equal payloads of at least ``least``
    bytes the one with the largest id is a response and the others revisit it; rows that repeat that id are
    responses too; a null id never is the response unless all are null, when all are responses.
    """
    html = F.coalesce(F.col(quoted(html_col)), F.lit(""))
    p = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("bytes"))
    top = p.where(F.col("bytes") >= least).groupBy("sha", "bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    top = top.select(F.concat("sha", F.lit("")).alias("sha2"), "top", F.col("bytes").alias("bytes2"))
    p = p.join(top, (F.col("sha") == F.col("sha2")) & (F.col("bytes") == F.col("bytes2")), "left")
    p = p.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        path = f"{folder}/raw/part-{part:06d}.warc.gz"
        first = next(batches, None)
        if first is None:
            return

        def fill(out):
            nonlocal n
            with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
                for b in _chain(first, batches):
                    for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                        z.write(record(page_id, url, html.encode(), refers, refers is not None))
                        n += 1

        put_file(path, fill)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    made = p.mapInArrow(write, "path string, records long")
    made.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("path string, records long").parquet(f"{folder}/manifest")


def _chain(first, rest):
    yield first
    yield from rest


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of a manifest (path, ...); returns (path, records) of the new ones."""

    def work(batches):
        for pdf in batches:
            out = [f"{folder}/members/{p.rsplit('/', 1)[1]}" for p in pdf["path"]]
            pdf["records"] = [normalise(a, b) for a, b in zip(pdf["path"], out, strict=True)]
            yield pdf.assign(path=out)[["path", "records"]]

    done = _spread(manifest).mapInPandas(work, "path string, records long")
    done.write.parquet(f"{folder}/index")
    return manifest.sparkSession.read.schema("path string, records long").parquet(f"{folder}/index")


def _spread(manifest: DataFrame) -> DataFrame:
    return manifest.select("path").repartition(max(1, manifest.count()))


def read_archives(index: DataFrame) -> DataFrame:
    """One row per record of the normalised archives, each fetched by its offset in the sidecar index."""

    def work(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                system, name = file_system(path)
                with system.open_input_stream(f"{name}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with system.open_input_file(name) as f:
                    for x in entries:
                        rows.append(_row(read_record(f, x["offset"], x["length"])))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return _spread(index).mapInArrow(work, INDEX)


def _id(urn: str):
    value = urn.strip("<>")[len(URN) :]
    return int(value) if value else None


def _row(r: dict) -> tuple:
    http, _, payload = r["block"].partition(END)
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = r["warc-payload-digest"].removeprefix("sha1:")
    if r["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {r['warc-record-id']} does not match its digest")
    return _id(r["warc-record-id"]), size, digest, r["warc-type"], _id(r["warc-refers-to"]) if "warc-refers-to" in r else None


def _batch(rows: list):
    """Rows of INDEX; ids stay whole numbers beside nulls."""
    import pyarrow as pa

    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, **columns) -> DataFrame:
    """Write pages as archives, normalise them and read every record back.

    Returns one row per row of pages: page_id, payload_bytes, payload_digest (base32 SHA-1; both of the full
    payload), record_type, refers_to.  See ``write_archives`` for nulls, ties and repeats; an empty table
    gives no archives and no rows; other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "warc")
    return read_archives(normalise_archives(write_archives(pages, folder, least, **columns), folder))
