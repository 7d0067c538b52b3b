"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by the text's SHA-256.  A batch is
reduced to one row per digest (map-side first, so a text that is a third of all rows shuffles as a few rows),
its digests are matched with the index by a sort-merge anti-join on the buckets, and only new ones are
appended.  What is known already is noted in a second table, bucketed alike, as a count to be added.  Texts
never leave the scan: digests are what is shuffled.

The tables lie in a folder with a small manifest that names their number of buckets and which of the folder's
generations is current, so that an application with a catalog of its own finds them again.  Every row names the
batch that brought it; a batch that is given again, or whose append broke off, changes nothing that it has
changed already.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.llm.common import file_system, forget, new_folder, prepare, put_file, quoted, whole_row, written

INDEX = "digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING"
COLUMNS = [x.split()[0] for x in INDEX.split(", ")]


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """A bucketed table of digests with the row that stays for each, and one that counts rows of known texts.

    folder: where it is kept, which may hold one from before; without it a folder of its own in the shared one,
    deleted as the application ends.  On a cluster folder must be one that driver and executors share.  buckets
    counts for a new index only.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        prepare(spark)
        self.spark, self.folder = spark, (folder or new_folder(spark, "digest-index")).rstrip("/")
        system, path = file_system(self.folder)
        try:
            with system.open_input_stream(f"{path}/manifest.json") as f:
                state = json.loads(f.read())
            self.buckets, self.generation = state["buckets"], state["generation"]
        except FileNotFoundError:
            self.buckets, self.generation = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
            self._state(self.generation)
        self._register()

    def _state(self, generation: str) -> None:
        put_file(f"{self.folder}/manifest.json", lambda out: out.write(json.dumps({"buckets": self.buckets, "generation": generation}).encode()))

    def _register(self) -> None:
        """The tables of the current generation under names of this object, whatever the catalog knows."""
        mine = uuid.uuid4().hex
        self.name, self.again = f"digest_index_{mine}", f"digest_index_{mine}_again"
        for name, part in ((self.name, "known"), (self.again, "again")):
            place = f"{self.folder}/{self.generation}/{part}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({INDEX}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def rows(self) -> DataFrame:
        """(digest, keep_id, group_size) of all texts added so far; empty where nothing has been.

        A batch counts once for a text, however often it was given.
        """
        table = lambda name: self.spark.read.table(name).groupBy("digest", "batch").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        more = table(self.again).groupBy("digest").agg(F.sum("group_size").alias("more"))
        size = F.col("group_size") + F.coalesce("more", F.lit(0))
        return table(self.name).hint("merge").join(more, "digest", "left").select("digest", "keep_id", size.alias("group_size"))

    def _add(self, rows: DataFrame, name: str) -> None:
        rows.select(*COLUMNS).write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(name)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> None:
        """Add the texts of docs that the index does not have yet, and count the rows of those it has.

        Of equal texts within the batch the row with the largest id stays; a text that an earlier batch
        brought keeps the row it has.  A null id stays only if all rows of its text in its batch have a null id.
        batch names the rows of docs: the same rows under a name that the index has change nothing, also where
        an append of them broke off between its two writes.  Without a name every append is a batch of its own.
        An empty table adds nothing.
        """
        self._append(_hashed(docs, id_col, text_col), batch or uuid.uuid4().hex)

    def _append(self, hashed: DataFrame, batch: str) -> None:
        one = hashed.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("group_size"), F.lit(batch).alias("batch"))
        one = written(one, "digest-batch")
        there = self.spark.read.table(self.name)
        # in this order: what the batch itself brought in an append that broke off is not known from before
        self._add(one.join(there.where(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_semi"), self.again)
        self._add(one.join(there.select("digest").hint("merge"), "digest", "left_anti"), self.name)
        forget(one)

    def compact(self) -> None:
        """Rewrite both tables as one with a file a bucket; many small batches leave many small files.

        The new generation is whole before the manifest names it, by a move, and the old one is deleted after,
        so the index can be found at every moment.  Names of batches are forgotten.
        """
        old, whole = self.generation, self.rows().withColumn("batch", F.lit("compacted"))
        names = (self.name, self.again)
        self.generation = uuid.uuid4().hex
        self._register()
        self._add(whole.repartition(self.buckets, "digest"), self.name)
        self._state(self.generation)
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        system, path = file_system(f"{self.folder}/{old}")
        system.delete_dir(path)

    def close(self) -> None:
        """Take the tables' names out of the catalog; the index stays."""
        for name in (self.name, self.again):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """Delete the index."""
        self.close()
        system, path = file_system(self.folder)
        system.delete_dir(path)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("keep_id"), text_digest(F.col(quoted(text_col))).alias("digest"))


def _decided(hashed: DataFrame, index: DigestIndex | None, batches: int) -> DataFrame:
    """(digest, keep_id, group_size) after rows (keep_id, digest) were added from the largest ids down, so that what the index has is what stays; an index of our own is dropped."""
    own = index is None
    index = index or DigestIndex(hashed.sparkSession)
    key, run = F.col("keep_id"), uuid.uuid4().hex
    cuts, top = [], None
    if batches > 1:
        cuts = hashed.select(F.percentile_approx(key, [i / batches for i in range(1, batches)])).first()[0] or []
    for low in [*sorted(set(cuts), reverse=True), None]:
        part = hashed if low is None else hashed.where(key >= low)
        if top is not None:
            part = part.where((key < top) | key.isNull())
        index._append(part, f"{run}-{low}")
        top = low
    out = written(index.rows(), "digest-decisions")
    if own:
        index.drop()
    return out


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Add docs to the index and say for every row which row of its text stays.

    Returns one row per row of docs: ``id_col``, keep_id, group_size, kept, text_sha256.  Texts are equal when
    identical, null being the empty text.  docs are added in ``batches`` ranges of ids, the largest first, so
    of equal texts the largest id stays, unless an index is given that has the text from before: then its row
    stays.  group_size counts all rows added to the index.  Rows that repeat an id share its decision; a null
    id is kept only where its text has no other id.  An empty table gives no rows; other columns of docs are
    not read.  Joining the decisions back is a join on the digest whose rows side is dealt anew, so that
    adaptive execution can split a hot text.
    """
    d = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_digest(F.col(quoted(text_col))).alias("text_sha256"))
    d = written(d, "digests")  # texts are read and hashed once
    there = _decided(d.select(F.col("doc_id").cast("long").alias("keep_id"), F.col("text_sha256").alias("digest")), index, batches)
    out = d.join(there, F.col("text_sha256") == F.col("digest"))
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each text, repeated rows being one.

    Of several rows with the text and the id that stay, the one whose whole row has the least hash is kept.
    """
    hashed = written(_hashed(docs, id_col, text_col), "digests")
    stay = _decided(hashed, index, batches).select(F.col("keep_id").alias("keep"), "digest")
    marked = docs.select(whole_row(docs).alias("row"), F.col(quoted(id_col)).cast("long").alias("id"), text_digest(F.col(quoted(text_col))).alias("sha"))
    out = marked.join(stay, F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("digest")))
    one = Window.partitionBy("digest", "keep").orderBy(F.xxhash64("row"))
    return out.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
