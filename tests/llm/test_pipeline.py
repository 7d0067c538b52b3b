"""The pipeline stage by stage against what each stage's operator decides."""

from collections import Counter

from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "pack":
            assert docs.columns == before.columns
        if name == "exact_dedup":
            last = {}
            for r in before.collect():
                last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
            assert sorted(last.values()) == sorted(r.doc_id for r in docs.collect())
        if name == "mix":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
            assert max(r["count"] for r in docs.groupBy("doc_id").count().collect()) <= 2
    words = sum(len(r.text.split()) for r in spark.read.parquet(str(tmp_path / "mix")).collect())
    assert docs.agg({"length": "sum"}).first()[0] == words
    assert kept["near_dedup"] <= kept["exact_dedup"] <= kept["quality"]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text and columns of awkward names pass through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(40)
    null = lambda c: F.lit(None).cast(docs.schema[c].dataType).alias(c)
    odd = some.union(some.limit(5))
    for c in ("doc_id", "text", "source"):
        odd = odd.union(some.limit(3).select(*[null(c) if d == c else F.col(d) for d in docs.columns]))
    odd = odd.union(some.limit(2).select(*[F.lit("").alias("text") if d == "text" else F.col(d) for d in docs.columns]))
    odd = odd.union(some.limit(1).select(*[F.repeat(F.concat("text", F.lit(" ")), 200).alias("text") if d == "text" else F.col(d) for d in docs.columns]))
    docs = odd.withColumns({"id": F.lit(1), "n": F.lit("x"), "row": F.lit(2.0), "a.b": F.lit(3), "h": F.lit(4)})
    docs.write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    texts = lambda d: Counter(r.text or "" for r in d.select("text").collect())
    for name, stage in corpus_pipeline.STAGES:
        before, was = docs, texts(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            assert docs.agg({"length": "sum"}).first()[0] == sum(len(t.split()) * n for t, n in was.items())
            continue
        now = texts(docs)
        assert docs.columns == before.columns and set(now) <= set(was)
        if name == "quality":  # a text is judged alike in all its rows
            assert all(now[t] in (0, n) for t, n in was.items()) and sum(now.values()) > 20
        if name == "exact_dedup":
            last = {}
            for r in before.collect():
                last[r.text or ""] = max(last.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
            assert {r.text or "": -1 if r.doc_id is None else r.doc_id for r in docs.collect()} == last and set(now.values()) == {1}
        if name == "near_dedup":
            assert set(now.values()) == {1}
        if name == "mix":
            assert all(n <= 2 * was[t] for t, n in now.items())
