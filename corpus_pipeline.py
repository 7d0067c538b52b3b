"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

1. quality: documents that the classifier rejects go.
2. exact dedup: of equal texts the row with the largest doc_id stays.
3. near dedup: of each class of near-duplicates one document stays.
4. mix: documents are repeated or left out so that sources meet their target weights.
5. pack: what is left is cut and packed into sequences; one row per piece.

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents.
An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliarc.llm.common import new_folder, prepare
from foliarc.llm.exact_dedup import keep_distinct
from foliarc.llm.mixing import mixed_rows
from foliarc.llm.order_minhash import keep_one
from foliarc.llm.packing import pack
from foliarc.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", sequences)]

#: None: the classifier, the sketches and the Newton steps of the mix are not SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
