"""The corpus pipeline: five stages from documents to a mix, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banditframe.llm import decontaminate, mixing, pii, quality, resemblance
from banditframe.llm.common import cut, shared_dir, table


def _apart(docs: DataFrame, names: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage of docs, whose own columns of these names stand aside meanwhile."""
    own = {c: f"__own_{c}" for c in docs.columns if c in names}
    out = stage(docs.withColumnsRenamed(own))
    return out.drop(*own).withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = table(spark, sf_dir, "labels")
    return _apart(docs, quality.RESULTS, lambda d: quality.judge(d, labels).filter("keep"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the document of the smallest
    id; equal rows of that id count as one."""
    classes = resemblance.near_duplicates(docs)
    gone = cut(classes.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, and their length after that."""
    return _apart(docs, ["n_entities"], lambda d: pii.pseudonymize(d).withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the copies that it takes of each."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", replace_personal_data),
    ("mix", mix_sources),
]

#: XXH64, the classifier and the keyed surrogates can't be written in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
