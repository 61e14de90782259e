"""Saved interactions, sinks, and prefixes that are computed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = "env_id"


def _params(environments: DataFrame, name: str) -> DataFrame:
    """(id, text of the parameters), the same for the same parameters."""
    return environments.select(F.col(KEY).alias(name), F.to_json(F.struct(*sorted(c for c in environments.columns if c != KEY))).alias("params"))


def save(environments: DataFrame, interactions: DataFrame, path: str, overwrite: bool = False) -> str:
    """Writes interactions by environment and their parameters. What is there already decides: the same parameters, and only
    environments that are missing are added; others are an error unless they are to be overwritten. Returns what was done."""
    spark = interactions.sparkSession
    try:
        old = spark.read.parquet(f"{path}/environments")
    except AnalysisException:
        old = None
    if old is not None and not overwrite:
        ours, theirs = _params(environments, "a"), _params(old, "b")
        if not theirs.select("params").exceptAll(ours.select("params")).isEmpty():
            raise ValueError(f"{path} holds other environments; overwrite them or choose another path")
        done = spark.read.parquet(f"{path}/interactions").select(KEY).distinct()
        todo = environments.join(done, KEY, "left_anti")
        if todo.isEmpty():
            return "kept"
        interactions.join(todo.select(KEY), KEY, "left_semi").write.mode("append").partitionBy(KEY).parquet(f"{path}/interactions")
        todo.write.mode("append").parquet(f"{path}/environments")
        return "added"
    mode = "overwrite" if overwrite else "errorifexists"
    interactions.write.mode(mode).partitionBy(KEY).parquet(f"{path}/interactions")
    environments.write.mode(mode).parquet(f"{path}/environments")
    return "written"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(environments, interactions)."""
    return spark.read.parquet(f"{path}/environments"), spark.read.parquet(f"{path}/interactions")


def write_lines(df: DataFrame, path: str, column: str = "value", gzip: bool = False) -> None:
    df.select(column).write.mode("append").option("compression", "gzip" if gzip else "none").text(path)


def cache(df: DataFrame, durable: bool = False) -> DataFrame:
    """df computed once: in memory and on disk, or as a checkpoint in the shared folder."""
    return df.checkpoint() if durable else df.persist(StorageLevel.MEMORY_AND_DISK)


def discard(df: DataFrame) -> None:
    """Runs df for its effects only."""
    df.write.format("noop").mode("overwrite").save()


def for_each(df: DataFrame, f: Callable) -> None:
    """Hands the rows of each task to f, on the executors."""

    def each(rows: Iterator[Row]) -> None:
        for r in rows:
            f(r)

    df.foreachPartition(each)


def from_frames(parts: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """The rows of the pandas frames that make gives for the rows of each task, a bounded batch at a time."""

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield make(b)

    return parts.mapInPandas(frames, schema)


def to_dicts(df: DataFrame) -> list[dict]:
    """Rows of a reduced result."""
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]
