"""Ids by first appearance, parameter names, and the triples of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from banditframe.plans.index import with_index


def first_appearance(df: DataFrame, keys: list[str], order: list[str], name: str, start: int = 0) -> DataFrame:
    """(keys, name): distinct keys numbered by their first row in the order, over a range partitioning."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__seen"))
    return with_index(first, [], ["__seen"], name, start).withColumn(name, F.col(name).cast("int")).drop("__seen")


def triples(environments: DataFrame, learners: DataFrame, evaluators: DataFrame) -> DataFrame:
    """Every environment with every learner and evaluator: three dimension tables, one row a run."""
    one = lambda df, k: df.select(k).distinct()
    return one(environments, "environment_id").crossJoin(one(learners, "learner_id")).crossJoin(one(evaluators, "evaluator_id"))


def unfinished(all_: DataFrame, done: DataFrame) -> DataFrame:
    """Triples that the log doesn't hold yet."""
    ids = ["environment_id", "learner_id", "evaluator_id"]
    return all_.join(done.select(*ids).distinct(), ids, "left_anti")


def merged_params(params: DataFrame) -> DataFrame:
    """(pipe, key, value) rows of a pipeline, by position -> (key, value) where a key that several stages use has its number
    after it."""
    w = Window.partitionBy("key")
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy("pipe"))
    return params.select(F.when(n > 1, F.concat("key", at.cast("string"))).otherwise(F.col("key")).alias("key"), "value")


def fan_out(environments: DataFrame, variants: DataFrame) -> DataFrame:
    """Every environment in every variant (columns seed or others), with new environment ids by variant, then environment.
    Both are dimension tables; interactions follow by a join on the old id."""
    both = environments.withColumnRenamed("environment_id", "base_id").crossJoin(variants)
    order = Window.orderBy(*variants.columns, "base_id")
    return both.withColumn("environment_id", (F.dense_rank().over(order) - 1).cast("int"))


def concat(a: DataFrame, b: DataFrame, env: str = "environment_id") -> DataFrame:
    """Environments of a, then those of b with ids after a's."""
    shift = F.coalesce(a.agg(F.max(env).alias("m")).scalar(), F.lit(-1)) + 1
    return a.unionByName(b.withColumn(env, (F.col(env) + shift).cast(dict(a.dtypes)[env])), allowMissingColumns=True)
