"""Contiguous row numbers for each environment without a window over an environment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from banditframe.plans.tables import cut


def with_index(df: DataFrame, keys: list[str], order: list[str], name: str = "idx", start: int = 0) -> DataFrame:
    """df with name = start, start + 1, ... for each combination of keys in the order of order (ties in any order).

    Rows are range-partitioned by keys and order, so a key of any size spreads over many tasks. Each row knows its place in
    its task; the offset of (task, key) comes from a window over the small table of counts by task.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    id_ = F.monotonically_increasing_id()
    placed = cut(placed.withColumns({"__task": F.shiftright(id_, 33), "__row": id_.bitwiseAND((1 << 33) - 1)}))
    counts = placed.groupBy("__task", *keys).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = cut(offsets.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__task").alias("__t"), "__first", "__before"))
    same = placed["__task"] == offsets["__t"]
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(offsets[f"__{i}"])
    return placed.join(offsets, same).select(*df.columns, (F.col("__row") - F.col("__first") + F.col("__before") + start).alias(name))
