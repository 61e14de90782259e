"""Exact percentiles of columns of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditframe.plans.index import with_index
from banditframe.plans.prefix import running
from banditframe.plans.tables import cut


def percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float], out: str = "p", times: Column | None = None) -> DataFrame:
    """(keys, out: the value at each p, with linear interpolation at p * (n - 1)); times says how often a row counts.

    Equal values are counted first; distinct ones are numbered over a range partitioning and their counts summed in blocks, so that
    no task holds the values of a key. Null is left out."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), (F.lit(1) if times is None else times).alias("__n"))
    counts = with_index(rows.groupBy(*keys, "__v").agg(F.sum("__n").alias("__n")), keys, ["__v"], "__at")
    upto = cut(running(counts, keys, "__at", {"__to": F.col("__n")}))
    total = cut(upto.groupBy(*keys).agg(F.max("__to").alias("__all")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__all"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & upto[k].eqNullSafe(total[f"__k{i}"])
    place = [F.lit(float(p)) * (F.col("__all") - 1) for p in ps]
    ranks = [f(x) for x in place for f in (F.floor, F.ceil)]
    inside = lambda r: (r >= F.col("__to") - F.col("__n")) & (r < F.col("__to"))
    hit = upto.join(total, same) if keys else upto.crossJoin(total)
    found = hit.groupBy(*keys).agg(F.max("__all").alias("__all"), *[F.max(F.when(inside(r), F.col("__v"))).alias(f"__r{k}") for k, r in enumerate(ranks)])
    mixed = [F.col(f"__r{2 * k}") + (F.col(f"__r{2 * k + 1}") - F.col(f"__r{2 * k}")) * (x - F.floor(x)) for k, x in enumerate(place)]
    return found.select(*keys, F.array(*mixed).alias(out))
