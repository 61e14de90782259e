"""Running and sliding sums over a contiguous index, in blocks, so that one long sequence spreads over many tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running(df: DataFrame, keys: list[str], idx: str, sums: dict[str, Column], upto: int = 0, block: int = BLOCK) -> DataFrame:
    """df with, for each name in sums, the sum of its column over the rows of the key up to `upto` rows from the current one
    (0: with it, -1: before it). Block totals are summed in a window over blocks, rows in a window inside a block."""
    rows = df.withColumn("__block", F.floor(F.col(idx) / block))
    totals = rows.groupBy(*keys, "__block").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), *[F.sum(f"__t_{n}").over(over).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__block").orderBy(idx).rowsBetween(Window.unboundedPreceding, upto)
    rows = rows.withColumns({f"__s_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    same = rows["__block"] == base["__b"]
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(base[f"__k{i}"])
    both = {n: F.when(F.col(f"__o_{n}").isNull() & F.col(f"__s_{n}").isNull(), None).otherwise(F.coalesce(f"__o_{n}", F.lit(0)) + F.coalesce(f"__s_{n}", F.lit(0))) for n in sums}
    return rows.join(base, same, "left").select(*[c for c in df.columns if c not in sums], *[c.alias(n) for n, c in both.items()])


def sliding(df: DataFrame, keys: list[str], idx: str, span: int, outs: dict, block: int = BLOCK) -> DataFrame:
    """df with outs[name] (a function of a window) over the last span rows. The last span - 1 rows of a block are also dealt
    to the next one, where they are seen but not returned."""
    block = max(block, span)
    own = F.floor(F.col(idx) / block)
    late = F.floor((F.col(idx) + (span - 1)) / block)
    rows = df.withColumn("__home", own).withColumn("__block", F.explode(F.array_distinct(F.array(own, late))))
    w = Window.partitionBy(*keys, "__block").orderBy(idx).rowsBetween(-(span - 1), 0)
    return rows.withColumns({n: f(w) for n, f in outs.items()}).filter("__home = __block").drop("__home", "__block")


def numbered(df: DataFrame, keys: list[str], idx: str, name: str) -> DataFrame:
    """df with the number of each row in its key by idx, from 0. idx is a whole number without ties, with gaps or not."""
    return running(df, keys, idx, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))


def faded(df: DataFrame, keys: list[str], at: str, sums: dict[str, Column], fade: float, most: int = 1 << 14) -> DataFrame:
    """df with, for each name in sums, the sum of its column over the rows of the key so far, each times fade to the power of the
    rows since. at numbers a key's rows from 0 without gaps; 0 < fade < 1.

    Inside a block a row's share is its value over the fading so far, so one running sum will do; blocks are as long as these
    powers stay far from the ends of a double. A block's total reaches the next ones faded by its length: where that is next to
    nothing only the block before counts, else the totals are summed in the same way, block over block."""
    block = max(1, min(most, int(-460 / math.log(fade))))
    b, k = f"{at}_b", f"{at}_k"
    rows = df.withColumns({b: F.floor(F.col(at) / block), k: F.col(at) % block} | {f"__v_{n}": c.cast("double") for n, c in sums.items()})
    w = Window.partitionBy(*keys, b).orderBy(k)
    up, down = F.pow(F.lit(fade), -F.col(k)), F.pow(F.lit(fade), F.col(k))
    rows = rows.withColumns({f"__i_{n}": F.sum(F.col(f"__v_{n}") * up).over(w) * down for n in sums})
    totals = rows.groupBy(*keys, b).agg(*[F.sum(F.col(f"__v_{n}") * F.pow(F.lit(fade), (block - 1) - F.col(k))).alias(f"__t_{n}") for n in sums])
    step = fade**block
    if step > 1e-30:
        totals = faded(totals, keys, b, {f"__t_{n}": F.col(f"__t_{n}") for n in sums}, step, most)
    past = totals.select(*[F.col(x).alias(f"__k{i}") for i, x in enumerate(keys)], (F.col(b) + 1).alias("__n"), *[F.col(f"__t_{n}") for n in sums])
    same = rows[b] == past["__n"]
    for i, x in enumerate(keys):
        same = same & rows[x].eqNullSafe(past[f"__k{i}"])
    more = F.pow(F.lit(fade), F.col(k) + 1)
    outs = [(F.col(f"__i_{n}") + F.coalesce(F.col(f"__t_{n}"), F.lit(0.0)) * more).alias(n) for n in sums]
    return rows.join(past, same, "left").select(*[c for c in df.columns if c not in sums], *outs)
