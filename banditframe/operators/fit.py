"""Fitted transforms: scaling and imputing by statistics of the first rows of each environment.

Fitting turns contexts into (environment, feature, value) rows and aggregates them. For dense contexts, what is fitted has one entry
for each place of a row and is joined back by the environment's id. A sparse context's features may be any number: what is fitted stays
a table, which the cells of the contexts are joined with by environment and feature; a feature that most rows have is split by
Spark like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditframe.functions import stats
from banditframe.plans.ranks import percentiles
from banditframe.plans.tables import cut


def _usable(c: Column) -> Column:
    """Null for NaN, so that aggregates leave it out."""
    return F.when(~F.isnan(c), c)


def _shift(how: float | str, y: Column) -> Column:
    if not isinstance(how, str):
        return F.lit(float(how))
    return {"min": -F.min(y), "mean": -F.avg(y), "med": F.when(F.count(y) > 0, F.lit(0.0))}[how]


def _by_cell(df: DataFrame, target: str, keys: list[str], fitted: DataFrame, entries: Column) -> DataFrame:
    """df with its map target made again of what entries (a list of key and value, of f, x and the columns of fitted) gives for each
    cell; null and empty maps stay."""
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    cells = rows.select("__row", *keys, F.explode(target).alias("f", "x")).join(fitted, [*keys, "f"], "left")
    made = cells.groupBy("__row").agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("__made"))
    empty = F.create_map().cast(dict(made.dtypes)["__made"])
    value = F.when(F.col(target).isNotNull(), F.coalesce("__made", empty))
    return rows.join(made, "__row", "left").withColumn(target, value).select(*df.columns)


def scale(df: DataFrame, shift: float | str = 0, scale_: float | str = "minmax", using: int | None = None, target: str = "context", keys: list[str] = ("env_id",), idx: str = "idx") -> DataFrame:
    """(x + shift) * scale for every number of target. shift: a number, min, mean or med (which it takes away); scale: a number,
    or minmax, std, iqr or maxabs (by which it divides, unless under 1e-6). Null and NaN are left out and left alone. Sparse
    contexts count absent keys as 0 and can't be shifted."""
    keys = list(keys)
    dtype = dict(df.dtypes)[target]
    fit = df if using is None else df.filter(F.col(idx) < using)
    if dtype.startswith("map"):
        if shift != 0:
            raise ValueError("a sparse context can't be shifted")
        rows = fit.select(*keys, F.explode(target).alias("f", "x"))
    elif dtype.startswith("array"):
        rows = fit.select(*keys, F.posexplode(target).alias("f", "x"))
    else:
        rows = fit.select(*keys, F.lit(0).alias("f"), F.col(target).cast("double").alias("x"))
    rows = rows.select(*keys, "f", _usable(F.col("x").cast("double")).alias("x"))
    if dtype.startswith("map"):
        total = fit.groupBy(*keys).agg(F.count("*").alias("rows"))
        full = rows.groupBy(*keys, "f").agg(F.count("*").alias("here")).join(total, keys).select(*keys, "f", F.lit(0.0).alias("x"), (F.col("rows") - F.col("here")).alias("times"))
        rows = rows.withColumn("times", F.lit(1).cast("long")).unionByName(full.filter("times > 0"))
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    x, t = F.col("x"), F.col("times")
    moved = rows.groupBy(*keys, "f").agg(_shift(shift, x).alias("shift"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(x * t).alias("s"), F.sum(F.when(x.isNotNull(), t)).alias("n"))
    if shift == "med" or scale_ == "iqr":
        quarters = percentiles(rows, [*keys, "f"], "x", [0.25, 0.5, 0.75], "q", t)
        moved = moved.join(quarters, [*keys, "f"], "left")
        if shift == "med":
            moved = moved.withColumn("shift", -F.col("q")[1])
    if scale_ == "std":
        moved = cut(moved)
        two = rows.join(moved.select(*keys, "f", (F.col("s") / F.col("n")).alias("m")), [*keys, "f"]).groupBy(*keys, "f").agg(F.sum((x - F.col("m")) * (x - F.col("m")) * t).alias("ss"))
        moved = moved.join(two, [*keys, "f"])
    width = {
        "minmax": F.col("high") - F.col("low"),
        "iqr": F.when(F.col("n") > 1, F.col("q")[2] - F.col("q")[0]).otherwise(0.0) if scale_ == "iqr" else None,
        "maxabs": F.greatest(F.abs(F.col("low") + F.col("shift")), F.abs(F.col("high") + F.col("shift"))),
    }
    if scale_ == "std":
        width["std"] = F.sqrt(F.col("ss") / F.nullif(F.col("n") - 1, F.lit(0)))
    # a width divides, as the product with its reciprocal is rounded twice
    factor = F.when(width[scale_] >= 1e-6, width[scale_]).otherwise(1.0) if isinstance(scale_, str) else F.lit(float(scale_))
    scaled = lambda v, by: v / by if isinstance(scale_, str) else v * by
    if dtype.startswith("map"):
        known = cut(moved.filter("shift is not null").select(*keys, "f", F.col("shift").alias("__shift"), factor.alias("__scale")))
        v = F.col("x").cast("double")
        value = F.when(F.col("__scale").isNotNull() & ~F.isnan(v), scaled(v + F.col("__shift"), F.col("__scale"))).otherwise(v)
        return _by_cell(df, target, keys, known, F.array(F.struct(F.col("f").alias("key"), value.alias("value"))))
    fitted = moved.filter("shift is not null").select(*keys, F.struct(F.col("f").alias("f"), F.col("shift"), factor.alias("scale")).alias("e"))
    maps = cut(fitted.groupBy(*keys).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["f"], F.struct(e["shift"], e["scale"])))).alias("__fit")))
    out = df.join(maps, keys, "left")
    move = lambda f, v: F.when(F.try_element_at("__fit", f).isNotNull() & v.isNotNull() & ~F.isnan(v), scaled(v + F.try_element_at("__fit", f)["shift"], F.try_element_at("__fit", f)["scale"])).otherwise(v)
    c = F.col(target)
    if dtype.startswith("array"):
        made = F.transform(c, lambda v, i: move(i, v.cast("double")))
    else:
        made = move(F.lit(0), c.cast("double"))
    return out.withColumn(target, made).select(*df.columns)


def impute(df: DataFrame, stat: str = "mean", indicator: bool = True, using: int | None = None, target: str = "context", keys: list[str] = ("env_id",), idx: str = "idx") -> DataFrame:
    """Null cells get the feature's mean, median or mode in the fit rows. A feature that was null there gets an indicator, at the
    end of a dense row, as key_is_missing in a sparse one; a single value becomes [value, indicator]."""
    keys = list(keys)
    dtype = dict(df.dtypes)[target]
    fit = df if using is None else df.filter(F.col(idx) < using)
    if dtype.startswith("map"):
        rows = fit.select(*keys, idx, F.explode(target).alias("f", "x"))
    elif dtype.startswith("array"):
        rows = fit.select(*keys, idx, F.posexplode(target).alias("f", "x"))
    else:
        rows = fit.select(*keys, idx, F.lit(0).alias("f"), F.col(target).alias("x"))
    gaps = rows.groupBy(*keys, "f").agg((F.count("*") > F.count("x")).alias("gap"), F.avg("x").alias("v"))
    if stat == "median":
        middle = percentiles(rows, [*keys, "f"], "x", [0.5], "__m").select(*keys, "f", F.col("__m")[0].alias("v"))
        gaps = gaps.drop("v").join(middle, [*keys, "f"], "left")
    if stat == "mode":
        modes = stats.mode_first(rows.filter("x is not null"), [*keys, "f"], "x", idx).withColumnRenamed("x", "v")
        gaps = gaps.drop("v").join(modes, [*keys, "f"], "left")
    if dtype.startswith("map"):
        known = cut(gaps.select(*keys, "f", "gap", F.col("v").cast("double").alias("v")))
        own = F.struct(F.col("f").cast("string").alias("key"), F.coalesce(F.col("x").cast("double"), "v").alias("value"))
        flag = F.struct(F.concat("f", F.lit("_is_missing")).alias("key"), F.when(F.col("x").isNull(), 1.0).otherwise(0.0).alias("value"))
        return _by_cell(df, target, keys, known, F.when(F.col("gap"), F.array(own, flag)).otherwise(F.array(own)) if indicator else F.array(own))
    maps = cut(gaps.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("gap", F.col("v").cast("double").alias("v"))))).alias("__fit")))
    out = df.join(maps, keys, "left")
    c = F.col(target)
    at = lambda f, name: F.try_element_at("__fit", f)[name]
    fill = lambda f, v: F.coalesce(v.cast("double"), at(f, "v"))
    if dtype.startswith("array"):
        made = F.transform(c, lambda v, i: fill(i, v))
        if indicator:
            flags = F.transform(c, lambda v, i: F.when(F.coalesce(at(i, "gap"), F.lit(False)), F.when(v.isNull(), 1.0).otherwise(0.0)))
            made = F.concat(made, F.array_compact(flags))
    else:
        made = fill(F.lit(0), c)
        if indicator:
            made = F.array(made, F.when(c.isNull(), 1.0).otherwise(0.0))
    return out.withColumn(target, made).select(*df.columns)
