"""Statistics and intervals as aggregate expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditframe.plans.index import with_index
from banditframe.plans.prefix import running
from banditframe.plans.ranks import percentiles
from banditframe.plans.tables import cut


def var(y: Column) -> Column:
    """Sample variance; NaN for one value."""
    return F.coalesce(F.var_samp(y), F.when(F.count(y) > 0, F.lit(float("nan"))))


def stdev(y: Column) -> Column:
    return F.coalesce(F.stddev_samp(y), F.when(F.count(y) > 0, F.lit(float("nan"))))


def percentile(df: DataFrame, keys: list[str], value: str, p: float | list[float], out: str = "p") -> DataFrame:
    """(keys, out): exact, with linear interpolation at p * (n - 1); an array for a list of p. Ranks come from a range partitioning,
    so a group of any size spreads over many tasks."""
    found = percentiles(df, keys, value, p if isinstance(p, list) else [p], out)
    return found if isinstance(p, list) else found.withColumn(out, F.col(out)[0])


def iqr(df: DataFrame, keys: list[str], value: str, out: str = "iqr") -> DataFrame:
    """(keys, out): the width of the middle half; 0 for one value."""
    return percentile(df, keys, value, [0.25, 0.75], out).withColumn(out, F.col(out)[1] - F.col(out)[0])


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the columns of b's row of the same keys, null being a key."""
    other = b.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    if not keys:
        return a.crossJoin(other)
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(other[f"__of_{k}"])
    return a.join(other, same).drop(*[f"__of_{k}" for k in keys])


def mode_first(df: DataFrame, keys: list[str], value: str, idx: str) -> DataFrame:
    """(keys, value): the most frequent value, of equally frequent ones that which came first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(idx).alias("__first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias(value))


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, p: float) -> DataFrame:
    """(keys, value): interpolated between the values whose cumulative weights enclose p. Cumulative weight starts at 0 with
    the least value and leaves its weight out; values of weight zero are dropped first.

    Distinct values are numbered over a range partitioning and their weights summed in blocks; what encloses p is then the last value
    at or below p and the first one above, two aggregates, so no task holds a key's values."""
    one = df.filter(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    numbered = with_index(one, keys, [value], "__at")
    upto = cut(running(numbered, keys, "__at", {"__to": F.col("__w").cast("double")}).select(*keys, value, "__to"))
    ends = upto.groupBy(*keys).agg(F.min(F.struct(value, "__to")).alias("__first"), F.max("__to").alias("__all"))
    least = F.col("__first")["__to"]
    at = _beside(upto, ends, keys).withColumn("__c", F.try_divide(F.col("__to") - least, F.col("__all") - least))
    low = F.max(F.when(F.col("__c").isNull() | (F.col("__c") <= p), F.struct("__c", value)))
    high = F.min(F.when(F.col("__c") > p, F.struct("__c", value)))
    found = at.groupBy(*keys).agg(low.alias("__l"), high.alias("__h"))
    between = F.col("__l")[value] + (F.col("__h")[value] - F.col("__l")[value]) * F.try_divide(p - F.col("__l")["__c"], F.col("__h")["__c"] - F.col("__l")["__c"])
    return found.select(*keys, F.coalesce(between, F.col("__l")[value]).alias(value))


def phi(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def normal(x: Column) -> Column:
    """phi of a column: by the sum of odd powers near 0, and farther out by the continued fraction of the tail, both to the digits of a
    double."""
    x = x.cast("double")
    square, far = x * x, F.abs(x)
    density = F.exp(-square / 2) / math.sqrt(2 * math.pi)
    step = lambda a, k: F.struct((a["t"] * square / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * square / (2 * k + 1)).alias("s"))
    near = 0.5 + density * F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), step, lambda a: a["s"])
    tail = density / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), far, lambda a, k: far + k / a)
    return F.when(far <= 4, near).otherwise(F.when(x > 0, 1 - tail).otherwise(tail))


def z_of(confidence: float) -> float:
    """The two-sided normal quantile, by bisection of [-10, 10] to within 1e-4 of the probability."""
    low, high, want = -10.0, 10.0, (1 + confidence) / 2
    while True:
        mid = (low + high) / 2
        if abs(phi(mid) - want) < 1e-4:
            return mid
        low, high = (mid, high) if phi(mid) < want else (low, mid)


def stddev_ci(y: Column) -> dict[str, Column]:
    """Point, and what to take from and add to it."""
    sd = F.round(F.coalesce(F.stddev_samp(y), F.lit(0.0)), 5)
    return {"y": F.avg(y), "lower": sd, "upper": sd}


def stderr_ci(y: Column, confidence: float = 0.95) -> dict[str, Column]:
    se = z_of(confidence) * F.round(F.coalesce(F.stddev_samp(y), F.lit(0.0)) / F.sqrt(F.count(y)), 5)
    return {"y": F.avg(y), "lower": se, "upper": se}


def wilson_ci(y: Column) -> dict[str, Column]:
    """For values 0 and 1; others are an error."""
    z, n = 1.96, F.count(y)
    p = F.avg(F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.lit("binomial intervals need values of 0 and 1"))))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return {"y": p, "lower": F.round(p - (mid - half), 5), "upper": F.round(mid + half - p, 5)}


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gamma = np.vectorize(math.lgamma, otypes=[float])
    return gamma(a) + gamma(b) - gamma(a + b)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - _log_beta(a, b)) / a
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 200 + int(10 * math.sqrt(max(1.0, float(np.max(a + b, initial=1.0)))))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(turned, 1 - out, out)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray, steps: int = 60) -> np.ndarray:
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(steps):
        mid = (low + high) / 2
        under = incomplete_beta(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def clopper_pearson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Exact binomial bounds of k ones among n values: quantiles of beta distributions, for one row a group."""
    tail = (1 - confidence) / 2

    @F.pandas_udf("struct<low:double,high:double>")
    def bounds(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        a, m = ks.to_numpy(float), ns.to_numpy(float)
        low = np.where(a <= 0, 0.0, beta_quantile(tail, np.maximum(a, 1), m - a + 1))
        high = np.where(a >= m, 1.0, beta_quantile(1 - tail, a + 1, np.maximum(m - a, 1)))
        return pd.DataFrame({"low": low, "high": high})

    both = bounds(k.cast("double"), n.cast("double"))
    return F.round(both["low"], 6), F.round(both["high"], 6)


def weighted_mean(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of samples that have values[k] counts[r, k] times."""
    return counts @ values / counts.sum(axis=1)


@dataclass(frozen=True)
class weighted_quantile:
    """A statistic for bootstrap_ci: the percentile, with linear interpolation at p * (n - 1)."""

    p: float

    def __call__(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        upto = counts.cumsum(axis=1)
        at = self.p * (upto[:, -1] - 1)
        low, high = ((upto <= f(at)[:, None]).sum(axis=1) for f in (np.floor, np.ceil))
        return values[low] + (values[high] - values[low]) * (at - np.floor(at))


Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]


def bootstrap_ci(df: DataFrame, keys: list[str], y: str, confidence: float = 0.95, reps: int = 1000, seed: int = 1, statistic: Statistic = weighted_mean, point: Callable[[str], Column] | None = None, size: int = 4096, subsets: int = 8) -> DataFrame:
    """(keys, y, lower, upper): the basic bootstrap of any statistic, as a bag of little bootstraps.

    The n values of a key are dealt to subsets of about `size`, or of n to the power of 0.7 if that is more, as a subset can't tell the
    spread of so many values if its own lie farther apart than that; at most `subsets` of them are resampled (one, of all values, if
    there are no more than that: the plain bootstrap). Each is resampled to n values, by counts, `reps` times; the statistic's spread
    around its value of the subset is averaged over subsets. So a task has a subset at a time, whatever n is. statistic(values,
    counts) gives one number for each row of counts, of values that ascend. The point y is that of all values: the aggregate `point` of the
    column, the mean for the mean, the percentile for `weighted_quantile`, and else the mean of the statistic over all subsets, resampled or
    not. Null is left out; under three values the width is zero. Equal values are dealt by their counts, so the result does not depend on
    partitions."""
    rows = df.filter(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias("__y"))
    aggregate = point or (F.avg if statistic is weighted_mean else None)
    whole = rows.groupBy(*keys).agg(F.count("*").alias("__n"), (aggregate("__y") if aggregate else F.lit(None).cast("double")).alias("__point"))
    whole = whole.withColumn("__m", F.ceil(F.col("__n") / F.greatest(F.lit(float(size)), F.pow("__n", F.lit(0.7)))))
    exact = isinstance(statistic, weighted_quantile) and aggregate is None
    if exact:
        whole = _beside(whole.drop("__point"), percentile(rows, keys, "__y", statistic.p, "__point"), keys)
    whole = cut(whole)
    counts = rows.groupBy(*keys, "__y").agg(F.count("*").alias("__c"))
    dealt = _beside(counts, whole, keys).withColumn("__seed", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 62)))
    # c copies over m subsets: c / m for each, and one more for those after the value's own place
    m, c, own = F.col("__m"), F.col("__c"), F.pmod(F.xxhash64("__y", F.lit(seed)), F.col("__m"))
    first = F.sequence(F.lit(0).cast("long"), F.least(m, F.lit(subsets)) - 1)
    having = F.when(c >= m, F.sequence(F.lit(0).cast("long"), m - 1)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), c - 1), lambda k: (own + k) % m))
    some = dealt.withColumn("__part", F.explode(first if exact or aggregate is not None else having))
    more = F.pmod(F.col("__part") - own, m) < c % m
    some = some.withColumns({"__k": F.floor(c / m) + more.cast("long"), "__drawn": F.col("__part") < subsets}).filter("__k > 0")
    tail = (1 - confidence) / 2

    def one(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("__y")
        values, own, n = t["__y"].to_numpy(), t["__k"].to_numpy(float), int(t["__n"].iloc[0])
        at = float(statistic(values, own[None, :])[0])
        if not t["__drawn"].iloc[0]:
            return pd.DataFrame([(*key[:-1], at, None, None)])
        rng = np.random.default_rng([seed, int(t["__seed"].iloc[0]), int(t["__part"].iloc[0])])
        step, found = max(1, (1 << 20) // len(values)), []
        for r in range(0, reps, step):
            found.append(statistic(values, rng.multinomial(n, own / own.sum(), min(step, reps - r))))
        low, high = np.quantile(np.concatenate(found), [tail, 1 - tail])
        return pd.DataFrame([(*key[:-1], at, high - at, at - low)])

    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), *T.StructType.fromDDL("__at double, __l double, __u double").fields])
    each = some.groupBy(*keys, "__part").applyInPandas(one, schema)
    mean = each.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("__at", "__l", "__u")])
    wide = lambda c: F.when(F.col("__n") < 3, 0.0).otherwise(F.greatest(F.col(c), F.lit(0.0)))
    return _beside(whole, mean, keys).select(*keys, F.coalesce("__point", "__at").alias("y"), wide("__l").alias("lower"), wide("__u").alias("upper"))


INTERVALS = {"se": stderr_ci, "sd": stddev_ci, "bi": wilson_ci}


def interval(err: str | None, y: Column) -> dict[str, Column]:
    """The aggregates of an interval by its short name; None has zero width, a function gives its own."""
    if err is None:
        return {"y": F.avg(y), "lower": F.lit(0.0), "upper": F.lit(0.0)}
    return err(y) if callable(err) else INTERVALS[err](y)


def points(df: DataFrame, keys: list[str], y: str, err: Any = None) -> DataFrame:
    """(keys, y, lower, upper) by the short name of an interval: se, sd, bi or bs, None, or a function of a column."""
    if err == "bs":
        return bootstrap_ci(df.select(*keys, y), keys, y)
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in interval(err, F.col(y)).items()])
