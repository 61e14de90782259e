"""Policies as columns: fixed ones, and ones whose state before a row is an aggregate of the log's earlier rows.

Learned policies give pmf, an array aligned with actions. Their prefix sums run in blocks (see plans.prefix), so one long log
spreads over many tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.functions import rand
from banditframe.plans.prefix import running
from banditframe.plans.tables import cut

KEYS = ["env_id"]


def fixed(pmf: list[float]) -> Column:
    """Constant probabilities, which must not be negative and must sum to one."""
    if any(p < 0 for p in pmf) or abs(sum(pmf) - 1) > 1e-9:
        raise ValueError("probabilities must not be negative and must sum to one")
    return F.array(*[F.lit(float(p)) for p in pmf])


def uniform() -> Column:
    return F.transform("actions", lambda _: 1.0 / F.size("actions"))


def draw(df: DataFrame, pmf: str = "pmf", seed: int = 1, idx: str = "idx") -> DataFrame:
    """df with the drawn action's place `at`, the action `on_action`, and its probability `on_prob`."""
    at = rand.choice_index(seed, F.col(idx) + 1, F.size(pmf), F.col(pmf))
    rows = df.withColumn("at", at)
    return rows.withColumns({"on_action": F.get("actions", "at"), "on_prob": F.get(pmf, "at")})


def score(pmf: Column, action: Column | None = None) -> Column:
    """The probability of the logged action; 0 if it is not among the actions."""
    at = F.array_position(F.col("actions"), F.col("action") if action is None else action)
    return F.when(at > 0, F.get(pmf, (at - 1).cast("int"))).otherwise(0.0)


def greedy(values: Column, epsilon: float = 0.0) -> Column:
    """epsilon spread over all actions, the rest over those of the largest value; null is the least value."""
    known = F.transform(values, lambda v: F.coalesce(v, F.lit(float("-inf"))))
    best = F.array_max(known)
    share = F.size(F.filter(known, lambda v: v == best))
    return F.transform(known, lambda v: epsilon / F.size(known) + F.when(v == best, (1 - epsilon) / share).otherwise(0.0))


def _log_sums(df: DataFrame, actions: list[str], sums: dict, reward: str, keys: list[str], idx: str) -> DataFrame:
    """df with sums[name](is_action, reward) over earlier rows, as name_0, name_1, ... for each of the fixed actions."""
    cols = {f"{n}_{k}": f(F.col("action") == a, F.col(reward)) for n, f in sums.items() for k, a in enumerate(actions)}
    return running(df, keys, idx, cols, upto=-1)


def epsilon_greedy(df: DataFrame, actions: list[str], epsilon: float = 0.05, reward: str = "reward", keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """df with pmf of the epsilon-greedy policy that has learned from the log before each row. An action not seen yet has no value;
    if none has, all are equal."""
    sums = {"n": lambda hit, r: F.when(hit, 1).otherwise(0), "s": lambda hit, r: F.when(hit, r).otherwise(0.0)}
    rows = _log_sums(df, actions, sums, reward, keys, idx)
    q = F.array(*[F.try_divide(F.col(f"s_{k}"), F.col(f"n_{k}").cast("double")) for k in range(len(actions))])
    made = rows.withColumn("__q", q).withColumn("pmf", greedy(F.col("__q"), epsilon))
    return made.select(*df.columns, "pmf")


def ucb(df: DataFrame, actions: list[str], reward: str = "reward", keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """df with pmf of the tuned upper-confidence policy that has learned from the log before each row: actions not seen yet share
    everything; else those of the largest m + sqrt(ln t / n * min(1/4, V + sqrt(2 ln t / n))).

    An action's first reward counts for m only until its second comes, and never for V; values are
    compared at 9 decimals, as sums come in another order."""
    firsts = df.groupBy(*keys, "action").agg(F.min(idx).alias("__first"))
    seen = df.join(firsts, [*keys, "action"])
    late = F.col(idx) > F.col("__first")
    sums = {
        "n": lambda hit, r: F.when(hit, 1).otherwise(0),
        "f": lambda hit, r: F.when(hit & ~late, r).otherwise(0.0),
        "s": lambda hit, r: F.when(hit & late, r).otherwise(0.0),
        "q": lambda hit, r: F.when(hit & late, r * r).otherwise(0.0),
    }
    rows = _log_sums(seen, actions, sums, reward, keys, idx)
    t = F.greatest(F.col(idx), F.lit(1)).cast("double")

    def value(k: int) -> Column:
        n, s, q = F.col(f"n_{k}").cast("double"), F.col(f"s_{k}"), F.col(f"q_{k}")
        later = n - 1
        m = F.when(n == 1, F.col(f"f_{k}")).otherwise(F.try_divide(s, later))
        var = F.when(later > 1, F.greatest((q - F.try_divide(s * s, later)) / F.nullif(later - 1, F.lit(0.0)), F.lit(0.0)))
        bound = F.least(F.lit(0.25), F.coalesce(var + F.sqrt(2 * F.ln(t) / n), F.lit(0.25)))
        return F.when(n > 0, F.round(m + F.sqrt(F.ln(t) / n * bound), 9))

    values = F.array(*[value(k) for k in range(len(actions))])
    rows = rows.withColumn("__v", values)
    unseen = F.size(F.filter("__v", lambda v: v.isNull()))
    pmf = F.when(unseen > 0, F.transform("__v", lambda v: F.when(v.isNull(), 1.0 / unseen).otherwise(0.0))).otherwise(greedy(F.col("__v")))
    return rows.withColumn("pmf", pmf).select(*[c for c in df.columns], "pmf")


def misguided(df: DataFrame, shifter: float, scaler: float, reward: str = "reward", out: str = "learned") -> DataFrame:
    """The reward that a misguided policy learns from, in a column of its own."""
    return df.withColumn(out, shifter + scaler * F.col(reward))


def linear(df: DataFrame, n_actions: int, features: str = "x", kind: str = "ucb", alpha: float = 1.0, block: int = 1000, reward: str = "reward", keys: list[str] = KEYS, idx: str = "idx", seed: int = 1) -> DataFrame:
    """df with pmf of a linear policy that has learned from the log up to the block of each row.

    features is an array of one feature array for each action. A = I + sum x x', b = sum r x over logged rows; ucb takes the
    largest theta.x + alpha sqrt(x'A^-1 x), ts the largest of a draw from N(theta, alpha A^-1). The state is that before the
    row's block: sums of a block are aggregates, states a running sum over blocks, and each block solves one system of the
    features' width."""
    rows = df.withColumn("__block", F.floor(F.col(idx) / block))
    at = (F.array_position(F.col("actions"), F.col("action")) - 1).cast("int")
    chosen = rows.withColumn("__x", F.get(features, at))
    outer = F.flatten(F.transform("__x", lambda a: F.transform("__x", lambda b: a * b)))
    cells = chosen.withColumns({"__o": outer, "__r": F.transform("__x", lambda a: a * F.col(reward))})
    long = cells.select(*keys, "__block", F.posexplode(F.concat("__o", "__r")).alias("c", "v")).groupBy(*keys, "__block", "c").agg(F.sum("v").alias("v"))
    blocks = long.groupBy(*keys, "__block").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("v"))
    spread = blocks.select(*keys, "__block", F.posexplode("v").alias("c", "v"))
    before = Window.partitionBy(*keys, "c").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    states = spread.withColumn("v", F.coalesce(F.sum("v").over(before), F.lit(0.0))).groupBy(*keys, "__block")
    states = states.agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("v"))

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series, number: pd.Series) -> pd.Series:
        """theta (or a draw of it) and the inverse, in one array."""

        def one(v, b) -> np.ndarray:
            v = np.asarray(v, float)
            d = int(round((-1 + (1 + 4 * len(v)) ** 0.5) / 2))
            inv = np.linalg.inv(np.eye(d) + v[: d * d].reshape(d, d))
            theta = inv @ v[d * d :]
            if kind == "ts" and alpha > 0:
                theta = np.random.default_rng([seed, int(b)]).multivariate_normal(theta, alpha * (inv + inv.T) / 2)
            return np.concatenate([theta, inv.ravel()])

        return pd.Series([one(v, b) for v, b in zip(sums, number)])

    states = cut(states.select(*keys, "__block", solve("v", "__block").alias("__s")))
    known = rows.join(states, [*keys, "__block"])
    d = F.size(F.get(features, 0))
    known = known.withColumns({"__theta": F.slice("__s", 1, d), "__inv": F.slice("__s", d + 1, d * d), "__d": d})
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def value(x: Column) -> Column:
        mean = dot(x, F.col("__theta"))
        if kind == "ts":
            return F.round(mean, 5)
        ax = F.transform(x, lambda _, i: dot(F.slice("__inv", i * F.col("__d") + 1, F.col("__d")), x))
        return F.round(mean + alpha * F.sqrt(F.greatest(dot(x, ax), F.lit(0.0))), 9)

    values = known.withColumn("__v", F.transform(features, value))
    return values.withColumn("pmf", greedy(F.col("__v"))).select(*df.columns, "pmf")
