"""Off-policy evaluation: reward estimates of logged data, evaluation of policies, rejection sampling, the evaluation job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.functions import encoders, rand
from banditframe.operators import policy
from banditframe.plans.index import with_index
from banditframe.plans.prefix import running
from banditframe.plans.tables import cut

KEYS = ["env_id"]
NEEDS = {"on": ["actions", "rewards"], "ips": ["action", "reward"], "dm": ["context", "actions", "action", "reward"], "dr": ["context", "actions", "action", "reward"], "rejection": ["context", "action", "reward", "actions", "probability"]}


def lacking(df: DataFrame, mode: str) -> list[str]:
    """The columns that an evaluation needs and df has not."""
    return [c for c in NEEDS[mode] if c not in df.columns]


def require(df: DataFrame, mode: str) -> None:
    """An error that names the columns an evaluation lacks, before any job runs."""
    if names := lacking(df, mode):
        raise ValueError(f"{mode} evaluation needs the columns {', '.join(names)}")


def incomplete(df: DataFrame, mode: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, rows, incomplete, and for each needed column how often it is null): which environments of a log an evaluation can't use
    as they are. A column that df has not is null in every row."""
    gap = lambda c: F.col(c).isNull() if c in df.columns else F.lit(True)
    any_ = F.lit(False)
    for c in NEEDS[mode]:
        any_ = any_ | gap(c)
    count = lambda x: F.sum(x.cast("long"))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), count(any_).alias("incomplete"), *[count(gap(c)).alias(c) for c in NEEDS[mode]])


def ips(action: Column, logged: Column = None, reward: Column = None, probability: Column = None) -> Column:
    """reward / probability for the logged action (a missing or zero probability counts as 1), 0 for others."""
    logged = F.col("action") if logged is None else logged
    reward = F.col("reward") if reward is None else reward
    probability = F.col("probability") if probability is None else probability
    return F.when(action.eqNullSafe(logged), reward / F.coalesce(F.nullif(probability, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def ips_rewards(df: DataFrame, out: str = "rewards") -> DataFrame:
    """The estimated reward of every action."""
    p = F.coalesce(F.nullif("probability", F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out, F.transform("actions", lambda a: F.when(a.eqNullSafe(F.col("action")), F.col("reward") / p).otherwise(0.0)))


#: What a regression estimate looks at: the constant, the action, its crosses with the context and with the context's squares.
CROSSES = [1, "a", "xa", "xxa"]


def _features(df: DataFrame, actions: list[str], at: Column, terms: list, width: int) -> Column:
    """The cross terms of the context (x) and the indicators of the action in place `at` (a)."""
    on = F.transform(F.sequence(F.lit(0), F.lit(len(actions) - 1)), lambda k: F.when(k == at, 1.0).otherwise(0.0))
    if not width:  # without a context only what holds no x is left
        terms = [t for t in terms if not isinstance(t, str) or "x" not in t]
        return encoders.crosses({"a": (on, len(actions))}, terms)
    c = F.col("context") if dict(df.dtypes)["context"].startswith("array") else F.array("context")
    x = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(c, i).cast("double"), F.lit(0.0)))
    return encoders.crosses({"x": (x, width), "a": (on, len(actions))}, terms)


def moments(rows: DataFrame, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each fold of rows (x, y, w, fold) the sums of w x x' and w y x. Tasks sum what they read; what meets on the driver is a
    matrix as wide as x for each fold."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x, w = np.stack(part["x"].to_numpy()), part["w"].to_numpy()[:, None]
                own = np.concatenate([x.T @ (x * w), (x * w).T @ part["y"].to_numpy()[:, None]], axis=1)
                at[fold] = at[fold] + own if fold in at else own
        for fold, m in at.items():
            i, j = np.nonzero(m)
            yield pd.DataFrame({"fold": fold, "i": i, "j": j, "v": m[i, j]})

    found = rows.mapInPandas(summed, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for fold, part in found.groupby("fold"):
        m = np.zeros((width, width + 1))
        m[part["i"], part["j"]] = part["v"]
        out[int(fold)] = (m[:, :-1], m[:, -1])
    return out


def least_squares(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The coefficients; of features that say the same the shortest ones, in units of each one's size."""
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    size[size == 0] = 1.0
    return np.linalg.lstsq(gram / np.outer(size, size), right / size, rcond=1e-10)[0] / size


def direct_method(df: DataFrame, actions: list[str], out: str = "rewards", folds: int = 1, features: list = CROSSES, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """The predicted reward of every action, by a linear regression on cross terms of action and context (as in
    `encoders.crosses`), rows weighted by 1 / probability. With folds, a row's prediction comes from a model of the other folds; all
    models come from one pass. Rows without a reward teach nothing; missing context numbers are 0."""
    require(df, "dm")
    logged = (F.array_position(F.col("actions"), F.col("action")) - 1).cast("int")
    p = F.coalesce(F.nullif("probability", F.lit(0.0)), F.lit(1.0)) if "probability" in df.columns else F.lit(1.0)
    fold = F.pmod(F.xxhash64(*keys, idx), F.lit(folds)).cast("int")
    dtype = dict(df.dtypes)["context"]
    width = (df.agg(F.max(F.size("context"))).first()[0] or 0) if dtype.startswith("array") else 0 if dtype == "void" else 1
    one = lambda at: _features(df, actions, at, features, width)
    train = df.filter("reward is not null").select(one(logged).alias("x"), F.col("reward").cast("double").alias("y"), (1 / p).alias("w"), fold.alias("fold"))
    sums = moments(train, train.select(F.size("x")).limit(1).first()[0] if not train.isEmpty() else 0)
    made = None
    for f in range(folds):
        used = [m for k, m in sums.items() if folds == 1 or k != f]
        if not used:
            raise ValueError("no rewards to learn from")
        beta = F.array(*[F.lit(float(b)) for b in least_squares(sum(g for g, _ in used), sum(r for _, r in used))])
        value = lambda k, beta=beta: F.aggregate(F.zip_with(one(F.lit(k)), beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        pred = F.array(*[value(k) for k in range(len(actions))])
        made = F.when(fold == f, pred) if made is None else made.when(fold == f, pred)
    return df.withColumn(out, made)


def doubly_robust(df: DataFrame, actions: list[str], out: str = "rewards", **options) -> DataFrame:
    """The direct method's rewards, plus its error / probability on the logged action."""
    p = F.coalesce(F.nullif("probability", F.lit(0.0)), F.lit(1.0))
    dm = direct_method(df, actions, "__dm", **options)
    zipped = F.arrays_zip(F.col("actions").alias("a"), F.col("__dm").alias("m"))
    fixed = F.transform(zipped, lambda z: z["m"] + F.when(z["a"].eqNullSafe(F.col("action")), (F.col("reward") - z["m"]) / p).otherwise(0.0))
    return dm.withColumn(out, fixed).drop("__dm")


# ---- evaluation of policies


def on_policy(df: DataFrame, seed: int = 1) -> DataFrame:
    """df (with pmf) with the drawn action and its reward of the full reward vector, as eval_reward."""
    require(df, "on")
    return policy.draw(df, seed=seed).withColumn("eval_reward", F.get("rewards", "at"))


def off_policy_score(df: DataFrame) -> DataFrame:
    """eval_reward = probability of the logged action under the policy * reward / logged probability."""
    require(df, "ips")
    return df.withColumn("eval_reward", policy.score(F.col("pmf")) * ips(F.col("action")))


def off_policy_drawn(df: DataFrame, seed: int = 1) -> DataFrame:
    """eval_reward = inverse propensity reward of a drawn action."""
    require(df, "ips")
    return policy.draw(df, seed=seed).withColumn("eval_reward", ips(F.col("on_action")))


def at_drawn(df: DataFrame, rewards: str, seed: int = 1) -> DataFrame:
    """eval_reward = estimated reward (direct method or doubly robust) of a drawn action."""
    return policy.draw(df, seed=seed).withColumn("eval_reward", F.get(rewards, "at"))


def record(df: DataFrame, what: list[str], keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """The recorded columns, and all that the evaluation does not use itself."""
    own = {"context", "actions", "rewards", "action", "reward", "probability", "pmf", "at", "on_action", "on_prob", "eval_reward", *keys, idx}
    source = {"reward": "eval_reward", "action": "on_action", "probability": "on_prob"}
    picked = [F.col(source.get(w, w) if source.get(w, w) in df.columns else w).alias(w) for w in what]
    return df.select(*keys, idx, *picked, *[c for c in df.columns if c not in own])


def correlated(df: DataFrame, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """(keys, warn): whether, at some point from the 21st to the 199th row, at most 1 % of the estimated rewards were zero, which
    tells that policy and log choose alike."""
    w = Window.partitionBy(*keys).orderBy(idx)
    rows = df.filter(F.col(idx) < 199).withColumn("__z", F.sum(F.when(F.col("eval_reward") == 0, 1).otherwise(0)).over(w))
    n = F.col(idx) + 1
    return rows.groupBy(*keys).agg(F.max((n > 20) & (n < 200) & (F.col("__z") <= n * 0.01)).alias("warn"))


def igl(df: DataFrame, seed: int = 1) -> DataFrame:
    """Grounded interactions: the policy sees the user in front of the context and is judged by its feedback; both the feedback and
    the reward of the drawn action are recorded."""
    dtype = dict(df.dtypes)["context"]
    if dtype.startswith("map"):
        context = F.map_concat(F.create_map(F.lit("userid"), F.col("userid").cast("double")), F.col("context"))
    elif dtype.startswith("array"):
        context = F.concat(F.array(F.col("userid").cast("double")), F.col("context"))
    else:
        context = F.array(F.col("userid").cast("double"), F.col("context").cast("double"))
    rows = policy.draw(df.withColumn("context", context), seed=seed)
    return rows.withColumns({"feedback": F.get("feedbacks", "at"), "eval_reward": F.get("rewards", "at")})


def rejection(df: DataFrame, c: float | None = None, ope: bool = False, cmax: float = 1.0, seed: int = 1, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """Rows (with pmf) that rejection sampling accepts: u <= c * pi / p, one draw a row. c is a constant, or the least of p and
    (1 - p) / (K - 1) over the environment's first 100 rows, at most cmax.

    With ope the recorded reward is the mean of the accepted reward and the estimates of the rejected rows right before it."""
    require(df, "rejection")
    rows = df.withColumn("on_prob", policy.score(F.col("pmf")))
    if c is None:
        p, k = F.col("probability"), F.size("actions")
        least = F.least(F.min(F.nullif(p, F.lit(0.0))), F.min(F.nullif((1 - p) / (k - 1), F.lit(0.0))), F.lit(cmax))
        rows = rows.join(df.filter(F.col(idx) < 100).groupBy(*keys).agg(least.alias("__c")), keys)
    else:
        rows = rows.withColumn("__c", F.lit(float(c)))
    rows = rows.withColumn("__ok", rand.u(seed, F.col(idx) + 1) <= F.col("__c") * F.col("on_prob") / F.col("probability"))
    if not ope:
        return rows.filter("__ok").withColumn("eval_reward", F.col("reward")).drop("__ok", "__c")
    value = F.when(F.col("__ok"), F.col("reward")).otherwise(F.col("on_prob") * ips(F.col("action")))
    runs = running(rows.withColumn("__v", value), keys, idx, {"__run": F.when(F.col("__ok"), 1).otherwise(0)}, upto=-1)
    runs = runs.withColumn("__run", F.coalesce("__run", F.lit(0)))
    means = runs.groupBy(*keys, "__run").agg(F.avg("__v").alias("eval_reward"))
    return runs.filter("__ok").join(means, [*keys, "__run"]).drop("__ok", "__c", "__v", "__run")


def rejection_adaptive(df: DataFrame, cpct: float = 0.005, cmax: float = 1.0, block: int = 1000, seed: int = 1, keys: list[str] = KEYS, idx: str = "idx", bins: int = 1024) -> DataFrame:
    """As `rejection`, with c for each block of rows from the percentile of p / pi over all earlier blocks.

    Earlier blocks are summed as counts in `bins` bins of log(p / pi), so what a block needs is bounded; c is exact to the width of
    a bin, below the value. The first block has the least of its own probabilities."""
    require(df, "rejection")
    rows = df.withColumn("on_prob", policy.score(F.col("pmf"))).withColumn("__block", F.floor(F.col(idx) / block))
    ratio = F.col("probability") / F.col("on_prob")
    width = 20.0 / bins
    cells = rows.filter("on_prob > 0").groupBy(*keys, "__block", F.floor((F.ln(ratio) + 10) / width).alias("bin")).agg(F.count("*").alias("n"))
    # each block with each bin of its environment: a running sum for each bin, then one over the bins of each block
    cells = cut(cells)
    blocks = rows.select(*keys, "__block").distinct().join(cells.select(*keys, "bin").distinct(), keys)
    before = Window.partitionBy(*keys, "bin").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    past = blocks.join(cells, [*keys, "__block", "bin"], "left").withColumn("n", F.sum("n").over(before)).filter("n > 0")
    w = Window.partitionBy(*keys, "__block")
    seen = past.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    c = seen.filter(F.col("upto") > cpct * (F.col("all") - 1)).groupBy(*keys, "__block").agg(F.least(F.exp(F.min("bin") * width - 10), F.lit(cmax)).alias("__c"))
    first = rows.filter("__block = 0").groupBy(*keys).agg(F.least(F.min("probability"), F.lit(cmax)).alias("__c0"))
    rows = rows.join(c, [*keys, "__block"], "left").join(first, keys).withColumn("__c", F.coalesce("__c", "__c0"))
    return rows.filter(rand.u(seed, F.col(idx) + 1) <= F.col("__c") * F.col("on_prob") / F.col("probability")).withColumn("eval_reward", F.col("reward")).drop("__block", "__c", "__c0")


# ---- the evaluation job


def evaluate(interactions: DataFrame, policies: dict[int, Callable[[DataFrame], DataFrame]], evaluators: dict[int, Callable[[DataFrame], DataFrame]], done: DataFrame | None = None) -> DataFrame:
    """(environment_id, learner_id, evaluator_id, index, reward) of every environment, policy and evaluator. Triples in done are
    left out before their policies run."""
    out = None
    for lrn, pol in policies.items():
        for val, ev in evaluators.items():
            rows = interactions
            if done is not None:
                had = done.filter((F.col("learner_id") == lrn) & (F.col("evaluator_id") == val)).select(F.col("environment_id").alias("env_id")).distinct()
                rows = rows.join(had, "env_id", "left_anti")
            made = ev(pol(rows)).select(F.col("env_id").alias("environment_id"), F.lit(lrn).alias("learner_id"), F.lit(val).alias("evaluator_id"), "idx", F.col("eval_reward").alias("reward"))
            out = made if out is None else out.unionByName(made)
    out = with_index(out, ["environment_id", "learner_id", "evaluator_id"], ["idx"], "index", 1)
    return out.select("environment_id", "learner_id", "evaluator_id", "index", "reward")
