"""Order, sampling, batching and shocks of interactions. Rows have a contiguous idx from 0 for each env_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.functions import rand
from banditframe.plans.index import with_index

KEYS = ["env_id"]


def take(df: DataFrame, n: int, strict: bool = False, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """The first n rows of each environment; strict: none of one that has fewer."""
    out = df.filter(F.col(idx) < n)
    if not strict:
        return out
    return out.join(df.filter(F.col(idx) == n - 1).select(*keys), keys, "left_semi") if n else out


def slice_rows(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, idx: str = "idx") -> DataFrame:
    """Rows start, start + step, ... before stop."""
    out = df.filter((F.col(idx) >= start) & ((F.col(idx) - start) % step == 0))
    return out if stop is None else out.filter(F.col(idx) < stop)


def sort(df: DataFrame, by: list[Column], keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """Rows of each environment ordered by columns (ties keep their order) and renumbered."""
    named = df.withColumns({f"__b{k}": c for k, c in enumerate(by)})
    out = with_index(named.withColumnRenamed(idx, "__old"), keys, [*[f"__b{k}" for k in range(len(by))], "__old"], idx)
    return out.select(*df.columns)


def sparse_key(m: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0.0))


def _hash(seed: int, keys: list[str], idx: str) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *keys, idx)


def shuffle(df: DataFrame, seed: int = 1, logged: bool = False, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """A permutation of each environment that depends on the seed, the environment and idx only. Logged rows use another seed, so
    that their order doesn't follow the draws that logged them."""
    at = _hash(int(seed * 3.21 * 1000) if logged else seed, keys, idx)
    return sort(df, [at], keys, idx)


def reservoir(df: DataFrame, n: int | None, seed: int = 1, strict: bool = False, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """n rows of each environment, all equally likely, in random order; all of a shorter one, or none if strict.

    A first cut keeps the least hashes of each task's share of an environment; only those are ranked again."""
    if n is None:
        return shuffle(df, seed, keys=keys, idx=idx)
    marked = df.withColumns({"__h": _hash(seed, keys, idx), "__part": F.pmod(F.xxhash64(idx, F.lit(7)), F.lit(64))})
    local = Window.partitionBy(*keys, "__part").orderBy("__h", idx)
    best = marked.withColumn("__r", F.row_number().over(local)).filter(F.col("__r") <= n)
    final = Window.partitionBy(*keys).orderBy("__h", idx) if keys else Window.orderBy("__h", idx)
    out = best.withColumn("__n", (F.row_number().over(final) - 1).cast("long")).filter(F.col("__n") < n)
    if strict:
        enough = df.groupBy(*keys).agg(F.count("*").alias("__c")).filter(F.col("__c") >= n)
        out = out.join(enough.select(*keys), keys, "left_semi") if keys else out.filter(F.lit(n) <= enough.agg(F.max("__c")).scalar())
    return out.select(*[F.col("__n").alias(c) if c == idx else F.col(c) for c in df.columns])


def riffle(df: DataFrame, spacing: int = 3, seed: int = 1, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """Rows from the end go, one by one, to a random place in each run of `spacing` rows from the start. Exact for a spacing of
    2 or more."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = df.join(sizes, keys).withColumn("__m", F.floor(F.col("__n") / (spacing + 1)))
    i = F.col("__n") - 1 - F.col(idx)  # the i-th row from the end
    moved = i < F.col("__m")
    r = lambda k: F.floor((spacing + 1) * rand.u(seed, k + 1))
    tie = F.when((i > 0) & (r(i - 1) == spacing) & (r(i) == 0), 1).otherwise(0)
    slot = F.when(moved, i * spacing + r(i) - i + tie).otherwise(F.col(idx))
    # the i-th goes before the row in its place; at one place later ones go first, unless the tie moved them
    placed = rows.withColumns({"__slot": slot.cast("double"), "__kind": F.when(moved, 0).otherwise(1), "__i": F.when(moved, F.when(tie == 1, i - 1.5).otherwise(i)).otherwise(0.0)})
    return sort(placed, [F.col("__slot"), F.col("__kind"), F.col("__i")], keys, idx).select(*df.columns)


def batch(df: DataFrame, n: int, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """(keys, batch_id, columns as arrays) of every n rows; the last batch may be short."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys, F.floor(F.col(idx) / n).alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct(idx, *[c for c in rest if c != idx]))).alias("__r"))
    return out.select(*keys, "batch_id", *[F.col("__r")[c].alias(c) for c in rest])


def unbatch(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The rows of batches; columns that are no arrays repeat."""
    arrays = [c for c, t in df.dtypes if t.startswith("array") and c not in keys]
    rest = [c for c in df.columns if c not in arrays and c != "batch_id"]
    return df.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("__z")).select(*rest, *[F.col("__z")[c].alias(c) for c in arrays])


def batch_safe(df: DataFrame, op: Callable[[DataFrame], DataFrame], keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """An operator on single rows applied to batches, which are made again in the first one's size."""
    n = df.filter("batch_id = 0").agg(F.max(F.size(idx))).first()[0]
    return batch(op(unbatch(df, keys)), n, keys, idx)


def cycle(df: DataFrame, after: int = 0, column: str = "rewards", idx: str = "idx") -> DataFrame:
    """From row `after` on, each action has the reward of the one before it, the first that of the last. Only for actions that are
    text or one-hot; others are left as they are."""
    kind = dict(df.dtypes)["actions"]
    r, n = F.col(column), F.size(column)
    turned = F.concat(F.slice(r, n, 1), F.slice(r, 1, n - 1))
    ok = F.col(idx) >= after
    if kind.startswith("array<array"):
        acts = F.col("actions")
        unit = F.forall(acts, lambda a: (F.size(a) == n) & (F.size(F.filter(a, lambda x: x == 1)) == 1) & (F.size(F.filter(a, lambda x: x == 0)) == n - 1))
        ok = ok & unit & (F.size(F.array_distinct(acts)) == n)
    elif kind != "array<string>":
        return df
    return df.withColumn(column, F.when(ok & (n > 0), turned).otherwise(r))


def binary(df: DataFrame, column: str = "rewards") -> DataFrame:
    """1 for the best action (the first of several), 0 for all others."""
    best = F.array_position(F.col(column), F.array_max(column))
    return df.withColumn(column, F.transform(column, lambda _, i: F.when(i + 1 == best, 1.0).otherwise(0.0)))


def _noiser(how: tuple | Callable, seed: int) -> Callable[[Column, Column], Column]:
    """A function of a cell and its number among all cells (from 0)."""
    if callable(how):
        return lambda x, k: how(x, rand.u(seed, k + 1))
    kind, a, b = how if len(how) == 3 else ("g", *how)
    return (lambda x, k: x + rand.gauss(seed, k, a, b)) if kind == "g" else (lambda x, k: x + rand.randint(seed, k + 1, a, b))


def noise(df: DataFrame, context: tuple | Callable | None = None, reward: tuple | Callable | None = None, width: int = 1, n_actions: int = 0, seed: int = 1, idx: str = "idx") -> DataFrame:
    """Noise on numbers: normal (mean, sd), ('i', low, high) for whole numbers, or a function of cell and draw. Without any, the
    context gets standard normal noise. Cells are numbered row by row, the context's before the rewards'; all rows have the
    same number of cells (width of the context, n_actions rewards)."""
    if context is None and reward is None:
        context = ("g", 0, 1)
    cells = (width if context else 0) + (n_actions if reward else 0)
    base = F.col(idx) * cells
    out = df
    if context:
        f = _noiser(context, seed)
        dtype = dict(df.dtypes)["context"]
        if dtype.startswith("array"):
            made = F.transform("context", lambda x, i: f(x, base + i))
        elif dtype.startswith("map"):
            made = F.map_from_entries(F.transform(F.sort_array(F.map_entries("context")), lambda e, i: F.struct(e["key"], f(e["value"], base + i).alias("value"))))
        else:
            made = f(F.col("context"), base)
        out = out.withColumn("context", made)
    if reward:
        g = _noiser(reward, seed)
        off = base + (width if context else 0)
        out = out.withColumn("rewards", F.transform("rewards", lambda x, i: g(x, off + i)))
    return out


def grounded(df: DataFrame, n_users: int, n_normal: int, n_words: int, n_good: int, seed: int = 1, idx: str = "idx") -> DataFrame:
    """Feedback words in place of rewards: each row has a user; a normal one says a good word for the best action and a bad one
    for others, any other user the reverse. feedbacks holds the word for each action."""
    for v, name in ((n_users, "n_users"), (n_normal, "n_normal"), (n_words, "n_words"), (n_good, "n_good")):
        if v != int(v):
            raise ValueError(f"{name} must be a whole number and not {v}")
    if n_normal > n_users:
        raise ValueError("there can't be more normal users than users")
    if n_good > n_words:
        raise ValueError("there can't be more good words than words")
    best = F.array_position(F.col("rewards"), F.array_max("rewards"))
    user = F.floor(F.lit(int(n_users)) * rand.u(seed, F.col(idx) + 1)).cast("int")
    draw = rand.u(F.lit(seed) + F.col(idx), F.lit(1))
    good = F.floor(n_good * draw).cast("int")
    bad = (F.lit(int(n_good)) + F.floor((n_words - n_good) * draw)).cast("int")
    rows = df.withColumns({"userid": user, "isnormal": user < n_normal, "__best": best, "__good": good, "__bad": bad})
    word = F.transform("rewards", lambda _, i: F.when((i + 1 == F.col("__best")) == F.col("isnormal"), F.col("__good")).otherwise(F.col("__bad")))
    already = F.array_sort(F.array_distinct(F.transform("rewards", lambda x: x.cast("double")))) == F.array(F.lit(0.0), F.lit(1.0))
    ones = F.transform("rewards", lambda _, i: F.when(i + 1 == F.col("__best"), 1.0).otherwise(0.0))
    rows = rows.withColumns({"feedbacks": word, "rewards": F.when(already, F.transform("rewards", lambda x: x.cast("double"))).otherwise(ones)})
    return rows.drop("__best", "__good", "__bad")


def where_size(df: DataFrame, n_interactions: tuple | None = None, n_actions: tuple | None = None, n_features: tuple | None = None, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """Environments whose rows, and whose first context's width, are in range, and rows whose number of actions is. Ranges are
    (low, high), None for no bound."""

    def between(c: Column, r: tuple) -> Column:
        low = c >= r[0] if r[0] is not None else F.lit(True)
        return low & (c <= r[1] if r[1] is not None else F.lit(True))

    out = df if n_actions is None else df.filter(between(F.size("actions"), n_actions))
    if n_interactions is not None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(between(F.col("__n"), n_interactions))
        out = out.join(sizes.select(*keys), keys, "left_semi")
    if n_features is not None:
        wide = df.filter(F.col(idx) == 0).filter(between(F.size("context"), n_features))
        out = out.join(wide.select(*keys), keys, "left_semi")
    return out


def params(environments: DataFrame, **constants) -> DataFrame:
    """Constants attached to the environment dimension."""
    return environments.withColumns({k: F.lit(v) for k, v in constants.items()})


def empty_environments(environments: DataFrame, df: DataFrame, key: str = "env_id") -> DataFrame:
    """Environments that have no rows."""
    return environments.join(df.select(key).distinct(), key, "left_anti")


def prepend(df: DataFrame, rows: DataFrame, keys: list[str] = KEYS, idx: str = "idx") -> DataFrame:
    """rows (with their own idx from 0) before those of df."""
    shift = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    moved = df.join(shift, keys, "left").withColumn(idx, F.col(idx) + F.coalesce("__n", F.lit(0))).drop("__n")
    return rows.select(*df.columns).unionByName(moved)


def logged(df: DataFrame, pmf: Column, seed: int = 1, idx: str = "idx") -> DataFrame:
    """action, reward and probability as a policy of fixed probabilities would have logged them."""
    rows = df.withColumn("__pmf", pmf)
    at = rand.choice_index(seed, F.col(idx) + 1, F.size("__pmf"), F.col("__pmf"))
    rows = rows.withColumn("__at", at)
    return rows.withColumns({"action": F.get("actions", "__at"), "reward": F.get("rewards", "__at"), "probability": F.get("__pmf", "__at")}).drop("__pmf", "__at")
