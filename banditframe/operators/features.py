"""Representations of contexts and actions: categories, sparse and dense forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.functions.encoders import bucket, levels, onehot
from banditframe.plans.index import with_index


def repr_actions(df: DataFrame, how: str = "onehot", column: str = "actions") -> DataFrame:
    """Text actions as one-hot arrays (their level is their place in the row's list) or as they are. Rewards stay aligned; a
    logged action gets the same form."""
    if how == "string":
        return df
    acts = F.col(column)
    out = {column: F.transform(acts, lambda a: onehot(a, acts))}
    if "action" in df.columns:
        out["action"] = onehot(F.col("action"), acts)
    return df.withColumns(out)


def repr_context(parts: list[tuple[Column, Column | None]], how: str = "onehot") -> Column:
    """A context of cells (column, levels or None for numbers): one-hot spliced, one-hot nested, or text."""
    if how == "string":
        return F.array(*[c.cast("string") for c, _ in parts])
    cells = [F.array(c.cast("double")) if lv is None else F.transform(onehot(c, lv), lambda x: x.cast("double")) for c, lv in parts]
    return F.array(*cells) if how == "onehot_tuple" else F.flatten(F.array(*cells))


def repr_sparse(m: Column, categorical: list[str]) -> Column:
    """Text cells of a sparse context become {key_level: 1}; others must be numbers."""
    key = lambda k, v: F.when(k.isin(*categorical), F.concat(k, F.lit("_"), v)).otherwise(k)
    entry = lambda e: F.struct(key(e["key"], e["value"]).alias("key"), F.when(e["key"].isin(*categorical), 1.0).otherwise(e["value"].try_cast("double")).alias("value"))
    return F.map_from_entries(F.transform(F.map_entries(m), entry))


def sparse(c: Column, dtype: str, name: str = "context", headers: list[str] | None = None) -> Column:
    """A dense row or single value as a map; zeros are left out, null stays null."""
    if dtype.startswith("map"):
        return c
    if dtype.startswith("array"):
        keys = F.array(*[F.lit(h) for h in headers]) if headers else F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: i.cast("string"))
        full = F.when(F.size(c) > 0, F.map_from_arrays(keys, c))
        return F.map_filter(full, lambda _, v: v != 0)
    return F.when(c.isNotNull(), F.map_filter(F.create_map(F.lit(name), c), lambda _, v: v.cast("string") != "0"))


def dense_hashed(m: Column, n: int) -> Column:
    """A map as an array of n slots by CRC-32 of the key; of keys with one slot the last in the map wins."""
    zeros = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda _: F.lit(0.0))
    put = lambda acc, e: F.transform(acc, lambda x, i: F.when(i == bucket(e["key"], n), e["value"].cast("double")).otherwise(x))
    return F.aggregate(F.map_entries(m), zeros, put)


def slots(df: DataFrame, m: str, n: int, order: list[str], seed: int = 1) -> DataFrame:
    """(key, slot): keys in order of first appearance get the next of n slots, in an order shuffled by hash, again and again.

    The dictionary has a row for each feature name, found by an aggregation and numbered over a range partitioning."""
    first = df.select(*order, F.explode(F.map_keys(m)).alias("key")).groupBy("key").agg(F.min(F.struct(*order)).alias("o"))
    ranked = with_index(first, [], ["o", "key"], "r").select("key", (F.col("r") % n).alias("r"))
    spark = df.sparkSession
    shuffled = spark.range(n).select((F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id")) - 1).alias("r"), F.col("id").cast("int").alias("slot"))
    return ranked.join(shuffled, "r").select("key", "slot")


def dense_lookup(df: DataFrame, m: str, n: int, order: list[str], out: str = "dense", seed: int = 1) -> DataFrame:
    """df with an array of n slots in place of a map, by the dictionary of `slots`; of keys with one slot the last by key wins."""
    known = slots(df, m, n, order, seed)
    cells = df.select(*order, F.explode(m).alias("key", "value")).join(known, "key")
    lists = cells.groupBy(*order).agg(F.sort_array(F.collect_list(F.struct("key", "slot", "value"))).alias("__c"))
    zeros = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda _: F.lit(0.0))
    made = F.aggregate(F.col("__c"), zeros, lambda acc, e: F.transform(acc, lambda x, i: F.when(i == e["slot"], e["value"].cast("double")).otherwise(x)))
    return df.join(lists.select(*order, made.alias(out)), order, "left").withColumn(out, F.coalesce(F.col(out), zeros)).drop(m)


def finalize(df: DataFrame, how: str = "onehot") -> DataFrame:
    """Text actions as one-hot arrays, and rewards as a map from the action's text to its reward."""
    text = F.transform("actions", lambda a: a.cast("string"))
    rewards = F.map_from_arrays(text, F.col("rewards"))
    return repr_actions(df.withColumn("rewards", rewards), how) if dict(df.dtypes)["actions"] == "array<string>" else df.withColumn("rewards", rewards)


def supervised(df: DataFrame, features: Column, label: str, kind: str = "c", idx: str = "idx", take: int | None = None, seed: int = 1) -> DataFrame:
    """Interactions of a supervised table. c: the sorted labels are the actions and a row's own one has reward 1; m: labels are
    lists, an action's reward is its Jaccard share; r: no actions, the reward is minus the distance to the label."""
    from banditframe.functions import rewards as R
    from banditframe.operators.reshape import reservoir

    if take is not None:
        df = reservoir(df, take, seed, keys=[], idx=idx)
    if kind == "r":
        return df.select(F.lit(0).alias("env_id"), F.col(idx).alias("idx"), features.alias("context"), F.array().cast("array<double>").alias("actions"), R.spec("L1", F.col(label)).alias("rewards"))
    if kind == "m":
        known = levels(df.select(F.explode(label).alias("l")), "l").scalar()
        rewards = F.transform("actions", lambda a: R.hamming(F.col(label), F.array(a)))
    else:
        known = levels(df, label).scalar()
        rewards = F.transform("actions", lambda a: R.binary(F.col(label), a))
    rows = df.withColumn("actions", known)
    return rows.select(F.lit(0).alias("env_id"), F.col(idx).alias("idx"), features.alias("context"), "actions", rewards.alias("rewards"))


def drop_by_descriptor(df: DataFrame, descriptors: DataFrame, target: str) -> DataFrame:
    """The columns that descriptors (name, ignore, row_id, type) let pass, complete rows only, the target as label. Descriptors
    are one row a column."""
    bad = {r["name"] for r in descriptors.filter("ignore or row_id or type not in ('numeric', 'nominal')").select("name").collect()}
    keep = [c for c in df.columns if c == target or c not in bad]
    return df.select(*keep).dropna().withColumnRenamed(target, "label")
