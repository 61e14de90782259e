"""Policies of a user's own that learn: a state that rows update, and states that merge.

A learner is sequential: before each row of a log it gives probabilities to the row's actions, then it learns from the row's action
and reward. That runs in blocks here. A state of each block's rows alone comes first; a scan merges these into what each block begins
with, in blocks of blocks, as often as it takes; then each block is run through from there. No task holds an environment, and the
result is that of one pass over all rows, if states merge: learning from some rows and then others gives the merge of the state
learned from the first, and that learned from the others alone.

Cases: idx orders the rows of an environment, with gaps or not, ties in any order; a null key is a key; a row whose
probabilities are None gets null; an empty table gives an empty result; all columns are kept, one named like the result is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditframe.plans.tables import cut

#: Rows of a block, and blocks that one task merges.
BLOCK, SPAN = 4096, 512


@dataclass(frozen=True)
class Learner:
    """zero() is the state before any row; update(state, row) that after a row, which is a dict; merge(a, b) that of a's rows and
    then b's; predict(state, row) the probabilities of row["actions"]. States are whatever can be pickled, and not changed in
    place by merge or predict."""

    zero: Callable[[], Any]
    update: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    predict: Callable[[Any, dict], list[float] | None]


def _rows(t: pa.Table, idx: str) -> Iterator[dict]:
    return iter(t.sort_by(idx).to_pylist())


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def _block_states(df: DataFrame, learner: Learner, keys: list[str], idx: str, used: list[str]) -> DataFrame:
    """(keys, __block, __state): the state of each block's rows alone."""

    def one(t: pa.Table) -> pa.Table:
        state = learner.zero()
        for row in _rows(t, idx):
            state = learner.update(state, row)
        return t.select([*keys, "__block"]).slice(0, 1).append_column("__state", pa.array([pickle.dumps(state)], pa.binary()))

    schema = T.StructType([*_key_fields(df, keys), T.StructField("__block", T.LongType()), T.StructField("__state", T.BinaryType())])
    return df.select(*dict.fromkeys([*keys, "__block", idx, *used])).groupBy(*keys, "__block").applyInArrow(one, schema)


def _merged(t: pa.Table, learner: Learner) -> tuple[pa.Table, list[bytes], bytes]:
    """Blocks in order, the state before each (of these blocks alone), and that of all."""
    t = t.sort_by("__block")
    state, before = learner.zero(), []
    for s in t["__state"].to_pylist():
        before.append(pickle.dumps(state))
        state = learner.merge(state, pickle.loads(s))
    return t, before, pickle.dumps(state)


def _totals(states: DataFrame, learner: Learner, keys: list[str]) -> DataFrame:
    """SPAN blocks each made one."""

    def total(t: pa.Table) -> pa.Table:
        own = t.select([*keys, "__up"]).slice(0, 1).append_column("__state", pa.array([_merged(t, learner)[2]], pa.binary()))
        return own.rename_columns([*keys, "__block", "__state"])

    schema = T.StructType([*_key_fields(states, keys), T.StructField("__block", T.LongType()), T.StructField("__state", T.BinaryType())])
    return states.withColumn("__up", F.floor(F.col("__block") / SPAN).cast("long")).groupBy(*keys, "__up").applyInArrow(total, schema)


def _scan(states: DataFrame, learner: Learner, keys: list[str]) -> DataFrame:
    """states with, in place of each block's own state, that of all blocks before it."""
    rows = states.withColumn("__up", F.floor(F.col("__block") / SPAN).cast("long"))
    schema = rows.schema

    if (rows.agg(F.max("__up")).first()[0] or 0) == 0:

        def alone(t: pa.Table) -> pa.Table:
            t, before, _ = _merged(t, learner)
            return t.set_column(t.column_names.index("__state"), "__state", pa.array(before, pa.binary()))

        return rows.groupBy(*keys).applyInArrow(alone, schema).drop("__up")

    over = _scan(cut(_totals(states, learner, keys)), learner, keys).withColumnRenamed("__block", "__up")

    def below(t: pa.Table, o: pa.Table) -> pa.Table:
        t, before, _ = _merged(t, learner)
        start = pickle.loads(o["__state"][0].as_py())
        return t.set_column(t.column_names.index("__state"), "__state", pa.array([pickle.dumps(learner.merge(start, pickle.loads(b))) for b in before], pa.binary()))

    return rows.groupBy(*keys, "__up").cogroup(over.groupBy(*keys, "__up")).applyInArrow(below, schema).drop("__up")


def learned(df: DataFrame, learner: Learner, out: str = "pmf", keys: list[str] = ["env_id"], idx: str = "idx", used: list[str] = ["context", "actions", "action", "reward", "probability"], block: int = BLOCK) -> DataFrame:
    """df with the probabilities that the learner gives before each row. used: the columns that it looks at, those that df has."""
    df = df.drop(out)
    used = [c for c in used if c in df.columns]
    rows = df.withColumn("__block", F.floor(F.col(idx) / block).cast("long"))
    before = cut(_scan(cut(_block_states(rows, learner, keys, idx, used)), learner, keys))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        state, made, t = pickle.loads(s["__state"][0].as_py()), [], t.sort_by(idx)
        for row in t.select(list(dict.fromkeys([*keys, idx, *used]))).to_pylist():
            p = learner.predict(state, row)
            made.append(None if p is None else [float(x) for x in p])
            state = learner.update(state, row)
        return t.append_column(out, pa.array(made, pa.list_(pa.float64())))

    return rows.groupBy(*keys, "__block").cogroup(before.groupBy(*keys, "__block")).applyInArrow(run, schema).drop("__block")


def states(df: DataFrame, learner: Learner, keys: list[str] = ["env_id"], idx: str = "idx", used: list[str] = ["context", "actions", "action", "reward", "probability"], block: int = BLOCK) -> DataFrame:
    """(keys, state): what the learner knows after all rows of an environment, pickled; another log goes on from there by merge."""
    rows = df.withColumn("__block", F.floor(F.col(idx) / block).cast("long"))
    found = cut(_block_states(rows, learner, keys, idx, [c for c in used if c in df.columns]))
    while (found.agg(F.max("__block")).first()[0] or 0) > 0:
        found = cut(_totals(found, learner, keys))
    return found.select(*keys, F.col("__state").alias("state"))
