"""Policies that learn: blocks and scans against one pass over all rows."""

import pickle
import random

import pytest

from banditframe.operators import learning

SCHEMA = "env_id string, idx long, actions array<string>, action string, reward double, pmf string, other string"


def order_learner():
    """A state that tells any wrong order: the last three actions, and sums by action."""

    def update(state, row):
        last, sums = state
        return (*last, row["action"])[-3:], sums | {row["action"]: sums.get(row["action"], 0.0) + row["reward"]}

    def merge(a, b):
        return (*a[0], *b[0])[-3:], {k: a[1].get(k, 0.0) + b[1].get(k, 0.0) for k in a[1] | b[1]}

    def predict(state, row):
        return None if row["actions"] is None else [state[0].count(a) + state[1].get(a, 0.0) / 100 for a in row["actions"]]

    return learning.Learner(lambda: ((), {}), update, merge, predict)


def log(sizes, seed=1):
    rng = random.Random(seed)
    out = []
    for env, n in sizes.items():
        for k in range(n):
            out.append((env, 3 * k + (k % 2), None if k % 17 == 5 else ["a", "b", "c"], rng.choice("abc"), float(rng.randrange(5)), "old", None))
    rng.shuffle(out)
    return out


def one_pass(rows):
    found, ends = {}, {}
    for env in {r[0] for r in rows}:
        L = order_learner()
        state = L.zero()
        for r in sorted((r for r in rows if r[0] == env), key=lambda r: r[1]):
            row = dict(zip(["env_id", "idx", "actions", "action", "reward"], r))
            found[env, r[1]] = L.predict(state, row)
            state = L.update(state, row)
        ends[env] = state
    return found, ends


@pytest.mark.parametrize("block, span", [(5, 3), (64, 512), (10_000, 512)])
def test_blocks_give_what_one_pass_gives(spark, monkeypatch, block, span):
    monkeypatch.setattr(learning, "SPAN", span)
    rows = log({"x": 211, "y": 40, None: 33, "z": 1})
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, ends = one_pass(rows)
    got = learning.learned(df, order_learner(), block=block)
    assert got.columns == ["env_id", "idx", "actions", "action", "reward", "other", "pmf"]
    assert {(r.env_id, r.idx): r.pmf for r in got.collect()} == want
    assert {r.env_id: pickle.loads(r.state) for r in learning.states(df, order_learner(), block=block).collect()} == ends


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert learning.learned(empty, order_learner()).collect() == [] and learning.states(empty, order_learner()).collect() == []


def test_another_log_goes_on(spark):
    rows = log({"x": 60})
    early, late = ([r for r in rows if (r[1] < 90) == first] for first in (True, False))
    a, b = (pickle.loads(learning.states(spark.createDataFrame(x, SCHEMA), order_learner(), block=7).first().state) for x in (early, late))
    assert order_learner().merge(a, b) == one_pass(rows)[1]["x"]
