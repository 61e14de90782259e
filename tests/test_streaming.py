"""Learners and joins on streams: rows in any order, over restarts, and what is given up."""

import datetime as dt
import pickle

import pytest
from pyspark.sql import functions as F

from banditframe.operators import learning
from banditframe.streaming import live
from tests.test_learning import order_learner

SCHEMA = "env_id string, idx long, actions array<string>, action string, reward double, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def fed(spark, base, pieces, make):
    """The stream's rows after each piece; it is started anew for each."""
    seen = []
    for rows in pieces:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        q = make(spark.readStream.schema(SCHEMA).parquet(f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out")
        q.option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination(120)
        seen.append({(r.env_id, r.idx): r.pmf for r in spark.read.parquet(f"{base}/out").collect()})
    return seen


def rows(env, places):
    return [(env, k, ["a", "b"], "ab"[k % 3 == 0], float(k % 4), T0 + dt.timedelta(minutes=k)) for k in places]


def alone(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return {(r.env_id, r.idx): r.pmf for r in learning.learned(df, order_learner()).collect()}


def test_rows_wait_for_those_before_them(spark, tmp_path):
    pieces = [rows("x", [3, 1, 4]) + rows("y", [0]), rows("x", [0, 5, 3]) + rows("y", [200, 150]), rows("x", [2, 0]) + rows("y", [1])]
    seen = fed(spark, tmp_path, pieces, lambda log: live.learned(log, order_learner()))
    want = alone(spark, rows("x", range(6)) + rows("y", [0, 1]))
    assert seen[0] == {("y", 0): want["y", 0]}
    assert set(seen[1]) == {("y", 0), ("x", 0), ("x", 1)}
    assert seen[2] == want


def test_a_gap_is_given_up_when_the_watermark_has_passed(spark, tmp_path):
    pieces = [rows("x", [0, 2, 3]), rows("other", [0]) + rows("z", [500]), rows("x", [4]) + rows("z", [700]), rows("z", [800])]
    seen = fed(spark, tmp_path, pieces, lambda log: live.learned(log, order_learner(), ts="ts", late="10 minutes"))
    assert set(seen[0]) == {("x", 0)}
    want = alone(spark, rows("x", [0, 2, 3]))
    assert {k: v for k, v in seen[-1].items() if k[0] == "x"} == want


def test_state_of_old_batches_is_removed(spark, tmp_path):
    log = spark.createDataFrame(rows("x", range(40)), SCHEMA).select(F.lit(1).alias("env_id"), "idx", "action", "reward")
    for k in range(5):
        log.filter(F.floor(F.col("idx") / 8) == k).write.mode("append").parquet(f"{tmp_path}/in")
        q = live.epsilon_greedy(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), str(tmp_path), ["a", "b"])
        q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["3", "4"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40


@pytest.mark.parametrize("after, reward", [(0, 5.0), (60, 5.0), (61, 0.0), (None, 0.0)])
def test_rewards_within_an_hour(spark, tmp_path, after, reward):
    end = T0 + dt.timedelta(days=9)
    for k in range(2):
        made = [(1, T0, "a")] if k == 0 else [(2, end, "a")]
        paid = ([] if after is None else [(1, T0 + dt.timedelta(minutes=after), 5.0)]) if k == 0 else [(3, end, 1.0)]
        spark.createDataFrame(made, "id long, ts timestamp, action string").write.mode("append").parquet(f"{tmp_path}/a")
        spark.createDataFrame(paid, "id long, ts timestamp, reward double").write.mode("append").parquet(f"{tmp_path}/b")
    a, b = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, s in (("a", "id long, ts timestamp, action string"), ("b", "id long, ts timestamp, reward double")))
    q = live.rewarded(a, b, "id", "1 hour", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.id: r.reward for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1] == reward


def test_rows_of_an_environment_are_not_held_at_once():
    """Fifty thousand rows in one call come out in pieces, and those that wait are in the state; the order and the result stay."""
    from banditframe.operators.learning import Learner
    from banditframe.streaming.live import _Online

    class Value:
        at = None

        def exists(self):
            return self.at is not None

        def get(self):
            return self.at

        def update(self, v):
            self.at = v

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop

    counts = Learner(zero=int, update=lambda s, r: s + 1, merge=lambda a, b: a + b, predict=lambda s, r: [float(s)])
    one = _Online(counts, "idx", [], ["idx"], None)
    one.HELD, one.PIECE, one.known, one.early = 1000, 500, Value(), Map()
    aside, rows = [], [{"idx": (k * 7919) % 50_000} for k in range(50_000)]

    def fresh():
        for k, row in enumerate(rows):
            if k % 10_000 == 9_999:
                aside.append(sum(len(pickle.loads(v[0])) for v in one.early.values()))
            yield row

    made = list(one._go(fresh(), False, None))
    got = [v for t in made for v in zip(t["idx"], t["pmf"])]
    assert aside[0] > 8_000 and aside[2] > 28_000 and max(map(len, made)) <= 628 and not one.early
    assert got == [(k, [float(k)]) for k in range(50_000)]
