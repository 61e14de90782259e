"""Policies and their values on a live log."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from banditframe.operators.learning import Learner
from banditframe.operators.policy import greedy
from banditframe.plans.prefix import running
from banditframe.plans.tables import cut, remove

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_value(log: DataFrame, value: str, by: list[str], ts: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """The mean value of a policy in windows of event time; rows later than `late` are left out."""
    rows = log.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "mean", "n")


def epsilon_greedy(log: DataFrame, path: str, actions: list[str], epsilon: float = 0.1, reward: str = "reward") -> DataStreamWriter:
    """A writer of (env_id, idx, action, probability) for a streaming log (env_id, idx, action, reward): the probability that an
    epsilon-greedy policy gives each row's action, learned from the rows before it.

    Rows of a micro-batch are taken in the order of idx, by prefix sums in blocks, so that one environment spreads over many tasks.
    What carries over to the next one is a count and a sum for each environment and action. Both are written in a folder of the
    batch, so that a batch that is run again leaves the same; states that no batch can need any more are removed. The rows of a
    batch are computed once."""

    def step(rows: DataFrame, batch: int) -> None:
        spark, rows = rows.sparkSession, cut(rows)
        names = [f"{x}_{k}" for k in range(len(actions)) for x in "ns"]
        hit = lambda k: F.col("action") == actions[k]
        sums = {f"n_{k}": F.when(hit(k), 1).otherwise(0).cast("long") for k in range(len(actions))} | {f"s_{k}": F.when(hit(k), F.col(reward)).otherwise(0.0) for k in range(len(actions))}
        here = running(rows, ["env_id"], "idx", sums, upto=-1)
        old = spark.read.parquet(f"{path}/state/{batch - 1}") if batch else None
        if old is not None:
            before = old.withColumnsRenamed({n: f"__{n}" for n in names})
            here = here.join(before, "env_id", "left")
        total = lambda n: F.coalesce(F.col(n), F.lit(0)) + (F.coalesce(F.col(f"__{n}"), F.lit(0)) if old is not None else F.lit(0))
        q = F.array(*[F.try_divide(total(f"s_{k}"), total(f"n_{k}").cast("double")) for k in range(len(actions))])
        known = F.array(*[F.lit(a) for a in actions])
        made = here.withColumn("__q", q).withColumn("pmf", greedy(F.col("__q"), epsilon)).withColumn("__at", F.array_position(known, F.col("action")))
        p = F.when(F.col("__at") > 0, F.get("pmf", (F.col("__at") - 1).cast("int"))).otherwise(0.0)
        made.select("env_id", "idx", "action", p.alias("probability")).write.mode("overwrite").parquet(f"{path}/out/batch={batch}")
        new = rows.groupBy("env_id").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        state = (new if old is None else old.unionByName(new)).groupBy("env_id").agg(*[F.sum(n).alias(n) for n in names])
        state.write.mode("overwrite").parquet(f"{path}/state/{batch}")
        if batch > 1:
            remove(spark, f"{path}/state/{batch - 2}")

    return log.writeStream.foreachBatch(step)


def rewarded(choices: DataFrame, rewards: DataFrame, on: str, within: str = "1 hour", late: str = "1 hour", ts: str = "ts", reward: str = "reward", missing: float = 0.0) -> DataFrame:
    """choices with the reward that a second stream brings for them: that with the same `on` and a time up to `within` after the
    choice's; `missing` for choices that get none, as soon as the watermarks of both streams (`late`) say that none can come. State is
    kept for as long as that. If several rewards come, each gives a row."""
    right = rewards.select(F.col(on).alias("__on"), F.col(ts).alias("__at"), F.col(reward).alias("__reward")).withWatermark("__at", late)
    left = choices.drop(reward).withWatermark(ts, late)
    met = left.join(right, (left[on] == right["__on"]) & (right["__at"] >= left[ts]) & (right["__at"] <= left[ts] + F.expr(f"interval {within}")), "left_outer")
    return met.withColumn(reward, F.coalesce("__reward", F.lit(missing))).drop("__on", "__at", "__reward")


class _Online(StatefulProcessor):
    """One environment: the state of a learner, the number of the row that it waits for, and rows that came before their turn, CHUNK
    numbers to an entry."""

    CHUNK, HELD, PIECE = 128, 1 << 17, 1 << 13

    def __init__(self, learner: Learner, idx: str, used: list[str], out: list[str], ts: str | None) -> None:
        self.learner, self.idx, self.used, self.out, self.ts = learner, idx, used, out, ts

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", T.StructType([T.StructField("next", T.LongType()), T.StructField("state", T.BinaryType())]))
        self.early = handle.getMapState("early", T.StructType([T.StructField("chunk", T.LongType())]), T.StructType([T.StructField("rows", T.BinaryType())]))

    def _stored(self, c: int) -> dict[int, dict]:
        return pickle.loads(bytes(self.early.getValue((c,))[0])) if self.early.containsKey((c,)) else {}

    def _store(self, c: int, rows: dict[int, dict]) -> None:
        if rows:
            self.early.updateValue((c,), (pickle.dumps(rows),))
        elif self.early.containsKey((c,)):
            self.early.removeKey((c,))

    def _go(self, fresh: Iterator[dict], skip: bool, times: Any) -> Iterator[pd.DataFrame]:
        """Takes the rows whose turn it is, puts the others aside; skip: the first row that is there is the next one. No more than HELD
        rows and a chunk are in memory at once."""
        n, state = self.known.get() if self.known.exists() else (0, None)
        state = self.learner.zero() if state is None else pickle.loads(bytes(state))
        held: dict[int, dict[int, dict]] = {}
        many, made = 0, []
        if skip and (aside := [k[0] for k in self.early.keys()]):
            n = min(self._stored(min(aside)))
        for row in chain(fresh, [None]):
            if row is not None:
                if row[self.idx] >= n:  # the others have had their turn, or were given up
                    held.setdefault(row[self.idx] // self.CHUNK, {})[row[self.idx]] = row
                    many += 1
                if many < self.HELD:
                    continue
            more = True
            while more:
                c = n // self.CHUNK
                rows = self._stored(c) | held.pop(c, {})
                while (own := rows.pop(n, None)) is not None:
                    p = self.learner.predict(state, own)
                    made.append((*(own[x] for x in self.out), None if p is None else [float(v) for v in p]))
                    state, n = self.learner.update(state, own), n + 1
                self._store(c, rows)
                more = n // self.CHUNK > c
                if len(made) >= self.PIECE or made and not more:
                    yield pd.DataFrame(made, columns=[*self.out, "pmf"])
                    made = []
            for c, rows in held.items():
                self._store(c, self._stored(c) | rows)
            held, many = {}, 0
        self.known.update((n, pickle.dumps(state)))
        if self.ts is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if aside := [k[0] for k in self.early.keys()]:
                first = self._stored(min(aside))
                at = int(first[min(first)][self.ts].timestamp() * 1000)
                self.handle.registerTimer(max(at, times.getCurrentWatermarkInMs()) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = list(dict.fromkeys([*self.out, self.idx, *self.used]))
        yield from self._go((row for batch in rows for row in batch[names].to_dict("records")), False, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """What is missing is given up."""
        yield from self._go(iter(()), True, timerValues)

    def close(self) -> None:
        pass


def learned(log: DataFrame, learner: Learner, out: list[str] = ["action"], used: list[str] = ["context", "actions", "action", "reward", "probability"], key: str = "env_id", idx: str = "idx", ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, idx, out columns, pmf) of a streaming log: the probabilities that the learner gives before each row of an environment.

    The rows of an environment are numbered from 0 without gaps. They may come in any order and in any micro-batch: a row waits in
    map state for those before it, for as long as it takes; or, if ts names the rows' time, until the watermark (`late` behind the
    latest time) has passed the first waiting row, when a timer gives up what is missing, and what comes of it later is left out. A
    row that comes twice counts once. State is the learner's, and the waiting rows; it is in Spark's RocksDB store (which this sets for
    the session), so a stream that is started again goes on. An environment is one task's here, as its rows are taken one by
    one; `epsilon_greedy` above, or `operators.learning` on a table, split one."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    used = [c for c in [*used, ts] if c in log.columns]
    names = [key, idx, *(c for c in out if c not in (key, idx))]
    schema = T.StructType([*(log.schema[c] for c in names), T.StructField("pmf", T.ArrayType(T.DoubleType()))])
    rows = log.select(*dict.fromkeys([*names, *used]))
    rows = rows if ts is None else rows.withWatermark(ts, late)
    return rows.groupBy(key).transformWithStateInPandas(_Online(learner, idx, used, names, ts), schema, "Append", "None" if ts is None else "EventTime")
