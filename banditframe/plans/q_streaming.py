"""Streaming queries: the events as a file source, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from banditframe.functions import encoders as E
from banditframe.operators import features, ope, policy, reshape, rows
from banditframe.plans import data, q_interactions, q_policies
from banditframe.plans.data import LOGGED, TYPES
from banditframe.plans.q_policies import DRAWN, EPS, P_SQL, PMF, _epsilon_learner
from banditframe.plans.tables import shared_dir, table
from banditframe.streaming import live

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _run(spark, df, base=None):
    """The rows of a stream that has read all that there is. They are written as Parquet to the shared folder. A stream that ran
    before with the same base goes on from there."""
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _stream(spark, df):
    """df as a file source, written first."""
    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query(f"WITH {LOGGED} SELECT env_id, idx, round({P_SQL.format(a='action')} * reward / probability, 6) AS reward FROM logged WHERE reward > 0.01")
def x1_row_operators(spark, d):
    """Filter, fixed policy and score on a stream: the same columns as on a table."""
    rows = _stream(spark, data.logged(spark, d)).filter("reward > 0.01")
    out = ope.off_policy_score(rows.withColumn("pmf", policy.fixed(PMF)))
    return _run(spark, out.select("env_id", "idx", F.round("eval_reward", 6).alias("reward")))


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY ALL) SELECT start, event_type, round(mean, 6) AS mean, n FROM w")
def x2_windowed_value(spark, d):
    """All windows, as of the end of the stream: a first run reads the events, in as many files and tasks as there are; a second
    one goes on with a row of its own that moves the watermark past all windows."""
    ev = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    end = ev.agg(F.max("ts").alias("m")).select((F.col("m") + F.expr("interval 10 days")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    path, base = (f"{shared_dir(spark)}/{x}-{uuid.uuid4().hex}" for x in ("source", "stream"))
    ev.write.parquet(path)
    out = live.windowed_value(spark.readStream.schema(ev.schema).parquet(path), "value", ["event_type"])
    _run(spark, out, base)
    end.write.mode("append").parquet(path)
    return _run(spark, out, base).filter("event_type <> 'end'").withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


@query(f"WITH {LOGGED}, {EPS} SELECT env_id, idx, action, round(p, 6) AS probability FROM pm WHERE cand = action")
def x3_epsilon_greedy(spark, d):
    """The log comes in three pieces, by idx; each is a micro-batch or several."""
    log = data.logged(spark, d).select("env_id", "idx", "action", "reward")
    base, third = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", log.agg(F.max("idx")).first()[0] // 3 + 1
    log.limit(0).write.parquet(f"{base}/source")
    stream = live.epsilon_greedy(spark.readStream.schema(log.schema).parquet(f"{base}/source"), base, TYPES).option("checkpointLocation", f"{base}/check").trigger(availableNow=True)
    for k in range(3):
        log.filter(F.floor(F.col("idx") / third) == k).write.mode("append").parquet(f"{base}/source")
        stream.start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("env_id", "idx", "action", F.round("probability", 6).alias("probability"))


@query(f"WITH {LOGGED}, {EPS} SELECT env_id, idx, action, list(round(p, 6) ORDER BY cand) AS pmf FROM pm GROUP BY ALL")
def x3_stateful_learner(spark, d):
    """A user's policy with its state in the stream. The log comes in three pieces that have rows of everywhere in it, and the
    stream is started again for each, so rows wait for others over restarts."""
    log = data.logged(spark, d).select("env_id", "idx", "actions", "action", "reward")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{base}/source"
    log.limit(0).write.parquet(path)
    out = live.learned(spark.readStream.schema(log.schema).parquet(path), _epsilon_learner(0.1))
    for k in range(3):
        log.filter(F.pmod(F.xxhash64("env_id", "idx"), F.lit(3)) == k).write.mode("append").parquet(path)
        made = _run(spark, out, base)
    return made.select("env_id", "idx", "action", F.transform("pmf", lambda p: F.round(p, 6)).alias("pmf"))


@query(q_interactions.SQL["p13_drop"])
def x1_drop_rows_and_columns(spark, d):
    return _run(spark, rows.drop(_stream(spark, q_interactions._items(spark, d)), [3, "l_discount", "l_tax"], F.col("l_discount") > 0.05))


@query(q_interactions.SQL["p14_label"])
def x1_label(spark, d):
    out = rows.label(_stream(spark, q_interactions._items(spark, d)), "l_returnflag", "c")
    return _run(spark, out.select("features.l_orderkey", "features.l_linenumber", "features.l_tax", "label", "kind"))


@query(q_interactions.SQL["p15_encode"])
def x1_encode(spark, d):
    out = rows.encode(_stream(spark, q_interactions._items(spark, d)), {"l_quantity": E.string, 6: lambda c: F.coalesce(F.nanvl(E.numeric(c), F.lit(-1.0)), F.lit(-1.0))})
    return _run(spark, out.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


@query(q_interactions.SQL["p17_structure"])
def x1_structure(spark, d):
    q = _stream(spark, q_interactions._items(spark, d).drop("l_extendedprice", "l_discount", "l_returnflag"))
    out = q.select(rows.structure([["l_tax"], None, "l_quantity"], q.columns).alias("s"))
    return _run(spark, out.select(F.col("s._1.l_orderkey"), F.col("s._1.l_linenumber"), F.col("s._0.l_tax"), F.col("s.l_quantity")))


@query(q_interactions.SQL["p19_flatten"])
def x1_flatten(spark, d):
    q = _stream(spark, q_interactions._items(spark, d))
    dense = rows.flatten_dense([(F.col("l_quantity"), False), (F.array("l_tax", "l_discount"), True)])
    m = rows.flatten_sparse(F.create_map(F.lit("k"), F.array("l_tax", "l_discount")))
    return _run(spark, q.select("l_orderkey", "l_linenumber", dense.alias("x"), F.try_element_at(m, F.lit("k_0")).alias("k0"), F.try_element_at(m, F.lit("k_1")).alias("k1")))


@query(q_interactions.SQL["r4_sparse"])
def x1_sparse(spark, d):
    q = _stream(spark, q_interactions._items(spark, d))
    m = features.sparse(F.array("l_tax", "l_discount"), "array<double>")
    return _run(spark, q.select("l_orderkey", "l_linenumber", F.try_element_at(m, F.lit("0")).alias("t"), F.try_element_at(m, F.lit("1")).alias("d"), F.size(m).alias("n")))


@query(q_interactions.SQL["r8_binary"])
def x1_binary_rewards(spark, d):
    q = _stream(spark, q_interactions._items(spark, d)).withColumn("rewards", F.array("l_tax", "l_discount"))
    return _run(spark, reshape.binary(q).select("l_orderkey", "l_linenumber", "rewards"))


@query(q_interactions.SQL["r9_noise"])
def x1_noise(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("value").alias("context"))
    return _run(spark, reshape.noise(_stream(spark, ev)).select("idx", F.round("context", 6).alias("context")))


@query(q_interactions.SQL["r14_j11_logged"])
def x1_logged(spark, d):
    """A logging policy on a stream of simulated interactions."""
    out = reshape.logged(_stream(spark, data.simulated(spark, d)), F.transform("actions", lambda a: F.lit(0.1)), 13)
    return _run(spark, out.select("idx", "action", "reward", "probability"))


@query(q_policies.SQL["e3_draw_and_score"])
def x1_draw_and_score(spark, d):
    log = _stream(spark, data.logged(spark, d)).withColumn("pmf", policy.fixed(PMF))
    out = policy.draw(log).withColumn("score", policy.score(F.col("pmf")))
    return _run(spark, out.select("env_id", "idx", "on_action", "on_prob", "score"))


@query(f"WITH {LOGGED}, {DRAWN} SELECT env_id, idx, actions[k] AS action, CASE WHEN actions[k] = action THEN round(reward / probability, 6) ELSE 0 END AS reward, [CASE WHEN a = action THEN round(reward / probability, 6) ELSE 0 END for a in actions] AS rewards FROM dr")
def x1_drawn_rewards(spark, d):
    """Estimated rewards of all actions, and of a drawn one, recorded."""
    log = ope.ips_rewards(_stream(spark, data.logged(spark, d)).withColumn("pmf", policy.fixed(PMF)), "estimates")
    out = ope.record(ope.off_policy_drawn(log), ["action", "reward"])
    return _run(spark, out.select("env_id", "idx", "action", F.round("reward", 6).alias("reward"), F.transform("estimates", lambda r: F.round(r, 6)).alias("rewards")))


@query(q_interactions.SQL["p12_head"])
def x1_head(spark, d):
    q = _stream(spark, q_interactions._items(spark, d))
    m = rows.head_sparse(F.create_map(F.lit("0"), F.col("l_quantity")), {"0": "first"})
    return _run(spark, rows.head(q.select("l_orderkey", "l_linenumber", "l_tax", m["first"]), ["k", "n", "tax", "first"]))


@query(q_interactions.SQL["p18_default"])
def x1_default(spark, d):
    docs = _stream(spark, table(spark, d, "documents").select("doc_id", "n_chars"))
    m = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.col("n_chars"), F.lit("b"), F.col("n_chars"))).otherwise(F.create_map(F.lit("b"), F.col("n_chars")))
    full = rows.default_sparse(m, {"a": 7, "c": 1})
    return _run(spark, docs.select("doc_id", full["a"].cast("long").alias("a"), full["b"].cast("long").alias("b")))


@query(q_interactions.SQL["r1_repr_context"])
def x1_repr_context(spark, d):
    """Levels that are known beforehand."""
    q = _stream(spark, q_interactions._items(spark, d))
    known = F.array(*[F.lit(x) for x in "ANR"])
    return _run(spark, q.select("l_orderkey", "l_linenumber", features.repr_context([(F.col("l_quantity"), None), (F.col("l_returnflag"), known)]).alias("context")))


@query(q_interactions.SQL["r6_f14_dense_hashing"])
def x1_dense_hashing(spark, d):
    docs = _stream(spark, q_interactions._sparse_docs(spark, d))
    return _run(spark, docs.select("doc_id", features.dense_hashed(F.col("context"), 16).alias("dense")))


@query(f"WITH {data.FACTS} SELECT event_id, name, data_id, round(value, 6) AS value FROM ev JOIN envs USING (environment_id) WHERE data_id = 1")
def x1_static_join(spark, d):
    """Live facts get their environment's parameters from a table, and are filtered by them."""
    ev = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).cast("int").alias("environment_id"), "value")
    envs = data.events_result(spark, d).environments
    out = _stream(spark, ev).join(envs, "environment_id").filter("data_id = 1")
    return _run(spark, out.select("event_id", "name", "data_id", F.round("value", 6).alias("value")))


@query("""SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 AND event_id % 120 <= 60 THEN round(value, 6) ELSE 0 END AS reward FROM events""")
def x4_rewarded(spark, d):
    """Choices meet rewards that come up to two hours later, or never; after an hour they count as missing. Each stream goes on
    with a row that moves its watermark past all others."""
    ev = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    paid = ev.filter("event_id % 3 <> 0").select("event_id", (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 120).cast("int"))).alias("ts"), F.col("value").alias("reward"))
    made, base = ev.select("event_id", "ts", "event_type"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    streams = {}
    for name, df in (("made", made), ("paid", paid)):
        df.write.parquet(f"{base}/{name}")
        streams[name] = spark.readStream.schema(df.schema).parquet(f"{base}/{name}")
    out = live.rewarded(streams["made"], streams["paid"], "event_id", "1 hour", "1 day")
    last = ev.agg(F.max("ts").alias("m"))
    for k in range(2):
        _run(spark, out, base)
        end = last.select(F.lit(-1 - k).cast("long").alias("event_id"), (F.col("m") + F.make_dt_interval(days=F.lit(10 * (k + 1)))).alias("ts"))
        end.withColumn("event_type", F.lit("end")).select(made.columns).write.mode("append").parquet(f"{base}/made")
        end.withColumn("reward", F.lit(0.0)).select(paid.columns).write.mode("append").parquet(f"{base}/paid")
    return _run(spark, out, base).filter("event_type <> 'end'").select("event_id", "event_type", F.round("reward", 6).alias("reward"))
