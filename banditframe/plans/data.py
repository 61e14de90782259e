"""The driver's tables in the roles of interactions and results, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from banditframe.operators.results import Result
from banditframe.plans.index import with_index
from banditframe.plans.tables import table

TYPES = ["click", "error", "purchase", "signup", "view"]

#: events as facts: environment = user_id % 10, learner = event type, index by (ts, event_id), reward = value / 501 (which leaves no ties when
#: rounded).
FACTS = """
ev AS (SELECT event_id, ts, user_id, event_type, value, (user_id % 10)::INT AS environment_id, dense_rank() OVER (ORDER BY event_type)::INT AS learner_id FROM events),
ints AS (SELECT environment_id, learner_id, 0 AS evaluator_id, row_number() OVER (PARTITION BY environment_id, learner_id ORDER BY ts, event_id) AS "index",
    value / 501 AS reward FROM ev),
lrns AS (SELECT DISTINCT learner_id, event_type AS family, (learner_id % 2)::INT AS seed FROM ev),
envs AS (SELECT DISTINCT environment_id, (environment_id % 3)::INT AS data_id, 'e' || environment_id AS name FROM ev),
vals AS (SELECT 0 AS evaluator_id, 'sequential' AS eval_type)
"""

#: orders as facts: environment = priority, learner = status, index by (date, key), reward = total price.
ORDER_FACTS = """
od AS (SELECT o_orderkey, o_orderdate, o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority)::INT AS environment_id, dense_rank() OVER (ORDER BY o_orderstatus)::INT AS learner_id FROM orders),
oints AS (SELECT environment_id, learner_id, 0 AS evaluator_id, row_number() OVER (PARTITION BY environment_id, learner_id ORDER BY o_orderdate, o_orderkey) AS "index", o_totalprice AS reward FROM od)
"""

#: events as logged interactions of ten environments: actions are the event types, probability the type's share.
LOGGED = """
lg0 AS (SELECT (user_id % 10)::INT AS env_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS idx, user_id, event_type AS action, value / 501 AS reward FROM events),
shares AS (SELECT env_id, action, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY env_id) AS probability FROM lg0 GROUP BY env_id, action),
logged AS (SELECT lg0.env_id, idx, (user_id % 7)::DOUBLE AS context, ['click', 'error', 'purchase', 'signup', 'view'] AS actions, action, reward, round(probability, 9) AS probability FROM lg0 JOIN shares USING (env_id, action))
"""

#: draw k of the generator as a SQL macro-free expression over jump pairs.
JUMPS = "jump(b, a, c) AS (VALUES {})"


def events_result(spark: SparkSession, d: str) -> Result:
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    types = ev.select("event_type").distinct().withColumn("learner_id", F.row_number().over(Window.orderBy("event_type")))
    ev = ev.join(types, "event_type").withColumn("environment_id", (F.col("user_id") % 10).cast("int"))
    ev = with_index(ev.select("environment_id", "learner_id", "ts", "event_id", "value"), ["environment_id", "learner_id"], ["ts", "event_id"], "index", 1)
    ints = ev.select("environment_id", "learner_id", F.lit(0).alias("evaluator_id"), "index", (F.col("value") / 501).alias("reward"))
    lrns = types.select("learner_id", F.col("event_type").alias("family"), (F.col("learner_id") % 2).cast("int").alias("seed"))
    envs = ev.select("environment_id").distinct().select("environment_id", (F.col("environment_id") % 3).cast("int").alias("data_id"), F.concat(F.lit("e"), F.col("environment_id").cast("string")).alias("name"))
    vals = spark.range(1).select(F.lit(0).alias("evaluator_id"), F.lit("sequential").alias("eval_type"))
    return Result(envs, lrns, vals, ints)


def orders_result(spark: SparkSession, d: str) -> Result:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    envs = o.select("o_orderpriority").distinct().withColumn("environment_id", F.row_number().over(Window.orderBy("o_orderpriority")))
    lrns = o.select("o_orderstatus").distinct().withColumn("learner_id", F.row_number().over(Window.orderBy("o_orderstatus")))
    o = o.join(envs, "o_orderpriority").join(lrns, "o_orderstatus")
    o = with_index(o.select("environment_id", "learner_id", "o_orderdate", "o_orderkey", "o_totalprice"), ["environment_id", "learner_id"], ["o_orderdate", "o_orderkey"], "index", 1)
    ints = o.select("environment_id", "learner_id", F.lit(0).alias("evaluator_id"), "index", F.col("o_totalprice").alias("reward"))
    vals = spark.range(1).select(F.lit(0).alias("evaluator_id"), F.lit("sequential").alias("eval_type"))
    return Result(envs.select("environment_id", F.col("o_orderpriority").alias("priority")), lrns.select("learner_id", F.col("o_orderstatus").alias("family")), vals, ints)


def logged(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    env = (F.col("user_id") % 10).cast("int")
    rows = with_index(ev.withColumn("env_id", env), ["env_id"], ["ts", "event_id"])
    counts = rows.groupBy("env_id", F.col("event_type").alias("action")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("env_id").agg(F.sum("n").alias("all"))
    shares = counts.join(totals, "env_id").select("env_id", "action", F.round(F.col("n").cast("double") / F.col("all"), 9).alias("probability"))
    rows = rows.select("env_id", "idx", (F.col("user_id") % 7).cast("double").alias("context"), F.array(*[F.lit(t) for t in TYPES]).alias("actions"), F.col("event_type").alias("action"), (F.col("value") / 501).alias("reward"))
    return rows.join(shares, ["env_id", "action"])


def simulated(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as a supervised set: context of 64 numbers, ten labels as actions, reward 1 for the row's label."""
    e = table(spark, d, "embeddings")
    actions = F.array(*[F.lit(k) for k in range(10)])
    rewards = F.transform(actions, lambda a: F.when(a == F.col("label"), 1.0).otherwise(0.0))
    return e.select(F.lit(0).alias("env_id"), F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("context"), actions.alias("actions"), rewards.alias("rewards"), "label")


def rounded(x: Column, digits: int) -> Column:
    """x rounded as SQL engines round doubles: times a power of ten, half away from zero, and divided again. A small negative number
    becomes -0.0, as there; Spark's own rounding goes by the decimal text and gives 0.0."""
    at = x * F.lit(10.0**digits)
    whole = F.when(at < 0, -F.round(-at)).when(at == 0, at).otherwise(F.round(at)) / F.lit(10.0**digits)
    return F.when(F.abs(at) < 2.0**52, whole).otherwise(x)


def jump_values() -> str:
    from banditframe.functions.rand import jumps

    return "jump(b, a, c) AS (VALUES " + ", ".join(f"({b}, {a}, {c})" for b, (a, c) in enumerate(jumps())) + ")"


def draw_sql(seed: str, k: str) -> str:
    """A scalar subquery for draw k of seed, over the jump table; unrolled, as list lambdas differ between versions."""
    from banditframe.functions.rand import jumps

    s = f"(({seed})::BIGINT % 1073741824)"
    for b, (a, c) in enumerate(jumps(20)):
        s = f"(SELECT CASE WHEN (({k})::BIGINT >> {b}) & 1 = 1 THEN (s * {a} + {c}) & 1073741823 ELSE s END FROM (SELECT {s} AS s))"
    return f"({s} / 1073741824.0)"


def crc_sql(source: str, longest: int) -> str:
    """crc(s, v): CRC-32 of the texts s of a table, ASCII of at most `longest` characters, for a WITH clause. CRC-32 is linear in its
    input but for a constant of the length, so it is the XOR of what each character adds at its distance from the end."""
    from zlib import crc32

    zero = {n: crc32(bytes(n)) for n in range(longest + 1)}
    ends = ", ".join(f"({n}, {v})" for n, v in zero.items())
    adds = ", ".join(f"({n}, {c}, {crc32(bytes([c]) + bytes(n)) ^ zero[n + 1]})" for n in range(longest) for c in range(32, 127))
    return f"""zeros(n, v) AS (VALUES {ends}), adds(n, c, v) AS (VALUES {adds}),
chars AS (SELECT s, unnest(range(1, length(s) + 1)) AS k FROM (SELECT DISTINCT s FROM {source})),
crc AS (SELECT s, xor(bit_xor(a.v::BIGINT), any_value(z.v)::BIGINT) AS v FROM chars JOIN adds a ON a.n = length(s) - k AND a.c = ascii(s[k]) JOIN zeros z ON z.n = length(s) GROUP BY s)"""
