"""Queries on what users hand in (intervals, noise, contrasts, operators, sinks), on checks, and on properties of results that SQL
can't compute itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from banditframe.functions import encoders as E
from banditframe.functions import stats
from banditframe.operators import profile, reshape
from banditframe.operators import results as R
from banditframe.plans import data
from banditframe.plans.data import FACTS, LOGGED, draw_sql
from banditframe.plans.tables import table

Q, SQL = {}, {}
KEY = "l_orderkey, l_linenumber"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


MEANS = f"WITH {FACTS}, m AS (SELECT environment_id, learner_id, avg(reward) AS y FROM ints GROUP BY ALL)"


@query(f"{MEANS} SELECT learner_id, round(avg(y), 6) AS y, TRUE AS narrow, TRUE AS wide FROM m GROUP BY 1")
def a14_bootstrap_width(spark, d):
    """The bootstrap's interval is about as wide as the normal one, on either side, for values of which many are equal too."""
    r = data.events_result(spark, d)
    means = r.grouped(["environment_id", "learner_id"], "reward", span=None)
    near = means.groupBy("learner_id").agg((1.96 * F.stddev_pop("y") / F.sqrt(F.count("*"))).alias("h"))
    one = stats.points(means, ["learner_id"], "y", "bs").join(near, "learner_id")
    flags = means.select("learner_id", (F.col("y") > 0.05).cast("double").alias("z"))
    rows = r.interactions.select("learner_id", (F.col("reward") > 0.05).cast("double").alias("z")).union(flags)
    half = rows.groupBy("learner_id").agg((1.96 * F.stddev_pop("z") / F.sqrt(F.count("*"))).alias("hz"))
    two = stats.points(rows, ["learner_id"], "z", "bs").select("learner_id", F.col("lower").alias("lz"), F.col("upper").alias("uz")).join(half, "learner_id")
    ok = lambda c, h, f: (F.col(c) > F.col(h) / f) & (F.col(c) < F.col(h) * f)
    return one.join(two, "learner_id").select("learner_id", F.round("y", 6).alias("y"), (ok("lower", "h", 2) & ok("upper", "h", 2)).alias("narrow"), (ok("lz", "hz", 1.3) & ok("uz", "hz", 1.3)).alias("wide"))


@query(f"WITH {FACTS} SELECT learner_id, round(quantile_cont(reward, 0.5), 6) AS y, TRUE AS wide FROM ints GROUP BY 1")
def a14_bootstrap_median(spark, d):
    """The bootstrap of another statistic, in subsets of 500 rows: about as wide as the median's error, of all rows, should be."""
    rows = data.events_result(spark, d).interactions.select("learner_id", F.col("reward").alias("y"))
    normal = rows.groupBy("learner_id").agg((1.96 * 1.2533 * F.stddev_pop("y") / F.sqrt(F.count("*"))).alias("h"))
    out = stats.bootstrap_ci(rows, ["learner_id"], "y", statistic=stats.weighted_quantile(0.5), size=500)
    exact = stats.percentile(rows, ["learner_id"], "y", 0.5)
    ok = lambda c: (F.col(c) > F.col("h") / 3) & (F.col(c) < F.col("h") * 3)
    out = out.join(normal, "learner_id").join(exact, "learner_id")
    return out.select("learner_id", F.round("p", 6).alias("y"), (ok("lower") & ok("upper") & (F.abs(F.col("y") - F.col("p")) < F.col("h"))).alias("wide"))


@query(f"{MEANS} SELECT learner_id, data_id, round(avg(y), 6) AS y, TRUE AS inside FROM m JOIN envs USING (environment_id) GROUP BY ALL")
def a17_bootstrap_curves(spark, d):
    """Points with bootstrap intervals over a parameter."""
    out = data.events_result(spark, d).learner_curves(x="data_id", err="bs")
    return out.select("learner_id", "data_id", F.round("y", 6).alias("y"), ((F.col("lower") >= 0) & (F.col("upper") >= 0) & (F.col("lower") + F.col("upper") < 1)).alias("inside"))


@query(f"{MEANS}, s AS (SELECT learner_id, data_id, avg(y) AS y, min(y) AS low, max(y) AS high FROM m JOIN envs USING (environment_id) GROUP BY ALL) SELECT learner_id, data_id, round(y, 6) AS y, round(y - low, 5) AS lower, round(high - y, 5) AS upper FROM s")
def d5_custom_interval(spark, d):
    """An interval of one's own: from the least to the largest value."""
    reach = lambda y: {"y": F.avg(y), "lower": F.avg(y) - F.min(y), "upper": F.max(y) - F.avg(y)}
    out = data.events_result(spark, d).learner_curves(x="data_id", err=reach)
    return out.select("learner_id", "data_id", F.round("y", 6).alias("y"), F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


@query(f"SELECT event_id AS idx, round(value * (1 + {draw_sql('7', 'event_id + 1')}), 6) AS context FROM events")
def d6_custom_noise(spark, d):
    """Noise of one's own: a number grows by up to its size."""
    ev = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("value").alias("context"))
    return reshape.noise(ev, context=lambda x, u: x * (1 + u), seed=7).select("idx", F.round("context", 6).alias("context"))


@query(f"{MEANS} SELECT a.environment_id::VARCHAR AS x, round(b.y / a.y, 5) AS y, CASE WHEN b.y / a.y < 0.5 THEN 'l1' WHEN b.y / a.y > 0.5 THEN 'l2' ELSE 'tie' END AS outcome FROM m a JOIN m b ON a.environment_id = b.environment_id AND a.learner_id = 1 AND b.learner_id = 2")
def d7_custom_contrast(spark, d):
    """A contrast of one's own: the ratio of the sides."""
    out = data.events_result(spark, d).contrast_points(1, 2, mode=lambda a, b: b / a)
    return out.select("x", F.round("y", 5).alias("y"), "outcome")


@query(f"WITH {LOGGED} SELECT env_id, idx, action FROM logged WHERE reward > 0.5 AND idx % 2 = 0")
def d2_custom_filter(spark, d):
    """An operator of one's own is a function of a table."""
    even = lambda df: df.filter("idx % 2 = 0")
    return data.logged(spark, d).transform(even).transform(R.where, reward={">": 0.5}).select("env_id", "idx", "action")


@query("SELECT * FROM region")
def p23_identity(spark, d):
    return table(spark, d, "region").transform(lambda df: df)


@query(f"SELECT {KEY}, list_position(['A', 'N', 'R'], l_returnflag) - 1 AS as_int, [(l_returnflag = 'A')::INT, (l_returnflag = 'N')::INT, (l_returnflag = 'R')::INT] AS as_onehot FROM lineitem")
def f22_level_helpers(spark, d):
    items = table(spark, d, "lineitem")
    known = E.levels(items, "l_returnflag").scalar()
    q = items.withColumn("known", known)
    return q.select("l_orderkey", "l_linenumber", E.categorical(F.col("l_returnflag"), F.col("known")).alias("as_int"), E.onehot(F.col("l_returnflag"), F.col("known")).alias("as_onehot"))


@query("""SELECT l_quantity, round(CASE WHEN z >= 0 THEN 1 - q ELSE q END, 4) AS p FROM (SELECT l_quantity, z, exp(-z * z / 2) / 2.5066282746 * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS q
FROM (SELECT DISTINCT l_quantity, (l_quantity - 25) / 12.5 AS z, 1 / (1 + 0.2316419 * abs((l_quantity - 25) / 12.5)) AS t FROM lineitem))""")
def f5_normal_distribution(spark, d):
    """The normal distribution function, against a known polynomial good to seven digits."""
    return table(spark, d, "lineitem").select("l_quantity").distinct().select("l_quantity", F.round(stats.normal((F.col("l_quantity") - 25) / 12.5), 4).alias("p"))


@query("SELECT unnest(['ok', 'no y', 'index and more', 'no rows']) AS asked, unnest(['', 'speed is not a column of the interactions', 'the x-axis can''t be index and a parameter', 'there is no data']) AS faults FROM (SELECT count(*) FROM events)")
def t5_faults(spark, d):
    r = data.events_result(spark, d)
    empty = R.Result(r.environments, r.learners, r.evaluators, r.interactions.filter("reward < -1"))
    asked = [("ok", r.faults("index", "reward")), ("no y", r.faults("index", "speed")), ("index and more", r.faults(["index", "data_id"], "reward")), ("no rows", empty.faults("index", "reward"))]
    return spark.createDataFrame([(a, "; ".join(f)) for a, f in asked], "asked string, faults string")


@query(f"""{MEANS}, g AS (SELECT data_id, learner_id, environment_id, round(y, 6) AS y FROM m JOIN envs USING (environment_id) WHERE NOT (learner_id = 2 AND data_id = 1))
SELECT data_id, list(y ORDER BY environment_id) FILTER (learner_id = 1) AS one, coalesce(list(y ORDER BY environment_id) FILTER (learner_id = 2), ['nan'::DOUBLE]) AS two FROM g GROUP BY 1""")
def t1_wide(spark, d):
    """One column a label; a label without values at an x has [NaN] there."""
    r = data.events_result(spark, d)
    gone = r.environments.filter("data_id = 1").select("environment_id", F.lit(2).alias("learner_id"))
    facts = r.interactions.join(gone, ["environment_id", "learner_id"], "left_anti")
    out = R.Result(r.environments, r.learners, r.evaluators, facts).raw_learners(x="data_id", p=None, wide=True)
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return out.select("data_id", rounded("1").alias("one"), rounded("2").alias("two"))


@query(f"WITH {LOGGED} SELECT count(DISTINCT env_id)::INT AS environments, round(avg(reward), 6) AS mean FROM logged WHERE env_id % 2 = 0")
def s11_batched_logs(spark, d):
    """Batches become their means; environments that are not logged are left out."""
    log = data.logged(spark, d).select("env_id", "idx", "action", "reward")
    rows = reshape.batch(log, 1).withColumns({"logged": F.col("env_id") % 2 == 0, "family": F.lit("x")})
    made = R.from_logged(rows, ["env_id"], ["family"], ["env_id", "batch_id"])
    return made.interactions.agg(F.countDistinct("environment_id").cast("int").alias("environments"), F.round(F.avg("reward"), 6).alias("mean"))


@query("SELECT count(*) AS n, TRUE AS falling, TRUE AS at_most_all, TRUE AS enough FROM embeddings")
def m15_shares(spark, d):
    """Shares of variance fall, are at most all of it, and as many dimensions as hold 95 % are no more than there are."""
    e = table(spark, d, "embeddings").select(F.col("embedding").alias("x"))
    one = profile.principal(e, 64)
    s = [F.col(f"pca_top_{k}_pct") for k in (1, 2, 3)]
    return one.select(e.agg(F.count("*").alias("n")).scalar().alias("n"), ((s[0] >= s[1]) & (s[1] >= s[2]) & (s[2] > 0)).alias("falling"), (s[0] + s[1] + s[2] <= 1).alias("at_most_all"), F.col("pca_dims_95").between(1, 64).alias("enough"))


@query(f"WITH {LOGGED} SELECT env_id, count(*) AS n, TRUE AS all_there, count(*) // 4 AS moved FROM logged GROUP BY 1")
def o7_riffle_moves(spark, d):
    """A riffle keeps all rows and the order of those that stay; one of four goes from the end into each run of three."""
    log = data.logged(spark, d).select("env_id", "idx").withColumn("was", F.col("idx"))
    out = reshape.riffle(log, 3, 1)
    n = log.groupBy("env_id").agg(F.count("*").alias("n"))
    both = out.join(n, "env_id").withColumn("late", F.col("was") >= F.col("n") - F.floor(F.col("n") / 4))
    return both.groupBy("env_id").agg(F.max("n").alias("n"), ((F.countDistinct("was") == F.max("n")) & (F.countDistinct("idx") == F.max("n")) & (F.max("idx") == F.max("n") - 1)).alias("all_there"), F.count_if("late").alias("moved"))


def _slots(n: int) -> str:
    from zlib import crc32

    names = [f"lang={x}" for x in ("de", "en", "es", "fr")] + [f"source=src{k}" for k in range(64)] + ["n_chars"]
    return ", ".join(f"('{x}', {crc32(x.encode()) % n})" for x in names)


@query(f"WITH s(key, slot) AS (VALUES {_slots(16)}), c AS (SELECT doc_id, unnest(['lang=' || lang, 'source=' || source]) AS key FROM documents) SELECT doc_id, list(DISTINCT slot ORDER BY slot) AS slots FROM c JOIN s USING (key) GROUP BY 1")
def f14_slots(spark, d):
    """The slots of hashed names, against CRC-32 as a table."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"))).alias("key"))
    return docs.groupBy("doc_id").agg(F.sort_array(F.collect_set(E.bucket(F.col("key"), 16))).alias("slots"))
