"""Queries on results: predicates, joins, aggregates, windows, order, and the analysis tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from banditframe.functions import stats
from banditframe.operators import ids
from banditframe.operators import results as R
from banditframe.plans import data
from banditframe.plans.data import FACTS, ORDER_FACTS
from banditframe.plans.index import with_index
from banditframe.plans.prefix import running
from banditframe.plans.ranks import percentiles
from banditframe.plans.tables import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ints(spark, d):
    return data.events_result(spark, d).interactions


ROUND = 'round(reward, 6) AS reward'


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- predicates


@query(f"WITH {FACTS} SELECT learner_id, \"index\" FROM ints")
def p1_columns(spark, d):
    return R.columns(R.columns(_ints(spark, d), slice(0, 4)), ["learner_id", "index"])


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\" FROM ints WHERE reward > 0.5 AND \"index\" % 2 = 0")
def p2_where_row(spark, d):
    return R.where(_ints(spark, d), (F.col("reward") > 0.5) & (F.col("index") % 2 == 0)).select("environment_id", "learner_id", "index")


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", NULLIF(learner_id, 3) AS maybe FROM ints WHERE NULLIF(learner_id, 3) IS NULL")
def p3_where_equal_missing(spark, d):
    ints = _ints(spark, d).withColumn("maybe", F.nullif("learner_id", F.lit(3)))
    return R.where(ints, maybe=None).select("environment_id", "learner_id", "index", "maybe")


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\" FROM ints WHERE NULLIF(learner_id, 3) IS DISTINCT FROM 2")
def p4_where_not_equal(spark, d):
    ints = _ints(spark, d).withColumn("maybe", F.nullif("learner_id", F.lit(3)))
    return R.where(ints, maybe={"!=": 2}).select("environment_id", "learner_id", "index")


@query(f"WITH {FACTS} SELECT 'lt' AS op, environment_id, \"index\" FROM ints WHERE NULLIF(\"index\", 2) < 4 UNION ALL SELECT 'le', environment_id, \"index\" FROM ints WHERE NULLIF(\"index\", 2) <= 4")
def p5_where_less(spark, d):
    ints = _ints(spark, d).withColumn("maybe", F.nullif("index", F.lit(2)))
    pick = lambda op, cmp: R.where(ints, maybe={cmp: 4}).select(F.lit(op).alias("op"), "environment_id", "index")
    return pick("lt", "<").union(pick("le", "<="))


@query(f"WITH {FACTS} SELECT 'gt' AS op, environment_id, \"index\" FROM ints WHERE NULLIF(\"index\", 90) > 80 UNION ALL SELECT 'ge', environment_id, \"index\" FROM ints WHERE NULLIF(\"index\", 90) >= 80")
def p6_where_greater(spark, d):
    ints = _ints(spark, d).withColumn("maybe", F.nullif("index", F.lit(90)))
    pick = lambda op, cmp: R.where(ints, maybe={cmp: 80}).select(F.lit(op).alias("op"), "environment_id", "index")
    return pick("gt", ">").union(pick("ge", ">="))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, count(*) AS n FROM ints WHERE learner_id IN (1, 4) GROUP BY ALL")
def p7_where_in(spark, d):
    return R.where(_ints(spark, d), learner_id=[1, 4]).groupBy("environment_id", "learner_id").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, count(*) AS n FROM ints WHERE NOT coalesce(NULLIF(learner_id, 3) IN (1, 4), FALSE) GROUP BY ALL")
def p8_where_not_in(spark, d):
    ints = _ints(spark, d).withColumn("maybe", F.nullif("learner_id", F.lit(3)))
    return R.where(ints, maybe={"!in": [1, 4]}).groupBy("environment_id", "learner_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'text' AS kind FROM documents WHERE source = 'src1' OR regexp_matches(source, '^src1[0-4]$') UNION ALL SELECT doc_id, 'number' FROM documents WHERE regexp_matches(source, '(\\D|^)7(\\D|$)') UNION ALL SELECT doc_id, 'equal' FROM documents WHERE doc_id = 7")
def p9_match_f19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    text = R.where(docs, source={"match": "^src1[0-4]?$"}).select("doc_id", F.lit("text").alias("kind"))
    number = R.where(docs, source={"match": 7}).select("doc_id", F.lit("number").alias("kind"))
    return text.union(number).union(R.where(docs, doc_id={"match": 7}).select("doc_id", F.lit("equal").alias("kind")))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\" FROM ints WHERE abs(reward - 0.5) < 0.1")
def p10_where_callable(spark, d):
    return R.where(_ints(spark, d), reward=lambda c: F.abs(c - 0.5) < 0.1).select("environment_id", "learner_id", "index")


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\" FROM ints WHERE environment_id = 2 OR \"index\" <= 3 OR learner_id IN (5)")
def p11_where_any(spark, d):
    return R.where(_ints(spark, d), environment_id=2, index={"<=": 3}, learner_id=[5]).select("environment_id", "learner_id", "index")


# ---- joins


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", data_id, family, eval_type FROM ints JOIN envs USING (environment_id) JOIN lrns USING (learner_id) JOIN vals USING (evaluator_id)")
def j1_attach(spark, d):
    return data.events_result(spark, d).joined().select("environment_id", "learner_id", "index", "data_id", "family", "eval_type")


def _counted(r):
    return r.counts()


def _counts_sql(facts: str) -> str:
    return f"""WITH {FACTS}, f AS ({facts}) SELECT 'environments' AS "table", count(*) AS "rows" FROM envs WHERE {{e}} UNION ALL SELECT 'learners', count(*) FROM lrns WHERE {{l}}
    UNION ALL SELECT 'evaluators', count(*) FROM vals WHERE {{v}} UNION ALL SELECT 'interactions', count(*) FROM f"""


IN_F = {"e": "environment_id IN (SELECT environment_id FROM f)", "l": "learner_id IN (SELECT learner_id FROM f)", "v": "evaluator_id IN (SELECT evaluator_id FROM f)"}


@query(_counts_sql("SELECT * FROM ints WHERE environment_id IN (SELECT environment_id FROM envs WHERE data_id = 1)").format(**IN_F | {"e": "data_id = 1"}))
def j2_filter_env_a22(spark, d):
    return _counted(data.events_result(spark, d).filter_env(data_id=1))


@query(_counts_sql("SELECT * FROM ints WHERE learner_id IN (SELECT learner_id FROM lrns WHERE seed = 1)").format(**IN_F))
def j3_filter_lrn(spark, d):
    return _counted(data.events_result(spark, d).filter_lrn(seed=1))


@query(_counts_sql("SELECT * FROM ints WHERE evaluator_id IN (SELECT evaluator_id FROM vals WHERE eval_type = 'sequential')").format(**IN_F))
def j4_filter_val(spark, d):
    return _counted(data.events_result(spark, d).filter_val(eval_type="sequential"))


@query(_counts_sql("SELECT * FROM ints WHERE reward > 0.9").format(**IN_F))
def j5_filter_int(spark, d):
    return _counted(data.events_result(spark, d).filter_int(reward={">": 0.9}))


@query(_counts_sql("SELECT * FROM ints WHERE environment_id IN (SELECT environment_id FROM envs WHERE data_id = 1) AND learner_id IN (SELECT learner_id FROM lrns WHERE family = 'view' OR seed = 1) AND \"index\" <= 20").format(**IN_F))
def j6_where_result(spark, d):
    return _counted(data.events_result(spark, d).where(data_id=1, family="view", seed=1, index={"<=": 20}))


@query(f"WITH {FACTS}, s AS (SELECT environment_id, learner_id FROM ints GROUP BY ALL HAVING count(*) % 2 = 1) SELECT environment_id, learner_id, \"index\" FROM ints WHERE (environment_id, learner_id) NOT IN (SELECT (environment_id, learner_id) FROM s) OR \"index\" <= 5")
def j7_remove(spark, d):
    r = data.events_result(spark, d)
    odd = r.interactions.groupBy(*R.TRIPLE).count().filter("count % 2 = 1")
    return r.remove(odd, 5).select("environment_id", "learner_id", "index")


@query(f"WITH {FACTS} SELECT environment_id, learner_id, evaluator_id FROM (SELECT DISTINCT environment_id FROM ints) CROSS JOIN (SELECT learner_id FROM lrns) CROSS JOIN (SELECT evaluator_id FROM vals)")
def j9_triples(spark, d):
    r = data.events_result(spark, d)
    return ids.triples(r.environments, r.learners, r.evaluators)


@query(f"WITH {FACTS} SELECT environment_id, learner_id, 0 AS evaluator_id FROM envs CROSS JOIN lrns WHERE (environment_id, learner_id) NOT IN (SELECT (environment_id, learner_id) FROM ints WHERE reward > 0.97)")
def j10_unfinished_u5(spark, d):
    r = data.events_result(spark, d)
    return ids.unfinished(ids.triples(r.environments, r.learners, r.evaluators), r.filter_int(reward={">": 0.97}).interactions)


@query("WITH a AS (SELECT event_type, event_id FROM events WHERE event_id % 2 = 0), b AS (SELECT event_type, event_id FROM events WHERE event_id % 3 = 0) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b")
def j12_difference(spark, d):
    ev = table(spark, d, "events").select("event_type", "event_id")
    a, b = ev.filter("event_id % 2 = 0"), ev.filter("event_id % 3 = 0")
    return R.differences(a, b)


# ---- aggregates


@query(f"WITH {FACTS} SELECT environment_id, learner_id, count(*) AS \"count\" FROM ints GROUP BY ALL")
def a1_group_count(spark, d):
    return R.group_table(_ints(spark, d), ["environment_id", "learner_id"], "count")


@query(f"WITH {FACTS} SELECT environment_id, learner_id, evaluator_id, list(round(reward, 6) ORDER BY \"index\") AS reward FROM ints GROUP BY ALL")
def a1_group_lists(spark, d):
    return R.group_table(_r(_ints(spark, d), "reward"), R.TRIPLE, "reward")


@query(f"WITH {FACTS}, m AS (SELECT environment_id, learner_id, avg(reward) AS y FROM ints GROUP BY ALL) SELECT data_id, family, round(avg(y), 6) AS y, count(*) AS n FROM m JOIN envs USING (environment_id) JOIN lrns USING (learner_id) GROUP BY ALL")
def a2_grouped_mean_a3(spark, d):
    return _r(data.events_result(spark, d).grouped(["data_id", "family"], "reward", span=None).groupBy("data_id", "family").agg(F.avg("y").alias("y"), F.count("*").alias("n")), "y")


@query(f"WITH {FACTS}, t AS (SELECT *, row_number() OVER (PARTITION BY environment_id, learner_id ORDER BY \"index\" DESC) AS k FROM ints) SELECT environment_id, learner_id, round(avg(reward), 6) AS y FROM t WHERE k <= 10 GROUP BY ALL")
def a2_grouped_last(spark, d):
    return _r(data.events_result(spark, d).grouped(["environment_id", "learner_id"], "reward", "last", span=10), "y")


@query(f"WITH {FACTS} SELECT environment_id, round(var_samp(reward), 6) AS var, round(stddev_samp(reward), 6) AS sd FROM ints GROUP BY ALL")
def a4_variance(spark, d):
    y = F.col("reward")
    return _r(_ints(spark, d).groupBy("environment_id").agg(stats.var(y).alias("var"), stats.stdev(y).alias("sd")), "var", "sd")


PCT = "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(median(l_tax), 6) AS med FROM lineitem GROUP BY ALL"


@query(PCT)
def a5_percentile_a7_a8(spark, d):
    """Three flags hold all prices: percentiles by ranks over a range partitioning."""
    items = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_tax")
    price = percentiles(items, ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95, 0.25, 0.75])
    tax = percentiles(items, ["l_returnflag"], "l_tax", [0.5], "t")
    p = [F.col("p")[k] for k in range(5)]
    return price.join(tax, "l_returnflag").select("l_returnflag", *[F.round(x, 4).alias(n) for x, n in zip(p, ("p05", "p50", "p95"))], F.round(p[4] - p[3], 4).alias("iqr"), F.round(F.col("t")[0], 6).alias("med"))


@query("""WITH one AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
c AS (SELECT l_returnflag, v, (sum(w) OVER q - first_value(w) OVER q) / (sum(w) OVER (PARTITION BY l_returnflag) - first_value(w) OVER q) AS c FROM one WINDOW q AS (PARTITION BY l_returnflag ORDER BY v)),
n AS (SELECT *, lead(v) OVER q AS v2, lead(c) OVER q AS c2 FROM c WINDOW q AS (PARTITION BY l_returnflag ORDER BY v))
SELECT l_returnflag, round(v + (v2 - v) * (0.3 - c) / (c2 - c), 4) AS v FROM n WHERE c <= 0.3 AND c2 > 0.3""")
def a6_weighted_percentile(spark, d):
    items = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"), "l_quantity")
    return stats.weighted_percentile(items, ["l_returnflag"], "v", "l_quantity", 0.3).withColumn("v", F.round("v", 4))


@query("WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_max(l_quantity, (n, -f)) AS l_quantity FROM c GROUP BY ALL")
def a9_mode(spark, d):
    items = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return stats.mode_first(items, ["l_returnflag"], "l_quantity", "at")


@query("SELECT l_returnflag, min(l_tax) AS low, max(l_tax) AS high, round(max(abs(l_extendedprice - 30000)), 4) AS far FROM lineitem GROUP BY ALL")
def a10_extremes(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), F.round(F.max(F.abs(F.col("l_extendedprice") - 30000)), 4).alias("far"))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", round(avg(reward) OVER w, 6) AS mean, round(var_samp(reward) OVER w, 6) AS var FROM ints WINDOW w AS (PARTITION BY environment_id, learner_id ORDER BY \"index\")")
def a11_online_moments(spark, d):
    """Running mean and variance from running sums in blocks; values are centred before squaring to keep their digits."""
    y = F.col("reward") - 0.5
    run = running(_ints(spark, d), R.TRIPLE, "index", {"n": F.lit(1), "s": y, "q": y * y})
    var = F.when(F.col("n") > 1, (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1)))
    return run.select("environment_id", "learner_id", "index", F.round(F.col("s") / F.col("n") + 0.5, 6).alias("mean"), F.round(var, 6).alias("var"))


def _ci(spark, d, f):
    return _ints(spark, d).groupBy("environment_id", "learner_id").agg(*[F.round(c, 6).alias(n) for n, c in f(F.col("reward")).items()])


@query(f"WITH {FACTS} SELECT environment_id, learner_id, round(avg(reward), 6) AS y, round(coalesce(stddev_samp(reward), 0), 5) AS lower, round(coalesce(stddev_samp(reward), 0), 5) AS upper FROM ints GROUP BY ALL")
def a12_stddev_interval(spark, d):
    return _ci(spark, d, stats.stddev_ci)


@query(f"WITH {FACTS} SELECT environment_id, learner_id, round(avg(reward), 6) AS y, round(1.96044921875 * round(coalesce(stddev_samp(reward), 0) / sqrt(count(*)), 5), 6) AS lower, round(1.96044921875 * round(coalesce(stddev_samp(reward), 0) / sqrt(count(*)), 5), 6) AS upper FROM ints GROUP BY ALL")
def a13_stderr_interval(spark, d):
    return _ci(spark, d, stats.stderr_ci)


@query()
def a14_bootstrap_interval(spark, d):
    """Over one mean for each environment and learner, as the resamples multiply the rows."""
    means = data.events_result(spark, d).grouped(["environment_id", "learner_id"], "reward", span=None)
    return _r(stats.bootstrap_ci(means, ["learner_id"], "y"), "y", "lower", "upper")


BIN = "SELECT (user_id % 10)::INT AS environment_id, avg((event_type = 'purchase')::INT) AS p, count(*) AS n, 1.96 AS z FROM events GROUP BY ALL"


@query(f"SELECT environment_id, round(p, 6) AS y, round(p - ((p + z*z/(2*n)) / (1 + z*z/n) - z/(1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 5) AS lower, round((p + z*z/(2*n)) / (1 + z*z/n) + z/(1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)) - p, 5) AS upper FROM ({BIN})")
def a15_wilson_interval(spark, d):
    ev = table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("environment_id"), (F.col("event_type") == "purchase").cast("int").alias("v"))
    return _r(ev.groupBy("environment_id").agg(*[c.alias(n) for n, c in stats.wilson_ci(F.col("v")).items()]), "y")


#: Forty halvings of the two binomial tails.
TAILS = """WITH RECURSIVE s AS (SELECT (user_id % 10)::INT AS environment_id, sum((event_type = 'purchase')::INT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT environment_id, k, n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS e, 0 AS i FROM s UNION ALL
SELECT environment_id, k, n, CASE WHEN t1 < 0.025 THEN m1 ELSE a END, CASE WHEN t1 < 0.025 THEN b ELSE m1 END, CASE WHEN t2 > 0.025 THEN m2 ELSE c END, CASE WHEN t2 > 0.025 THEN e ELSE m2 END, i + 1
FROM (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(m1) + (n - j) * ln(1 - m1)) for j in range(k, n + 1)]) AS t1,
list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(m2) + (n - j) * ln(1 - m2)) for j in range(0, k + 1)]) AS t2
FROM (SELECT *, (a + b) / 2 AS m1, (c + e) / 2 AS m2 FROM r)) WHERE i < 40)
SELECT environment_id, k, n, CASE WHEN k = 0 THEN 0.0 ELSE round((a + b) / 2, 6) END AS low, CASE WHEN k = n THEN 1.0 ELSE round((c + e) / 2, 6) END AS high FROM r WHERE i = 40"""


@query(TAILS)
def a16_exact_binomial_interval(spark, d):
    ev = table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("environment_id"), (F.col("event_type") == "purchase").cast("int").alias("v"))
    sums = ev.groupBy("environment_id").agg(F.sum("v").alias("k"), F.count("*").alias("n"))
    low, high = stats.clopper_pearson(F.col("k"), F.col("n"))
    return sums.select("environment_id", "k", "n", low.alias("low"), high.alias("high"))


CURVE = f"""WITH {FACTS}, fin AS (SELECT * FROM ints WHERE "index" <= (SELECT min(n) FROM (SELECT count(*) AS n FROM ints GROUP BY environment_id, learner_id)) AND environment_id IN (SELECT environment_id FROM ints GROUP BY 1 HAVING count(DISTINCT learner_id) = (SELECT count(DISTINCT learner_id) FROM ints))),
mv AS (SELECT learner_id, "index", avg(reward) OVER (PARTITION BY environment_id, learner_id ORDER BY "index") AS y FROM fin),
pts AS (SELECT learner_id, "index", avg(y) AS y, coalesce(stddev_samp(y), 0) AS sd, count(*) AS n FROM mv GROUP BY ALL),
rk AS (SELECT learner_id, row_number() OVER (ORDER BY arg_max(y, "index") DESC, learner_id) AS rank FROM pts GROUP BY learner_id)"""


@query(f"{CURVE} SELECT learner_id, \"index\", round(y, 6) AS y, round(CASE WHEN \"index\" % 5 = 0 THEN 1.96044921875 * round(sd / sqrt(n), 5) ELSE 0 END, 6) AS lower, round(CASE WHEN \"index\" % 5 = 0 THEN 1.96044921875 * round(sd / sqrt(n), 5) ELSE 0 END, 6) AS upper, rank FROM pts JOIN rk USING (learner_id)")
def a17_interval_every_fifth(spark, d):
    return _r(data.events_result(spark, d).learner_curves(err="se", errevery=5), "y", "lower", "upper")


@query(f"WITH {FACTS} SELECT count(DISTINCT learner_id) AS learners, count(DISTINCT environment_id) AS environments FROM ints")
def a18_experiment_counts(spark, d):
    return _ints(spark, d).agg(F.countDistinct("learner_id").alias("learners"), F.countDistinct("environment_id").alias("environments"))


@query(f"WITH {FACTS}, part AS (SELECT * FROM ints WHERE NOT (environment_id = 3 AND learner_id = 2)), t AS (SELECT DISTINCT environment_id, learner_id FROM part) SELECT environment_id, learner_id, count(*) OVER (PARTITION BY environment_id) AS \"rows\", (SELECT count(DISTINCT learner_id) FROM t) AS levels FROM t")
def a19_pairing(spark, d):
    r = data.events_result(spark, d).filter_int(~((F.col("environment_id") == 3) & (F.col("learner_id") == 2)))
    return r.pairing("learner_id", "environment_id").select("environment_id", "learner_id", "rows", "levels")


@query(f"WITH {FACTS}, s AS (SELECT environment_id, learner_id FROM ints GROUP BY ALL HAVING count(*) >= 100) SELECT environment_id, learner_id, \"index\" FROM ints JOIN s USING (environment_id, learner_id) WHERE \"index\" <= 100")
def a20_even_length(spark, d):
    return data.events_result(spark, d).filter_fin(n=100).interactions.select("environment_id", "learner_id", "index")


@query(f"WITH {FACTS}, part AS (SELECT * FROM ints WHERE NOT (environment_id = 3 AND learner_id = 2)), s AS (SELECT environment_id FROM part GROUP BY 1 HAVING count(DISTINCT learner_id) = 5), p AS (SELECT * FROM part JOIN s USING (environment_id)) SELECT environment_id, learner_id, \"index\" FROM p WHERE \"index\" <= (SELECT min(n) FROM (SELECT count(*) AS n FROM p GROUP BY environment_id, learner_id))")
def a21_filter_fin(spark, d):
    r = data.events_result(spark, d).filter_int(~((F.col("environment_id") == 3) & (F.col("learner_id") == 2)))
    return r.filter_fin("min", "learner_id", "environment_id").interactions.select("environment_id", "learner_id", "index")


@query(f"WITH {FACTS}, part AS (SELECT * FROM ints WHERE NOT (environment_id = 3 AND learner_id = 2)), c AS (SELECT environment_id, count(*) AS n FROM (SELECT DISTINCT environment_id, learner_id FROM part) GROUP BY 1) SELECT 'too few' AS reason, count(*) FILTER (n < 5) AS number FROM c UNION ALL SELECT 'too many', count(*) FILTER (n > 5) FROM c")
def a21_removed(spark, d):
    r = data.events_result(spark, d).filter_int(~((F.col("environment_id") == 3) & (F.col("learner_id") == 2)))
    return r.removed()


# ---- windows


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", round(avg(reward) OVER (PARTITION BY environment_id, learner_id ORDER BY \"index\"), 6) AS mean FROM ints")
def w1_progressive_mean(spark, d):
    return R.moving_average(_ints(spark, d), "reward").select("environment_id", "learner_id", "index", F.round("mean", 6).alias("mean"))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", round(avg(reward) OVER (PARTITION BY environment_id, learner_id ORDER BY \"index\" ROWS 9 PRECEDING), 6) AS mean FROM ints")
def w2_sliding_mean(spark, d):
    return R.moving_average(_ints(spark, d), "reward", 10).select("environment_id", "learner_id", "index", F.round("mean", 6).alias("mean"))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", round(reward, 6) AS mean FROM ints")
def w3_span_one(spark, d):
    return R.moving_average(_ints(spark, d), "reward", 1).select("environment_id", "learner_id", "index", F.round("mean", 6).alias("mean"))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", round(sum(reward * (1 + \"index\" % 3)) OVER w / sum(1 + \"index\" % 3) OVER w, 6) AS mean FROM ints WINDOW w AS (PARTITION BY environment_id, learner_id ORDER BY \"index\" ROWS 19 PRECEDING)")
def w4_weighted_mean(spark, d):
    ints = _ints(spark, d).withColumn("w", 1 + F.col("index") % 3)
    return R.moving_average(ints, "reward", 20, "w").select("environment_id", "learner_id", "index", F.round("mean", 6).alias("mean"))


@query(f"""WITH RECURSIVE {FACTS}, r AS (SELECT environment_id, learner_id, "index", reward AS n, 1.0::DOUBLE AS d FROM ints WHERE "index" = 1
UNION ALL SELECT i.environment_id, i.learner_id, i."index", r.n * (1 - 2.0 / 11) + i.reward, r.d * (1 - 2.0 / 11) + 1 FROM r JOIN ints i ON i.environment_id = r.environment_id AND i.learner_id = r.learner_id AND i."index" = r."index" + 1)
SELECT environment_id, learner_id, "index", round(n / d, 6) AS mean FROM r""")
def w5_exponential_mean(spark, d):
    return R.exponential(_ints(spark, d), "reward", 10).select("environment_id", "learner_id", "index", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, (user_id % 10)::INT AS environment_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS \"index\" FROM events")
def w6_row_numbers(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 10).cast("int").alias("environment_id"))
    return with_index(ev, ["environment_id"], ["ts", "event_id"], "index", 1).drop("ts")


@query("SELECT event_type, (row_number() OVER (ORDER BY min(struct_pack(a := ts, b := event_id))) - 1)::INT AS id FROM events GROUP BY event_type")
def w7_ids_by_first_appearance(spark, d):
    return ids.first_appearance(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "id")


# ---- order


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY NULLIF(o_orderstatus, 'F') ASC NULLS LAST, o_orderpriority, o_orderkey) AS rank FROM orders) WHERE rank <= 50")
def o1_index(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    top = R.index(o.select("status", "o_orderpriority", "o_orderkey"), "status", "nothing", "o_orderpriority", "o_orderkey").limit(50)
    return top.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("status").isNull().alias("m"), "status", "o_orderpriority", "o_orderkey"))), lambda s: s["o_orderkey"]).alias("k")).select(F.posexplode("k").alias("rank", "o_orderkey")).select("o_orderkey", (F.col("rank") + 1).cast("long").alias("rank"))


@query(f"WITH {FACTS}, m AS (SELECT environment_id, learner_id, avg(reward) AS m FROM ints GROUP BY ALL), g AS (SELECT environment_id, seed, learner_id, m FROM m JOIN lrns USING (learner_id)), b AS (SELECT environment_id, seed, arg_max(learner_id, (m, learner_id)) AS learner_id FROM g GROUP BY ALL) SELECT environment_id, learner_id, count(*) AS n FROM ints JOIN b USING (environment_id, learner_id) GROUP BY ALL")
def o8_best(spark, d):
    return data.events_result(spark, d).filter_best("seed", "environment_id").interactions.groupBy("environment_id", "learner_id").agg(F.count("*").alias("n"))


@query(f"{CURVE} SELECT learner_id, \"index\", round(y, 6) AS y, rank FROM pts JOIN rk USING (learner_id) WHERE rank <= 2")
def o9_top_curves(spark, d):
    return _r(data.events_result(spark, d).learner_curves(top_n=2), "y").select("learner_id", "index", "y", "rank")


@query(f"WITH {FACTS}, m AS (SELECT data_id, avg(reward) AS y FROM ints JOIN envs USING (environment_id) GROUP BY environment_id, data_id) SELECT data_id, round(avg(y), 6) AS y, row_number() OVER (ORDER BY data_id DESC) AS at FROM m GROUP BY data_id")
def o10_x_descending(spark, d):
    from pyspark.sql import Window

    r = data.events_result(spark, d)
    means = r.interactions.groupBy("environment_id").agg(F.avg("reward").alias("m")).join(r.environments, "environment_id").groupBy("data_id").agg(F.round(F.avg("m"), 6).alias("y"))
    return means.withColumn("at", F.row_number().over(Window.orderBy(F.col("data_id").desc())).cast("long"))


@query("SELECT event_id, event_type, NULL::INT AS extra_a, NULL::VARCHAR AS extra_b FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, 1, 'x' FROM events WHERE event_id % 2 = 1")
def u1_insert(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type")
    more = ev.filter("event_id % 2 = 1").select("event_id", F.lit("x").alias("extra_b"), F.lit(1).alias("extra_a"))
    return R.insert(ev.filter("event_id % 2 = 0"), more)


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def u4_common_keys(spark, d):
    ev = table(spark, d, "events")
    return ev.filter("event_type = 'purchase'").select("user_id").intersect(ev.filter("event_type = 'error'").select("user_id"))


# ---- analysis tables


@query(f"{CURVE} SELECT learner_id, \"index\", round(y, 6) AS y FROM mv")
def t1_raw_learners(spark, d):
    return _r(data.events_result(spark, d).raw_learners(), "y")


@query(f"WITH {FACTS}, m AS (SELECT environment_id, learner_id, avg(reward) AS y FROM ints GROUP BY ALL), e AS (SELECT a.environment_id, a.y AS y1, b.y AS y2 FROM m a JOIN m b ON a.environment_id = b.environment_id AND a.learner_id = 1 AND b.learner_id IN (3, 5)) SELECT environment_id::VARCHAR AS x, round(y1, 6) AS y1, round(y2, 6) AS y2 FROM e")
def t2_raw_contrast_j8(spark, d):
    return _r(data.events_result(spark, d).raw_contrast(1, [3, 5]), "y1", "y2")


@query(f"WITH {FACTS}, m AS (SELECT environment_id, learner_id, \"index\", avg(reward) OVER (PARTITION BY environment_id, learner_id ORDER BY \"index\") AS y FROM ints) SELECT a.\"index\" AS x, round(a.y, 6) AS y1, round(b.y, 6) AS y2 FROM m a JOIN m b ON a.environment_id = b.environment_id AND a.\"index\" = b.\"index\" WHERE a.learner_id = 1 AND b.learner_id = 2")
def t2_raw_contrast_index(spark, d):
    return _r(data.events_result(spark, d).raw_contrast(1, 2, x="index"), "y1", "y2")


FLAG = f"{CURVE} SELECT learner_id, \"index\", round(y, 6) AS y, round(1.96044921875 * round(sd / sqrt(n), 5), 6) AS lower, round(1.96044921875 * round(sd / sqrt(n), 5), 6) AS upper, rank FROM pts JOIN rk USING (learner_id)"


@query(FLAG)
def t3_learner_curves(spark, d):
    return _r(data.events_result(spark, d).learner_curves(err="se"), "y", "lower", "upper")


@query(FLAG)
def flagship_curves(spark, d):
    """Which learner is best, and how sure are we."""
    return t3_learner_curves(spark, d)


@query(f"""WITH {ORDER_FACTS}, m AS (SELECT environment_id, learner_id, avg(reward) AS y FROM oints GROUP BY ALL), v AS (SELECT a.environment_id, b.y - a.y AS v FROM m a JOIN m b ON a.environment_id = b.environment_id AND a.learner_id = 1 AND b.learner_id > 1),
pt AS (SELECT environment_id::VARCHAR AS x, avg(v) AS y, 1.96044921875 * round(coalesce(stddev_samp(v), 0) / sqrt(count(*)), 5) AS h FROM v GROUP BY ALL)
SELECT x, round(y, 4) AS y, round(h, 4) AS lower, round(h, 4) AS upper, CASE WHEN y + h < 0 THEN 'l1' WHEN y - h > 0 THEN 'l2' ELSE 'tie' END AS outcome FROM pt""")
def t4_contrast_points(spark, d):
    out = data.orders_result(spark, d).contrast_points(1, [2, 3], err="se")
    return out.withColumns({c: F.round(c, 4) for c in ("y", "lower", "upper")})


@query(f"WITH {FACTS}, m AS (SELECT environment_id, learner_id, \"index\", avg(reward) OVER (PARTITION BY environment_id, learner_id ORDER BY \"index\") AS y FROM ints), v AS (SELECT a.\"index\" AS x, (b.y > a.y)::INT AS v FROM m a JOIN m b ON a.environment_id = b.environment_id AND a.\"index\" = b.\"index\" WHERE a.learner_id = 1 AND b.learner_id = 2), p AS (SELECT x, avg(v) AS y FROM v GROUP BY x) SELECT x, round(y, 6) AS y, 0.0 AS lower, 0.0 AS upper, CASE WHEN y < .5 THEN 'l1' WHEN y > .5 THEN 'l2' ELSE 'tie' END AS outcome FROM p")
def t4_contrast_probability(spark, d):
    return _r(data.events_result(spark, d).contrast_points(1, 2, x="index", mode="prob"), "y")


@query(f"WITH {FACTS} SELECT learner_id, learner_id || '. ' || family || '(seed=' || seed || ')' AS full_name FROM lrns")
def f20_full_name(spark, d):
    return R.full_names(data.events_result(spark, d).learners).select("learner_id", "full_name")
