"""Queries on policies and off-policy evaluation, over the events as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from banditframe.functions import stats
from banditframe.operators import learning, ope, policy, reshape
from banditframe.plans import data
from banditframe.plans.data import LOGGED, TYPES, draw_sql
from banditframe.plans.prefix import running

Q, SQL = {}, {}
PMF = [0.4, 0.1, 0.1, 0.1, 0.3]
P_SQL = "CASE {a} WHEN 'click' THEN 0.4 WHEN 'error' THEN 0.1 WHEN 'purchase' THEN 0.1 WHEN 'signup' THEN 0.1 ELSE 0.3 END"
U = draw_sql("1", "idx + 1")
DRAWN = f"dr AS (SELECT *, CASE WHEN 0.4 >= u THEN 1 WHEN 0.5 >= u THEN 2 WHEN 0.6 >= u THEN 3 WHEN 0.7 >= u THEN 4 ELSE 5 END AS k FROM (SELECT *, {U} AS u FROM logged))"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark, d):
    return data.logged(spark, d)


def _fixed(spark, d):
    return _log(spark, d).withColumn("pmf", policy.fixed(PMF))


@query(f"WITH {LOGGED} SELECT env_id, idx, [0.4, 0.1, 0.1, 0.1, 0.3]::DOUBLE[] AS pmf FROM logged")
def e1_fixed(spark, d):
    return _fixed(spark, d).select("env_id", "idx", "pmf")


@query(f"WITH {LOGGED} SELECT env_id, idx, [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[] AS pmf FROM logged")
def e2_random(spark, d):
    return _log(spark, d).withColumn("pmf", policy.uniform()).select("env_id", "idx", "pmf")


@query(f"WITH {LOGGED}, {DRAWN} SELECT env_id, idx, actions[k] AS on_action, ([0.4, 0.1, 0.1, 0.1, 0.3]::DOUBLE[])[k] AS on_prob, {P_SQL.format(a='action')}::DOUBLE AS score FROM dr")
def e3_draw_and_score(spark, d):
    rows = policy.draw(_fixed(spark, d)).withColumn("score", policy.score(F.col("pmf")))
    return rows.select("env_id", "idx", "on_action", "on_prob", "score")


LONG = """lo AS (SELECT env_id, idx, action, reward, probability, a.a AS cand, (action = a.a)::INT AS hit FROM logged, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS a) a),
nth AS (SELECT env_id, idx, row_number() OVER (PARTITION BY env_id, action ORDER BY idx) AS nth FROM logged)"""

EPS = f"""{LONG}, q AS (SELECT env_id, idx, cand, action, reward, probability, sum(hit * reward) OVER w / NULLIF(sum(hit) OVER w, 0) AS q FROM lo WINDOW w AS (PARTITION BY env_id, cand ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mx AS (SELECT *, max(q) OVER (PARTITION BY env_id, idx) AS best FROM q), pm AS (SELECT *, 0.1 / 5 + CASE WHEN q IS NOT DISTINCT FROM best THEN 0.9 / sum((q IS NOT DISTINCT FROM best)::INT) OVER (PARTITION BY env_id, idx) ELSE 0 END AS p FROM mx)"""


@query(f"WITH {LOGGED}, {EPS} SELECT env_id, idx, list(round(p, 6) ORDER BY cand) AS pmf FROM pm GROUP BY ALL")
def e4_epsilon_greedy_w9(spark, d):
    return policy.epsilon_greedy(_log(spark, d), TYPES, 0.1).select("env_id", "idx", F.transform("pmf", lambda p: F.round(p, 6)).alias("pmf"))


UCB = f"""{LONG}, s AS (SELECT lo.env_id, lo.idx, cand, action, reward, probability, sum(hit) OVER w AS n, sum(CASE WHEN hit = 1 AND nth = 1 THEN reward ELSE 0 END) OVER w AS f, sum(CASE WHEN hit = 1 AND nth > 1 THEN reward ELSE 0 END) OVER w AS sm,
var_samp(CASE WHEN hit = 1 AND nth > 1 THEN reward END) OVER w AS v FROM lo JOIN nth USING (env_id, idx) WINDOW w AS (PARTITION BY lo.env_id, cand ORDER BY lo.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
vl AS (SELECT *, CASE WHEN n > 0 THEN round(CASE WHEN n = 1 THEN f ELSE sm / (n - 1) END + sqrt(ln(idx) / n * least(0.25, coalesce(v + sqrt(2 * ln(idx) / n), 0.25))), 9) END AS val FROM s),
un AS (SELECT *, sum((val IS NULL)::INT) OVER (PARTITION BY env_id, idx) AS unseen, max(val) OVER (PARTITION BY env_id, idx) AS best FROM vl),
pu AS (SELECT *, CASE WHEN unseen > 0 THEN CASE WHEN val IS NULL THEN 1.0 / unseen ELSE 0 END ELSE CASE WHEN val = best THEN 1.0 / sum((val = best)::INT) OVER (PARTITION BY env_id, idx) ELSE 0 END END AS p FROM un)"""


@query(f"WITH {LOGGED}, {UCB} SELECT env_id, idx, list(round(p, 6)::DOUBLE ORDER BY cand) AS pmf FROM pu GROUP BY ALL")
def e5_ucb(spark, d):
    return policy.ucb(_log(spark, d), TYPES).select("env_id", "idx", F.transform("pmf", lambda p: F.round(p, 6)).alias("pmf"))


def _linear(spark, d):
    log = _log(spark, d)
    x = lambda k: F.array(*[F.lit(1.0 if j == k else 0.0) for j in range(5)], F.col("context") / 7 if k < 4 else F.lit(0.0))
    return log.withColumn("x", F.array(*[x(k) for k in range(5)]))


@query()
def e6_linear_ucb(spark, d):
    return policy.linear(_linear(spark, d), 5, kind="ucb", alpha=0.5, block=200).select("env_id", "idx", "pmf")


@query()
def e7_linear_thompson(spark, d):
    return policy.linear(_linear(spark, d), 5, kind="ts", alpha=0.0, block=200).select("env_id", "idx", "pmf")


@query(f"WITH {LOGGED}, {EPS.replace('hit * reward', 'hit * (1 - 2 * reward)')} SELECT env_id, idx, list(round(p, 6) ORDER BY cand) AS pmf FROM pm GROUP BY ALL")
def e8_misguided(spark, d):
    rows = policy.misguided(_log(spark, d), 1.0, -2.0)
    return policy.epsilon_greedy(rows, TYPES, 0.1, reward="learned").select("env_id", "idx", F.transform("pmf", lambda p: F.round(p, 6)).alias("pmf"))


@query(f"SELECT vec_id AS idx, (floor(10 * ({draw_sql('1', 'vec_id + 1')} - 1e-12))::INT = label)::INT::DOUBLE AS reward FROM embeddings")
def e9_on_policy(spark, d):
    rows = data.simulated(spark, d).withColumn("pmf", policy.uniform())
    return ope.on_policy(rows).select("idx", F.col("eval_reward").alias("reward"))


@query(f"WITH {LOGGED} SELECT env_id, idx, round({P_SQL.format(a='action')} * reward / probability, 6) AS reward FROM logged")
def e10_ips_score(spark, d):
    return ope.off_policy_score(_fixed(spark, d)).select("env_id", "idx", F.round("eval_reward", 6).alias("reward"))


@query(f"WITH {LOGGED}, {EPS} SELECT env_id, idx, round(p * reward / probability, 6) AS reward FROM pm WHERE cand = action")
def e10_ips_score_learned(spark, d):
    return ope.off_policy_score(policy.epsilon_greedy(_log(spark, d), TYPES, 0.1)).select("env_id", "idx", F.round("eval_reward", 6).alias("reward"))


@query(f"WITH {LOGGED}, {DRAWN} SELECT env_id, idx, actions[k] AS action, CASE WHEN actions[k] = action THEN round(reward / probability, 6) ELSE 0 END AS reward FROM dr")
def e11_ips_drawn_e14(spark, d):
    out = ope.record(ope.off_policy_drawn(_fixed(spark, d)), ["action", "reward"])
    return out.select("env_id", "idx", "action", F.round("reward", 6).alias("reward"))


@query(f"WITH {LOGGED} SELECT env_id, idx, [CASE WHEN a = action THEN round(reward / probability, 6) ELSE 0 END for a in actions] AS rewards FROM logged")
def r15_ips_rewards(spark, d):
    return ope.ips_rewards(_log(spark, d)).select("env_id", "idx", F.transform("rewards", lambda r: F.round(r, 6)).alias("rewards"))


#: Per action one weighted line in the context: the regression on indicators and their products falls apart into these.
LINES = """ln AS (SELECT action AS cand, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw AS a FROM
(SELECT action, sum(1 / probability) AS sw, sum(context / probability) AS sx, sum(reward / probability) AS sy, sum(context * reward / probability) AS sxy, sum(context * context / probability) AS sxx FROM logged GROUP BY 1))"""


@query(f"WITH {LOGGED}, {LINES} SELECT env_id, idx, list(round(a + b * context, 5) ORDER BY cand) AS rewards FROM logged CROSS JOIN ln GROUP BY ALL")
def r16_direct_method(spark, d):
    return ope.direct_method(_log(spark, d), TYPES, features=["a", "xa"]).select("env_id", "idx", F.transform("rewards", lambda r: F.round(r, 5)).alias("rewards"))


#: Per action a weighted parabola in the context, by Cramer's rule: what constant, action, xa and xxa come to.
PARABOLAS = """qm AS (SELECT action AS cand, sum(w) AS s0, sum(w * x) AS s1, sum(w * x^2) AS s2, sum(w * x^3) AS s3, sum(w * x^4) AS s4, sum(w * reward) AS t0, sum(w * x * reward) AS t1, sum(w * x^2 * reward) AS t2
    FROM (SELECT *, 1 / probability AS w, context AS x FROM logged) GROUP BY 1),
qd AS (SELECT cand, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS d, t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2) AS da,
    s0*(t1*s4-s3*t2) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1) AS db, s0*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2) AS dc FROM qm),
qb AS (SELECT cand, da / d AS a, db / d AS b, dc / d AS c FROM qd)"""


@query(f"WITH {LOGGED}, {PARABOLAS} SELECT env_id, idx, list(round(a + b * context + c * context * context, 5) ORDER BY cand) AS rewards FROM logged CROSS JOIN qb GROUP BY ALL")
def r16_direct_method_squares(spark, d):
    """The constant, action, xa and xxa."""
    return ope.direct_method(_log(spark, d), TYPES).select("env_id", "idx", F.transform("rewards", lambda r: F.round(r, 5)).alias("rewards"))


@query(f"WITH {LOGGED}, {PARABOLAS}, {DRAWN} SELECT env_id, idx, round(a + b * context + c * context * context, 5) AS dm, round(a + b * context + c * context * context + CASE WHEN cand = action THEN (reward - a - b * context - c * context * context) / probability ELSE 0 END, 4) AS dr FROM dr JOIN qb ON cand = actions[k]")
def e12_evaluation_by_squares(spark, d):
    rows = ope.doubly_robust(ope.direct_method(_fixed(spark, d), TYPES, "dm"), TYPES, "dr")
    out = ope.at_drawn(rows, "dm").withColumnRenamed("eval_reward", "one")
    return out.select("env_id", "idx", F.round("one", 5).alias("dm"), F.round(F.get("dr", "at"), 4).alias("dr"))


@query(f"WITH {LOGGED}, {LINES} SELECT env_id, idx, list(round(a + b * context + CASE WHEN cand = action THEN (reward - a - b * context) / probability ELSE 0 END, 4) ORDER BY cand) AS rewards FROM logged CROSS JOIN ln GROUP BY ALL")
def r17_doubly_robust(spark, d):
    return ope.doubly_robust(_log(spark, d), TYPES, features=["a", "xa"]).select("env_id", "idx", F.transform("rewards", lambda r: data.rounded(r, 4)).alias("rewards"))


@query(f"WITH {LOGGED}, {LINES}, {DRAWN} SELECT env_id, idx, round(a + b * context, 5) AS dm, round(a + b * context + CASE WHEN cand = action THEN (reward - a - b * context) / probability ELSE 0 END, 4) AS dr FROM dr JOIN ln ON cand = actions[k]")
def e12_evaluation_by_models(spark, d):
    rows = ope.doubly_robust(ope.direct_method(_fixed(spark, d), TYPES, "dm", features=["a", "xa"]), TYPES, "dr", features=["a", "xa"])
    out = ope.at_drawn(rows, "dm").withColumnRenamed("eval_reward", "one")
    return out.select("env_id", "idx", F.round("one", 5).alias("dm"), F.round(F.get("dr", "at"), 4).alias("dr"))


@query(f"WITH {LOGGED}, {DRAWN}, z AS (SELECT env_id, idx, sum((actions[k] <> action OR reward = 0)::INT) OVER (PARTITION BY env_id ORDER BY idx) AS z FROM dr WHERE idx < 199) SELECT env_id, bool_or(idx + 1 > 20 AND z <= (idx + 1) * 0.01) AS warn FROM z GROUP BY 1")
def e15_correlated(spark, d):
    return ope.correlated(ope.off_policy_drawn(_fixed(spark, d)))


@query(f"SELECT idx, userid, CASE WHEN (k = label) = (userid < 4) THEN floor(2 * w) ELSE 2 + floor(3 * w) END::INT AS feedback, (k = label)::INT::DOUBLE AS reward FROM (SELECT vec_id AS idx, label, floor(6 * {draw_sql('9', 'vec_id + 1')})::INT AS userid, {draw_sql('9 + vec_id', '1')} AS w, floor(10 * ({draw_sql('1', 'vec_id + 1')} - 1e-12))::INT AS k FROM embeddings)")
def e16_grounded_evaluation(spark, d):
    rows = reshape.grounded(data.simulated(spark, d), 6, 4, 5, 2, seed=9).withColumn("pmf", policy.uniform())
    return ope.igl(rows).select("idx", "userid", "feedback", F.col("eval_reward").alias("reward"))


REJ = f"rj AS (SELECT *, {U} <= least(c, 1.0) * pi / probability AS ok FROM (SELECT *, {P_SQL.format(a='action')} AS pi, (SELECT least(min(NULLIF(probability, 0)), min((1 - probability) / 4)) FROM logged h WHERE h.idx < 100 AND h.env_id = logged.env_id) AS c FROM logged))"


@query(f"WITH {LOGGED}, {REJ} SELECT env_id, idx, round(reward, 6) AS reward FROM rj WHERE ok")
def e17_rejection(spark, d):
    return ope.rejection(_fixed(spark, d)).select("env_id", "idx", F.round("eval_reward", 6).alias("reward"))


@query(f"""WITH {LOGGED}, rw AS (SELECT *, {P_SQL.format(a='action')} AS pi, idx // 250 AS blk, {U} AS u FROM logged), cells AS (SELECT env_id, blk, floor((ln(probability / pi) + 10) / (20.0::DOUBLE / 1024)) AS bin, count(*) AS n FROM rw GROUP BY ALL),
past AS (SELECT b.env_id, b.blk, c.bin, sum(c.n) AS n FROM (SELECT DISTINCT env_id, blk FROM rw) b JOIN cells c ON c.env_id = b.env_id AND c.blk < b.blk GROUP BY ALL), seen AS (SELECT *, sum(n) OVER (PARTITION BY env_id, blk ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY env_id, blk) AS al FROM past),
c AS (SELECT env_id, blk, least(exp(min(bin) * (20.0::DOUBLE / 1024) - 10), 1.0) AS c FROM seen WHERE upto > 0.05 * (al - 1) GROUP BY ALL), f AS (SELECT env_id, least(min(probability), 1.0) AS c0 FROM rw WHERE blk = 0 GROUP BY 1)
SELECT env_id, idx, round(reward, 6) AS reward FROM rw JOIN f USING (env_id) LEFT JOIN c USING (env_id, blk) WHERE u <= coalesce(c, c0) * pi / probability""")
def e17_rejection_adaptive(spark, d):
    return ope.rejection_adaptive(_fixed(spark, d), cpct=0.05, block=250).select("env_id", "idx", F.round("eval_reward", 6).alias("reward"))


@query(f"WITH {LOGGED}, {REJ}, ru AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY env_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM rj), m AS (SELECT env_id, run, avg(CASE WHEN ok THEN reward ELSE pi * reward / probability END) AS y FROM ru GROUP BY ALL) SELECT env_id, idx, round(y, 6) AS reward FROM ru JOIN m USING (env_id, run) WHERE ok")
def e18_rejection_with_estimates(spark, d):
    return ope.rejection(_fixed(spark, d), ope=True).select("env_id", "idx", F.round("eval_reward", 6).alias("reward"))


@query(f"""WITH {LOGGED}, {DRAWN}, done AS (SELECT DISTINCT env_id FROM logged WHERE env_id < 3), r AS (
SELECT env_id, 1 AS learner_id, 0 AS evaluator_id, idx, 0.2 * reward / probability AS reward FROM logged UNION ALL SELECT env_id, 2, 0, idx, {P_SQL.format(a='action')} * reward / probability FROM logged
UNION ALL SELECT env_id, 2, 1, idx, CASE WHEN actions[k] = action THEN reward / probability ELSE 0 END FROM dr)
SELECT env_id AS environment_id, learner_id, evaluator_id, row_number() OVER (PARTITION BY env_id, learner_id, evaluator_id ORDER BY idx) AS "index", round(reward, 6) AS reward FROM r WHERE NOT (env_id < 3 AND learner_id = 2 AND evaluator_id = 0) AND NOT (learner_id = 1 AND evaluator_id = 1)""")
def e19_evaluation_job(spark, d):
    log = _log(spark, d)
    done = spark.createDataFrame([(e, 2, 0) for e in range(3)] + [(e, 1, 1) for e in range(10)], "environment_id int, learner_id int, evaluator_id int")
    pols = {1: lambda df: df.withColumn("pmf", policy.uniform()), 2: lambda df: df.withColumn("pmf", policy.fixed(PMF))}
    out = ope.evaluate(log, pols, {0: ope.off_policy_score, 1: ope.off_policy_drawn}, done)
    return out.withColumn("reward", F.round("reward", 6))


#: One feature for each action, so that A and b are numbers: (context - 3) * (place - 2).
ONE = """rx AS (SELECT *, (context - 3) * (list_position(actions, action) - 3) AS x FROM logged),
st AS (SELECT env_id, idx, context, 1 + coalesce(sum(x * x) OVER w, 0) AS a, coalesce(sum(x * reward) OVER w, 0) AS b FROM rx WINDOW w AS (PARTITION BY env_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
vl AS (SELECT env_id, idx, k, round({value}, {digits}) AS v FROM (SELECT *, (context - 3) * (k - 2) AS z FROM st, range(5) t(k))),
mx AS (SELECT *, max(v) OVER (PARTITION BY env_id, idx) AS best FROM vl)
SELECT env_id, idx, list(CASE WHEN v = best THEN round(1.0 / same, 6) ELSE 0 END ORDER BY k) AS pmf FROM (SELECT *, sum((v = best)::INT) OVER (PARTITION BY env_id, idx) AS same FROM mx) GROUP BY ALL"""


def _one_feature(spark, d, **options):
    log = _log(spark, d).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.array((F.col("context") - 3) * (k - 2))))
    out = policy.linear(log, 5, block=1, **options)
    return out.select("env_id", "idx", F.transform("pmf", lambda p: F.round(p, 6)).alias("pmf"))


@query(f"WITH {LOGGED}, " + ONE.format(value="z * b / a + 0.5 * sqrt(z * z / a)", digits=9))
def e6_linear_ucb_row_by_row(spark, d):
    """Blocks of one row: the sequential policy."""
    return _one_feature(spark, d, kind="ucb", alpha=0.5)


@query(f"WITH {LOGGED}, " + ONE.format(value="z * b / a", digits=5))
def e7_linear_thompson_row_by_row(spark, d):
    return _one_feature(spark, d, kind="ts", alpha=0.0)


@query("SELECT unnest(['on', 'ips', 'dm', 'dr', 'rejection']) AS mode, unnest(['actions,rewards', 'action,reward', 'action,actions,context,reward', 'action,actions,context,reward', 'action,actions,context,probability,reward']) AS lacking FROM (SELECT count(*) FROM events) UNION ALL SELECT 'ips of a log', '' FROM (SELECT count(*) FROM events)")
def e13_required_columns(spark, d):
    """What the events lack for each kind of evaluation, and what a log made of them does."""
    ev, log = data.table(spark, d, "events"), _log(spark, d)
    rows = [(m, ",".join(sorted(ope.lacking(ev, m)))) for m in ope.NEEDS] + [("ips of a log", ",".join(ope.lacking(log, "ips")))]
    return spark.createDataFrame(rows, "mode string, lacking string")


def _epsilon_learner(epsilon: float) -> learning.Learner:
    """A user's policy: counts and sums of rewards; epsilon over all actions, the rest over the best."""

    def update(state: dict, row: dict) -> dict:
        n, s = state.get(row["action"], (0, 0.0))
        return state | {row["action"]: (n + 1, s + row["reward"])}

    def merge(a: dict, b: dict) -> dict:
        return {k: tuple(x + y for x, y in zip(a.get(k, (0, 0.0)), b.get(k, (0, 0.0)))) for k in a | b}

    def predict(state: dict, row: dict) -> list[float]:
        value = [state[a][1] / state[a][0] if a in state else float("-inf") for a in row["actions"]]
        best = [v == max(value) for v in value]
        return [epsilon / len(value) + (1 - epsilon) * b / sum(best) for b in best]

    return learning.Learner(dict, update, merge, predict)


@query(f"WITH {LOGGED}, {EPS} SELECT env_id, idx, list(round(p, 6) ORDER BY cand) AS pmf FROM pm GROUP BY ALL")
def d3_learning_policy(spark, d):
    """A policy of a user's own that learns: the epsilon-greedy one, in blocks of 128 rows."""
    out = learning.learned(_log(spark, d), _epsilon_learner(0.1), block=128)
    return out.select("env_id", "idx", F.transform("pmf", lambda p: F.round(p, 6)).alias("pmf"))


def _fading_learner(fade: float) -> learning.Learner:
    """A user's policy whose state depends on order: (rows, counts that fade with each row)."""

    def update(state: tuple, row: dict) -> tuple:
        n, counts = state
        faded = {k: v * fade for k, v in counts.items()}
        return n + 1, faded | {row["action"]: faded.get(row["action"], 0.0) + 1}

    def merge(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], {k: a[1].get(k, 0.0) * fade ** b[0] + b[1].get(k, 0.0) for k in a[1] | b[1]}

    def predict(state: tuple, row: dict) -> list[float]:
        weights = [1 + state[1].get(a, 0.0) for a in row["actions"]]
        return [w / sum(weights) for w in weights]

    return learning.Learner(lambda: (0, {}), update, merge, predict)


@query(f"""WITH RECURSIVE {LOGGED}, st AS (SELECT env_id, idx, action, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS c FROM logged WHERE idx = 0 UNION ALL
SELECT l.env_id, l.idx, l.action, [x * 0.9 + (actions[i] = st.action)::INT for x, i in c] FROM st JOIN logged l ON l.env_id = st.env_id AND l.idx = st.idx + 1)
SELECT env_id, idx, [round((1 + x) / (5 + list_sum(c)), 6) for x in c] AS pmf FROM st""")
def d3_fading_policy(spark, d):
    """A policy of a user's own whose state fades, so that its blocks merge in order."""
    out = learning.learned(_log(spark, d), _fading_learner(0.9), block=100)
    return out.select("env_id", "idx", F.transform("pmf", lambda p: F.round(p, 6)).alias("pmf"))


@query(f"WITH {LOGGED}, h AS (SELECT env_id, CASE WHEN idx % 7 <> 0 THEN context END AS context, CASE WHEN idx % 5 <> 0 THEN reward END AS reward FROM logged) SELECT env_id, count(*) AS rows, sum((context IS NULL OR reward IS NULL)::INT) AS incomplete, sum((context IS NULL)::INT) AS context, 0 AS actions, 0 AS action, sum((reward IS NULL)::INT) AS reward FROM h GROUP BY 1")
def e13_incomplete_rows(spark, d):
    """Which rows of a log a regression estimate can't use."""
    hide = lambda c, n: F.when(F.col("idx") % n != 0, F.col(c))
    return ope.incomplete(_log(spark, d).withColumns({"context": hide("context", 7), "reward": hide("reward", 5)}), "dm")


@query(f"WITH {LOGGED} SELECT env_id, count(*) FILTER (WHERE context <> 3) AS rows, TRUE AS fits FROM logged GROUP BY 1")
def e7_thompson_draws(spark, d):
    """The draws themselves: with one feature the sign of a drawn coefficient, from N(b / a, alpha / a), decides the action. Over the
    rows of an environment it is positive about as often as these distributions say."""
    log = _log(spark, d).withColumn("__x", (F.col("context") - 3) * (F.array_position("actions", F.col("action")) - 3))
    drawn = policy.linear(log.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.array((F.col("context") - 3) * (k - 2)))), 5, kind="ts", alpha=0.5, block=1)
    past = running(log, ["env_id"], "idx", {"a": F.col("__x") * F.col("__x"), "b": F.col("__x") * F.col("reward")}, upto=-1)
    p = stats.normal(F.coalesce("b", F.lit(0.0)) / F.sqrt(0.5 * (1 + F.coalesce("a", F.lit(0.0)))))
    both = drawn.filter("context <> 3").join(past.select(F.col("env_id").alias("__e"), F.col("idx").alias("__i"), p.alias("p")), (F.col("env_id") == F.col("__e")) & (F.col("idx") == F.col("__i")))
    up = ((F.get("pmf", F.lit(4)) == 1) == (F.col("context") > 3)).cast("double")
    off = F.sum(up - F.col("p")) / F.sqrt(F.sum(F.col("p") * (1 - F.col("p"))))
    return both.groupBy("env_id").agg(F.count("*").alias("rows"), (F.abs(off) < 4.5).alias("fits"))
