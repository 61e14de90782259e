"""Queries on interactions: scalar functions, row shaping, representations, fits, order, sampling and shocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from banditframe.functions import encoders as E
from banditframe.functions import rand
from banditframe.functions import rewards as RW
from banditframe.operators import features as FT
from banditframe.operators import fit, ids, reshape, rows
from banditframe.plans import data
from banditframe.plans.data import FACTS, LOGGED, draw_sql
from banditframe.plans.tables import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def _log(spark, d):
    return data.logged(spark, d)


KEY = "l_orderkey, l_linenumber"

# ---- scalar functions


@query(f"SELECT {KEY}, -abs(l_quantity - 25) AS r FROM lineitem")
def f1_l1_reward(spark, d):
    return _items(spark, d).select("l_orderkey", "l_linenumber", RW.l1(F.lit(25.0), F.col("l_quantity")).alias("r"))


@query(f"SELECT {KEY}, CASE WHEN l_returnflag = 'R' THEN 2.5 ELSE 0.0 END::DOUBLE AS r FROM lineitem")
def f2_binary_reward(spark, d):
    return _items(spark, d).select("l_orderkey", "l_linenumber", RW.binary(F.lit("R"), F.col("l_returnflag"), 2.5).alias("r"))


@query(f"SELECT {KEY}, round((k::DOUBLE) / (2 + 3 - k), 6) AS r FROM (SELECT {KEY}, (l_returnflag IN ('A', 'N', 'x'))::INT + (l_linenumber::VARCHAR IN ('A', 'N', 'x'))::INT AS k FROM lineitem)")
def f3_hamming_reward(spark, d):
    labels = F.array(F.lit("A"), F.lit("N"), F.lit("x"))
    return _items(spark, d).select("l_orderkey", "l_linenumber", F.round(RW.hamming(labels, F.array("l_returnflag", F.col("l_linenumber").cast("string"))), 6).alias("r"))


@query(f"SELECT {KEY}, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE -1.0 END::DOUBLE AS r FROM lineitem")
def f4_discrete_reward(spark, d):
    acts, rs = F.array(F.lit("A"), F.lit("N"), F.lit("A")), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return _items(spark, d).select("l_orderkey", "l_linenumber", RW.discrete(acts, rs, F.col("l_returnflag"), -1.0).alias("r"))


@query(f"SELECT {KEY}, -abs(25 - l_quantity) AS l1, CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 0.0 END::DOUBLE AS bin, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 0.5 END::DOUBLE AS disc FROM lineitem")
def f1_f4_reward_struct(spark, d):
    """Rewards as data: three kinds of struct through one evaluation."""
    table_ = F.create_map(F.lit("A"), F.lit(1.0), F.lit("N"), F.lit(2.0))
    return _items(spark, d).select("l_orderkey", "l_linenumber", RW.evaluate(RW.spec("L1", F.lit(25.0)), F.col("l_quantity")).alias("l1"), RW.evaluate(RW.spec("Binary", F.lit("R"), value=2), F.col("l_returnflag")).alias("bin"), RW.evaluate(RW.spec("Discrete", map_=table_, default=0.5), F.col("l_returnflag")).alias("disc"))


@query(f"SELECT {KEY}, round(l_extendedprice / 7, 5) AS x, [round(l_tax / 3, 5), round(l_discount / 7, 5)] AS xs FROM lineitem")
def f6_minimize(spark, d):
    q = _items(spark, d)
    return q.select("l_orderkey", "l_linenumber", E.minimize(F.col("l_extendedprice") / 7, "double").alias("x"), E.minimize(F.array(F.col("l_tax") / 3, F.col("l_discount") / 7), "array<double>").alias("xs"))


@query("SELECT doc_id, coalesce(TRY_CAST(replace(source, 'src', '') AS DOUBLE), 'nan'::DOUBLE) AS num, n_chars::VARCHAR AS str, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS maybe, isnan(coalesce(TRY_CAST(lang AS DOUBLE), 'nan'::DOUBLE)) AS bad FROM documents")
def f7_f8_f9_encoders(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", E.numeric(F.replace("source", F.lit("src"), F.lit(""))).alias("num"), E.string(F.col("n_chars")).alias("str"), E.missing(F.col("lang"), values=("de", "")).alias("maybe"), F.isnan(E.numeric(F.col("lang"))).alias("bad"))


LV = "lv AS (SELECT list(l_returnflag ORDER BY f) AS l FROM (SELECT l_returnflag, min((l_orderkey, l_linenumber)) AS f FROM lineitem GROUP BY 1))"


@query(f"WITH {LV} SELECT {KEY}, [(l[1] = l_returnflag)::INT, (l[2] = l_returnflag)::INT, (l[3] = l_returnflag)::INT] AS one, list_position(list_sort(l), l_returnflag) - 1 AS cat, list_position(l, l_returnflag)::DOUBLE AS fac FROM lineitem, lv")
def f10_f11_f12_levels(spark, d):
    q = _items(spark, d)
    q = q.withColumns({"seen": E.levels(q, "l_returnflag", ["l_orderkey", "l_linenumber"]).scalar(), "known": E.levels(q, "l_returnflag").scalar()})
    c, seen, known = (F.col(x) for x in ("l_returnflag", "seen", "known"))
    return q.select("l_orderkey", "l_linenumber", E.onehot(c, seen).alias("one"), E.categorical(c, known).alias("cat"), E.factor(c, seen).alias("fac"))


@query(f"SELECT {KEY}, [1.0, round(a, 6), round(b, 6), round(a*a, 6), round(a*b, 6), round(b*b, 6), round(a*c, 6), round(b*c, 6)]::DOUBLE[] AS x FROM (SELECT {KEY}, l_quantity / 50 AS a, l_tax AS b, l_discount AS c FROM lineitem)")
def f13_crosses(spark, d):
    x = E.crosses({"x": (F.array(F.col("l_quantity") / 50, F.col("l_tax")), 2), "a": (F.array("l_discount"), 1)}, [1, "x", "xx", "xa"])
    return _items(spark, d).select("l_orderkey", "l_linenumber", F.transform(x, lambda v: F.round(v, 6)).alias("x"))


@query(f"SELECT {KEY}, [round(a*a*a, 6), round(a*a*b, 6), round(a*b*b, 6), round(b*b*b, 6)]::DOUBLE[] AS dense, round(a*a, 6) AS qq, round(a*b, 6) AS qt, round(b*b, 6) AS tt FROM (SELECT {KEY}, l_quantity / 50 AS a, l_tax AS b FROM lineitem)")
def f13_crosses_cubic_and_sparse(spark, d):
    q = _items(spark, d).withColumn("q", F.col("l_quantity") / 50)
    dense = E.crosses({"x": (F.array("q", "l_tax"), 2)}, ["xxx"])
    m = E.sparse_crosses({"x": F.create_map(F.lit("q"), F.col("q"), F.lit("t"), F.col("l_tax"))}, ["xx"])
    return q.select("l_orderkey", "l_linenumber", F.transform(dense, lambda v: F.round(v, 6)).alias("dense"), *[F.round(m[k], 6).alias(k) for k in ("qq", "qt", "tt")])


DRAW = "SELECT (event_id + 1)::BIGINT AS k, event_id FROM events"


@query(f"SELECT event_id, round({draw_sql('7', 'event_id + 1')}, 8) AS u, round(-2 + 5 * {draw_sql('7', 'event_id + 1')}, 6) AS r, 1 + floor(6 * {draw_sql('3', 'event_id + 1')})::BIGINT AS i FROM events")
def f15_f16_draws(spark, d):
    ev, k = table(spark, d, "events"), F.col("event_id") + 1
    return ev.select("event_id", F.round(rand.u(7, k), 8).alias("u"), F.round(rand.random(7, k, -2, 3), 6).alias("r"), rand.randint(3, k, 1, 6).alias("i"))


@query(f"SELECT event_id, round(sqrt(-2 * ln(a)) * CASE WHEN event_id % 2 = 0 THEN cos(2 * pi() * b) ELSE sin(2 * pi() * b) END, 6) AS g FROM (SELECT event_id, {draw_sql('5', '2 * (event_id // 2) + 1')} AS a, {draw_sql('5', '2 * (event_id // 2) + 2')} AS b FROM events)")
def f17_gauss(spark, d):
    return table(spark, d, "events").select("event_id", F.round(rand.gauss(5, F.col("event_id")), 6).alias("g"))


@query(f"SELECT event_id, ['a', 'b', 'c', 'd'][floor(4 * u)::INT + 1] AS plain, CASE WHEN 0.1 >= u THEN 'a' WHEN 0.1 + 0.2 >= u THEN 'b' WHEN 0.1 + 0.2 + 0.7 >= u THEN 'c' ELSE 'c' END AS weighted FROM (SELECT event_id, {draw_sql('11', 'event_id + 1')} AS u FROM events)")
def f18_choice(spark, d):
    k = F.col("event_id") + 1
    letters = F.array(*[F.lit(x) for x in "abcd"])
    weights = F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7))
    return table(spark, d, "events").select("event_id", rand.choice(11, k, letters).alias("plain"), rand.choice(11, k, F.slice(letters, 1, 3), weights).alias("weighted"))


@query(f"SELECT {KEY}, '{{\"L1Reward\":' || l_quantity::VARCHAR || '}}' AS j FROM lineitem")
def f21_reward_json(spark, d):
    return _items(spark, d).select("l_orderkey", "l_linenumber", RW.to_json(RW.spec("L1", F.col("l_quantity"))).alias("j"))


# ---- row shaping


@query(f"SELECT l_orderkey AS k, l_linenumber AS n, l_tax AS tax, l_quantity AS \"first\" FROM lineitem")
def p12_head(spark, d):
    q = _items(spark, d)
    m = rows.head_sparse(F.create_map(F.lit("0"), F.col("l_quantity")), {"0": "first"})
    return rows.head(q.select("l_orderkey", "l_linenumber", "l_tax", m["first"]), ["k", "n", "tax", "first"])


@query(f"SELECT {KEY}, l_quantity, l_returnflag FROM lineitem WHERE NOT l_discount > 0.05")
def p13_drop(spark, d):
    return rows.drop(_items(spark, d), [3, "l_discount", "l_tax"], F.col("l_discount") > 0.05)


@query("SELECT l_orderkey, l_linenumber, l_tax, l_returnflag AS label, 'c' AS kind FROM lineitem")
def p14_label(spark, d):
    return rows.label(_items(spark, d), "l_returnflag", "c").select("features.l_orderkey", "features.l_linenumber", "features.l_tax", "label", "kind")


@query(f"SELECT {KEY}, l_quantity::VARCHAR AS l_quantity, coalesce(TRY_CAST(l_returnflag AS DOUBLE), -1.0)::DOUBLE AS l_returnflag FROM lineitem")
def p15_encode(spark, d):
    out = rows.encode(_items(spark, d), {"l_quantity": E.string, 6: lambda c: F.coalesce(F.nanvl(E.numeric(c), F.lit(-1.0)), F.lit(-1.0))})
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("WITH f AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_id < 500) SELECT event_id, round((value - lo) / (hi - lo), 6) AS value FROM events, f")
def p16_fit_encode(spark, d):
    fit_ = lambda c: F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))
    ev = table(spark, d, "events").select("event_id", "value")
    return rows.fit_encode(ev, "event_id", {"value": (fit_, lambda c, f: F.round((c - f["lo"]) / (f["hi"] - f["lo"]), 6))}, using=500)


@query("SELECT l_orderkey, l_linenumber, l_tax, l_quantity FROM lineitem")
def p17_structure(spark, d):
    q = _items(spark, d).drop("l_extendedprice", "l_discount", "l_returnflag")
    s = rows.structure([["l_tax"], None, "l_quantity"], q.columns)
    return q.select(s.alias("s")).select(F.col("s._1.l_orderkey"), F.col("s._1.l_linenumber"), F.col("s._0.l_tax"), F.col("s.l_quantity"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, 7)::BIGINT AS a, n_chars AS b FROM documents")
def p18_default(spark, d):
    docs = table(spark, d, "documents")
    m = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.col("n_chars"), F.lit("b"), F.col("n_chars"))).otherwise(F.create_map(F.lit("b"), F.col("n_chars")))
    full = rows.default_sparse(m, {"a": 7, "c": 1})
    return docs.select("doc_id", full["a"].cast("long").alias("a"), full["b"].cast("long").alias("b"))


@query("SELECT l_orderkey, l_linenumber, [l_quantity, l_tax, l_discount] AS x, CASE WHEN l_tax <> 0 THEN l_tax END AS k0, CASE WHEN l_discount <> 0 THEN l_discount END AS k1 FROM lineitem")
def p19_flatten(spark, d):
    q = _items(spark, d)
    dense = rows.flatten_dense([(F.col("l_quantity"), False), (F.array("l_tax", "l_discount"), True)])
    m = rows.flatten_sparse(F.create_map(F.lit("k"), F.array("l_tax", "l_discount")))
    return q.select("l_orderkey", "l_linenumber", dense.alias("x"), F.try_element_at(m, F.lit("k_0")).alias("k0"), F.try_element_at(m, F.lit("k_1")).alias("k1"))


@query("SELECT vec_id AS idx, [round(embedding[1]::DOUBLE, 6), round(embedding[2]::DOUBLE, 6)] AS context, 10::BIGINT AS n FROM embeddings")
def p20_flatten_interactions(spark, d):
    s = data.simulated(spark, d)
    nested = s.withColumns({"context": F.array(F.slice("context", 1, 1), F.slice("context", 2, 1)), "actions": F.transform("actions", lambda a: F.array(F.array(a)))})
    return rows.flatten_interactions(nested).select("idx", F.transform("context", lambda x: F.round(x, 6)).alias("context"), F.size("actions").cast("long").alias("n"))


@query(f"WITH {LOGGED}, s AS (SELECT env_id FROM logged GROUP BY 1 HAVING count(*) BETWEEN 1000 AND 100000) SELECT env_id, count(*) AS n FROM logged JOIN s USING (env_id) GROUP BY 1")
def p21_where_sizes(spark, d):
    return reshape.where_size(_log(spark, d), (1000, 100000), (5, None)).groupBy("env_id").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT environment_id, data_id, 'a' AS tag, 3 AS seed FROM envs")
def p22_params(spark, d):
    return reshape.params(data.events_result(spark, d).environments.drop("name"), tag="a", seed=3)


@query(f"WITH {FACTS} SELECT environment_id FROM envs WHERE environment_id NOT IN (SELECT environment_id FROM ints WHERE reward > 0.975)")
def p24_empty(spark, d):
    r = data.events_result(spark, d)
    return reshape.empty_environments(r.environments, r.interactions.filter("reward > 0.975"), "environment_id").select("environment_id")


@query("SELECT vec_id AS idx, label::INT AS best, 10 AS n, 1.0::DOUBLE AS r FROM embeddings")
def p25_finalize(spark, d):
    s = data.simulated(spark, d).withColumn("actions", F.transform("actions", lambda a: a.cast("string")))
    out = FT.finalize(s)
    at = F.array_position(F.transform("actions", lambda a: F.get(a, F.col("label"))), 1) - 1
    return out.select("idx", at.cast("int").alias("best"), F.size("actions").alias("n"), F.element_at("rewards", F.col("label").cast("string")).alias("r"))


@query("SELECT o_orderpriority || CASE WHEN n > 1 THEN k::VARCHAR ELSE '' END AS key, o_orderkey AS value FROM (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders)")
def p26_param_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pipe"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("value"))
    return ids.merged_params(o)


# ---- sources in memory, supervised


@query("SELECT vec_id AS idx, ['0', '1', '2', '3', '4', '5', '6', '7', '8', '9'] AS actions, label::INT AS best, 64 AS width FROM embeddings")
def s13_supervised_classes(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", F.col("label").cast("string").alias("label"))
    out = FT.supervised(e, F.col("embedding"), "label")
    return out.select("idx", "actions", (F.array_position("rewards", 1.0) - 1).cast("int").alias("best"), F.size("context").alias("width"))


@query("SELECT l_orderkey * 10 + l_linenumber AS idx, -abs(5 - l_quantity)::DOUBLE AS r FROM lineitem")
def s13_supervised_regression(spark, d):
    q = _items(spark, d).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = FT.supervised(q, F.array("l_tax", "l_discount"), "l_quantity", "r")
    return out.select("idx", RW.evaluate(F.col("rewards"), F.lit(5.0)).alias("r"))


@query("WITH t AS (SELECT doc_id AS idx, [lang, source] AS l FROM documents), a AS (SELECT list(DISTINCT x ORDER BY x) AS acts FROM (SELECT unnest(l) AS x FROM t)) SELECT idx, len(acts)::INT AS n, round(list_sum([CASE WHEN list_contains(l, x) THEN 0.5 ELSE 0 END for x in acts]), 6)::DOUBLE AS total FROM t, a")
def s13_supervised_multilabel(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.array("lang", "source").alias("label"))
    out = FT.supervised(docs, F.col("idx"), "label", "m")
    return out.select("idx", F.size("actions").alias("n"), F.round(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0")
def s15_descriptors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.lit(1.5)).alias("x"), F.lit("t").alias("words"), "label")
    desc = spark.createDataFrame([("x", False, False, "numeric"), ("words", False, False, "string"), ("vec_id", False, False, "numeric")], "name string, ignore boolean, row_id boolean, type string")
    return FT.drop_by_descriptor(e.withColumnRenamed("label", "target"), desc, "target").select("vec_id", "label")


@query(f"WITH {FACTS} SELECT base_id, seed, (row_number() OVER (ORDER BY seed, base_id) - 1)::INT AS environment_id FROM (SELECT environment_id AS base_id FROM envs) CROSS JOIN (SELECT unnest([1, 2, 5]) AS seed)")
def s16_fan_out(spark, d):
    envs = data.events_result(spark, d).environments.select("environment_id")
    return ids.fan_out(envs, spark.createDataFrame([(1,), (2,), (5,)], "seed int"))


@query(f"WITH {FACTS} SELECT environment_id, data_id FROM envs UNION ALL SELECT environment_id + 10, data_id FROM envs WHERE environment_id < 4")
def s17_u3_concat(spark, d):
    envs = data.events_result(spark, d).environments.select("environment_id", "data_id")
    return ids.concat(envs, envs.filter("environment_id < 4"))


# ---- representations


@query(f"WITH {LOGGED} SELECT env_id, idx, [(action = 'click')::INT, (action = 'error')::INT, (action = 'purchase')::INT, (action = 'signup')::INT, (action = 'view')::INT] AS action, 5 AS n FROM logged")
def r1_repr(spark, d):
    return FT.repr_actions(_log(spark, d)).select("env_id", "idx", "action", F.size("actions").alias("n"))


@query(f"SELECT {KEY}, [l_quantity, (l_returnflag = 'A')::INT, (l_returnflag = 'N')::INT, (l_returnflag = 'R')::INT]::DOUBLE[] AS context FROM lineitem")
def r1_repr_context(spark, d):
    q = _items(spark, d)
    q = q.withColumn("known", E.levels(q, "l_returnflag").scalar())
    return q.select("l_orderkey", "l_linenumber", FT.repr_context([(F.col("l_quantity"), None), (F.col("l_returnflag"), F.col("known"))]).alias("context"))


def _scaled(shift: str, width: str, digits: int = 6, head: str = "") -> str:
    cells = (f"round(({c} - (SELECT {shift.format(c=c)} FROM lineitem {head})) / (SELECT {width.format(c=c)} FROM lineitem {head}), {digits})" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return f"SELECT {KEY}, [{', '.join(cells)}] AS context FROM lineitem"



def _wide(spark, d):
    q = _items(spark, d).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return q.select(F.lit(0).alias("env_id"), "idx", "l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("context"))


def _rounded(df):
    return df.select("l_orderkey", "l_linenumber", F.transform("context", lambda x: data.rounded(x, 6)).alias("context"))


@query(_scaled("min({c})", "max({c}) - min({c})"))
def r2_scale_minmax(spark, d):
    return _rounded(fit.scale(_wide(spark, d), "min", "minmax"))


@query(_scaled("avg({c})", "stddev_samp({c})", 5, "WHERE l_orderkey * 10 + l_linenumber < 30000"))
def r2_scale_standard(spark, d):
    out = fit.scale(_wide(spark, d), "mean", "std", using=30000)
    return out.select("l_orderkey", "l_linenumber", F.transform("context", lambda x: data.rounded(x, 5)).alias("context"))


@query(_scaled("median({c})", "quantile_cont({c}, .75) - quantile_cont({c}, .25)"))
def r2_scale_median_iqr(spark, d):
    return _rounded(fit.scale(_wide(spark, d), "med", "iqr"))


@query("WITH t AS (SELECT doc_id AS idx, n_chars, CASE WHEN doc_id % 2 = 0 THEN n_chars % 100 END AS odd FROM documents), s AS (SELECT max(n_chars) - min(n_chars) AS a, greatest(max(odd), 0) - least(min(odd), 0) AS b FROM t) SELECT idx, round(n_chars / a, 8) AS n, round(odd / b, 8) AS odd FROM t, s")
def r2_scale_sparse(spark, d):
    docs = table(spark, d, "documents")
    m = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("n"), F.col("n_chars").cast("double"), F.lit("odd"), (F.col("n_chars") % 100).cast("double"))).otherwise(F.create_map(F.lit("n"), F.col("n_chars").cast("double")))
    out = fit.scale(docs.select(F.lit(0).alias("env_id"), F.col("doc_id").alias("idx"), m.alias("context")))
    return out.select("idx", *[F.round(F.try_element_at("context", F.lit(k)), 8).alias(k) for k in ("n", "odd")])


GAPS = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 <> 3 THEN l_quantity END AS a, CASE WHEN l_linenumber % 5 <> 2 THEN l_tax END AS b, l_discount AS c FROM lineitem)"


def _gaps(spark, d):
    q = _items(spark, d)
    a, b = F.when(F.col("l_linenumber") % 7 != 3, F.col("l_quantity")), F.when(F.col("l_linenumber") % 5 != 2, F.col("l_tax"))
    return q.select(F.lit(0).alias("env_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), "l_orderkey", "l_linenumber", F.array(a, b, F.col("l_discount")).alias("context"))


def _impute_sql(agg: str) -> str:
    return f"WITH g AS {GAPS}, s AS (SELECT {agg.format('a')} AS sa, {agg.format('b')} AS sb FROM g) SELECT {KEY}, [round(coalesce(a, sa), 6), round(coalesce(b, sb), 6), round(c, 6), (a IS NULL)::INT, (b IS NULL)::INT]::DOUBLE[] AS context FROM g, s"


@query(_impute_sql("avg({})"))
def r3_impute_mean(spark, d):
    return _rounded(fit.impute(_gaps(spark, d), "mean"))


@query(_impute_sql("median({})"))
def r3_impute_median(spark, d):
    return _rounded(fit.impute(_gaps(spark, d), "median"))


@query(f"WITH g AS {GAPS}, ca AS (SELECT a, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM g WHERE a IS NOT NULL GROUP BY a), cb AS (SELECT b, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM g WHERE b IS NOT NULL GROUP BY b) SELECT {KEY}, [coalesce(a, (SELECT arg_max(a, (n, -f)) FROM ca)), coalesce(b, (SELECT arg_max(b, (n, -f)) FROM cb)), c]::DOUBLE[] AS context FROM g")
def r3_impute_mode(spark, d):
    return fit.impute(_gaps(spark, d), "mode", indicator=False).select("l_orderkey", "l_linenumber", "context")


@query(f"SELECT {KEY}, CASE WHEN l_tax <> 0 THEN l_tax END AS t, CASE WHEN l_discount <> 0 THEN l_discount END AS d, (l_tax <> 0)::INT + (l_discount <> 0)::INT AS n FROM lineitem")
def r4_sparse(spark, d):
    q = _items(spark, d)
    m = FT.sparse(F.array("l_tax", "l_discount"), "array<double>")
    return q.select("l_orderkey", "l_linenumber", F.try_element_at(m, F.lit("0")).alias("t"), F.try_element_at(m, F.lit("1")).alias("d"), F.size(m).alias("n"))


def _sparse_docs(spark, d):
    docs = table(spark, d, "documents")
    m = F.create_map(F.concat(F.lit("lang="), "lang"), F.lit(1.0), F.concat(F.lit("source="), "source"), F.lit(1.0), F.lit("n_chars"), F.col("n_chars").cast("double"))
    return docs.select("doc_id", m.alias("context"))


@query("SELECT doc_id, 64 AS n, (n_chars + 2)::DOUBLE AS total FROM documents")
def r5_dense_lookup(spark, d):
    """Every name has a slot of its own here, so a row's sum is kept whatever slots the names get."""
    out = FT.dense_lookup(_sparse_docs(spark, d), "context", 64, ["doc_id"])
    return out.select("doc_id", F.size("dense").alias("n"), F.aggregate("dense", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH ks AS (SELECT doc_id, 'lang=' || lang AS s, 1.0::DOUBLE AS value, 1 AS nth FROM documents UNION ALL SELECT doc_id, 'source=' || source, 1.0, 2 FROM documents UNION ALL SELECT doc_id, 'n_chars', n_chars::DOUBLE, 3 FROM documents),
{data.crc_sql("ks", 16)}, won AS (SELECT doc_id, v % 16 AS slot, arg_max(value, nth) AS value FROM ks JOIN crc USING (s) GROUP BY ALL)
SELECT g.doc_id, list(coalesce(value, 0.0) ORDER BY k) AS dense FROM (SELECT doc_id, k FROM documents, range(16) t(k)) g LEFT JOIN won ON won.doc_id = g.doc_id AND slot = k GROUP BY 1""")
def r6_f14_dense_hashing(spark, d):
    return _sparse_docs(spark, d).select("doc_id", FT.dense_hashed(F.col("context"), 16).alias("dense"))


@query("SELECT vec_id AS idx, [CASE WHEN vec_id >= 100 THEN (label = (k + 9) % 10) ELSE (label = k) END::INT::DOUBLE for k in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]] AS rewards FROM embeddings")
def r7_cycle(spark, d):
    s = data.simulated(spark, d).withColumn("actions", F.transform("actions", lambda a: a.cast("string")))
    return reshape.cycle(s, 100).select("idx", "rewards")


@query(f"SELECT {KEY}, [(l_tax >= l_discount)::INT, (l_tax < l_discount)::INT]::DOUBLE[] AS rewards FROM lineitem")
def r8_binary(spark, d):
    return reshape.binary(_items(spark, d).withColumn("rewards", F.array("l_tax", "l_discount"))).select("l_orderkey", "l_linenumber", "rewards")


@query(f"SELECT event_id AS idx, round(value + sqrt(-2 * ln(a)) * CASE WHEN event_id % 2 = 0 THEN cos(2 * pi() * b) ELSE sin(2 * pi() * b) END, 6) AS context FROM (SELECT event_id, value, {draw_sql('1', '2 * (event_id // 2) + 1')} AS a, {draw_sql('1', '2 * (event_id // 2) + 2')} AS b FROM events)")
def r9_noise(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("value").alias("context"))
    return reshape.noise(ev).select("idx", F.round("context", 6).alias("context"))


@query(f"SELECT event_id AS idx, [value + floor(3 * {draw_sql('4', '2 * event_id + 1')}), 1 + floor(3 * {draw_sql('4', '2 * event_id + 2')})]::DOUBLE[] AS rewards FROM events")
def r9_noise_rewards(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.array(F.col("value"), F.lit(1.0)).alias("rewards"))
    return reshape.noise(ev, reward=("i", 0, 2), n_actions=2, seed=4)


GROUND = f"g AS (SELECT vec_id AS idx, label, floor(6 * {draw_sql('9', 'vec_id + 1')})::INT AS userid, {draw_sql('9 + vec_id', '1')} AS w FROM embeddings)"


@query(f"WITH {GROUND} SELECT idx, userid, userid < 4 AS isnormal, [CASE WHEN (k = label) = (userid < 4) THEN floor(2 * w) ELSE 2 + floor(3 * w) END::INT for k in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]] AS feedbacks FROM g")
def r10_grounded(spark, d):
    return reshape.grounded(data.simulated(spark, d), 6, 4, 5, 2, seed=9).select("idx", "userid", "isnormal", "feedbacks")


@query(f"WITH {LOGGED} SELECT env_id, (idx // 32)::BIGINT AS batch_id, list(round(reward, 6) ORDER BY idx) AS reward, count(*)::INT AS n FROM logged GROUP BY ALL")
def r11_batch(spark, d):
    log = _log(spark, d).withColumn("reward", F.round("reward", 6))
    return reshape.batch(log.select("env_id", "idx", "reward"), 32).select("env_id", "batch_id", "reward", F.size("idx").alias("n"))


@query(f"WITH {LOGGED} SELECT env_id, idx, action FROM logged")
def r12_unbatch(spark, d):
    return reshape.unbatch(reshape.batch(_log(spark, d).select("env_id", "idx", "action"), 7))


@query(f"WITH {LOGGED} SELECT env_id, (i // 16)::BIGINT AS batch_id, list(idx ORDER BY idx) AS was FROM (SELECT env_id, idx, idx // 2 AS i FROM logged WHERE idx % 2 = 0) GROUP BY ALL")
def r13_batch_safe(spark, d):
    log = _log(spark, d).select("env_id", "idx").withColumn("was", F.col("idx"))
    even = lambda df: reshape.slice_rows(df, 0, None, 2).withColumn("idx", F.floor(F.col("idx") / 2))
    return reshape.batch_safe(reshape.batch(log, 16), even).select("env_id", "batch_id", "was")


@query(f"SELECT vec_id AS idx, floor(10 * u)::INT AS action, (floor(10 * u)::INT = label)::INT::DOUBLE AS reward, 0.1::DOUBLE AS probability FROM (SELECT vec_id, label, {draw_sql('13', 'vec_id + 1')} - 1e-12 AS u FROM embeddings)")
def r14_j11_logged(spark, d):
    s = data.simulated(spark, d)
    out = reshape.logged(s, F.transform("actions", lambda a: F.lit(0.1)), 13)
    return out.select("idx", "action", "reward", "probability")


# ---- order and sampling


@query(f"WITH {LOGGED} SELECT env_id, idx FROM logged WHERE idx < 20 AND env_id IN (SELECT env_id FROM logged GROUP BY 1 HAVING count(*) >= 20)")
def o2_take(spark, d):
    return reshape.take(_log(spark, d), 20, strict=True).select("env_id", "idx")


@query(f"WITH {LOGGED} SELECT env_id, idx FROM logged WHERE idx >= 5 AND idx < 200 AND (idx - 5) % 7 = 0")
def o3_slice_w8(spark, d):
    return reshape.slice_rows(_log(spark, d), 5, 200, 7).select("env_id", "idx")


@query(f"WITH {LOGGED} SELECT env_id, round(reward, 6) AS reward, row_number() OVER (PARTITION BY env_id ORDER BY context, idx) - 1 AS idx FROM logged")
def o4_sort(spark, d):
    return reshape.sort(_log(spark, d).select("env_id", "idx", "context", F.round("reward", 6).alias("reward")), [F.col("context")]).select("env_id", "reward", "idx")


@query(f"WITH {LOGGED} SELECT env_id, count(*) AS n, min(idx) AS lo, max(idx) AS hi, sum(idx)::BIGINT AS total, TRUE AS moved FROM logged GROUP BY env_id")
def o5_shuffle(spark, d):
    """A permutation: the same rows with all places taken once, and few of them in their old place."""
    log = _log(spark, d).select("env_id", "idx").withColumn("was", F.col("idx"))
    return reshape.shuffle(log, 3).groupBy("env_id").agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.sum("was").alias("total"), (F.avg((F.col("was") == F.col("idx")).cast("int")) < 0.3).alias("moved"))


@query(f"WITH {LOGGED} SELECT env_id, 50::BIGINT AS n, 50::BIGINT AS different, TRUE AS mixed FROM logged GROUP BY env_id HAVING count(*) >= 50")
def o6_reservoir(spark, d):
    log = _log(spark, d).select("env_id", "idx").withColumn("was", F.col("idx"))
    return reshape.reservoir(log, 50, 5, strict=True).groupBy("env_id").agg(F.count("*").alias("n"), F.countDistinct("was").alias("different"), (F.max("was") >= 50).alias("mixed"))


@query()
def o7_riffle(spark, d):
    log = _log(spark, d).select("env_id", "idx").withColumn("was", F.col("idx"))
    return reshape.riffle(log, 3, 1)


@query(f"WITH {LOGGED} SELECT env_id, idx + 3 AS idx, action FROM logged UNION ALL SELECT env_id, idx, action FROM logged WHERE idx < 3")
def u2_prepend(spark, d):
    log = _log(spark, d).select("env_id", "idx", "action")
    return reshape.prepend(log, log.filter("idx < 3"))
