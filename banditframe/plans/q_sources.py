"""Queries that write a driver table in a format, read it back with this package's reader, and return what was read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from banditframe.operators import results as R
from banditframe.plans import data
from banditframe.plans.data import FACTS, LOGGED
from banditframe.plans.tables import shared_dir, table
from banditframe.sources import log, store, text
from banditframe.sources.python_source import LinesSource, write_made

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_returnflag")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def s1_csv(spark, d):
    path = _path(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").write.option("header", True).csv(path)
    return text.csv(spark, path, header=True)


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, l_returnflag, l_linenumber = 3 AS missing FROM lineitem")
def s2_arff_dense(spark, d):
    path = _path(spark, "arff")
    rows = _items(spark, d).withColumn("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    text.write_arff(rows, path, "lineitem", {"l_returnflag": ["A", "N", "R"]})
    return text.read_arff(spark, path)


@query("SELECT l_orderkey, CASE WHEN l_tax <> 0 THEN l_tax END AS tax, CASE WHEN l_returnflag = 'A' THEN '0' ELSE l_returnflag END AS flag FROM lineitem")
def s2c_arff_sparse(spark, d):
    path = _path(spark, "arff")
    spark.createDataFrame([("@relation r\n@attribute k numeric\n@attribute tax numeric\n@attribute flag {A,N,R}\n@data",)], "value string").coalesce(1).write.text(f"{path}/part=0")
    cells = F.concat_ws(", ", F.concat(F.lit("0 "), "l_orderkey"), F.when(F.col("l_tax") != 0, F.concat(F.lit("1 "), "l_tax")), F.when(F.col("l_returnflag") != "A", F.concat(F.lit("2 "), "l_returnflag")))
    _items(spark, d).select(F.concat(F.lit("{"), cells, F.lit("}")).alias("value")).write.text(f"{path}/part=1")
    out = text.read_arff(spark, path)
    get = lambda k: F.try_element_at("row", F.lit(k))
    return out.select(F.coalesce(get("k"), F.lit("0")).cast("long").alias("l_orderkey"), get("tax").cast("double").alias("tax"), F.coalesce(get("flag"), F.lit("0")).alias("flag"))


def _svm(spark, d):
    return _items(spark, d).select(F.concat(F.col("l_returnflag"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(" 1:"), F.col("l_orderkey").cast("string"), F.lit(" 7:"), F.col("l_tax").cast("string")).alias("value"))


SVM = "SELECT l_orderkey::DOUBLE AS k, l_tax AS t, [l_returnflag, l_linenumber::VARCHAR] AS labels FROM lineitem"


@query(SVM)
def s3_libsvm(spark, d):
    path = _path(spark, "svm")
    rows = _svm(spark, d)
    rows.union(rows.select(F.lit("1:2 2:3")).limit(5)).write.text(path)
    return text.read_libsvm(spark, path).select(F.col("features")[1].alias("k"), F.col("features")[7].alias("t"), "labels")


@query(SVM)
def s4_manik(spark, d):
    """Each file begins with a line of sizes, which is no data."""
    path = _path(spark, "manik")
    rows = _svm(spark, d).withColumnRenamed("value", "10 8 9")
    rows.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return text.read_manik(spark, path).select(F.col("features")[1].alias("k"), F.col("features")[7].alias("t"), "labels")


@query("SELECT o_orderkey::VARCHAR || '|' || o_orderpriority AS value FROM orders")
def s5_s7_k1_lines_gzip(spark, d):
    path = _path(spark, "lines")
    rows = table(spark, d, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
    store.write_lines(rows, path, gzip=True)
    return text.open_path(spark, path)


@query("SELECT o_orderkey::VARCHAR AS value FROM orders")
def s6_delimited(spark, d):
    path = _path(spark, "delim")
    table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("value")).write.option("lineSep", ";").text(path)
    return text.delimited(spark, path, ";")


@query("SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment FROM customer")
def s8_frame(spark, d):
    """Pandas frames as rows: each task makes frames of the rows that it has."""
    parts = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return store.from_frames(parts, lambda f: f.assign(c_mktsegment=f.c_mktsegment.str.upper()), parts.schema)


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def s9_d9_python_source(spark, d):
    """The regions as literal rows of a data source written in Python."""
    spark.dataSource.register(LinesSource)
    rows = [[int(r[0]), r[1]] for r in table(spark, d, "region").select("r_regionkey", "r_name").collect()]
    return spark.read.format("banditframe_rows").option("schema", "r_regionkey bigint, r_name string").option("rows", json.dumps(rows)).load()


LOG = f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", round(reward, 5) AS reward, name, family FROM ints JOIN envs USING (environment_id) JOIN lrns USING (learner_id)"


@query(LOG)
def s10_k2_result_log(spark, d):
    """Triples of more than 100 rows have several lines; what is packed is found by reading."""
    path = _path(spark, "log")
    log.write(data.events_result(spark, d), path, rows=100)
    r = log.read(spark, path)
    names = r.environments.select("environment_id", F.col("params")["name"].alias("name"))
    families = r.learners.select("learner_id", F.col("params")["family"].alias("family"))
    return r.interactions.join(names, "environment_id").join(families, "learner_id").select("environment_id", "learner_id", "index", "reward", "name", "family")


@query(f"WITH {LOGGED}, w AS (SELECT *, (idx % 3)::INT AS fam FROM logged) SELECT (row_number() OVER (PARTITION BY env_id, fam ORDER BY idx)) AS \"index\", dense_rank() OVER (ORDER BY env_id)::INT - 1 AS environment_id, dense_rank() OVER (ORDER BY fam)::INT - 1 AS learner_id, round(reward, 6) AS reward FROM w")
def s11_from_logged(spark, d):
    rows = data.logged(spark, d).withColumn("fam", (F.col("idx") % 3).cast("int"))
    r = R.from_logged(rows, ["env_id"], ["fam"], ["idx", "env_id"])
    return r.interactions.select("index", "environment_id", "learner_id", F.round("reward", 6).alias("reward"))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, \"index\", round(reward, 6) AS reward, family AS action, data_id, name, eval_type, seed FROM ints JOIN lrns USING (learner_id) JOIN envs USING (environment_id) JOIN vals USING (evaluator_id)")
def s12_to_logged(spark, d):
    r = data.events_result(spark, d)
    facts = r.interactions.join(r.learners.select("learner_id", F.col("family").alias("action")), "learner_id").withColumn("nothing", F.lit(None).cast("string"))
    out = R.to_logged(R.Result(r.environments, r.learners, r.evaluators, facts))
    return out.select("environment_id", "learner_id", "index", F.round("reward", 6).alias("reward"), "action", "data_id", "name", "eval_type", "seed")


@query(f"WITH {LOGGED} SELECT env_id::INT AS env_id, count(*) AS n, round(sum(reward), 6) AS total FROM logged GROUP BY 1")
def s14_k3_save_and_load(spark, d):
    """Half of the environments are saved first, the rest is added by the second call, the third has nothing to do."""
    path, rows = _path(spark, "saved"), data.logged(spark, d)
    envs = rows.select("env_id").distinct().withColumn("name", F.concat(F.lit("e"), F.col("env_id").cast("string")))
    half = envs.filter("env_id < 5")
    done = [store.save(half, rows.join(half.select("env_id"), "env_id", "left_semi"), path), store.save(envs, rows, path), store.save(envs, rows, path)]
    if done != ["written", "added", "kept"]:
        raise AssertionError(done)
    return store.load(spark, path)[1].groupBy("env_id").agg(F.count("*").alias("n"), F.round(F.sum("reward"), 6).alias("total"))


@query(f"WITH {FACTS} SELECT environment_id, learner_id, count(*) AS n FROM ints GROUP BY ALL")
def k4_k6_reduced_export(spark, d):
    ints = store.cache(data.events_result(spark, d).interactions)
    reduced = ints.groupBy("environment_id", "learner_id").agg(F.count("*").alias("n"))
    rows = store.to_dicts(reduced)
    ints.unpersist()
    return spark.createDataFrame(rows, reduced.schema)


@query("SELECT 'rows given to a function' AS what, count(*) AS n FROM customer UNION ALL SELECT 'in a list', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'given to none', 0")
def k5_sinks(spark, d):
    """A function on the executors, a list of a reduced result, and no sink at all."""
    customers, seen = table(spark, d, "customer"), spark.sparkContext.accumulator(0)
    store.for_each(customers, lambda row: seen.add(1))
    store.discard(customers)
    rows = [("rows given to a function", seen.value), ("in a list", len(store.to_dicts(customers.select("c_mktsegment").distinct()))), ("given to none", 0)]
    return spark.createDataFrame(rows, "what string, n long")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def d9_python_sink(spark, d):
    """Orders through a sink written in Python, and read back."""
    path = _path(spark, "sink")

    def lines(frames):
        for f in frames:
            for key, priority in zip(f["o_orderkey"].tolist(), f["o_orderpriority"]):
                yield json.dumps({"o_orderkey": key, "o_orderpriority": priority})

    write_made(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, lines)
    return spark.read.schema("o_orderkey bigint, o_orderpriority string").json(path)
