import json

import pytest

from banditframe.sources import log, store, text


def write(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def test_arff_dense(spark):
    rows = write(spark, ["% weather", "@relation days", "@attribute wind numeric", "@attribute sky {clear, cloudy}", "@attribute rain numeric", "", "@DATA", "7.5,cloudy,?", "0,clear,12"])
    h = text.arff_header(rows)
    assert (h.names, h.levels[1]) == (["wind", "sky", "rain"], ["clear", "cloudy"])
    got = [tuple(r) for r in text.arff_dense(rows, h).collect()]
    assert got == [(7.5, "cloudy", None, True), (0, "clear", 12, False)]
    with pytest.raises(Exception, match="3 cells"):
        text.arff_dense(write(spark, ["7.5,cloudy"]), h).collect()


def test_arff_quotes(spark):
    rows = write(spark, ["@attribute 'full name' string", '@attribute "home town" {"Bad Ems", Ulm}', "@data", "'O\\'Hara, Ann',\"Bad Ems\"", '"Bo",Ulm'])
    h = text.arff_header(rows)
    assert (h.names, h.levels[1]) == (["full name", "home town"], ["Bad Ems", "Ulm"])
    assert [tuple(r)[:2] for r in text.arff_dense(rows, h).collect()] == [("O'Hara, Ann", "Bad Ems"), ("Bo", "Ulm")]
    with pytest.raises(ValueError, match="two attributes"):
        text.ArffHeader(["@attribute wind numeric", "@attribute wind numeric"])


def test_arff_sparse(spark):
    h = text.ArffHeader(["@attribute wind numeric", "@attribute sky {clear,cloudy}", "@attribute rain numeric"], sparse=True)
    assert h.levels[1] == ["0", "clear", "cloudy"]
    got = [r[0] for r in text.arff_sparse(write(spark, ["{0 4.5, 1 cloudy}", "{}", "{2 31}"]), h).collect()]
    assert got == [{"wind": "4.5", "sky": "cloudy"}, {}, {"rain": "31"}]
    with pytest.raises(Exception, match="no attribute"):
        text.arff_sparse(write(spark, ["{9 1}"]), h).collect()


def test_libsvm(spark):
    got = [tuple(r) for r in text.libsvm(write(spark, ["5 3:0.25 8:4", "3:9 4:9", "7,6 12:1.5", ""])).collect()]
    assert got == [({3: 0.25, 8: 4.0}, ["5"]), ({12: 1.5}, ["7", "6"])]


def test_manik_skips_the_first_line_of_each_file(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("2 12 9\n5 3:0.25 8:4\n7 12:1.5\n")
    assert text.read_manik(spark, str(tmp_path)).count() == 4


def test_paths(spark):
    with pytest.raises(ValueError):
        text.open_path(spark, "http://example.com/x")


def test_log_lines(spark):
    lines = ['["version",4]', '["experiment",{}]', '["E",7,{"town":"Ulm"}]', '["E",7,{"size":20}]', '["E",7,{"town":"Ems"}]', '["L",3,{"family":"greedy"}]', '["I",[7,3],{"_packed":{"reward":[0.25,0.75,0.5]}}]']
    r = log.decode(log._line_no(write(spark, lines)))
    assert r.environments.first()["params"] == {"town": "Ems", "size": "20"}
    assert sorted(tuple(x) for x in r.interactions.collect()) == [(7, 3, 0, 1, 0.25), (7, 3, 0, 2, 0.75), (7, 3, 0, 3, 0.5)]
    with pytest.raises(ValueError, match="version"):
        log.decode(log._line_no(write(spark, ['["version",3]'])))


def test_log_of_unknown_columns(spark):
    lines = ['["version",4]', '["I",[1,1,0],{"_packed":{"reward":[0,1],"who":["a",null],"where":[[1,2],[3]],"any":[1,"x"]}}]', '["I",[1,2,0],{"_packed":{"reward":[0.5]}}]']
    got = log.decode(log._line_no(write(spark, lines))).interactions
    assert dict(got.dtypes) | {"any": "", "index": ""} == {"environment_id": "int", "learner_id": "int", "evaluator_id": "int", "index": "", "reward": "double", "who": "string", "where": "array<bigint>", "any": ""}
    rows = sorted((r["learner_id"], r["index"], r["reward"], r["who"], r["where"]) for r in got.collect())
    assert rows == [(1, 1, 0.0, "a", [1, 2]), (1, 2, 1.0, None, [3]), (2, 1, 0.5, None, None)]
    assert log.decode(log._line_no(write(spark, ['["version",4]']))).interactions.count() == 0


def test_long_triples_have_several_lines(spark, tmp_path):
    from pyspark.sql import functions as F

    from banditframe.operators.results import Result

    ids = [spark.createDataFrame([(1,)], f"{n}_id int") for n in ("environment", "learner", "evaluator")]
    facts = lambda n, plus: spark.range(n).select(F.lit(1).alias("environment_id"), (F.col("id") % 2).cast("int").alias("learner_id"), F.lit(0).alias("evaluator_id"), (F.floor(F.col("id") / 2) + 1).cast("long").alias("index"), (F.col("id") + plus).cast("double").alias("reward"))
    log.write(Result(*ids, facts(2000, 0)), str(tmp_path), rows=10)
    lines = [r[0] for r in spark.read.text(str(tmp_path)).collect() if r[0].startswith('["I"')]
    assert len(lines) == 200 and all(len(json.loads(x)[2]["_packed"]["reward"]) == 10 for x in lines)
    key = lambda r: (r["learner_id"], r["index"], r["reward"])
    assert sorted(map(key, log.read(spark, str(tmp_path)).interactions.collect())) == sorted(map(key, facts(2000, 0).collect()))
    # logged again with fewer rows: the old lines do not count any more
    again = Result(*ids, facts(50, 7).filter("learner_id = 1"))
    log.encode(again, restored=True, rows=10).write.mode("append").text(str(tmp_path))
    got = log.read(spark, str(tmp_path)).interactions
    assert sorted(map(key, got.filter("learner_id = 1").collect())) == sorted(map(key, again.interactions.collect()))
    assert got.filter("learner_id = 0").count() == 1000


def test_log_numbers_are_short(spark):
    r = log.decode(log._line_no(write(spark, ['["version",4]', '["I",[0,1,2],{"_packed":{"reward":[0.123456789]}}]'])))
    ints = [json.loads(x["value"]) for x in log.encode(r, restored=True).collect() if x["value"].startswith('["I"')]
    assert ints == [["I", [0, 1, 2], {"_packed": {"reward": [0.12346]}}]]


def test_save_refuses_other_environments(spark, tmp_path):
    envs = spark.createDataFrame([(0, "a")], "env_id int, name string")
    rows = spark.createDataFrame([(0, 0)], "env_id int, idx long")
    assert store.save(envs, rows, str(tmp_path / "s")) == "written"
    other = spark.createDataFrame([(0, "b")], "env_id int, name string")
    with pytest.raises(ValueError, match="other environments"):
        store.save(other, rows, str(tmp_path / "s"))
    assert store.save(other, rows, str(tmp_path / "s"), overwrite=True) == "written"


def test_lines_of_a_users_making(spark, tmp_path):
    """A sink is a function from frames to lines; Spark's committer writes them."""
    from banditframe.sources.python_source import write_made

    def lines(frames):
        for f in frames:
            for a, b in zip(f["id"], f["name"]):
                yield f"{a}:{b}"

    df = spark.createDataFrame([(k, f"n{k}") for k in range(100)], "id long, name string").repartition(3)
    write_made(df, str(tmp_path / "out"), lines)
    write_made(df.limit(0), str(tmp_path / "out"), lines)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(f"{k}:n{k}" for k in range(100))
