import pytest
from pyspark.sql import functions as F

from banditframe.operators import results as R


def result(spark, ints, envs=None, lrns=None, vals=None, env_cols="environment_id int", lrn_cols="learner_id int"):
    facts = spark.createDataFrame(ints, "environment_id int, learner_id int, evaluator_id int, index long, reward double")
    envs = spark.createDataFrame(envs or [(e,) for e in sorted({i[0] for i in ints})], env_cols)
    lrns = spark.createDataFrame(lrns or [(x,) for x in sorted({i[1] for i in ints})], lrn_cols)
    vals = spark.createDataFrame(vals or [(v,) for v in sorted({i[2] for i in ints})], "evaluator_id int")
    return R.Result(envs, lrns, vals, facts)


CURVES = [(e, x, 0, i, float(e + x * i * i)) for e in (3, 5) for x in (4, 6) for i in (1, 2, 3)]


def test_progressive_curves(spark):
    r = result(spark, CURVES, lrns=[(4, "slow"), (6, "fast")], lrn_cols="learner_id int, family string")
    wide = {row["index"]: row.asDict() for row in r.raw_learners(l="full_name", wide=True).collect()}
    for x, name in ((4, "4. slow"), (6, "6. fast")):
        for i in (1, 2, 3):
            assert wide[i][name] == pytest.approx([e + x * sum(k * k for k in range(1, i + 1)) / i for e in (3, 5)])


def test_wide_lists_keep_their_order_and_gaps(spark):
    ints = [(9, 1, 0, 1, 5.0), (2, 1, 0, 1, 8.0), (2, 2, 0, 1, 1.0)]
    r = result(spark, ints, envs=[(9, "a"), (2, "a"), (4, "b")], env_cols="environment_id int, kind string")
    more = result(spark, [*ints, (4, 2, 0, 1, 6.0)], envs=[(9, "a"), (2, "a"), (4, "b")], env_cols="environment_id int, kind string")
    assert [tuple(x) for x in r.raw_learners(x="kind", p=None, wide=True).collect()] == [("a", [8.0, 5.0], [1.0])]
    a, b = more.raw_learners(x="kind", p=None, wide=True).collect()
    assert tuple(a) == ("a", [8.0, 5.0], [1.0]) and b["2"] == [6.0] and str(b["1"]) == "[nan]"


def test_contrast_by_index(spark):
    ints = [(e, x, 0, i, float(x * i + e)) for e in (7, 8) for x in (1, 2) for i in (1, 2)]
    got = sorted(tuple(r) for r in result(spark, ints).raw_contrast(1, 2, x="index").collect())
    assert got == [(1, 8.0, 9.0), (1, 9.0, 10.0), (2, 8.5, 10.0), (2, 9.5, 11.0)]
    with pytest.raises(ValueError, match="both sides"):
        result(spark, ints).raw_contrast(1, [1, 2])


def test_length_filter(spark):
    long = {(5, 2, 3): 3, (5, 6, 3): 4, (8, 2, 3): 2, (8, 9, 4): 1}
    r = result(spark, [(*t, i, 0.5) for t, n in long.items() for i in range(1, n + 1)]).filter_fin(n=3)
    assert [d.count() for d in (r.environments, r.learners, r.evaluators, r.interactions)] == [1, 2, 1, 6]


def test_pairing_finds_nothing(spark):
    r = result(spark, [(5, 2, 3, 1, None), (8, 6, 3, 1, None)]).filter_fin(l="learner_id", p="environment_id")
    assert [d.count() for d in (r.environments, r.learners, r.interactions)] == [0, 0, 0]


def test_pairing_counts_rows(spark):
    ints = [(e, x, 3, 1, None) for e in (5, 8, 9) for x in (2, 6)][:-1]
    r = result(spark, ints, envs=[(5, "k", 1), (8, "k", 2), (9, "l", 1)], env_cols="environment_id int, kind string, seed int")
    assert r.filter_fin(l="learner_id", p="kind").interactions.count() == 0
    assert {tuple(x) for x in r.removed(l="learner_id", p="kind").collect()} == {("too many", 1), ("too few", 1)}


def test_best_of_family(spark):
    ints = [(5, 2, 3, 1, 0.9), (5, 6, 3, 1, 0.2), (8, 2, 3, 1, 0.1), (8, 6, 3, 1, 0.4)]
    r = result(spark, ints, lrns=[(2, "tree"), (6, "tree")], lrn_cols="learner_id int, family string").filter_best("family", "environment_id")
    assert sorted(tuple(x) for x in r.interactions.collect()) == [(5, 2, 3, 1, 0.9), (8, 6, 3, 1, 0.4)]


def test_where(spark):
    df = spark.createDataFrame([(1, "red", "tall"), (2, "red", "small"), (3, "blue", "tall"), (4, "blue", "small")], "id int, colour string, size string")
    assert [r["id"] for r in R.where(df, colour="red", size="small").orderBy("id").collect()] == [1, 2, 4]
    assert [r["id"] for r in R.where(df, id=[1, 2, 3], comparison="!in").collect()] == [4]
    with pytest.raises(ValueError, match="no table"):
        result(spark, CURVES).where(nothing=1)


def plain_mean(v, span=None, weights=None):
    out = []
    for k in range(len(v)):
        if weights == "exp":
            w = [(1 - 2 / (1 + span)) ** (k - j) for j in range(k + 1)]
        else:
            w = [0 if span and j <= k - span else weights[j] if weights else 1 for j in range(k + 1)]
        out.append(sum(a * b for a, b in zip(w, v)) / sum(w))
    return out


@pytest.mark.parametrize("gap", [1, 3])
def test_moving_averages(spark, gap):
    v, w = [4, 1, 0, 7, 3, 3, 9, 2], [1, 2, 1, 3, 5, 1, 1, 2]
    df = spark.createDataFrame([(1, 1, 1, 2 + gap * i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w))], "environment_id int, learner_id int, evaluator_id int, index long, reward double, w double")
    mean = lambda **kw: [r["mean"] for r in R.moving_average(df, "reward", **kw).orderBy("index").collect()]
    for span in (None, 1, 2, 3, 20):
        assert mean(span=span) == pytest.approx(plain_mean(v, span))
        assert mean(span=span, weights="w") == pytest.approx(plain_mean(v, span, w))
    for span in (2, 5, 1000):
        assert mean(span=span, weights="exp") == pytest.approx(plain_mean(v, span, "exp"))


@pytest.mark.parametrize("span", [2, 9, 100, 100_000])
def test_exponential_blocks_agree(spark, span):
    from banditframe.plans.prefix import faded

    v = [float(k % 7) for k in range(300)]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "k int, at long, v double")
    want = plain_mean(v, span, "exp")
    for most in (4, 1 << 14):
        rows = faded(df, ["k"], "at", {"s": F.col("v"), "w": F.lit(1.0)}, 1 - 2 / (1 + span), most)
        assert [r["s"] / r["w"] for r in rows.orderBy("at").collect()] == pytest.approx(want)


def test_blocks_of_running_sums_agree(spark):
    from banditframe.plans.index import with_index
    from banditframe.plans.prefix import running, sliding

    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), F.col("id").cast("double").alias("v")).repartition(7)
    rows = with_index(df, ["k"], ["o"])
    at = {}
    for r in sorted(rows.collect(), key=lambda r: (r["k"], r["o"])):
        assert r["idx"] == at.get(r["k"], 0)
        at[r["k"]] = r["idx"] + 1
    for upto in (0, -1):
        a = {(r["k"], r["idx"]): r["s"] for r in running(rows, ["k"], "idx", {"s": F.col("v")}, upto, 5).collect()}
        b = {(r["k"], r["idx"]): r["s"] for r in running(rows, ["k"], "idx", {"s": F.col("v")}, upto).collect()}
        assert a == b
    a = {(r["k"], r["idx"]): r["m"] for r in sliding(rows, ["k"], "idx", 4, {"m": lambda w: F.avg("v").over(w)}, 5).collect()}
    b = {(r["k"], r["idx"]): r["m"] for r in sliding(rows, ["k"], "idx", 4, {"m": lambda w: F.avg("v").over(w)}).collect()}
    assert a == pytest.approx(b) and len(a) == 200


def test_same_rows_as_often(spark):
    a = spark.createDataFrame([(1, "x", 0.0), (1, "x", 0.0), (2, None, float("nan"))], "i int, s string, v double")
    turned = a.select("v", "s", "i").repartition(3)
    assert R.same_rows(a, turned) and R.same_rows(a.limit(0), a.limit(0))
    assert not R.same_rows(a, a.distinct()) and not R.same_rows(a, a.drop("v")) and not R.same_rows(a, a.limit(2))
    other = spark.createDataFrame([(1, "x", -0.0), (2, None, float("nan")), (2, None, float("nan"))], "i int, s string, v double")
    assert not R.same_rows(a, other) and not R.same_rows(a.limit(2).union(other), a.limit(1).union(other))
    assert R.same_rows(a.filter("i = 1").distinct(), other.filter("i = 1"))
    lists = spark.createDataFrame([([1.0],), ([-0.0],)], "l array<double>")
    assert R.same_rows(lists, spark.createDataFrame([([0.0],), ([1.0],)], "l array<double>"))
    assert tuple(R.differences(a, other).first()) == (1, 1)
    assert R.digest(a) == R.digest(turned) and R.digest(a)["n"] == 3
