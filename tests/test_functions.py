import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from banditframe.functions import encoders, rand, rewards, stats


def stream(seed, n):
    s, out = seed, []
    for _ in range(n):
        s = (116646453 * s + 9) % 2**30
        out.append(s / 2**30)
    return out


def test_draws_follow_the_sequence(spark):
    got = [r[0] for r in spark.range(1, 501).select(rand.u(7, F.col("id"))).collect()]
    assert got == stream(7, 500)
    assert spark.range(1).select(rand.u(1, 1)).first()[0] == pytest.approx(0.10863548, abs=1e-8)
    state = [r[0] for r in spark.range(1, 21).select(rand.state(7, F.col("id"))).collect()]
    assert [s / 2**30 for s in state] == stream(7, 20)


def test_text_seed():
    assert rand.seed_of("abc") == int.from_bytes(b"abc", "big") % 2**20
    assert rand.seed_of(3.0) == 3


def test_gauss_pairs(spark):
    us = stream(5, 4)
    want = []
    for a, b in ((us[0], us[1]), (us[2], us[3])):
        r = math.sqrt(-2 * math.log(a))
        want += [r * math.cos(2 * math.pi * b), r * math.sin(2 * math.pi * b)]
    assert [r[0] for r in spark.range(4).select(rand.gauss(5, F.col("id"))).collect()] == pytest.approx(want)


def test_choice_with_zero_weights_is_an_error(spark):
    with pytest.raises(Exception, match="greater than zero"):
        spark.range(1).select(rand.choice(1, F.col("id") + 1, F.array(F.lit("a")), F.array(F.lit(0.0)))).collect()


def test_rewards(spark):
    df = spark.createDataFrame([(1,)], "a int")
    lab = F.array(F.lit("a"), F.lit("b"))
    row = df.select(rewards.l1(F.lit(3.0), F.lit(1.0)), rewards.binary(F.lit("x"), F.lit("y")), rewards.hamming(lab, F.array(F.lit("a"), F.lit("a"), F.lit("c"))), rewards.discrete(F.array(F.lit(5), F.lit(6)), F.array(F.lit(0.5), F.lit(0.7)), F.lit(6)), rewards.discrete(F.array(F.lit(5)), F.array(F.lit(0.5)), F.lit(9), 2.0)).first()
    assert tuple(row) == (-2.0, 0.0, 2 / 3, 0.7, 2.0)
    with pytest.raises(Exception, match="same length"):
        df.select(rewards.discrete(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0.5)), F.lit(1))).collect()


def test_percentiles(spark):
    df = spark.createDataFrame([(3.0, 1.0), (2.0, 1.0), (1.0, 1.0)], "v double, w double")
    assert stats.percentile(df, [], "v", [0, 0.5, 1]).first()[0] == [1, 2, 3] and stats.percentile(df, [], "v", 0.25).first()[0] == 1.5
    assert stats.iqr(df, [], "v").first()[0] == 1.0 and stats.iqr(df.limit(1), [], "v").first()[0] == 0.0
    from banditframe.plans.ranks import percentiles

    many = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"), (F.col("id") % 3 + 1).alias("t")).union(spark.sql("SELECT 0L, CAST(NULL AS DOUBLE), 1L"))
    ps = [0.0, 0.05, 0.5, 0.77, 1.0]
    want = {r["k"]: r["p"] for r in many.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("p")).collect()}
    assert {r["k"]: r["p"] for r in percentiles(many, ["k"], "v", ps).collect()} == {k: pytest.approx(p) for k, p in want.items()}
    often = {r["k"]: r["p"] for r in many.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, ps)), F.col("t")).alias("p")).collect()}
    assert {r["k"]: r["p"] for r in percentiles(many, ["k"], "v", ps, times=F.col("t")).collect()} == {k: pytest.approx(p) for k, p in often.items()}
    assert percentiles(many, [], "v", [0.5]).first()[0] == [many.agg(F.median("v")).first()[0]]
    one = df.withColumn("k", F.lit(1))
    assert stats.weighted_percentile(one, ["k"], "v", "w", 0.25).first()["v"] == pytest.approx(1.5)
    part = spark.createDataFrame([(1, 3.0, 1.0), (1, 2.0, 1.0), (1, 1.0, 0.0)], "k int, v double, w double")
    assert stats.weighted_percentile(part, ["k"], "v", "w", 0.0).first()["v"] == 2.0


def test_intervals(spark):
    df = spark.createDataFrame([(v,) for v in (0, 0, 0, 1, 1, 1)], "v int")
    w = df.agg(*[c.alias(n) for n, c in stats.wilson_ci(F.col("v")).items()]).first()
    assert (w["y"], round(w["y"] - w["lower"], 5), round(w["y"] + w["upper"], 5)) == (0.5, 0.18761, 0.81239) or (round(w["y"] - w["lower"], 4), round(w["y"] + w["upper"], 4)) == (0.1876, 0.8124)
    low, high = stats.clopper_pearson(F.lit(3), F.lit(6))
    got = spark.range(1).select(low, high).first()
    assert tuple(got) == pytest.approx((0.118117, 0.881883), abs=1e-5)
    assert tuple(spark.range(1).select(*stats.clopper_pearson(F.lit(0), F.lit(4))).first())[0] == 0.0
    assert stats.z_of(0.95) == 1.96044921875
    large = spark.createDataFrame([(500_000, 1_000_000), (1_000_000, 1_000_000), (3, 1_000_000)], "k long, n long").select("k", *[c.alias(n) for n, c in zip(("low", "high"), stats.clopper_pearson(F.col("k"), F.col("n")))]).collect()
    assert [(r["low"], r["high"]) for r in large] == [pytest.approx(x, abs=2e-6) for x in ((0.49902, 0.50098), (0.999996, 1.0), (6.2e-7, 8.77e-6))]


def test_beta_quantiles_invert_sums():
    for n, k, p in ((12, 4, 0.3), (40, 39, 0.9), (7, 1, 0.5)):
        tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
        assert float(stats.incomplete_beta(p, k, n - k + 1)) == pytest.approx(tail)


def test_bootstrap_of_equal_values(spark):
    """Rows of two values only: each row has a weight of its own."""
    df = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") % 2).cast("double").alias("y"))
    r = stats.points(df, ["k"], "y", "bs").first()
    assert r["y"] == 0.5 and 0.025 < r["lower"] < 0.037 and 0.025 < r["upper"] < 0.037
    few = stats.points(df.limit(2), ["k"], "y", "bs").first()
    assert (few["lower"], few["upper"]) == (0, 0)
    with pytest.raises(Exception, match="0 and 1"):
        spark.createDataFrame([(2,)], "v int").agg(stats.wilson_ci(F.col("v"))["y"]).collect()


def test_variance_of_one_value_is_nan(spark):
    assert math.isnan(spark.range(1).agg(stats.var(F.col("id"))).first()[0])


def test_bootstrap(spark):
    df = spark.createDataFrame([(1, float(i % 7)) for i in range(60)] + [(2, 1.0), (2, 2.0)], "k int, y double").withColumn("i", F.monotonically_increasing_id())
    got = {r["k"]: r for r in stats.bootstrap_ci(df, ["k"], "y", reps=300).collect()}
    se = df.filter("k = 1").agg(F.stddev_samp("y") / math.sqrt(60)).first()[0]
    assert 1.2 * se < got[1]["lower"] < 3 * se and 1.2 * se < got[1]["upper"] < 3 * se
    assert (got[2]["lower"], got[2]["upper"]) == (0.0, 0.0)
    again = {r["k"]: r for r in stats.bootstrap_ci(df.repartition(5), ["k"], "y", reps=300).collect()}
    assert again[1]["lower"] == pytest.approx(got[1]["lower"])


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 0.99, 1.0])
def test_weighted_percentile_of_many(spark, monkeypatch, p):
    from banditframe.plans import prefix

    monkeypatch.setattr(prefix.running, "__defaults__", (0, 7))  # blocks of 7
    rng = np.random.default_rng(3)
    rows = [(k, float(v), float(w)) for k, n in (("a", 200), ("b", 1), (None, 30)) for v, w in zip(rng.integers(0, 60, n), rng.integers(0, 4, n) + (n == 1))]
    got = {r["k"]: r["v"] for r in stats.weighted_percentile(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", p).collect()}
    for key in ("a", "b", None):
        by = {}
        for k, v, w in rows:
            if k == key and w > 0:
                by[v] = by.get(v, 0) + w
        values = sorted(by)
        c = np.cumsum([by[v] for v in values]) - by[values[0]]
        want = np.interp(p, c / c[-1], values) if len(values) > 1 else values[0]
        assert got[key] == pytest.approx(want)


def test_bootstrap_in_subsets(spark):
    """Many values in subsets of a few: the width is that of all."""
    rows = spark.range(40_000).select((F.col("id") % 2).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003.0).alias("y"))
    for statistic, p, want in ((stats.weighted_mean, None, 0.2887), (stats.weighted_quantile(0.5), F.median, 0.5), (stats.weighted_quantile(0.5), None, 0.5)):
        got = stats.bootstrap_ci(rows, ["k"], "y", reps=200, statistic=statistic, point=p, size=1000).collect()
        for r in got:
            assert abs(r["y"] - 0.5) < 0.02
            for side in ("lower", "upper"):
                assert 0.75 < r[side] / (1.96 * want / math.sqrt(20_000)) < 1.3
    exact = stats.bootstrap_ci(rows.limit(0), ["k"], "y").collect()
    assert exact == []


def test_bootstrap_of_very_many_values(spark):
    """The point is that of all values, not of the subsets that are resampled, and small subsets tell the width, with many ties too."""
    rows = spark.range(240_000).select(F.lit(None).cast("int").alias("k"), (F.pmod(F.xxhash64(F.floor(F.col("id") / 6)), F.lit(100_003)) / 100_003.0).alias("y"))
    want = float(np.median(rows.toPandas()["y"]))
    half = stats.weighted_quantile(0.5)
    for statistic, near in ((half, 1e-12), (lambda v, c: half(v, c), 3e-4)):
        got = stats.bootstrap_ci(rows, ["k"], "y", reps=200, statistic=statistic, size=500).collect()
        assert len(got) == 1 and abs(got[0]["y"] - want) < near
        for side in ("lower", "upper"):
            assert 0.5 < got[0][side] / (1.96 * 0.5 / math.sqrt(240_000)) < 2


def test_statistics_of_weighted_samples():
    values, counts = np.array([1.0, 2.0, 5.0]), np.array([[1, 2, 1], [0, 0, 3], [4, 0, 1]])
    flat = [np.repeat(values, c) for c in counts]
    assert stats.weighted_mean(values, counts) == pytest.approx([x.mean() for x in flat])
    for p in (0.0, 0.25, 0.4, 1.0):
        assert stats.weighted_quantile(p)(values, counts) == pytest.approx([np.quantile(x, p) for x in flat])


def test_normal_has_all_digits(spark):
    xs = [-9.0, -4.1, -4.0, -3.9, -1.0, 0.0, 0.5, 3.99, 4.01, 8.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.normal(F.col("x"))).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([stats.phi(x) for x in xs[:-1]], rel=1e-9, abs=1e-15)


def test_crosses(spark):
    x = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    got = spark.range(1).select(encoders.crosses({"x": (x, 3)}, ["xxx"])).first()[0]
    assert got == [1, 2, 3, 4, 6, 9, 8, 12, 18, 27]
    four = F.array(*[F.lit(float(p)) for p in (2, 3, 5, 7)])
    terms = spark.range(1).select(encoders.crosses({"x": (four, 4)}, ["xxx"])).first()[0]
    assert len(terms) == 20 and len(set(terms)) == 20
    m = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(3.0))
    n = F.create_map(F.lit("z"), F.lit(5.0))
    assert spark.range(1).select(encoders.sparse_crosses({"x": m, "a": n}, [1, 2, "xx", "xa"])).first()[0] == {"const": 3.0, "aa": 4.0, "ab": 6.0, "bb": 9.0, "az": 10.0, "bz": 15.0}


def test_unknown_levels(spark):
    lv = F.array(F.lit("a"), F.lit("b"))
    assert spark.range(1).select(encoders.onehot(F.lit("c"), lv)).first()[0] == [0, 0]
    assert math.isnan(spark.range(1).select(encoders.factor(F.lit("c"), lv)).first()[0])
    for f in (lambda: encoders.categorical(F.lit("c"), lv), lambda: encoders.onehot(F.lit("c"), lv, True)):
        with pytest.raises(Exception, match="unknown value"):
            spark.range(1).select(f()).collect()


def test_crc_is_the_usual_one(spark):
    import zlib

    got = [r[0] for r in spark.createDataFrame([("a",), ("n_chars",)], "k string").select(encoders.bucket(F.col("k"), 16)).collect()]
    assert got == [zlib.crc32(b"a") % 16, zlib.crc32(b"n_chars") % 16]


def test_late_draws_agree_with_the_sequence(spark):
    """Draws after the first 2^20 go on with the stream; they do not begin again."""
    at, want = 7, {}
    for k in range(1, (1 << 20) + 4):
        at = (at * rand.FACTOR + rand.TERM) % rand.MODULUS
        if k <= 3 or k >= 1 << 20:
            want[k] = at
    got = {r["k"]: r["s"] for r in spark.createDataFrame([(k,) for k in want], "k long").select("k", rand.state(7, F.col("k")).alias("s")).collect()}
    assert got == want and got[(1 << 20) + 1] != got[1]
