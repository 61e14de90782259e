import pytest
from pyspark.sql import functions as F

from banditframe.functions import rand
from banditframe.operators import features, fit, ope, policy, profile, reshape


def vals(df, c="context"):
    return [r[c] for r in df.orderBy("idx").collect()]


def test_scale_scalar_with_null(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 1.0), (0, 2, 2.0)], "env_id int, idx long, context double")
    assert vals(fit.scale(df, "min", "minmax")) == [None, 0.0, 1.0]
    sparse = df.select("env_id", "idx", F.create_map(F.lit("a"), F.lit(1.0)).alias("context"))
    with pytest.raises(ValueError, match="shifted"):
        fit.scale(sparse, "min", "minmax")


def test_impute_with_flags(spark):
    df = spark.createDataFrame([(0, 0, [7.0, 2.0]), (0, 1, [8.0, None]), (0, 2, [None, 3.0])], "env_id int, idx long, context array<double>")
    assert vals(fit.impute(df, "mean")) == [[7, 2, 0, 0], [8, 2.5, 0, 1], [7.5, 3, 1, 0]]


def test_cycle_onehot(spark):
    acts = [[1, 0], [0, 1]]
    df = spark.createDataFrame([(0, 0, acts, [1.0, 3.0]), (0, 1, acts, [1.0, 4.0]), (0, 2, acts, [1.0, 5.0])], "env_id int, idx long, actions array<array<int>>, rewards array<double>")
    assert vals(reshape.cycle(df), "rewards") == [[3, 1], [4, 1], [5, 1]]
    numbers = df.withColumn("actions", F.array(F.lit(1), F.lit(2)))
    assert vals(reshape.cycle(numbers), "rewards") == [[1, 3], [1, 4], [1, 5]]


def test_sparse_from_dense(spark):
    got = spark.range(1).select(features.sparse(F.array(F.lit(1), F.lit(2), F.lit(3)), "array<int>")).first()[0]
    assert got == {"0": 1, "1": 2, "2": 3}


def test_dense_by_hashing(spark):
    rows = [({"a": 1},), ({"b": 2},), ({"c": 3},), ({"c": 1, "d": 4},)]
    got = [r[0] for r in spark.createDataFrame(rows, "m map<string,int>").select(features.dense_hashed(F.col("m"), 2)).collect()]
    assert got == [[0, 1], [0, 2], [0, 3], [4, 1]]


def test_inverse_propensity(spark):
    df = spark.createDataFrame([(0, 0, 1, [1, 2], 1.0, 0.5), (0, 1, 2, [1, 2], 0.25, 0.25)], "env_id int, idx long, action int, actions array<int>, reward double, probability double")
    assert vals(ope.ips_rewards(df), "rewards") == [[2, 0], [0, 1]]


def test_grounded_checks(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0])], "env_id int, idx long, rewards array<double>")
    for args in ((10, 20, 5, 2), (10, 5, 5, 10), (10.5, 5, 5, 2)):
        with pytest.raises(ValueError):
            reshape.grounded(df, *args)


def test_rejection_with_estimates(spark):
    df = spark.createDataFrame([(0, i, 1, [2, 5, 8], 2, 5.0, 0.25, s) for i, s in enumerate((0.05, 0.25, 0.05))], "env_id int, idx long, context int, actions array<int>, action int, reward double, probability double, s double")
    rows = df.withColumn("pmf", F.array("s", (1 - F.col("s")) / 2, (1 - F.col("s")) / 2))
    got = ope.rejection(rows, c=1.0, ope=True, seed=2).collect()
    assert [r["eval_reward"] for r in got] == [3.0]


def riffled(n, spacing, seed):
    s, out = seed, list(range(n))
    for i in range(n // (spacing + 1)):
        s = (116646453 * s + 9) % 2**30
        out.insert(i * spacing + int((spacing + 1) * (s / 2**30)), out.pop())
    return out


@pytest.mark.parametrize("spacing,seed", [(2, 1), (3, 1), (3, 9), (5, 4)])
def test_riffle(spark, spacing, seed):
    df = spark.range(90).select(F.lit(0).alias("env_id"), F.col("id").alias("idx"), F.col("id").alias("was"))
    assert vals(reshape.riffle(df, spacing, seed), "was") == riffled(90, spacing, seed)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 2).cast("int").alias("env_id"), F.floor(F.col("id") / 2).alias("idx"), F.col("id").alias("was"))
    for f in (lambda x: reshape.shuffle(x, 4), lambda x: reshape.reservoir(x, 20, 4)):
        a, b = (sorted(tuple(r) for r in f(x).select("env_id", "idx", "was").collect()) for x in (df, df.repartition(13)))
        assert a == b
    assert reshape.reservoir(df, 300, strict=True).count() == 0
    assert reshape.reservoir(df, 300).count() == 500


def test_batches_round_trip(spark):
    df = spark.range(10).select(F.lit(0).alias("env_id"), F.col("id").alias("idx"), (F.col("id") * 2).alias("x"))
    b = reshape.batch(df, 4)
    assert sorted(len(r["x"]) for r in b.collect()) == [2, 4, 4]
    assert vals(reshape.unbatch(b), "x") == vals(df, "x")


def test_linear_policies(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(0, i, ["a", "b"], str(rng.choice(["a", "b"])), float(rng.random()), [[1.0, float(c), 0.0], [0.0, float(c), 1.0]]) for i, c in enumerate(rng.random(12))]
    df = spark.createDataFrame(rows, "env_id int, idx long, actions array<string>, action string, reward double, x array<array<double>>")
    for kind, alpha in (("ucb", 0.7), ("ts", 0.0)):
        got = vals(policy.linear(df, 2, kind=kind, alpha=alpha, block=1), "pmf")
        a, b = np.eye(3), np.zeros(3)
        for (_, _, acts, act, r, xs), pmf in zip(rows, got):
            inv = np.linalg.inv(a)
            v = [round(float(np.dot(x, inv @ b) + (alpha * np.sqrt(np.array(x) @ inv @ np.array(x)) if kind == "ucb" else 0)), 9 if kind == "ucb" else 5) for x in xs]
            best = [x == max(v) for x in v]
            assert pmf == [t / sum(best) for t in best]
            x = np.array(xs[acts.index(act)])
            a, b = a + np.outer(x, x), b + r * x


def test_fixed_policy_checks():
    with pytest.raises(ValueError):
        policy.fixed([0.5, 0.6])
    with pytest.raises(ValueError):
        policy.fixed([1.5, -0.5])


def test_required_columns(spark):
    with pytest.raises(ValueError, match="rewards"):
        ope.on_policy(spark.createDataFrame([(0, 0, ["a"])], "env_id int, idx long, actions array<string>"))


def test_adaptive_rejection_accepts_what_it_should(spark):
    df = spark.range(2000).select(F.lit(0).alias("env_id"), F.col("id").alias("idx"), F.lit(1).alias("context"), F.array(F.lit("a"), F.lit("b")).alias("actions"), F.when(rand.u(3, F.col("id") + 1) < 0.5, "a").otherwise("b").alias("action"), F.lit(1.0).alias("reward"), F.lit(0.5).alias("probability"))
    got = ope.rejection_adaptive(df.withColumn("pmf", policy.fixed([0.9, 0.1])), cpct=0.0, block=500, seed=8)
    share = got.filter("action = 'a'").count() / got.count()
    assert abs(share - 0.9) < 0.05


def test_profile_counts(spark):
    df = spark.createDataFrame([([1.0, 2.0], "A"), ([3.0, 4.0], "B")] * 10, "x array<double>, y string")
    row = profile.labels(df).first()
    assert (row["class_count"], row["class_imbalance_ratio"], row["class_entropy"]) == (2, 0.0, 1.0)
    assert profile.volume_overlap(profile.long_form(df)).first()[0] == 0.0


def test_lookup_slots_wrap(spark):
    df = spark.createDataFrame([(0, {"a": 1.0, "b": 2.0}), (1, {"c": 3.0})], "i long, m map<string,double>")
    known = {r["key"]: r["slot"] for r in features.slots(df, "m", 2, ["i"]).collect()}
    assert known["a"] != known["b"] and known["c"] == known["a"]


def test_direct_method_crosses_and_folds(spark):
    """Predictions of crosses are those of a plain least squares, with each fold's model from the others."""
    import numpy as np

    from banditframe.operators import ope

    rng = np.random.default_rng(2)
    rows = [(1, i, [float(a), float(b)], ["u", "v"], "uv"[int(k)], float(r), float(p)) for i, (a, b, k, r, p) in enumerate(zip(rng.normal(size=80), rng.normal(size=80), rng.integers(0, 2, 80), rng.normal(size=80), rng.uniform(0.2, 1, 80)))]
    df = spark.createDataFrame(rows, "env_id int, idx long, context array<double>, actions array<string>, action string, reward double, probability double")
    fold = {r["idx"]: r["f"] for r in df.select("idx", F.pmod(F.xxhash64("env_id", "idx"), F.lit(2)).alias("f")).collect()}

    def cells(x, k):
        on = [float(k == 0), float(k == 1)]
        square = [x[0] * x[0], x[0] * x[1], x[1] * x[1]]
        return [1.0, *on, *(v * o for v in x for o in on), *(v * o for v in square for o in on)]

    for folds in (1, 2):
        got = {r["idx"]: r["rewards"] for r in ope.direct_method(df, ["u", "v"], folds=folds).collect()}
        for f in range(folds):
            used = [r for r in rows if folds == 1 or fold[r[1]] != f]
            w = np.sqrt([1 / r[6] for r in used])
            X, y = np.array([cells(r[2], "uv".index(r[4])) for r in used]), np.array([r[5] for r in used])
            beta = np.linalg.lstsq(X * w[:, None], y * w, rcond=None)[0]
            for r in rows:
                if folds == 1 or fold[r[1]] == f:
                    assert got[r[1]] == pytest.approx([float(np.dot(cells(r[2], k), beta)) for k in range(2)], abs=1e-6)
    with pytest.raises(ValueError, match="no rewards"):
        ope.direct_method(df.limit(0), ["u", "v"])


def test_sparse_fits_by_cell(spark):
    """Repeated rows, null and empty maps, features of one environment only."""
    rows = [(1, 0, {"a": 2.0, "b": None}), (1, 0, {"a": 2.0, "b": None}), (1, 1, {"a": 4.0, "b": 6.0}), (2, 0, {"a": 10.0}), (2, 1, {}), (2, 2, None), (None, 0, {"a": 1.0})]
    df = spark.createDataFrame(rows, "env_id int, idx long, context map<string,double>")
    got = sorted(((r["env_id"] or 0, r["idx"], sorted(({"none": 0} if r["context"] is None else r["context"]).items())) for r in fit.impute(df).collect()), key=str)
    filled = [("a", 2.0), ("b", 6.0), ("b_is_missing", 1.0)]
    assert got == sorted([(1, 0, filled), (1, 0, filled), (1, 1, [("a", 4.0), ("b", 6.0), ("b_is_missing", 0.0)]), (2, 0, [("a", 10.0)]), (2, 1, []), (2, 2, [("none", 0)]), (0, 0, [("a", 1.0)])], key=str)
    scaled = sorted(((r["env_id"] or 0, r["idx"], sorted(({"none": 0} if r["context"] is None else r["context"]).items())) for r in fit.scale(df.filter("env_id = 2"), 0, "maxabs").collect()), key=str)
    assert scaled == [(2, 0, [("a", 1.0)]), (2, 1, []), (2, 2, [("none", 0)])]


def test_sparse_vectors_over_a_dictionary(spark):
    from banditframe.operators import profile

    df = spark.createDataFrame([(1, {"x": 1.0, "b": 0.0}), (2, {"a": 2.0, "x": 3.0}), (3, None), (4, {})], "id long, m map<string,double>")
    known, out = profile.indexed(df, "m", "id")
    assert {tuple(r) for r in known.collect()} == {("a", 0), ("x", 1)}
    assert {r["id"]: (r["x"]["size"], r["x"]["indices"], r["x"]["values"]) for r in out.collect()} == {1: (2, [1], [1.0]), 2: (2, [0, 1], [2.0, 3.0]), 3: (2, [], []), 4: (2, [], [])}


def test_naive_bayes_of_odd_rows(spark):
    from banditframe.operators import profile

    rows = [(k % 3, [float(k % 2) * 5 + (k % 7) / 10, 1.0], k % 2) for k in range(60)] + [(0, None, 1), (1, [None, 1.0], 0), (2, [5.0, 1.0], None), (9, [5.2, 1.0], 1)]
    df = spark.createDataFrame(rows, "fold int, x array<double>, y int")
    got = profile.naive_bayes(df).collect()
    assert all(r["predicted"] is None if r["x"] is None or None in r["x"] else r["predicted"] == (r["x"][0] > 3) for r in got) and len(got) == len(rows)
    assert tuple(profile.scores(profile.naive_bayes(df.filter("y is not null and fold < 3").limit(60))).first()) == (1.0, 1.0)
    assert profile.naive_bayes(df.limit(0)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bins_are_made_beside_the_cells(spark):
    rows = spark.createDataFrame([([float(k), float(k % 3)], "ab"[k % 2]) for k in range(50)], "x array<double>, y string")
    made = plan(profile.binned(profile.long_form(rows), 100))
    assert "BuildRight" in made and "BuildLeft" not in made and "Exchange hashpartitioning(f" not in made


def test_values_do_not_meet_by_key_to_be_ranked(spark):
    """With bins over few keys, no side of a percentile's joins is an aggregate of unknown size."""
    from banditframe.plans.ranks import percentiles

    rows = spark.createDataFrame([(k % 2, float(k)) for k in range(50)], "f int, v double")
    made = percentiles(rows, ["f"], "v", [0.5])
    assert "cut-" in plan(made).split("Join", 1)[1].split("BroadcastExchange", 1)[1] and "HashAggregate" not in plan(made).split("BroadcastExchange", 1)[1]
    assert sorted((r["f"], r["p"][0]) for r in made.collect()) == [(0, 24.0), (1, 25.0)]


def test_cells_stay_where_they_are_for_class_pairs(spark):
    rows = spark.createDataFrame([([float(k), float(k % 3)], "abc"[k % 3]) for k in range(50)], "x array<double>, y string")
    made = plan(profile.single_feature_efficiency(profile.long_form(rows)))
    assert "BuildRight" in made and "BuildLeft" not in made and "SortMergeJoin" not in made and "Exchange hashpartitioning(f" not in made
    dense = rows.select(F.lit(0).alias("env_id"), F.lit(0).alias("idx"), F.col("x").alias("context"))
    made = plan(fit.scale(dense, "mean", "std"))
    assert "SortMergeJoin" not in made


def test_scaled_numbers_are_divided_and_rounded_as_in_sql(spark):
    from banditframe.plans.data import rounded

    xs = [-1e-9, 1e-9, 0.0, -0.0, -0.00015, 1.00005, 2.5e20, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(rounded(F.col("x"), 4)).collect()]
    assert [str(x) for x in got] == ["-0.0", "0.0", "0.0", "-0.0", "-0.0001", "1.0001", "2.5e+20", "nan", "None"]
    df = spark.createDataFrame([(0, k, float(k)) for k in (0, 5, 49)], "env_id int, idx long, context double")
    assert vals(fit.scale(df, "min", "minmax")) == [0.0, 5 / 49, 1.0] and 5 / 49 != 5 * (1 / 49)


def test_sparse_vectors_compute_their_maps_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id long, w string").groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", F.lit(1.0))))).alias("m"))
    _, out = profile.indexed(df, "m", "id")
    assert "ExistingRDD" not in plan(out) and "LocalTableScan" not in plan(out)
    assert {r["id"]: r["x"]["indices"] for r in out.collect()} == {1: [0, 1], 2: []}
