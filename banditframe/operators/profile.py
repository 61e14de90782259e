"""The profile of a supervised data set: counts, entropies, shapes and simple models of its features and labels.

All of it is aggregation over (row, feature, value, label) rows; distinct values of binned features and labels are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.plans.index import with_index
from banditframe.plans.ranks import percentiles
from banditframe.plans.tables import cut


def long_form(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(f, v, y): a row for each cell."""
    return df.select(F.posexplode(x).alias("f", "v"), F.col(y).alias("y")).withColumn("v", F.col("v").cast("double"))


def dense(df: DataFrame, m: str, y: str = "y") -> DataFrame:
    """Maps as arrays over the union of their keys, absent keys 0."""
    names = df.select(F.explode(F.map_keys(m)).alias("k")).distinct().agg(F.sort_array(F.collect_list("k")).alias("k")).scalar()
    rows = df.withColumn("__k", names)
    return rows.select(F.transform("__k", lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0)).cast("double")).alias("x"), y)


def indexed(df: DataFrame, m: str, id_: str) -> tuple[DataFrame, DataFrame]:
    """Maps as sparse vectors over the union of their keys, of any number: the dictionary (key, f), numbered by key over a range
    partitioning, and (id, x: size, indices, values) for each row. Cells meet the dictionary in a join, so no task or row holds it. Zeros
    and nulls are left out; ids are not repeated. df is computed once: a row without cells is kept as one without a key."""
    cells = cut(df.select(id_, F.explode_outer(m).alias("key", "v")).withColumn("v", F.col("v").cast("double")))
    known = cut(with_index(cells.filter("v <> 0").select("key").distinct(), [], ["key"], "f"))
    n = known.count()
    found = cells.join(known, (cells["key"] == known["key"]) & (cells["v"] != 0), "left")
    full = found.groupBy(id_).agg(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "v")))).alias("c"))
    return known, full.select(id_, F.struct(F.lit(n).cast("long").alias("size"), F.col("c")["f"].alias("indices"), F.col("c")["v"].alias("values")).alias("x"))


def binned(cells: DataFrame, n: int) -> DataFrame:
    """cells with bin: values cut at the 5th and 95th percentile and rounded to one of about n / 10 steps. The percentiles are written,
    so the join has a side that is known to be small: neither are cells sent to the driver nor do those of a feature meet in one task."""
    ends = cut(percentiles(cells, ["f"], "v", [0.05, 0.95], "__p"))
    steps = n / 10 - 1
    width = F.col("__p")[1] - F.col("__p")[0]
    at = steps * (F.col("v") - F.col("__p")[0]) / F.when(width == 0, 1.0).otherwise(width)
    return cells.join(ends, "f").withColumn("bin", F.bround(at, 0)).drop("__p")


def _entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, h, levels) of count rows, in bits."""
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("__t"), F.sum(F.col(n) * F.log2(F.col(n))).alias("__s"), F.count("*").alias("levels"))
    return totals.select(*keys, (F.log2("__t") - F.col("__s") / F.col("__t")).alias("h"), "levels")


def _share(h: Column, levels: Column) -> Column:
    return h / F.when(levels > 1, F.log2(levels.cast("double"))).otherwise(1.0)


def labels(df: DataFrame, y: str = "y") -> DataFrame:
    """One row: class_count, class_entropy, class_entropy_n, class_imbalance_ratio."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    one = counts.agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n"))).alias("s"), F.collect_list("n").alias("c"))
    h = F.log2("t") - F.col("s") / F.col("t")
    odds = F.aggregate("c", F.lit(0.0), lambda a, n: a + F.try_divide(n.cast("double"), (F.col("t") - n).cast("double")))
    ratio = (F.col("k") - 1) / F.col("k") * odds
    return one.select(F.col("k").alias("class_count"), h.alias("class_entropy"), _share(h, F.col("k")).alias("class_entropy_n"), F.when(F.col("k") == 1, 1.0).otherwise(1 - F.try_divide(F.lit(1.0), ratio)).alias("class_imbalance_ratio"))


def information(cells: DataFrame) -> DataFrame:
    """(f, hx, hx_n, hxy, hxy_n, mi, levels) of binned cells."""
    xy = cut(cells.groupBy("f", "bin", "y").agg(F.count("*").alias("n")))
    hxy = _entropy(xy, ["f"]).select("f", F.col("h").alias("hxy"), F.col("levels").alias("lxy"))
    hx = _entropy(xy.groupBy("f", "bin").agg(F.sum("n").alias("n")), ["f"]).select("f", F.col("h").alias("hx"), "levels")
    hy = _entropy(xy.groupBy("f", "y").agg(F.sum("n").alias("n")), ["f"]).select("f", F.col("h").alias("hy"))
    all_ = hx.join(hxy, "f").join(hy, "f")
    return all_.select("f", "hx", _share(F.col("hx"), F.col("levels")).alias("hx_n"), "hxy", _share(F.col("hxy"), F.col("lxy")).alias("hxy_n"), (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"), "hy", "levels")


def information_summary(info: DataFrame) -> DataFrame:
    """One row: counts of numeric and two-valued features, means of entropies and mutual information, the two largest."""
    mi = F.avg("mi")
    top = F.sort_array(F.collect_list("mi"), asc=False)
    return info.agg(
        F.count_if(F.col("levels") != 2).alias("feature_numeric_count"),
        F.count_if(F.col("levels") == 2).alias("feature_onehot_count"),
        F.avg("hx").alias("feature_entropy_mean"),
        F.avg("hx_n").alias("feature_entropy_mean_n"),
        F.avg("hxy").alias("joint_entropy_mean"),
        F.avg("hxy_n").alias("joint_entropy_mean_n"),
        mi.alias("mutual_info_mean"),
        F.get(top, F.lit(0)).alias("mutual_info_rank1"),
        F.get(top, F.lit(1)).alias("mutual_info_rank2"),
        F.try_divide(F.max("hy"), mi).alias("equivalent_num_attr"),
        F.try_divide(F.avg("hx") - mi, mi).alias("noise_signal_ratio"),
    )


def fisher(cells: DataFrame) -> DataFrame:
    """One row: 1 / (1 + the largest ratio of between-class to within-class spread)."""
    groups = cells.groupBy("f", "y").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("ss"))
    whole = groups.groupBy("f").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    ratio = groups.join(whole, "f").groupBy("f").agg(F.try_divide(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)), F.sum("ss")).alias("r"))
    return ratio.agg((1 / (1 + F.max("r"))).alias("max_fisher_discrim"))


def _pairs(cells: DataFrame) -> DataFrame:
    """(f, y1, y2, low, high, all_low, all_high): overlap and range of each feature for each pair of classes. Classes are few;
    pairs are of classes, not of rows."""
    ends = cells.groupBy("f", "y").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    a = ends.select("f", F.col("y").alias("y1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = ends.select("f", F.col("y").alias("y2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = a.join(b, "f").filter("y1 < y2")
    return both.select("f", "y1", "y2", F.greatest("lo1", "lo2").alias("low"), F.least("hi1", "hi2").alias("high"), F.least("lo1", "lo2").alias("all_low"), F.greatest("hi1", "hi2").alias("all_high"))


def volume_overlap(cells: DataFrame) -> DataFrame:
    """One row: the mean over class pairs of the product over features of overlap / range."""
    pairs = _pairs(cells).filter("all_high > all_low")
    part = F.greatest(F.col("high") - F.col("low"), F.lit(0.0)) / (F.col("all_high") - F.col("all_low"))
    return pairs.groupBy("y1", "y2").agg(F.product(part).alias("v")).agg(F.avg("v").alias("volume_overlapping"))


def single_feature_efficiency(cells: DataFrame) -> DataFrame:
    """One row: the mean over class pairs of the least share of rows, over features, inside the overlap. The pairs are written, so that
    their size is known and cells need not meet them by feature and class."""
    pairs = _pairs(cells)
    sides = cut(pairs.select("f", "y1", "y2", "low", "high", F.explode(F.array("y1", "y2")).alias("y")))
    hit = cells.join(sides, ["f", "y"]).groupBy("y1", "y2", "f").agg(F.avg(F.col("v").between(F.col("low"), F.col("high")).cast("double")).alias("share"))
    return hit.groupBy("y1", "y2").agg(F.min("share").alias("s")).agg(F.avg("s").alias("max_single_feature_eff"))


def nonzero(df: DataFrame, x: str = "x") -> DataFrame:
    return df.agg(F.avg(F.size(F.filter(x, lambda v: v != 0)) / F.size(x)).alias("percent_nonzero_feat"))


def principal(df: DataFrame, k: int, x: str = "x") -> DataFrame:
    """One row: the first three shares of variance, and how many components hold 95 % of it. k is the features' width; the model
    is a matrix of that size, made by aggregation."""
    model = PCA(k=k, inputCol="v", outputCol="p").fit(df.select(array_to_vector(F.col(x).cast("array<double>")).alias("v")))
    shares = [float(s) for s in model.explainedVariance]
    total, dims = 0.0, 0
    for s in shares:
        dims += 1
        total += s
        if total >= 0.95:
            break
    row = tuple([*shares[:3], *[None] * (3 - len(shares[:3])), dims])
    return df.sparkSession.createDataFrame([row], "pca_top_1_pct double, pca_top_2_pct double, pca_top_3_pct double, pca_dims_95 int")


def landmarks(df: DataFrame, x: str = "x", y: str = "y", id_: str = "id", folds: int = 5) -> DataFrame:
    """(model, f1, accuracy): mean scores over folds of Gaussian naive Bayes, fifty stumps, and one entropy stump."""
    rows = StringIndexer(inputCol=y, outputCol="label", handleInvalid="skip").fit(df).transform(df)
    rows = cut(rows.select(F.col(x).cast("array<double>").alias("x"), "label", F.pmod(F.xxhash64(id_), F.lit(folds)).alias("fold"))).withColumn("features", array_to_vector("x"))
    bayes = scores(naive_bayes(rows.drop("features"), "x", "label"), "label").first()
    models = {
        "average_node": RandomForestClassifier(maxDepth=1, numTrees=50, impurity="entropy", seed=1),
        "best_node": DecisionTreeClassifier(maxDepth=1, impurity="entropy", seed=1),
    }
    out = [("naive_bayes", bayes["f1"], bayes["accuracy"])]
    for name, model in models.items():
        got = []
        for f in range(folds):
            made = model.fit(rows.filter(F.col("fold") != f)).transform(rows.filter(F.col("fold") == f))
            got.append([MulticlassClassificationEvaluator(metricName=m).evaluate(made) for m in ("f1", "accuracy")])
        out.append((name, *[float(sum(s) / folds) for s in zip(*got)]))
    return df.sparkSession.createDataFrame(out, "model string, f1 double, accuracy double")


def naive_bayes(df: DataFrame, x: str = "x", y: str = "y", fold: str = "fold") -> DataFrame:
    """df with `predicted`, by Gaussian naive Bayes of the other folds: counts, sums and squares of each fold, label and feature come from
    one pass, and a fold's model from all but its own. What is gathered is as large as folds, labels and features are many; labels
    are whole numbers, and of equal ones the least wins. Rows with a null feature or label teach nothing and get null."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(["f", "y"]):
                v = np.stack(part["x"].to_numpy())
                own = np.stack([np.full(v.shape[1], float(len(v))), v.sum(axis=0), (v * v).sum(axis=0)])
                at[key] = at[key] + own if key in at else own
        for (f, label), m in at.items():
            yield pd.DataFrame({"f": f, "y": label, "k": np.arange(m.shape[1]), "n": m[0], "s": m[1], "q": m[2]})

    whole = F.col(x).cast("array<double>")
    usable = F.col(y).isNotNull() & F.coalesce(~F.exists(x, lambda v: v.isNull()), F.lit(False))
    rows = df.filter(usable).select(F.col(fold).cast("long").alias("f"), F.col(y).cast("long").alias("y"), whole.alias("x"))
    got = rows.mapInPandas(summed, "f long, y long, k int, n double, s double, q double").groupBy("f", "y", "k").agg(*[F.sum(c).alias(c) for c in "nsq"]).toPandas()
    labels_, width = np.sort(got["y"].unique()), int(got["k"].max()) + 1 if len(got) else 0
    sums: dict[int, np.ndarray] = {}
    for f, part in got.groupby("f"):
        m = sums[int(f)] = np.zeros((3, len(labels_), width))
        m[:, np.searchsorted(labels_, part["y"]), part["k"]] = part[["n", "s", "q"]].to_numpy().T
    all_ = sum(sums.values())

    def model(f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, s, q = all_ - sums[f] if f in sums else all_
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            spread = q / n - mean * mean
            total = q.sum(axis=0) / n.sum(axis=0) - (s.sum(axis=0) / n.sum(axis=0)) ** 2
            return np.log(n[:, 0] / n[:, 0].sum()), mean, np.maximum(spread, 1e-9 * np.nanmax(total, initial=0))

    @F.pandas_udf("long")
    def predicted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[int, tuple] = {}
        for xs, fs in batches:
            out: list = []
            for v, f in zip(xs, fs):
                if v is None or not len(labels_) or np.isnan(v := np.asarray(v, float)).any():
                    out.append(None)
                    continue
                if f not in known:
                    known[f] = model(f)
                prior, mean, spread = known[f]
                z = prior - 0.5 * (np.log(2 * np.pi * spread) + (v - mean) ** 2 / spread).sum(axis=1)
                out.append(int(labels_[np.nanargmax(z)]))
            yield pd.Series(out, dtype="Int64")

    return df.withColumn("predicted", predicted(whole, F.col(fold).cast("long")))


def scores(df: DataFrame, y: str = "y", fold: str = "fold") -> DataFrame:
    """One row: accuracy, and f1 weighted by how often a label is, both as means over folds of rows with `predicted`."""
    cells = df.groupBy(fold, F.col(y).alias("y"), "predicted").agg(F.count("*").alias("n"))
    both = cells.select(fold, F.explode(F.array(F.struct(F.col("y").cast("long").alias("l"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("l"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("c")).select(fold, "c.*")
    each = both.groupBy(fold, "l").agg(*[F.sum(c).alias(c) for c in ("is", "said", "hit")])
    own = each.groupBy(fold).agg((F.sum("hit") / F.sum("is")).alias("accuracy"), (F.sum(F.col("is") * 2 * F.col("hit") / (F.col("is") + F.col("said"))) / F.sum("is")).alias("f1"))
    return own.agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"))


def ranked(info: DataFrame, n: int = 2) -> DataFrame:
    """The features of largest mutual information."""
    return info.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mi").desc(), "f"))).filter(F.col("rank") <= n).select("rank", "f", "mi")
