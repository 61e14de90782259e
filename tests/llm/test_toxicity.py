"""Toxicity: held-out labels, what labels may reach, and the label model on votes of known accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from banditframe.llm import queries
from banditframe.llm import toxicity as T

HELD = lambda i: F.crc32(i.cast("string")) % 5 == 0


def auc(scores, labels):
    rank = scores.rank()
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    return (rank[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op13_toxicity(spark, sf).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    out = both[both.held_out]
    assert 700 < len(out) < 950
    assert (out.predicted == out.toxic).mean() > 0.975 and auc(out.score, out.toxic) > 0.95
    assert out[out.toxic == 0].predicted.mean() < 0.01 and out[out.toxic == 1].predicted.mean() > 0.85


def test_held_out_labels_teach_nothing(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(HELD(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (T.score(docs, x, HELD).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (99, 1), (4, 0)], "doc_id long, toxic int")
    got = T.score(odd, labels, HELD).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in odd.collect())))
    assert all(0 <= r.score <= 1 for r in got)
    assert T.score(none, labels, HELD).count() == 0
    assert T.score(odd, labels.filter("false")).count() == odd.count()
    held = T.score(odd, labels, lambda i: F.lit(True)).collect()
    assert all(r.held_out and r.score < 0.5 for r in held)


def test_without_labels_the_fixed_voters_speak(spark):
    rows = [(k, f"The report number {k} was fine and we liked reading all of it today") for k in range(60)]
    rows += [(100 + k, f"You are a pathetic idiot, and report number {k} is worthless trash") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in T.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert all(got[i] == (i >= 100) for i, _ in rows)


@pytest.mark.parametrize("word, hit", [("idiots", True), ("1d10t", True), ("Idiot", True), ("idio", False), ("classic", False)])
def test_voters_see_insults(word, hit):
    n, votes, found, _ = T.read(f"so {word} it was", T._Known([]))
    assert n == 4 and (votes[0] == 1) == hit and not found
    assert votes[T.NAMES.index("no_terms")] == (0 if hit else 2)


def test_terms_are_words_and_beginnings():
    known = T._Known(["bomente*", "trash"])
    assert T.read("bomente bomenteja TRASH trash", known)[2:] == ([0, 1], [1, 2])


def test_label_model_knows_accuracies_and_copies(spark, monkeypatch):
    """Voters of known accuracy; three of them are copies of a bad one and must not outvote a good one."""
    rng = np.random.default_rng(5)
    n, right = 6000, [0.95, 0.9, 0.85, 0.6]
    y = (rng.random(n) < 0.3).astype(int)
    votes = np.stack([np.where(rng.random(n) < a, y, 1 - y) for a in right] + [np.zeros(n, int)] * 3, axis=1)
    for k in range(4, 7):
        votes[:, k] = np.where(rng.random(n) < 0.97, votes[:, 3], 1 - votes[:, 3])
    votes = np.where(votes == 1, 1, 2)
    monkeypatch.setattr(T, "NAMES", [f"v{k}" for k in range(7)])
    labels = np.where(rng.random(n) < 0.05, y, -1)
    rows = [([int(v) for v in vs], int(lab), 1) for vs, lab in zip(votes, labels)]
    model = T.fit_label_model(spark.createDataFrame(rows, "votes array<tinyint>, label int, n long"), rounds=12)
    assert abs(model.prior - 0.3) < 0.03
    assert all(abs(model.accuracy[f"v{k}"] - a) < 0.04 for k, a in enumerate(right))
    tied = [c for pair, c in model.correlation.items() if set(pair.split("-")) <= {"v3", "v4", "v5", "v6"}]
    assert len(tied) == 3 and min(tied) > 0.8
    guessed = model.posterior(votes, np.full(n, -1)) > 0.5
    assert (guessed == (y == 1)).mean() > 0.96


def test_copies_of_one_text_do_not_make_terms(spark):
    """A text that was copied (and once changed a little) often, with a toxic label, has no terms; what many texts share has."""
    rng = np.random.default_rng(7)
    words = [f"word{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    one = " ".join(f"copied{k}" for k in range(40))
    rows = [(k, say(40), 0) for k in range(200)] + [(1000 + k, f"{say(30)} grumble{'abc'[k % 3]}x {say(5)}", 1) for k in range(30)]
    rows += [(2000 + k, one, 1) for k in range(60)] + [(3000 + k, f"{one} and {k}", 1) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, lab) for i, _, lab in rows], "doc_id long, label int")
    learned = T.learn_terms(docs, known, "doc_id", "text", 10_000, 1000)
    assert "grumble*" in learned and not any(t.startswith("copied") for t in learned)
