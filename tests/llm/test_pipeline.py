"""The pipeline's stages against plain versions of what each must do to its own input."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from banditframe.llm import quality
from tests.llm.test_resemblance import kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.toPandas())
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs.toPandas())
    return out


def test_stages_return_documents(steps):
    columns = list(steps[0].columns)
    assert all(list(s.columns) == columns for s in steps[1:5]) and list(steps[5].columns)[:5] == columns
    assert all(set(b.doc_id) <= set(a.doc_id) for a, b in zip(steps, steps[1:]))


def test_quality_stage(spark, steps):
    judged = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), keep_text=False).toPandas()
    assert set(steps[1].doc_id) == set(judged.doc_id[judged.keep])
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    good = set(labels.doc_id[labels.quality == 1])
    assert len(good - set(steps[1].doc_id)) <= 0.02 * len(good)


def test_near_duplicate_stage(steps):
    """By all pairs of five-word shingle sets of similarity 0.8, which is what the contract asks of stages."""
    assert set(steps[2].doc_id) == kept(steps[1])


def test_decontamination_stage(steps):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet").text
    bad = {i for i, t in zip(steps[2].doc_id, steps[2].text) if any(b in t for b in bench)}
    assert bad and set(steps[3].doc_id) == set(steps[2].doc_id) - bad


def test_personal_data_stage(steps):
    before, after = steps[3].set_index("doc_id"), steps[4].set_index("doc_id")
    assert list(before.sort_index().index) == list(after.sort_index().index)
    odd = before.text.str.contains(r"@mail\d|\d{16}|\d+\.\d+\.\d+\.\d+|\+1 \(|token = ")
    for i in before.index:
        assert (after.text[i] != before.text[i]) == bool(odd[i])
    assert not after.text.str.contains(r"@mail\d").any() and (after.n_chars == after.text.str.len()).all()


def test_mix_stage(steps):
    m = steps[5]
    assert (m.copies > 0).all() and (m.taken == m.copies * m["size"]).all() and (m.copies <= 2).all()
    g = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((g.taken - g.target).abs() <= m.groupby("source")["size"].max() / 2 + 1).all()


def test_run_gives_the_last_step(spark, steps):
    got = P.run(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(steps[5].doc_id, steps[5].taken))


@pytest.mark.parametrize("k", range(5))
def test_odd_and_no_documents(spark, odd, none, k):
    name, stage = P.STAGES[k]
    out = stage(spark, odd, SF)
    assert set(odd.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    out.collect()
    empty = stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), SF)
    assert empty.count() == 0 and dict(none.select("doc_id", "text").dtypes).items() <= dict(empty.dtypes).items()
    if name == "near_duplicates":
        assert stage(spark, odd.filter(F.col("doc_id") > 0), SF).filter("doc_id = 1").count() == 1
