"""The Merkle manifest against a plain tree, and against SQL."""

import random
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from banditframe.llm import manifest as M
from banditframe.llm import queries
from tests.test_oracle import rows as cells

H = lambda *x: sha256("".join(x).encode()).hexdigest()


def tree(nodes):
    """Root and each node's witness."""
    proofs, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(k, min(k + 8, len(nodes)))) for k in range(0, len(nodes), 8)]
        for run in runs:
            for place, k in enumerate(run):
                for leaf in at[k]:
                    proofs[leaf].append((place, [nodes[j] for j in run if j != k]))
        at = [[leaf for k in run for leaf in at[k]] for run in runs]
        nodes = [H(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], proofs


def plain(docs):
    one = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append((d[0], H(*map(one, [d[0], d[3], d[2], d[4], d[1]]))))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(by[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in groups}
    trees = {g: tree([h for _, h in leaves[g]]) for g in groups}
    root, above = tree([trees[g][0] for g in groups])
    return sorted([(i, g, k, h, trees[g][0], root, trees[g][1][k] + above[n]) for n, g in enumerate(groups) for k, (i, h) in enumerate(leaves[g])], key=str)


def whole(df):
    return sorted([(*r[:-1], [(p["at"], p["others"]) for p in r[-1]]) for r in M.manifest(df, witnesses=True).collect()], key=str)


@pytest.mark.parametrize("block", [8, 64])
def test_witnesses(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(3)
    sizes = {"en": 600, "de": 65, "fr": 8, "é": 9, None: 64, "x": 1}
    docs = [(n if n % 50 else None, f"Text {n % 20}", g, rng.choice(["a", None]), n) for g, m in sizes.items() for n in range(m)]
    docs += docs[:5]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = whole(df)
    assert got == plain(docs)
    assert all(M.fold(r[3], r[6]) == r[5] for r in got)
    thin = {(r.lang, r.position): r for r in M.manifest(df, presented=F.lit("0" * 64)).collect()}
    assert all(thin[r[1], r[2]].folded_root == M.fold("0" * 64, r[6]) for r in got)
    assert all(thin[r[1], r[2]].proof_sha256 == H(*(x for _, others in r[6] for x in others)) for r in got)


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()]
    assert whole(odd) == plain(docs)
    assert whole(odd.filter("doc_id = 6")) == plain([d for d in docs if d[0] == 6])
    assert whole(none) == [] and M.manifest(none).count() == 0


def test_appender_extends_as_siblings_come():
    nodes = [H(str(k)) for k in range(100)]
    t = M.Appender(M.height(100))
    for k, x in enumerate(nodes):
        t.append(x)
        assert len(t.witness[0]) == (0 if k < 7 else 1 if k < 63 else 2)
        assert sum(map(len, t.open)) <= 8 * 3
    assert (t.close(), t.witness) == tree(nodes)


def test_matches_sql(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        theirs = duck.execute(queries.oracle_sql()["op12_merkle"]).df()
        got = queries.op12_merkle(spark, folder).toPandas()
        assert 0 < got.verified.sum() < len(got) and cells(got) == cells(theirs)
