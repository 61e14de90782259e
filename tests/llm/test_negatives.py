"""Hard negatives against plain sorting, and against SQL."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from banditframe.llm import negatives, queries
from tests.test_oracle import rows as cells

SCHEMA = "vec_id long, embedding array<float>, label int, score string, a string"


def plain(data, positives=5, k=10, low=30, high=90):
    """Rows (number, id, vector, label) -> sorted result rows."""
    used = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab, *_ in data if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda x: (-x[0], math.inf if x[1] is None else x[1])
    out = []
    for i, lab, v in used:
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, other) for j, other, w in used if j != i]
        best = sorted([x for x in scored if x[2] == lab], key=key)[:positives]
        for p, j, _ in best:
            found = sorted([x for x in scored if x[2] != lab and low * p <= 100 * x[0] <= high * p], key=key)[:k]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def ours(df, **options):
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()
    return sorted([tuple(r) for r in got], key=str)


def test_ties_odd_rows_and_bad_vectors(spark):
    rng = random.Random(1)
    base = [[rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)] for _ in range(12)]
    data = [(n, rng.choice(base), rng.choice([0, 0, 0, 1, 2]), "x", "y") for n in range(400)]
    data += [(100, base[0], 1, "x", "y"), (100, base[0], 1, "x", "y"), (None, base[1], 0, "x", "y"), (500, [], 1, None, None), (501, [1.0], 1, None, None), (600, [0.5, 0.5, 0.5, 0.5, 2.0, 3.0], 0, None, None)]
    data += [(700, None, 1, "x", "y"), (701, [None, 1.0, 0.0, 0.0], 1, "x", "y"), (702, [float("nan")] * 4, 1, "x", "y"), (703, [float("inf")] * 4, 1, "x", "y"), (704, base[2], None, "x", "y")]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = plain(data)
    assert len(want) > 100 and ours(df) == want
    assert ours(df, positives=2, k=3, low=0, high=100) == plain(data, 2, 3, 0, 100)


def test_one_vector_for_all_and_chunks(spark, monkeypatch):
    data = [(n, [0.5, -0.25], n % 3, None, None) for n in range(900)] + [(n, [0.25, -0.25], n % 3, None, None) for n in range(900, 1000)]
    df = spark.createDataFrame(data, SCHEMA)
    assert ours(df) == plain(data)
    assert ours(df.filter("vec_id < 100").union(df.filter("vec_id >= 100"))) == plain(data)


def test_large_numbers_are_exact(spark):
    data = [(n, [3e9 + n * 1000, -1e9], n % 2, None, None) for n in range(0, 300, 10)]
    df = spark.createDataFrame(data, SCHEMA)
    data = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert ours(df, low=0, high=100) == [tuple(min(x, negatives.TOP) for x in r) for r in plain(data, low=0, high=100)]


def test_empty(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []
    assert ours(spark.createDataFrame([(0, [1.0], 1, None, None)], SCHEMA)) == []


def test_matches_sql(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        theirs = duck.execute(queries.oracle_sql()["op11_negatives"]).df()
        got = queries.op11_negatives(spark, folder).toPandas()
        assert len(theirs) > 50 and cells(got) == cells(theirs)
