"""The mix against a plain version that ranks and draws in one list for each source."""

import hashlib
import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from banditframe.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """(source: words) -> targets, by the water level over weights 3, 1, 2."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values())
    free, want = {s for s in sizes if sizes[s]}, {s: 0.0 for s in sizes}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return want | {s: weight[s] * level for s in free}
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            free.discard(s)
    return want


def plain_mix(rows, near=0.001):
    """rows (id, text, source, importance) -> how many copies of each."""
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets, seen, u = plain_targets(sizes), {}, []
    for i, t, _, _ in rows:
        n = seen[i, t] = seen.get((i, t), -1) + 1
        key = "|".join(["42", "" if i is None else str(i), t or "", str(n) if n else ""])
        u.append((int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    copies = [0] * len(rows)
    for s, size in sizes.items():
        own = [k for k, r in enumerate(rows) if r[2] == s]
        f = targets[s] / size if size else 0.0
        whole = math.floor(f + 1e-12)
        rest = f - whole if f - whole > 1e-9 else 0.0
        for k in own:
            copies[k] = whole
        if not rest:
            continue
        scale = sum(words(rows[k][1]) * rows[k][3] for k in own) / size
        p = {k: rows[k][3] / scale * rest for k in own}
        rank = {k: u[k] * 1e-12 if p[k] >= 1 else u[k] / (1 - u[k]) * (1 - p[k]) / p[k] for k in own}
        gap, left = targets[s] - whole * size, sorted((k for k in own if words(rows[k][1])), key=rank.get)
        first = True
        while left and (first or gap > max(near * targets[s], 1.0)):
            left, first, run = [k for k in left if words(rows[k][1]) <= gap] if not first else left, False, gap
            passed = []
            for j, k in enumerate(left):
                n = words(rows[k][1])
                if n > gap:  # too long for the whole band
                    continue
                if n > run:
                    passed = left[j + 1 :]
                    break
                copies[k] += 1
                run -= n
            gap, left = run, passed
        out = [k for k in own if copies[k] == whole and words(rows[k][1])]
        best = min(out, key=lambda k: (abs(words(rows[k][1]) - gap), rank[k]), default=None)
        if gap > 0 and best is not None and abs(words(rows[best][1]) - gap) < gap:
            copies[best] += 1
    return copies


def by_length(text):
    return 0.5 + words(text) / (words(text) + 200)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_draws_as_the_plain_version(spark, name):
    docs = pd.read_parquet(f"/root/testdata/{name}/documents.parquet")
    rows = [(i, t, s, by_length(t)) for i, t, s in zip(docs.doc_id, docs.text, docs.source)]
    got = queries.op1_mixing(spark, f"/root/testdata/{name}").toPandas()
    assert list(got.columns)[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert dict(zip(got.doc_id, got.copies)) == dict(zip(docs.doc_id, plain_mix(rows)))
    assert dict(zip(got.doc_id, got["size"])) == {i: words(t) for i, t, _, _ in rows}
    g = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), all=("source_size", "first"))
    assert (g["size"] == g["all"]).all() and ((g.taken - g.target).abs() <= got.groupby("source")["size"].max() / 2 + 1).all()
    again = queries.op1_mixing(spark, f"/root/testdata/{name}").toPandas()
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, again.itertuples(index=False)))


def test_repeated_rows_are_drawn_one_by_one(spark):
    ten = " ".join("w" * 10)
    rows = [(1, ten, "a")] * 50 + [(2, "x y z", "a"), (3, ten, "b"), (None, ten, None), (None, ten, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    g = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    assert ((g.taken - g.target).abs() <= 5).all()
    assert sorted(got.copies) == sorted(plain_mix([(*r, 1.0) for r in rows]))


def test_importance_shifts_inclusion(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.lit("a").alias("source"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.5).alias("imp"))
    out = mixing.mix(docs, importance="imp", share=0.4, weights=(1,))
    got = {r["imp"]: r["c"] for r in out.groupBy("imp").agg(F.sum("copies").alias("c")).collect()}
    assert abs(sum(got.values()) - 1200) <= 1 and 2.3 < got[1.5] / got[0.5] < 3.9
    sure = mixing.mix(docs.withColumn("imp", F.when(F.col("doc_id") < 100, 1000.0).otherwise(1.0)), importance="imp", share=0.4, weights=(1,))
    assert sure.filter("doc_id < 100 and copies = 0").count() == 0


def test_odd_rows(odd, none):
    rows = mixing.mix(odd, importance="n_chars").collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert all(r["size"] == r["taken"] == 0 for r in rows if not (r["text"] or "").strip())
    assert mixing.mix(none).count() == 0
