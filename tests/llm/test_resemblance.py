"""The near-duplicate stage against all pairs of documents, by five-word shingles and a Jaccard similarity of 0.8."""

import pandas as pd

import corpus_pipeline as P
from banditframe.llm import resemblance


def kept(docs):
    """The ids that stay: the smallest of each class of pairs that share 0.8 of their shingles."""
    words = {i: (t or "").lower().split() for i, t in zip(docs.doc_id, docs.text)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if i < j and small >= 0.8 * large and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if root[i] == i}


def test_stage_removes_all_of_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.drop_near_duplicates(spark, docs, "").toPandas()
    assert set(got.doc_id) == kept(docs.toPandas())


def test_members_far_from_the_centre_are_compared(spark):
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(12):  # a chain: each changes three words more at its end, so that only neighbours are near
        rows.append((k, " ".join(base[3 * k :] + [f"x{j}" for j in range(3 * k)])))
    rows += [(50, " ".join(base[:60] + [f"y{j}" for j in range(40)])), (51, None), (52, " "), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resemblance.near_duplicates(docs).toPandas()
    want = kept(pd.DataFrame(rows[:15], columns=["doc_id", "text"]))
    assert set(got.component_id) == want and len(got) == len(rows)


def test_blocks_of_open_members(spark, monkeypatch):
    """Many texts that are alike but not near, with a few near pairs among them: blocks of a few members find what all pairs give."""
    import random

    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for j in rng.sample(range(120), 4):
            words[j] = f"x{k}.{j}"
        rows.append((2 * k, " ".join(words)))
        if k % 6 == 0:
            words[rng.randrange(120)] = "y"
            rows.append((2 * k + 1, " ".join(words)))
    want = kept(pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert 20 < len(want) < len(rows) - 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for members, hashes in ((512, 1 << 18), (7, 1 << 18), (512, 700)):
        monkeypatch.setattr(resemblance, "MEMBERS", members)
        monkeypatch.setattr(resemblance, "HASHES", hashes)
        assert set(resemblance.near_duplicates(df).toPandas().component_id) == want
