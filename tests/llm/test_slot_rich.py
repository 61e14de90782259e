"""Copies of benchmark items that are mostly numbers and names."""

from banditframe.llm import decontaminate

ITEMS = ["What is 12 times 7?", "The Old Man And The Sea By Night", "3, 5, 8, 13, 21, 34", "Der Hund Jagt Den Ball Im Garten", "Paris 1889 Tower", "Carbon dioxide"]


def leaks(spark, texts):
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}


def test_copies_are_found_whatever_their_case(spark):
    n = len(ITEMS) - 1  # the last has too few words for a passage
    texts = [f"He asked then: {t} and went on" for t in ITEMS[:n]] + [f"he asked then {t.lower()} and went on" for t in ITEMS[:n]]
    assert leaks(spark, texts) == {(k, k % n) for k in range(2 * n)}


def test_items_of_few_words_are_whole_documents(spark):
    assert leaks(spark, ["Carbon dioxide.", "carbon DIOXIDE", "it holds carbon dioxide too", "Sulfur dioxide"]) == {(0, 5), (1, 5)}


def test_other_slots_are_no_copies(spark):
    texts = ["Was ist 12 plus 7?", "Her Young Son Met His Best Friend Today", "1, 2, 3, 4, 5, 6, 7", "Rom 1950 Park"]
    assert leaks(spark, texts) == set()


def test_each_text_is_judged_for_itself(spark):
    item = "what colour is the early morning sky over the quiet sea today"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    half = item.split()[:5], item.split()[5:]
    rows = [(None, "so " + " ".join(half[0])), (None, "then " + " ".join(half[1])), (None, "a clean text"), (7, f"he asked {item}"), (7, "another clean text"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(None, 1), (7, 1)}
    assert {r["text"] for r in decontaminate.decontaminate(docs, bench).collect()} == {rows[k][1] for k in (0, 1, 2, 4)}


def plain_windows(text, width=5):
    import re

    w = re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_][^\W_]*", text)
    return [tuple(x.lower() for x in w[k : k + width]) for k in range(len(w) - width + 1)], len(w)


def test_leaks_against_a_plain_version(spark):
    """Both ways: items whose words stand in a text to six tenths are found, and nothing is found that shares no window."""
    import pandas as pd

    from banditframe.llm import queries

    docs, bench = (pd.read_parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, "/root/testdata/sf0.01").collect()}
    want = set()
    items = {i: plain_windows(t) for i, t in zip(bench.item_id, bench.text)}
    for d, t in zip(docs.doc_id, docs.text):
        seen = set(plain_windows(t)[0])
        for i, (windows, n) in items.items():
            covered = {k + j for k, x in enumerate(windows) if x in seen for j in range(5)}
            if len(covered) >= 0.6 * n:
                want.add((d, i))
    assert got >= want and len(want) > 20
    assert len(got - want) <= 0.02 * len(want)
