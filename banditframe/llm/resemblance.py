"""Near-duplicate classes by the Jaccard similarity of word shingles: candidates by fingerprints and minima, then exact set sizes.

SimHash fingerprints of the shingle sets meet in the binary trie join of `simhash`, which finds the closest pairs. A pair of
similarity 0.8 differs in about 10 of 64 bits, and no trie prunes at a budget that would reach it, so MinHash bands find the rest:
those of 5 of 160 minima find a pair of similarity 0.8 but for 1 in 300,000, and closer ones more surely. Each candidate's sets
are compared before it becomes a link. A band's members are compared with one of them first; after that only members
that are not yet of one class are compared with each other, so a large class of near copies costs no square of its size. What is left
of a band is dealt to blocks of bounded size, and a task compares two blocks at a time: it returns the links that it finds, and no pair
of members is ever a row. A pair that shares several bands is compared in the first of them.

Cases: a null or blank text has the empty set, equal to any other; a text of fewer words than a shingle is one shingle;
texts of equal sets are one leaf, so copies cost nothing; a null id never becomes a class id unless a class has no other;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditframe.llm.common import cut
from banditframe.llm.components import components
from banditframe.llm.simhash import LOWER, links

BANDS, ROWS = 32, 5
#: Members of a block of a band, and hashes of all its sets, at most (about).
MEMBERS, HASHES = 512, 1 << 18
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
FLIPS, FACTORS = _DRAWN[0], _DRAWN[1] << np.uint64(1) | np.uint64(1)


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 of the shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends)), np.uint64))


def leaf(hashes: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(hashes.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: a bit is set if it is in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for a text of any length
        votes += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed hash for each band of minima; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):  # bounded memory for a text of any length
        least = np.minimum(least, ((hashes[k : k + 2048, None] ^ FLIPS) * FACTORS).min(axis=0))
    parts = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least this similarity."""
    left, right = (sets.select(F.col("leaf").alias(f"l{k}"), F.col("hashes").alias(f"h{k}")) for k in "ab")
    both = pairs.join(right, pairs["b"] == right["lb"]).join(left, pairs["a"] == left["la"])
    common = F.size(F.array_intersect("ha", "hb"))
    return cut(both.withColumn("c", common).filter(F.col("c") / (F.size("ha") + F.size("hb") - F.col("c")) >= similarity).select("a", "b"))


def _common(sets: list[np.ndarray], owners: np.ndarray, tokens: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """How many hashes of the sorted set a each of n sets has, whose hashes are tokens with their owners."""
    at = np.searchsorted(a, tokens)
    at[at == len(a)] = 0
    return np.bincount(owners[a[at] == tokens], minlength=n)


def compared(t: pa.Table, similarity: float) -> pa.Table:
    """Links between two blocks of a band's members, or inside one (rows: side 0 or 1 or both, leaf, root, band numbers, hashes)."""
    t = t.combine_chunks()
    side, leaves, roots = (t[c].to_numpy() for c in ("side", "leaf", "root"))
    lists, band = t["hashes"].to_numpy(zero_copy_only=False), int(t["band"][0].as_py())
    sets = [np.sort(np.asarray(x, np.int64)) for x in lists]
    shared = np.stack([np.asarray(x, np.int64) for x in t["bands"].to_numpy(zero_copy_only=False)])
    here = int(np.flatnonzero((shared == band).all(axis=0))[0])
    inside = t["i"][0].as_py() == t["j"][0].as_py()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 0 if inside else side == 1))
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        sizes = np.array([len(sets[k]) for k in right])
        tokens, owners = np.concatenate([sets[k] for k in right]), np.repeat(np.arange(len(right)), sizes)
        for k in left:
            n = len(sets[k])
            # a pair's first band, two classes, sizes that allow the similarity
            ok = ~(shared[right, :here] == shared[k, :here]).any(axis=1) & (roots[right] != roots[k]) & (np.minimum(sizes, n) >= similarity * np.maximum(sizes, n))
            if inside:
                ok &= leaves[right] > leaves[k]
            if not ok.any():
                continue
            mine = ok[owners]
            c = _common(sets, owners[mine], tokens[mine], sets[k], len(right))
            for j in np.flatnonzero(ok & (c >= similarity * (sizes + n - c))):
                out.append((min(leaves[k], leaves[right[j]]), max(leaves[k], leaves[right[j]])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _rest(apart: DataFrame, bands_of: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members (band, leaf, size, root) of one band and two classes: a band's members in blocks, any two of which, or one
    alone, are a group."""
    counts = cut(apart.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / HASHES)).cast("int").alias("blocks")))
    dealt = apart.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("leaf", "band"), F.col("blocks")).cast("int"))
    # a block meets all others: as the first of two with those after it, as the second with those before it, and alone
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    dealt = dealt.select("band", "leaf", "root", F.explode(pair).alias("q")).select("band", "leaf", "root", "q.*")
    whole = dealt.join(bands_of, "leaf").join(sets, "leaf").select("band", "i", "j", "side", "leaf", "root", "bands", "hashes")
    return cut(whole.groupBy("band", "i", "j").applyInArrow(lambda t: compared(t, similarity), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """(id, component_id: the smallest id reachable over pairs of at least this Jaccard similarity)."""

    @F.pandas_udf("struct<leaf:long,size:int,fp:long,bands:array<long>>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            sets = [shingles(t, width) for t in s]
            yield pd.DataFrame({"leaf": [leaf(x) for x in sets], "size": [len(x) for x in sets], "fp": [fingerprint(x) for x in sets], "bands": [bands(x) for x in sets]})

    @F.pandas_udf("struct<leaf:long,hashes:array<long>>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            sets = [shingles(t, width) for t in s]
            yield pd.DataFrame({"leaf": [leaf(x) for x in sets], "hashes": [x.view(np.int64) for x in sets]})

    marked = cut(docs.select(id_col, sketch(text_col).alias("s")).select(id_col, "s.*"))
    leaves = cut(marked.groupBy("leaf").agg(F.min(id_col).alias("least"), F.max("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))

    # leaves of one fingerprint, with one of them, and these of fingerprints that the trie links
    filled = leaves.filter("size > 0").select("leaf", "fp")
    centres = cut(filled.groupBy("fp").agg(F.min("leaf").alias("centre")))
    same = filled.join(centres, "fp").filter("leaf <> centre").select(F.col("centre").alias("a"), F.col("leaf").alias("b"))
    of = lambda k: centres.select(F.col("fp").alias(f"f{k}"), F.col("centre").alias(k))
    near = links(centres.select("fp"), budget).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(of("a"), "fa").join(of("b"), "fb").select("a", "b")

    spread = leaves.select("leaf", "size", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("leaf").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut(spread.join(shared, "band"))
    stars = cut(members.filter("leaf <> centre").select(F.col("centre").alias("a"), F.col("leaf").alias("b")).union(same).union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # equal ids of other rows come along; their leaves are not looked up
    used = stars.select(F.explode(F.array("a", "b")).alias("leaf")).union(members.select("leaf")).distinct()
    ids = cut(leaves.join(used, "leaf", "left_semi").select(F.col("least").alias("__least")))
    sets = docs.join(ids, docs[id_col].eqNullSafe(ids["__least"]), "left_semi").select(whole(text_col).alias("s")).select("s.*")
    sets = cut(sets.dropDuplicates(["leaf"]))

    found = _verified(stars, sets, similarity)
    roots = components(found)
    rooted = cut(members.join(roots, members["leaf"] == roots["node"], "left").select("band", "leaf", "size", F.coalesce("root", "leaf").alias("root")))
    open_ = rooted.groupBy("band").agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("band")
    apart = cut(rooted.join(open_, "band", "left_semi"))
    found = found.union(_rest(apart, leaves.select("leaf", "bands"), sets, similarity))

    roots = components(found)
    rooted = cut(leaves.join(roots, leaves["leaf"] == roots["node"], "left").select("leaf", "least", F.coalesce("root", "leaf").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut(rooted.join(least, "root").select(F.col("leaf").alias("of"), "component_id"))
    return marked.join(classes, marked["leaf"] == classes["of"]).select(id_col, "component_id")
