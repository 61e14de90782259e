"""SimHash fingerprints of word shingles, and their near-duplicate classes by a binary trie self-join.

Cases: a null or blank text has fingerprint zero, linked like any other; a text of fewer words than a shingle is one
shingle; rows with equal fingerprints are one trie leaf, so copies cost nothing; a null id never becomes a class id unless
a class has no other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditframe.llm.common import cut
from banditframe.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    votes, n = np.zeros(64, np.int64), len(ends)
    for k in range(0, n, 65536):  # bounded memory for a text of any length
        h = np.fromiter((xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536])), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """docs with a signed 64-bit fingerprint column."""

    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.withColumn(out, udf(F.col(text_col)))


def trie_join(values: np.ndarray, budget: int, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct sorted uint64 values that differ in at most budget bits.

    A trie node is a range of the sorted values that share their leading bits. Pairs of nodes go down together, a bit at a
    time; a pair whose two branches differ in that bit pays one from its budget, and a pair that can't pay is dropped. Pairs
    are kept on a stack in chunks, so memory does not grow with their number.
    """
    n = len(values)
    stack = [(0, *(np.array([x], np.int64) for x in (0, n, 0, n, budget)))]
    while stack:
        bit, a, b, c, d, left = stack.pop()
        if len(a) > chunk:
            h = len(a) // 2
            stack += [(bit, a[:h], b[:h], c[:h], d[:h], left[:h]), (bit, a[h:], b[h:], c[h:], d[h:], left[h:])]
            continue
        lone = (b - a == 1) & (d - c == 1)
        if bit == 64 or lone.any():
            x, y, can = a[lone], c[lone], left[lone]
            rest = (values[x] ^ values[y]) & np.uint64((1 << (64 - bit)) - 1 if bit else 0xFFFFFFFFFFFFFFFF)
            ok = (x != y) & (np.bitwise_count(rest) <= can)
            if ok.any():
                yield x[ok], y[ok]
            a, b, c, d, left = (v[~lone] for v in (a, b, c, d, left))
        if not len(a):
            continue
        m, o = _split(values, a, b, bit), _split(values, c, d, bit)
        same = a == c
        down = [(a, m, c, o, left), (m, b, o, d, left), (a, m, o, d, left - 1)]
        down.append(tuple(v[~same] for v in (m, b, c, o, left - 1)))
        new = [np.concatenate(v) for v in zip(*down)]
        live = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] >= 0)
        if live.any():
            stack.append((bit + 1, *(v[live] for v in new)))


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """For each range [low, high) of equal leading bits, where its values with the next bit set begin."""
    shift = np.uint64(63 - bit)
    edge = ((values[low] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(values, edge), low, high)


def forest(values: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Links that join the same values as all pairs within the budget do: at most one for each value."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for x, y in trie_join(values, budget):
        for i, j in zip(x.tolist(), y.tolist()):
            if (p := root(i)) != (q := root(j)):
                parent[max(p, q)] = min(p, q)
                out.append((i, j))
    return out


def _children(mask: int, budget: int) -> list[int]:
    """mask with one of budget + 1 parts of its free bits added: values within the budget agree in one of the parts."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (budget + 1) for k in range(budget + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, budget: int = 2, leaf: int = 1024) -> DataFrame:
    """(a, b) links of the distinct column fp that connect all values within budget bits of each other.

    Values are dealt to groups that agree in some bits, such that two near values meet in one group at least, and each group
    is joined by its trie. A group of more than leaf values is dealt again by more bits; once log2(leaf) bits or fewer are
    free, a group can't be larger than leaf. So no group is unbounded, whatever the values are, and none is left out.
    """
    spark = fps.sparkSession

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def joined(lists: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> list:
            v = np.sort(np.asarray(x, np.int64).view(np.uint64))
            s = v.view(np.int64).tolist()
            return [{"a": s[i], "b": s[j]} for i, j in forest(v, budget)]

        return pd.Series([one(x) for x in lists])

    found, masks, rows, last = [], [0], fps.select("fp"), False
    if fps.count() > leaf:
        masks = _children(0, budget)
    while True:
        keys = F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]))
        if "mask" in rows.columns:
            per = F.array(*[F.struct(F.lit(_signed(m)).alias("of"), F.lit(_signed(c)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(c))).alias("key")) for m in masks for c in _children(m, budget)])
            masks = sorted({c for m in masks for c in _children(m, budget)})
            dealt = rows.select("fp", F.explode(F.filter(per, lambda s: s["of"] == F.col("mask"))).alias("k")).select("fp", "k.mask", "k.key").distinct()
        else:
            dealt = rows.select("fp", keys.alias("k")).select("fp", "k.mask", "k.key")
        last = all(64 - m.bit_count() <= leaf.bit_length() - 1 for m in masks)
        hot = None if last else cut(dealt.groupBy("mask", "key").count().filter(F.col("count") > leaf).select("mask", "key"))
        if hot is not None and hot.isEmpty():
            hot = None
        fit = dealt if hot is None else dealt.join(hot, ["mask", "key"], "left_anti")
        groups = fit.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        found.append(cut(groups.select(F.explode(joined("fps")).alias("l")).select("l.a", "l.b").distinct()))
        if hot is None:
            break
        rows = cut(dealt.join(hot, ["mask", "key"], "left_semi"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out if len(found) == 1 else out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links of at most budget bits)."""
    marked = cut(with_fingerprint(docs.select(id_col, text_col), text_col, shingle).select(id_col, "fp"))
    leaves = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(leaves, budget))
    rooted = leaves.join(roots, leaves["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut(rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes, marked["fp"] == classes["of"]).select(id_col, digits.alias("fingerprint"), "component_id")
