"""Hard negatives by slot-decomposed selection.

The rows are dealt to stripes of bounded size, one task each; the anchors, in blocks, pass through every stripe (a stated query set
against all rows, in blocks). First each anchor's positives are found, the best rows of its own label. Their upper limits split the
scores into disjoint slots, and rows of other labels are candidates of one slot each: a task keeps the best few of a slot, and
partial window limits merge these before and after the shuffle. A positive's window ends at its limit, so what it may take is
the slots from there down; merging the slots from the lowest one up, keeping the best few each time, answers the overlapping
windows of all positives of an anchor at once. What a window takes is a prefix of that, down to its lower limit.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of different
lengths are compared as if zeros followed the shorter one, and an empty one has score 0; a row with a null id takes part, comes last
among ties, and is no anchor; rows that repeat an id count each for itself, but none is a positive or negative of its own id's
anchors, and each repeated anchor gets its own rows; positives of negative score have an empty window; components are whole
numbers after scaling, cut to the range of a long, and sums are exact, cut to that range at the end; labels are whole numbers; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.llm.common import cut

#: Rows of a stripe at most (about), rows of a packed block, anchors of a packed block, and rows scored at a time.
STRIPE, BLOCK, ANCHORS, CHUNK = 1 << 17, 512, 256, 1 << 14
TOP = (1 << 63) - 1
#: Stands for a null id inside.
NO_ID = TOP


def _matrix(lists: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as doubles or, if they may pass 2^53, as Python's."""
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    if most(a) * most(b) * max(a.shape[1], 1) < 2**53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(object) @ b.astype(object).T


def first(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the positions at, which ascend, the k of the largest values, largest first, earlier ones first among equals."""
    own = values[at]
    if len(at) > k and own.dtype != object:
        least = np.partition(own, len(at) - k)[len(at) - k]
        at, own = at[own >= least], own[own >= least]
    return at[np.argsort(-own, kind="stable")[:k]]


def _unpack(row) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return np.asarray(row.ids, np.int64), np.asarray(row.labels, np.int64), np.split(np.asarray(row.q, np.int64), np.cumsum(row.sizes)[:-1]) if len(row.ids) else []


def _candidates(batches: Iterator[pd.DataFrame], k: int, negatives: bool) -> Iterator[pd.DataFrame]:
    """One stripe: its rows come first, then all anchors. (a, slot, score, id): the k best of each slot of each anchor."""
    ids, labels, vectors, matrix = [], [], [], None
    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False):
            if row.kind == 0:
                i, lab, v = _unpack(row)
                ids.append(i), labels.append(lab), vectors.extend(v)
                continue
            if matrix is None:
                if not ids:
                    return
                all_ids, all_labels = np.concatenate(ids), np.concatenate(labels)
                order = np.argsort(all_ids, kind="stable")
                matrix = _matrix([vectors[j] for j in order], max(map(len, vectors)))
                all_ids, all_labels = all_ids[order], all_labels[order]
                vectors.clear()
            own_ids, own_labels, own = _unpack(row)
            width = max(matrix.shape[1], max(map(len, own)))
            anchors = _matrix(own, width)
            rows = matrix if width == matrix.shape[1] else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))
            limits = np.split(np.asarray(row.limits, np.int64), np.cumsum(row.n_limits)[:-1])
            kept: dict[tuple[int, int], list] = {}
            for c in range(0, len(rows), CHUNK):
                s = scores(anchors, rows[c : c + CHUNK])
                i, lab = all_ids[c : c + CHUNK], all_labels[c : c + CHUNK]
                for j in range(len(own)):
                    if not negatives:
                        at = np.flatnonzero((lab == own_labels[j]) & (i != own_ids[j]))
                        kept.setdefault((j, 0), []).append((s[j], i, first(s[j], at, k)))
                        continue
                    ends = limits[j]
                    at = np.flatnonzero((lab != own_labels[j]) & (i != own_ids[j]) & (s[j] <= ends[-1]) & (s[j] >= row.least[j]))
                    slot = np.searchsorted(ends, s[j][at])
                    for n in np.unique(slot):
                        kept.setdefault((j, int(n)), []).append((s[j], i, first(s[j], at[slot == n], k)))
            for (j, n), found in kept.items():
                all_s, all_i = np.concatenate([x[at] for x, _, at in found]), np.concatenate([y[at] for _, y, at in found])
                for m in first(all_s, np.arange(len(all_s)), k):
                    out.append((row.numbers[j], n, min(max(int(all_s[m]), -TOP), TOP), all_i[m]))
        if out:
            yield pd.DataFrame(out, columns=["a", "slot", "score", "id"])


def _packed(rows: DataFrame, size: int, kind: int) -> DataFrame:
    """Rows (number, id, label, q, limits, least), packed by about size. Blocks follow from the numbers, so none is large."""
    blocks = -(-rows.count() // size) or 1
    s = rows.groupBy(F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("number", "id", "label", "q", "limits", "least")).alias("s"))
    of = lambda name: F.transform("s", lambda x: x[name])
    long = {"numbers": of("number"), "ids": of("id"), "labels": of("label"), "least": of("least"), "sizes": F.transform("s", lambda x: F.size(x["q"])), "q": F.flatten(of("q"))}
    return s.select(F.lit(kind).alias("kind"), "block", *[c.alias(n) for n, c in long.items()], F.transform("s", lambda x: F.size(x["limits"])).alias("n_limits"), F.flatten(of("limits")).alias("limits"))


def _best(rows: DataFrame, anchors: DataFrame, stripes: int, k: int, negatives: bool) -> DataFrame:
    """(a, slot, score, id): the k best of all rows for each slot of each anchor."""
    every = F.sequence(F.lit(0), F.lit(stripes - 1))
    asked = _packed(anchors, ANCHORS, 1).withColumn("stripe", F.explode(every))
    both = rows.withColumn("stripe", F.pmod("block", F.lit(stripes)).cast("int")).unionByName(asked)
    dealt = both.repartitionById(stripes, F.col("stripe").cast("int")).sortWithinPartitions("kind")
    found = dealt.mapInPandas(lambda it: _candidates(it, k, negatives), "a long, slot int, score long, id long")
    w = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")


def _share(score: Column, percent: int) -> Column:
    return score.cast("decimal(38,0)") * percent / 100


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, low: int = 30, high: int = 90, k: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that anchor holds for and each of its
    first `positives` rows of the same label, the first k rows of other labels whose score is from low to high percent of the
    positive's."""
    whole = F.forall(vec_col, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    used = vectors.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & whole)
    q = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    none = F.array().cast("array<long>")
    rows = used.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("q"), F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), none.alias("limits"), F.lit(0).cast("long").alias("least"))
    rows = cut(rows.withColumn("number", F.monotonically_increasing_id()))
    n = rows.count()
    stripes = max(-(-n // STRIPE), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 128), 1)
    blocks = cut(_packed(rows, min(BLOCK, max(n // (4 * stripes), 1)), 0))
    anchors = rows.filter("anchor")

    near = _best(blocks, anchors, stripes, positives, False)
    near = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "id"))).alias("p"))
    known = cut(near.select("a", F.filter(F.transform("p", lambda x: F.struct((-x["m"]).alias("score"), x["id"].alias("id"))), lambda x: x["score"] >= 0).alias("p")).filter(F.size("p") > 0))
    limits = F.array_sort(F.array_distinct(F.transform("p", lambda x: F.floor(_share(x["score"], high)).cast("long"))))
    least = F.array_min(F.transform("p", lambda x: F.ceil(_share(x["score"], low)).cast("long")))
    known = known.select("a", "p", limits.alias("ends"), least.alias("low"))
    asked = anchors.drop("limits", "least").join(known, anchors["number"] == known["a"]).select("number", "id", "label", "q", F.col("ends").alias("limits"), F.col("low").alias("least"))
    asked = cut(asked)

    slots = _best(blocks, asked, stripes, k, True)
    items = slots.groupBy("a").agg(F.collect_list(F.struct((-F.col("score")).alias("m"), "id", "slot")).alias("items"))
    # from the lowest slot up: what all slots so far hold together, the k best of it
    start = F.array(F.filter("items", lambda x: F.lit(False)))
    step = lambda acc, j: F.concat(acc, F.array(F.slice(F.array_sort(F.concat(F.element_at(acc, -1), F.filter("items", lambda x: x["slot"] == j))), 1, k)))
    both = items.join(known, "a").join(asked.select(F.col("number").alias("a"), F.col("id").alias("anchor_id")), "a")
    both = both.select("anchor_id", "ends", F.aggregate(F.sequence(F.lit(0), F.size("ends") - 1), start, step).alias("merged"), F.explode("p").alias("p"))
    own = F.get("merged", F.array_position("ends", F.floor(_share(F.col("p.score"), high)).cast("long")).cast("int"))
    found = both.select("anchor_id", "p", F.posexplode(F.filter(own, lambda x: -x["m"] >= _share(F.col("p.score"), low))).alias("at", "x"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return found.select("anchor_id", real("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), real("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("x.m")).alias("negative_score"))
