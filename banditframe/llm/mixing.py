"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document of a source whose target is f times its size is expected f times
in the mix: floor(f) copies are certain, the rest is drawn. The draw ranks the documents of a source by random odds
u/(1-u) divided by inclusion odds p/(1-p) and takes them in that order until the words still due are used up; documents whose
inclusion probability reaches 1 come first. Inclusion probabilities are unequal by `importance`, scaled so that the words
expected of a source are those due.

Cases: a null text has size 0 and is never drawn; a source of size 0 has target 0; null is a source of its own, ranked
last; rows with equal id and text are numbered, so each is drawn for itself; a null importance counts as 1; an empty table gives an
empty result; columns size, source_size, target, copies and taken are replaced, other columns are kept and not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.llm.common import cut, n_words
from banditframe.plans.index import with_index

_SRC, _SIZE, _U, _P, _KEY, _NTH = "__source", "__size", "__u", "__p", "__key", "__nth"


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and cols, the same on every run and in any SQL engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def water_level(spark_rows: DataFrame, total: float) -> float:
    """The level x at which the sum of least(weight * x, most) over the rows is total (or the sum of most, if less).

    Each pass fixes the rows that have reached their most and shares the rest by weight; the passes end when no row is
    above, so there are as many as there are times that the excess had to be reshared.
    """
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("most")
        held, free = spark_rows.agg(
            F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not free:
            return math.inf
        new = max(level, (total - held) / free)
        if new <= level:
            return level
        level = new


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, scale) -> the same with target. There is one row for each source, not for each document."""
    ranked = with_index(sizes.withColumn("__none", F.col(_SRC).isNull()), [], ["__none", _SRC], "rank")
    at = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(ranked.select("*", F.get(at, (F.col("rank") % len(weights)).cast("int")).alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(ranked.filter("most > 0"), float(share) * total) if total else 0.0
    target = F.least(F.col("weight") * F.lit(level), F.col("most")) if math.isfinite(level) else F.col("most")
    return ranked.select(_SRC, "n", "source_size", "scale", F.coalesce(target, F.lit(0.0)).alias("target"))


def _plan(rows: DataFrame, targets: DataFrame, near: float) -> DataFrame:
    """One row a source: target, whole copies, and the bands of the Pareto order that are drawn.

    A band is all rows with order in (low, high] and size up to big. The first band ends where the words due would be
    exceeded; each later one passes over the document that did not fit and fills what is left with smaller ones. Passes go on
    until every source is within `near` of its target or has no document left that fits. At last, one more document is taken
    where that leaves a smaller error. Sums run over sqrt(n) buckets of the order and then inside one bucket, so no task holds
    a source.
    """
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select("*", F.floor(f + 1e-12).cast("long").alias("whole"), f.alias("f"))
    plan = plan.withColumns({"rest": F.when(F.col("f") - F.col("whole") > 1e-9, F.col("f") - F.col("whole")).otherwise(0.0), "buckets": F.ceil(F.sqrt("n"))})
    plan = plan.withColumns({"gap": F.col("target") - F.col("whole") * F.col("source_size"), "low": F.lit(-1.0), "bands": F.array().cast("array<struct<low:double,high:double,big:double>>")})
    plan = cut(plan)
    live = (F.col("rest") > 0) & (F.col("low") < 1) & ((F.col("low") < 0) | (F.col("gap") > F.greatest(near * F.col("target"), F.lit(1.0))))
    while not plan.filter(live).isEmpty():
        due = rows.join(plan.filter(live).select(F.col(_SRC).alias("s"), "rest", "scale", "buckets", "gap", "low"), rows[_SRC].eqNullSafe(F.col("s")))
        due = due.withColumn("order", order(F.col("rest"), F.col("scale"))).filter((F.col("order") > F.col("low")) & (F.col(_SIZE) > 0) & (F.col(_SIZE) <= F.col("gap")))
        due = due.select(_SRC, _SIZE, "gap", "order", F.floor(F.col("order") * F.col("buckets")).alias("bucket"))
        before = Window.partitionBy(_SRC).orderBy("bucket")
        sums = due.groupBy(_SRC, "bucket").agg(F.sum(_SIZE).alias("words"), F.max("order").alias("top"), F.first("gap").alias("gap"))
        sums = sums.withColumns({"sum": F.sum("words").over(before), "reach": F.lag("top").over(before)})
        whole = cut(sums.groupBy(F.col(_SRC).alias("w")).agg(F.sum("words").alias("all")))
        full = sums.filter("sum > gap").groupBy(_SRC).agg(F.min_by(F.struct("bucket", (F.col("sum") - F.col("words")).alias("base"), "reach"), "bucket").alias("at"))
        full = cut(full.select(F.col(_SRC).alias("s"), "at.*"))
        inside = due.join(full, due[_SRC].eqNullSafe(full["s"]) & (due["bucket"] == full["bucket"]))
        run = F.sum(_SIZE).over(Window.partitionBy(_SRC).orderBy("order")) + F.col("base")
        inside = inside.withColumn("run", run).filter("run <= gap").groupBy(_SRC).agg(F.max("order").alias("high"), F.max("run").alias("run"))
        ends = full.join(inside, full["s"].eqNullSafe(inside[_SRC]), "left").select("s", F.coalesce("high", "reach", F.lit(-1.0)).alias("high"), F.coalesce("run", "base").alias("used"))
        plan = plan.join(ends, plan[_SRC].eqNullSafe(ends["s"]), "left").join(whole, plan[_SRC].eqNullSafe(whole["w"]), "left")
        # no bucket is full: all that fit are drawn; the first that fits no more is passed over
        high = F.when(F.col("s").isNull(), 1.0).otherwise(F.greatest("high", F.when(F.col("low") < 0, 0.0).otherwise(F.col("low"))))
        band = F.struct("low", high.alias("high"), F.col("gap").alias("big"))
        rest = F.col("gap") - F.coalesce("used", "all", F.lit(0.0))
        plan = cut(plan.select(_SRC, "n", "source_size", "scale", "target", "whole", "rest", "buckets", *[F.when(live, new).otherwise(F.col(c)).alias(c) for c, new in (("gap", rest), ("low", high), ("bands", F.concat("bands", F.array(band))))]))
    # the document that brings a source nearest to its target, if any brings it nearer
    due = rows.join(plan.filter("gap > 0").select(F.col(_SRC).alias("s"), "rest", "scale", "gap", "bands"), rows[_SRC].eqNullSafe(F.col("s")))
    due = due.withColumn("order", order(F.col("rest"), F.col("scale"))).filter(~_drawn(F.col("bands"), F.col("order")) & (F.col("order") < 2) & (F.col(_SIZE) > 0))
    due = due.withColumn("off", F.abs(F.col(_SIZE) - F.col("gap"))).filter(F.col("off") < F.col("gap"))
    last = due.groupBy(F.col(_SRC).alias("s")).agg(F.min(F.struct("off", "order")).alias("m")).select("s", F.col("m.order").alias("last"))
    return cut(plan.join(last, plan[_SRC].eqNullSafe(last["s"]), "left").drop("s"))


def _drawn(bands: Column, at: Column) -> Column:
    return F.exists(bands, lambda b: (at > b["low"]) & (at <= b["high"]) & (F.col(_SIZE) <= b["big"]))


def order(mean: Column, scale: Column) -> Column:
    """The Pareto order of a row, scaled into (0, 1): random odds over inclusion odds, relative to the source's mean odds. Rows that
    are sure to be drawn come before all others."""
    p = F.col(_P) / scale * mean
    odds = F.col(_U) / (1 - F.col(_U)) * (mean / (1 - mean)) * (1 - p) / p
    return F.when(mean <= 0, F.lit(2.0)).when(p >= 1, F.col(_U) * 1e-12).otherwise(F.greatest(odds / (1 + odds), F.lit(1e-12)))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with the number of each among the rows of its key, from 0."""
    again = cut(rows.groupBy(_KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(_KEY).alias("__again")))
    if again.isEmpty():
        return rows.withColumn(_NTH, F.lit(0).cast("long"))
    same = rows[_KEY] == again["__again"]
    many = rows.join(again, same, "left_semi").withColumn("__any", F.monotonically_increasing_id())
    many = with_index(many, [_KEY], ["__any"], _NTH).drop("__any")
    return rows.join(again, same, "left_anti").withColumn(_NTH, F.lit(0).cast("long")).unionByName(many)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance: str | Column | None = None, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, near: float = 0.001) -> DataFrame:
    """docs with size, source_size, target, copies and taken (words, repeats counted).

    weights repeat over the sources in code point order; all sources together get share times all words, and no source
    more than most times its own. importance (a positive column) makes the inclusion probabilities of a source's documents
    unequal: p is importance, over its mean by words, times the source's share.
    """
    p = F.lit(1.0) if importance is None else F.greatest(F.coalesce((F.col(importance) if isinstance(importance, str) else importance).cast("double"), F.lit(1.0)), F.lit(1e-9))
    rows = _numbered(docs.withColumns({_SRC: F.col(source_col), _SIZE: n_words(F.col(text_col)), _P: p, _KEY: F.xxhash64(id_col, text_col)}))
    again = F.when(F.col(_NTH) > 0, F.col(_NTH).cast("string"))
    rows = rows.withColumn(_U, uniform(seed, F.col(id_col), F.col(text_col), again))
    small = cut(rows.select(_SRC, _SIZE, _U, _P))
    scale = F.coalesce(F.try_divide(F.sum(F.col(_SIZE) * F.col(_P)), F.sum(_SIZE)), F.lit(1.0))
    sizes = small.groupBy(_SRC).agg(F.count("*").alias("n"), F.sum(_SIZE).alias("source_size"), scale.alias("scale"))
    plan = _plan(small, source_targets(sizes, weights, share, most), near)
    plan = plan.select(F.col(_SRC).alias("__s"), F.col("source_size").alias("__all"), F.col("scale").alias("__scale"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("rest").alias("__rest"), F.col("bands").alias("__bands"), F.col("last").alias("__last"))
    out = rows.join(plan, rows[_SRC].eqNullSafe(plan["__s"])).withColumn("__order", order(F.col("__rest"), F.col("__scale")))
    drawn = _drawn(F.col("__bands"), F.col("__order")) | F.col("__order").eqNullSafe(F.col("__last"))
    copies = (F.col("__whole") + F.when((F.col("__rest") > 0) & (F.col(_SIZE) > 0) & drawn, 1).otherwise(0)).cast("long")
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return out.withColumn("__copies", copies).select(*keep, F.col(_SIZE).alias("size"), F.col("__all").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col(_SIZE)).alias("taken"))


def by_length(text: Column) -> Column:
    """An importance that prefers longer documents: from 1/2 for none to 3/2 for very many words."""
    return 0.5 + n_words(text) / (n_words(text) + 200.0)
