"""Quality of documents by hierarchical empirical Bayes.

A logistic model on counts of the text and on hashed n-grams of word shapes gives each document's evidence p. Hosts, and paths
below them, get Beta posteriors of their share of good documents: a host is shrunk toward the whole table's share, a path toward
its host's, the more so the fewer documents it has; the strengths come from the spread between hosts and between paths. A
document's posterior odds are its own odds times those of its path, relative to the whole table's, where path, host and table are
taken without the document itself (the strengths alone come from all).

Cases: a null or blank text has evidence 0; a null host or path is a site of its own; labels that are null, or of no
document, are left out, and of several labels of a document the mean counts; without labels of both kinds the evidence of
every text with words is the labels' share (1 if there are none); a document alone in its table has the prior share 1/2; an empty
table gives an empty result; columns of the same names as results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditframe.llm.common import cut

FEATURES = ["symbols", "upper", "repeats", "bars", "distinct", "digits", "length"]
RESULTS = ["evidence", "host_posterior", "path_posterior", "posterior", "keep"]
#: Shape n-grams are hashed to so many features.
BUCKETS = 1 << 11
RUN = re.compile(r"(.)\1+", re.S)


class _Classes(dict):
    """Characters by class, for str.translate: A capitals, a other letters, 9 digits, others as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return out


class _Shapes(dict):
    """The shape of a word: its classes of characters, runs made one. Emptied when it has many words; long words are not kept."""

    classes = _Classes()

    def __missing__(self, word: str) -> str:
        shape = RUN.sub(r"\1", word.translate(self.classes))
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = shape
        return shape


def describe(text: str | None, shapes: dict | None = None) -> tuple[int, list[float], list[str]]:
    """Number of words, FEATURES, and the words' shapes."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return 0, [0.0] * len(FEATURES), []
    shapes = _Shapes() if shapes is None else shapes
    symbols = len(re.findall(r"[^\w\s.,;:'\"()-]{2,}", text))
    upper = sum(map(str.isupper, words))
    repeats = sum(map(eq, words, words[1:]))
    digits = len(re.findall(r"\d", text))
    # the share of distinct words falls with length in any text; the exponent takes that out
    counts = [symbols / n, upper / n, repeats / n, words.count("|") / n, len(set(words)) / n**0.9, digits / len(text), sum(map(len, words)) / n / 10]
    return n, counts, list(map(shapes.__getitem__, words))


def bucket(gram: str | tuple[str, str]) -> int:
    return crc32((gram if isinstance(gram, str) else "\x1f".join(gram)).encode("utf-8", "replace")) % BUCKETS


def vector(text: str | None) -> SparseVector:
    """FEATURES and the shares of the hashed shape n-grams (n of 1 and 2)."""
    n, counts, seen = describe(text)
    cells: dict[int, float] = dict(enumerate(counts))
    for g, c in Counter([*seen, *zip(seen, seen[1:])]).items():
        k = len(FEATURES) + bucket(g)
        cells[k] = cells.get(k, 0.0) + c / n
    return SparseVector(len(FEATURES) + BUCKETS, {k: v for k, v in cells.items() if v})


class _Weights(dict):
    """The weights of n-grams, kept by n-gram; emptied when there are many."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, gram: str | tuple[str, str]) -> float:
        if len(self) >= 200_000:
            self.clear()
        out = self[gram] = float(self.weights[len(FEATURES) + bucket(gram)])
        return out


@dataclass(frozen=True)
class Model:
    """A logistic model; without weights, the same share for every text."""

    intercept: float
    weights: np.ndarray | None = None

    def scorer(self) -> Callable[[pd.Series], pd.DataFrame]:
        """n_words and evidence of texts."""
        shapes, grams = _Shapes(), None if self.weights is None else _Weights(self.weights)

        def one(text: str | None) -> tuple[int, float]:
            n, counts, seen = describe(text, shapes)
            if not n or grams is None:
                return n, self.intercept if n else 0.0
            total = sum(map(grams.__getitem__, seen)) + sum(map(grams.__getitem__, zip(seen, seen[1:])))
            z = self.intercept + float(np.dot(self.weights[: len(FEATURES)], counts)) + total / n
            return n, 1 / (1 + exp(-max(min(z, 700.0), -700.0)))

        return lambda texts: pd.DataFrame([one(t) for t in texts], columns=["n_words", "evidence"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str = "text", most_labels: int = 50_000) -> Model:
    """The model, fitted on at most about most_labels labelled rows. That many ids are what is broadcast, so that no text is moved
    that is not sampled."""
    known = labels.filter(f"{id_col} is not null and quality is not null").groupBy(id_col).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    n = known.count()
    part = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_labels / max(n, 1)))
    rows = docs.select(id_col, F.col(text_col).alias("__t")).filter(F.rlike("__t", F.lit(r"\S"))).join(F.broadcast(known.filter(part)), id_col)
    train = cut(rows.select("label", F.udf(vector, VectorUDT(), useArrow=False)("__t").alias("x")))
    share, kinds = train.agg(F.avg("label"), F.countDistinct("label")).first()
    if kinds < 2:
        return Model(1.0 if share is None else float(share))
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-2, maxIter=100).fit(train)
    return Model(float(model.intercept), model.coefficients.toArray())


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with n_words and evidence in a struct column __f."""

    @F.pandas_udf("n_words long, evidence double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for s in batches:
            yield score(s)

    return docs.withColumn("__f", udf(F.col(text_col)))


def _strength(mean: Column, spread: Column) -> Column:
    """The prior's weight in documents, for means of this spread; between 1 and 10,000."""
    return F.least(F.greatest(F.coalesce(F.try_divide(mean * (1 - mean), spread) - 1, F.lit(1e4)), F.lit(1.0)), F.lit(1e4))


def sites(rows: DataFrame, host: str, path: str) -> DataFrame:
    """One row for each host and path of rows (host, path, p): number and sum of p of the path (__n, __s), its host (__hn, __hs) and
    the table (__tn, __ts), the strengths (__k0, __k1), and the posteriors of host and path."""
    paths = cut(rows.groupBy(host, path).agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    total = paths.agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(float(total["mean"] if total["mean"] is not None else 0.5), 1e-6), 1 - 1e-6)
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    inside = lambda n, m: F.greatest(n * F.pow(m - mean, 2) - mean * (1 - mean), F.lit(0.0))  # noqa: E731  what sampling alone doesn't explain
    k0 = hosts.agg(_strength(F.lit(mean), F.sum(inside(F.col("hn"), F.col("hs") / F.col("hn"))) / F.sum("hn"))).first()[0]
    hosts = hosts.select(F.col(host).alias("__of"), "hn", "hs", ((k0 * mean + F.col("hs")) / (k0 + F.col("hn"))).alias("host_posterior"))
    both = cut(paths.join(hosts, paths[host].eqNullSafe(hosts["__of"])).drop("__of"))
    off = F.greatest(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_posterior"), 2) - F.col("host_posterior") * (1 - F.col("host_posterior")), F.lit(0.0))
    k1 = both.agg(_strength(F.lit(mean), F.sum(off) / F.sum("n"))).first()[0]
    fixed = {"__tn": F.lit(total["n"] or 0), "__ts": F.lit(float(total["s"] or 0.0)), "__k0": F.lit(k0), "__k1": F.lit(k1)}
    own = {"__h": host, "__d": path, "__n": "n", "__s": "s", "__hn": "hn", "__hs": "hs"}
    return cut(both.select(*[F.col(c).alias(n) for n, c in own.items()], *[c.alias(n) for n, c in fixed.items()], "host_posterior", ((k1 * F.col("host_posterior") + F.col("s")) / (k1 + F.col("n"))).alias("path_posterior")))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(q / (1 - q))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5, most_labels: int = 50_000, keep_text: bool = True) -> DataFrame:
    """docs (without the text, if not keep_text) with RESULTS. Texts are read twice, and shuffled only if the sites outgrow what Spark
    broadcasts."""
    docs = docs.drop(*RESULTS)
    marked = with_evidence(docs, fit(docs, labels, id_col, text_col, most_labels), text_col)
    small = cut(marked.select(id_col, F.col(host).alias("__host"), F.col(path).alias("__path"), "__f"))
    known = sites(small.select("__host", "__path", F.col("__f.evidence").alias("p")), "__host", "__path")
    rows = marked if keep_text else small.select(F.col(id_col), F.col("__host").alias(host), F.col("__path").alias(path), "__f")
    rows = rows.join(known, rows[host].eqNullSafe(known["__h"]) & rows[path].eqNullSafe(known["__d"]))
    e = F.col("__f.evidence")
    # everything without the document itself
    mean = F.least(F.greatest(F.coalesce(F.try_divide(F.col("__ts") - e, F.col("__tn") - 1), F.lit(0.5)), F.lit(1e-6)), F.lit(1 - 1e-6))
    above = (F.col("__k0") * mean + F.col("__hs") - e) / (F.col("__k0") + F.col("__hn") - 1)
    others = (F.col("__k1") * above + F.col("__s") - e) / (F.col("__k1") + F.col("__n") - 1)
    z = _logit(e) + _logit(others) - _logit(mean)
    rows = rows.withColumn("posterior", F.when(F.col("__f.n_words") > 0, 1 / (1 + F.exp(-z))).otherwise(0.0))
    rest = [c for c in docs.columns if keep_text or c in (id_col, host, path)]
    return rows.select(*rest, e.alias("evidence"), "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= threshold).alias("keep"))
