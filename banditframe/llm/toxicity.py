"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters say toxic (1), clean (2) or nothing (0) of a text. Some have fixed lists of insults or patterns; others share out the terms
(words, and beginnings of longer words, for insults that are inflected; copies of a text count once) that toxic texts of the labelled rows hold much more often
than clean ones; two speak for clean texts. The label model is a distribution over the true class and all votes: each voter depends on
the class and on one other voter at most, along a forest of the largest mutual information given the class, so that voters which say the same
thing do not count twice. Its accuracies and correlations are estimated by expectation maximisation over the counts of vote
patterns of all rows; labels are one more voter with errors of its own. A logistic model on the terms is fitted to the posteriors;
only what it sees in a text makes up a score.

Bounds, all parameters: terms are counted over, and the logistic model is fitted on, at most about most_labels and most_rows rows, drawn
by hash; at most most_terms terms are kept. Votes, their patterns and the label model cover every row that may be learned from.

Cases: a null or empty text has no terms and the score of that; null or several labels of a document: the mean of those that
are not null counts; labels of no document are left out; without labels of both classes there are no learned terms, and the fixed
voters remain; without any row to learn from, the score is the label model's first guess; an empty table gives an empty result;
rows that repeat an id are scored each for itself; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditframe.llm.common import cut

#: Fixed lists: insults by kind, and those of other languages.
INSULTS = {
    "stupid": ["idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "dumbass", "imbecile", "dimwit", "halfwit", "cretin", "brainless", "fool", "fools", "clown", "clowns"],
    "contempt": ["loser", "losers", "pathetic", "worthless", "useless", "scum", "trash", "garbage", "vermin", "filth", "lowlife", "parasite", "parasites", "nobody"],
    "disgust": ["disgusting", "repulsive", "vile", "ugly", "freak", "freaks", "creep", "pig", "pigs", "rat", "rats"],
    "abuse": ["bastard", "bastards", "bitch", "asshole", "jerk", "whore", "slut", "prick"],
    "other": ["dummkopf", "arschloch", "depp", "trottel", "abschaum", "versager", "hurensohn", "missgeburt", "imbécile", "connard", "salope", "crétin", "ordure", "abruti", "débile", "idiota", "imbécil", "estúpido", "estúpida", "gilipollas", "cabrón", "basura", "escoria"],
}
PHRASES = ["shut up", "hate you", "go to hell", "kill yourself", "nobody likes you", "halt die klappe", "ta gueule", "ferme-la", "cállate"]
WHOM = ["you", "your", "youre", "u", "he", "she", "they", "du", "ihr", "tu", "vous", "eres", "sois"]
LEET = str.maketrans("0134578@$", "oieastbas")
WORD = re.compile(r"\w+(?:[@$]\w+)*")
#: Lengths of beginnings.
HEADS = range(4, 10)
LEARNED = 16
NAMES = [*INSULTS, "phrase", "addressed", "disguised", *(f"terms{k}" for k in range(LEARNED)), "no_terms", "few_terms"]
_KIND = {w: k for k, ws in enumerate(INSULTS.values()) for w in ws}
_ADDRESSED = re.compile(rf"\b(?:{'|'.join(WHOM)})\b(?:\W+\w+){{0,3}}?\W+(?:{'|'.join(_KIND)})\b")


def terms(word: str) -> list[str]:
    """A word, and its beginnings with a star if more follows."""
    return [word[:40], *(word[:n] + "*" for n in HEADS if n < len(word))]


class _Known(dict):
    """For each word: the numbers of its learned terms and its kind of insult, or None. Emptied when there are many."""

    def __init__(self, learned: list[str]) -> None:
        super().__init__()
        self.at = {t: k for k, t in enumerate(learned)}

    def __missing__(self, word: str):
        if len(self) >= 200_000:
            self.clear()
        found = [self.at[t] for t in terms(word) if t in self.at]
        plain = word.isalpha()
        kind = _KIND.get(word if plain else word.translate(LEET), -1)
        out = self[word] = (found, kind, not plain) if found or kind >= 0 else None
        return out


def read(text: str | None, known: _Known) -> tuple[int, list[int], list[int], list[int]]:
    """(number of words, votes, learned terms, how often each)."""
    low = (text or "").lower()
    words = Counter(WORD.findall(low))
    votes, hits, insults = [0] * len(NAMES), Counter(), 0
    for w, n in words.items():
        if (x := known[w]) is not None:
            for t in x[0]:
                hits[t] += n
            if x[1] >= 0:
                votes[x[1]] = 1
                insults += n
                if x[2]:
                    votes[NAMES.index("disguised")] = 1
    base = len(INSULTS)
    votes[base] = int(any(p in low for p in PHRASES))
    votes[base + 1] = int(insults > 0 and _ADDRESSED.search(low) is not None)
    for t in hits:
        votes[base + 3 + t % LEARNED] = 1
    total = words.total()
    if not hits and not insults:
        votes[-2] = 2
    if len(hits) + insults <= total / 500:
        votes[-1] = 2
    return total, votes, list(hits), list(hits.values())


# ---- terms


def sketch(text: str | None) -> int:
    """The least hash of three words in a row: the same for copies, and mostly for near copies, of a text."""
    words = WORD.findall((text or "").lower())
    return min((crc32(" ".join(words[k : k + 3]).encode("utf-8", "replace")) for k in range(max(len(words) - 2, 1))), default=0)


def learn_terms(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, most_labels: int, most_terms: int) -> list[str]:
    """The terms that toxic texts hold more often, surest first. known: (id, label 0 or 1). Texts of one label and sketch count once, or
    the words of one text that was copied often would be terms."""
    n = known.count()
    part = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_labels / max(n, 1)))
    rows = docs.select(id_col, F.col(text_col).alias("t")).join(F.broadcast(known.filter(part)), id_col).select("label", "t")

    @F.pandas_udf("long")
    def sketched(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t) for t in texts], dtype="int64")

    rows = rows.withColumn("s", sketched("t")).groupBy("label", "s").agg(F.min("t").alias("t"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"term": list(seen), "clean": [x[0] for x in seen.values()], "toxic": [x[1] for x in seen.values()]})
            seen.clear()
            return made

        for batch in batches:
            for label, text in zip(batch["label"], batch["t"]):
                words = set(WORD.findall((text or "").lower()))
                for t in {t for w in words for t in terms(w)} | {""}:  # the empty term counts texts
                    seen.setdefault(t, [0, 0])[int(label)] += 1
                if len(seen) > 400_000:
                    yield out()
        if seen:
            yield out()

    counts = cut(rows.mapInPandas(counted, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    texts = counts.filter("term = ''").first()
    if texts is None or not texts["clean"] or not texts["toxic"]:
        return []
    cells = [F.col("toxic") + 0.5, F.lit(texts["toxic"] + 0.5) - F.col("toxic"), F.col("clean") + 0.5, F.lit(texts["clean"] + 0.5) - F.col("clean")]
    odds = F.ln(cells[0] / cells[1]) - F.ln(cells[2] / cells[3])
    sure = odds / F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
    best = counts.filter("term <> '' and toxic >= 3").withColumns({"odds": odds, "sure": sure}).filter((F.col("odds") > 2) & (F.col("sure") > 3.5))
    return [r[0] for r in best.orderBy(F.desc("sure"), "term").limit(most_terms).select("term").collect()]


# ---- label model


@dataclass
class LabelModel:
    """prior: share of toxic texts; parents: each voter's in the tree (-1: none); tables[y][j][a][b]: probability that voter j says b if
    the class is y and its parent says a; label: probabilities that a label of 1 is given in either class. Accuracies (of what a
    voter says, how much is right) and correlations (of a voter and its parent, within classes) are what was estimated."""

    prior: float
    parents: list[int]
    tables: np.ndarray
    label: tuple[float, float]
    accuracy: dict[str, float] = field(default_factory=dict)
    correlation: dict[str, float] = field(default_factory=dict)

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of votes and labels (0, 1, or -1 for none)."""
        z = np.zeros((2, len(votes)))
        for y, share in enumerate((1 - self.prior, self.prior)):
            z[y] = np.log(share)
            for j, p in enumerate(self.parents):
                z[y] += np.log(self.tables[y, j, votes[:, p] if p >= 0 else 0, votes[:, j]])
            z[y] += np.where(labels < 0, 0.0, np.log(np.where(labels == 1, self.label[y], 1 - self.label[y])))
        return 1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50)))


def guess(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The posteriors to begin with: toxic if two voters say so."""
    said = (votes == 1).sum(axis=1) - 0.5 * (votes == 2).sum(axis=1)
    free = 1 / (1 + np.exp(np.clip(3.0 - 2.0 * said, -50, 50)))
    return np.where(labels < 0, free, np.where(labels == 1, 0.95, 0.05))


def _forest(s: np.ndarray, least: float = 0.1) -> list[int]:
    """Parents by the maximum spanning forest of mutual information given the class, as a share of what the lesser voter says at all;
    less than `least` of it is no edge, or edges would explain what the class does. s[y, 3j+a, 3k+b]: expected counts."""
    v = s.shape[1] // 3
    info, says = np.zeros((v, v)), np.zeros(v)
    total = sum(np.trace(s[y]) for y in range(2)) / v
    for y in range(2):
        cells = s[y].reshape(v, 3, v, 3).transpose(0, 2, 1, 3) + 1e-9
        n = cells.sum(axis=(2, 3), keepdims=True)
        info += (cells / total * np.log(cells * n / (cells.sum(axis=3, keepdims=True) * cells.sum(axis=2, keepdims=True)))).sum(axis=(2, 3))
        share = np.diagonal(s[y]).reshape(v, 3) + 1e-9
        says -= (share / total * np.log(share / share.sum(axis=1, keepdims=True))).sum(axis=1)
    info /= np.maximum(np.minimum(says[:, None], says[None, :]), 1e-9)
    parents, best, frm = [-1] * v, np.full(v, -1.0), np.full(v, -1)
    best[0] = np.inf
    left = set(range(v))
    while left:
        j = max(left, key=lambda k: (best[k], -k))
        left.remove(j)
        parents[j] = int(frm[j]) if best[j] >= least else -1
        for k in left:
            if info[j, k] > best[k]:
                best[k], frm[k] = info[j, k], j
    return parents


def maximise(s: np.ndarray, given: np.ndarray, weight: float = 5.0) -> LabelModel:
    """The model of expected counts s of pairs of votes, and given[y, l] of labels."""
    v = s.shape[1] // 3
    n = np.array([np.trace(s[y]) / v for y in range(2)])
    prior = float(np.clip((n[1] + 0.5) / (n.sum() + 1), 1e-4, 1 - 1e-4))
    parents = _forest(s)
    tables = np.zeros((2, v, 3, 3))
    accuracy, correlation = {}, {}
    single = np.array([[[s[y, 3 * j + b, 3 * j + b] for b in range(3)] for j in range(v)] for y in range(2)])
    for j, p in enumerate(parents):
        for y in range(2):
            own = (single[y, j] + 1 / 3) / (n[y] + 1)
            for a in range(3):
                cells = s[y, 3 * p + a, 3 * j : 3 * j + 3] if p >= 0 else single[y, j]
                tables[y, j, a] = (cells + weight * own) / (cells.sum() + weight)
        right, wrong = single[1, j, 1] + single[0, j, 2], single[0, j, 1] + single[1, j, 2]
        accuracy[NAMES[j]] = float((right + 0.5) / (right + wrong + 1))
        if p >= 0:  # of both saying toxic
            moved = []
            for y in range(2):
                a, b, ab = single[y, j, 1] / max(n[y], 1e-9), single[y, p, 1] / max(n[y], 1e-9), s[y, 3 * p + 1, 3 * j + 1] / max(n[y], 1e-9)
                spread = np.sqrt(a * (1 - a) * b * (1 - b))
                moved.append((ab - a * b) / spread if spread > 1e-9 else 0.0)
            correlation[f"{NAMES[p]}-{NAMES[j]}"] = float((moved[0] * n[0] + moved[1] * n[1]) / max(n.sum(), 1e-9))
    label = tuple(float((given[y, 1] + (9.0 if y else 1.0)) / (given[y].sum() + 10)) for y in range(2))
    # labels have errors, but say what the classes are
    return LabelModel(prior, parents, tables, (min(label[0], 0.1), max(label[1], 0.9)), accuracy, correlation)


def fit_label_model(patterns: DataFrame, rounds: int = 6) -> LabelModel | None:
    """The model of (votes, label, n) by expectation maximisation; a round is an aggregation of a fixed number of cells. The first
    one looks at labelled rows alone, if there are labels of both classes."""
    v, model = len(NAMES), None
    size = 9 * v * v
    taught = patterns.filter("label >= 0").select("label").distinct().count() == 2
    for _ in range(rounds):

        def expected(batches: Iterator[pd.DataFrame], model: LabelModel | None = model) -> Iterator[pd.DataFrame]:
            cells = np.zeros(2 * size + 4)
            for batch in batches:
                if not len(batch):
                    continue
                votes, labels, n = np.stack(batch["votes"].to_numpy()).astype(np.int64), batch["label"].to_numpy(), batch["n"].to_numpy(float)
                p = guess(votes, labels) if model is None else model.posterior(votes, labels)
                n = np.where(labels < 0, 0.0, n) if model is None and taught else n
                x = np.zeros((len(votes), 3 * v))
                x[np.arange(len(votes))[:, None], 3 * np.arange(v) + votes] = 1.0
                for y, w in enumerate((n * (1 - p), n * p)):
                    cells[y * size : (y + 1) * size] += (x.T @ (x * w[:, None])).ravel()
                    for k in range(2):
                        cells[2 * size + 2 * y + k] += w[labels == k].sum()
            at = np.flatnonzero(cells)
            yield pd.DataFrame({"cell": at, "value": cells[at]})

        sums = patterns.mapInPandas(expected, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        if not sums:
            return None
        cells = np.zeros(2 * size + 4)
        for cell, value in sums:
            cells[cell] = value
        model = maximise(cells[: 2 * size].reshape(2, 3 * v, 3 * v), cells[2 * size :].reshape(2, 2))
    return model


# ---- classifier

EXTRA = ["hits", "density", *NAMES[: len(INSULTS) + 3]]


def cells(n: int, votes, found, times) -> tuple[list[int], list[float]]:
    """The classifier's features of a text: how many learned terms it has, how dense they are, fixed voters, and the terms."""
    total = float(sum(times))
    first = [np.log1p(total), min(100 * total / n, 10.0) if n else 0.0, *(float(x == 1) for x in votes[: len(INSULTS) + 3])]
    at = [k for k, x in enumerate(first) if x] + [len(EXTRA) + int(t) for t in found]
    return at, [x for x in first if x] + [float(np.log1p(c)) for c in times]


@dataclass
class Model:
    """What scores texts: the learned terms, the logistic model (None: nothing to learn from), and the label model behind it."""

    terms: list[str]
    labels: LabelModel | None = None
    intercept: float = 0.0
    weights: np.ndarray | None = None

    def scores(self, rows: pd.DataFrame) -> np.ndarray:
        if self.weights is None:
            return guess(np.stack(rows["votes"].to_numpy()).astype(int), np.full(len(rows), -1)) if len(rows) else np.zeros(0)
        z = np.empty(len(rows))
        for k, (n, votes, found, times) in enumerate(zip(rows["n_words"], rows["votes"], rows["found"], rows["times"])):
            at, values = cells(n, votes, found, times)
            z[k] = self.intercept + float(np.dot(self.weights[at], values)) if at else self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def with_votes(docs: DataFrame, learned: list[str], text_col: str = "text") -> DataFrame:
    """docs with a struct __v of n_words, votes, found and times."""

    @F.pandas_udf("n_words long, votes array<tinyint>, found array<int>, times array<int>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Known(learned)
        for s in batches:
            yield pd.DataFrame([read(t, known) for t in s], columns=["n_words", "votes", "found", "times"])

    return docs.withColumn("__v", udf(F.col(text_col)))


def _fit_classifier(rows: DataFrame, model: LabelModel, width: int, most_rows: int) -> tuple[float, np.ndarray]:
    """Rows (n_words, votes, found, times, label) meet their posterior labels: once as toxic and once as clean, by weight."""

    @F.pandas_udf("double")
    def posterior(votes: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(np.stack(votes.to_numpy()).astype(np.int64), label.to_numpy()) if len(votes) else [], dtype=float)

    vector = F.udf(lambda *row: SparseVector(width, dict(zip(*cells(*row)))), VectorUDT(), useArrow=True)
    n = rows.count()
    part = F.pmod(F.xxhash64("doc", "n_words"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_rows / max(n, 1)))
    seen = rows.filter(part).select(posterior("votes", "label").alias("p"), vector("n_words", "votes", "found", "times").alias("x"))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("p")).alias("w"))))
    train = cut(seen.select("x", both.alias("b")).select("x", "b.y", "b.w").filter("w > 1e-6"))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4, maxIter=100).fit(train)
    return float(fitted.intercept), fitted.coefficients.toArray()


def score(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column] = lambda i: F.lit(False), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labels: int = 30_000, most_rows: int = 20_000, most_terms: int = 1500) -> DataFrame:
    """(id, held_out, score, predicted) of every row; nothing is learned from rows whose id held_out holds for, nor from their labels."""
    out = F.coalesce(held_out(F.col("doc")), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).withColumn("held_out", out)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = cut(known.filter(~out))
    learned = learn_terms(rows, known, "doc", "t", most_labels, most_terms)
    seen = cut(with_votes(rows, learned, "t").select("doc", "held_out", "__v.*"))
    taught = seen.filter("not held_out").join(known, "doc", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    patterns = cut(taught.groupBy("votes", "label").agg(F.count("*").alias("n")))
    found, model = fit_label_model(patterns), Model(learned)
    if found is not None:
        model = Model(learned, found, *_fit_classifier(taught, found, len(EXTRA) + len(learned), most_rows))

    @F.pandas_udf("double")
    def scored(n_words: pd.Series, votes: pd.Series, found: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series(model.scores(pd.DataFrame({"n_words": n_words, "votes": votes, "found": found, "times": times})))

    rows = seen.withColumn("score", scored("n_words", "votes", "found", "times"))
    return rows.select(F.col("doc").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
