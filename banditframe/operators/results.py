"""The result star schema: environments, learners, evaluators, and their interactions, with the queries that compare them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from banditframe.functions import stats
from banditframe.plans.index import with_index
from banditframe.plans.prefix import faded, numbered, running, sliding

ENV, LRN, VAL, INDEX = "environment_id", "learner_id", "evaluator_id", "index"
TRIPLE = [ENV, LRN, VAL]
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=", "in", "!in", "match")


# ---- predicates -----------------------------------------------------------------------------------------------------


def _match(c: Column, dtype: str, p: Any) -> Column:
    """Number against number is equality, number against text a whole number inside it, text a regular expression."""
    number = dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal")
    if isinstance(p, (int, float)) and not isinstance(p, bool):
        return c == p if number else c.cast("string").rlike(rf"(\D|^){p}(\D|$)")
    return c.cast("string").rlike(str(p))


def predicate(df: DataFrame, name: str, value: Any, comparison: str | None = None) -> Column:
    """One keyword of `where`: a value, a list, a function of a column, or {comparison: value}."""
    c, dtype = F.col(name), dict(df.dtypes)[name]
    if callable(value):
        return value(c)
    if comparison is None and isinstance(value, dict) and len(value) == 1 and next(iter(value)) in COMPARISONS:
        comparison, value = next(iter(value.items()))
    listed = isinstance(value, (list, tuple, set, range))
    if comparison is None:
        comparison = "in" if listed else "="
    if comparison in ("in", "!in"):
        values = list(value) if listed else [value]
        known = [v for v in values if v is not None]
        found = c.isin(known) if known else F.lit(False)
        found = F.coalesce(found, F.lit(False)) | (c.isNull() if len(known) < len(values) else F.lit(False))
        return ~found if comparison == "!in" else found
    if comparison == "match":
        return _match(c, dtype, value)
    if comparison == "=":
        return c.eqNullSafe(F.lit(value))
    if comparison == "!=":
        return ~c.eqNullSafe(F.lit(value))
    return {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[comparison]


def where(df: DataFrame, row_pred: Column | None = None, comparison: str | None = None, **kwargs: Any) -> DataFrame:
    """Rows that meet any of the keywords (they are alternatives), or the row predicate."""
    preds = [predicate(df, k, v, comparison) for k, v in kwargs.items()]
    if row_pred is not None:
        preds.append(row_pred)
    return df.filter(reduce(or_, preds)) if preds else df


def columns(df: DataFrame, key: str | list[str] | slice) -> DataFrame:
    """Columns by name, list of names, or slice of positions."""
    if isinstance(key, slice):
        return df.select(*df.columns[key])
    return df.select(*([key] if isinstance(key, str) else key))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended; columns that one side lacks are null there, new ones come last in order of name."""
    out = df.unionByName(rows, allowMissingColumns=True)
    return out.select(*df.columns, *sorted(c for c in out.columns if c not in df.columns))


def index(df: DataFrame, *cols: str) -> DataFrame:
    """Rows ordered by the given columns, missing values last; names that are not columns are left out."""
    known = [F.col(c).asc_nulls_last() for c in cols if c in df.columns]
    return df.orderBy(*known) if known else df


def group_table(df: DataFrame, keys: list[str], select: None | str | list[str] = None, order: str = INDEX) -> DataFrame:
    """Keys, their counts, or their values as lists in order."""
    if select is None:
        return df.select(*keys).distinct()
    if select == "count":
        return df.groupBy(*keys).agg(F.count("*").alias("count"))
    names = [select] if isinstance(select, str) else select
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *names))).alias("__l"))
    return lists.select(*keys, *[F.col("__l")[n].alias(n) for n in names])


def digest(df: DataFrame) -> Row:
    """A number of rows and two sums of hashes that do not depend on their order: one pass without a shuffle of rows. Tables of equal
    rows have equal digests; others have, but for one in 2^100."""
    plain = [(F.col(c) + F.lit(0.0)).cast(t) if t in ("float", "double") else F.col(c) for c, t in sorted(df.dtypes)]  # -0.0 is 0.0
    sums = [F.sum(F.xxhash64(F.lit(k), *plain).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    return df.agg(F.count("*").alias("n"), *sums).first()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows, each as often. Digests tell most tables apart; where they agree, rows are counted for one side
    and against the other, in one shuffle. Columns of floating point numbers inside others are only counted."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    nested = any(("float" in t or "double" in t) and t not in ("float", "double") for _, t in a.dtypes)
    if dict(a.dtypes) == dict(b.dtypes) and not nested and digest(a) != digest(b):
        return False
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("__side").alias("__d")).filter("__d <> 0").isEmpty()


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a and only_b, how many rows either has more of, by one shuffle."""
    both = a.withColumn("__side", F.lit(1).cast("long")).unionByName(b.withColumn("__side", F.lit(-1).cast("long")))
    d = F.col("__d")
    counts = both.groupBy(*a.columns).agg(F.sum("__side").alias("__d"))
    return counts.agg(F.coalesce(F.sum(F.greatest(d, F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-d, F.lit(0))), F.lit(0)).alias("only_b"))


# ---- averages over an index -----------------------------------------------------------------------------------------


def moving_average(df: DataFrame, y: str, span: int | None = None, weights: str | None = None, keys: list[str] = TRIPLE, idx: str = INDEX, out: str = "mean") -> DataFrame:
    """df with the mean of y so far (span None), or of the last span rows; weights name a column, or 'exp' for weights that
    fade by 1 - 2/(1 + span) a row. Sums run in blocks of rows, so a long triple spreads over many tasks."""
    if span == 1 and (weights is None or weights == "exp"):
        return df.withColumn(out, F.col(y).cast("double"))
    if weights == "exp":
        return exponential(df, y, span, keys, idx, out)
    w = F.lit(1.0) if weights is None else F.col(weights)
    top, low = w * F.col(y), F.when(F.col(y).isNotNull(), w)
    if span is None:
        rows = running(df, keys, idx, {"__s": top, "__w": low})
    else:
        at = numbered(df, keys, idx, "__at")
        rows = sliding(at, keys, "__at", span, {"__s": lambda over: F.sum(top).over(over), "__w": lambda over: F.sum(low).over(over)})
    return rows.withColumn(out, F.try_divide("__s", "__w")).select(*[c for c in df.columns if c != out], out)


def exponential(df: DataFrame, y: str, span: int, keys: list[str] = TRIPLE, idx: str = INDEX, out: str = "mean") -> DataFrame:
    """The exponential mean: the faded sum of the values over that of ones."""
    at = numbered(df, keys, idx, "__at")
    rows = faded(at, keys, "__at", {"__s": F.col(y), "__w": F.lit(1.0)}, 1 - 2 / (1 + span))
    return rows.withColumn(out, F.col("__s") / F.col("__w")).select(*[c for c in df.columns if c != out], out)


# ---- the four tables ------------------------------------------------------------------------------------------------


def full_names(learners: DataFrame) -> DataFrame:
    """learners with full_name: id, family, and the other parameters that are not null, in column order."""
    rest = [c for c in learners.columns if c not in (LRN, "family", "full_name")]
    shown = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in rest])) if rest else F.array().cast("array<string>")
    family = F.col("family") if "family" in learners.columns else F.col(LRN).cast("string")
    args = F.when(F.size(shown) > 0, F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")"))).otherwise("")
    if {"args", "seed"} <= set(learners.columns):
        args = F.when(family == "vw", F.concat(F.lit("("), F.col("args"), F.lit(", seed="), F.col("seed").cast("string"), F.lit(")"))).otherwise(args)
    return learners.withColumn("full_name", F.concat(F.col(LRN).cast("string"), F.lit(". "), family, args))


@dataclass(frozen=True)
class Result:
    environments: DataFrame
    learners: DataFrame
    evaluators: DataFrame
    interactions: DataFrame

    # -- joins and filters

    def _dims(self) -> dict[str, tuple[str, DataFrame]]:
        return {"environments": (ENV, self.environments), "learners": (LRN, self.learners), "evaluators": (VAL, self.evaluators)}

    def joined(self, cols: list[str] | None = None) -> DataFrame:
        """The interactions with the columns of all dimensions (or those asked for). Dimensions are one row an id; whether they
        are broadcast is decided by their size."""
        out = self.interactions
        for id_, dim in self._dims().values():
            dim = full_names(dim) if id_ == LRN and "full_name" not in dim.columns and (cols is None or "full_name" in cols) else dim
            names = [c for c in dim.columns if c != id_ and c not in out.columns and (cols is None or c in cols)]
            if names:
                out = out.join(dim.select(id_, *names), id_)
        return out

    def _pruned(self, facts: DataFrame, *but: str) -> "Result":
        dims = {n: dim if n in but else dim.join(facts.select(id_).distinct(), id_, "left_semi") for n, (id_, dim) in self._dims().items()}
        return Result(interactions=facts, **dims)

    def _filter_dim(self, name: str, pred: Column | None, kwargs: dict) -> "Result":
        id_, dim = self._dims()[name]
        kept = where(dim, pred, **kwargs)
        return replace(self, **{name: kept})._pruned(self.interactions.join(kept.select(id_), id_, "left_semi"), name)

    def filter_env(self, pred: Column | None = None, **kwargs: Any) -> "Result":
        return self._filter_dim("environments", pred, kwargs)

    def filter_lrn(self, pred: Column | None = None, **kwargs: Any) -> "Result":
        return self._filter_dim("learners", pred, kwargs)

    def filter_val(self, pred: Column | None = None, **kwargs: Any) -> "Result":
        return self._filter_dim("evaluators", pred, kwargs)

    def filter_int(self, pred: Column | None = None, **kwargs: Any) -> "Result":
        return self._pruned(where(self.interactions, pred, **kwargs))

    def where(self, **kwargs: Any) -> "Result":
        """Each keyword goes to the first table that has its column; tables combine by and, keywords of one table by or."""
        out, todo = self, dict(kwargs)
        for name, f in (("environments", "filter_env"), ("learners", "filter_lrn"), ("evaluators", "filter_val"), ("interactions", "filter_int")):
            own = {k: todo.pop(k) for k in list(todo) if k in getattr(self, name).columns}
            if own:
                out = getattr(out, f)(**own)
        if todo:
            raise ValueError(f"no table has the columns {sorted(todo)}")
        return out

    def remove(self, triples: DataFrame, n: int = 0) -> DataFrame:
        """The interactions without those of the triples, or without theirs after the first n."""
        if not n:
            return self.interactions.join(triples.select(*TRIPLE), TRIPLE, "left_anti")
        marked = self.interactions.join(triples.select(*TRIPLE).withColumn("__cut", F.lit(True)), TRIPLE, "left")
        return marked.filter(F.col("__cut").isNull() | (F.col(INDEX) <= n)).drop("__cut")

    def counts(self) -> DataFrame:
        one = lambda name, df: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        return one("environments", self.environments).union(one("learners", self.learners)).union(one("evaluators", self.evaluators)).union(one("interactions", self.interactions))

    # -- even outcomes

    def _levels(self, *cols: str) -> DataFrame:
        """One row a triple, with the columns asked for."""
        triples = self.interactions.select(*TRIPLE).distinct()
        return replace(self, interactions=triples).joined(list(cols))

    def pairing(self, l: str | list[str], p: str | list[str]) -> DataFrame:
        """(triple, p, rows, levels): how many rows each value of p has against the number of values of l. Rows count, not
        distinct values of l, so two rows for one value are too many."""
        ls, ps = _list(l), _list(p)
        rows = self._levels(*ls, *ps).withColumns({"__p": F.struct(*ps), "__l": F.struct(*ls)})
        levels = rows.agg(F.countDistinct("__l").alias("levels"))
        sizes = rows.groupBy("__p").agg(F.count("*").alias("rows"))
        return rows.join(sizes.withColumnRenamed("__p", "__q"), F.col("__p").eqNullSafe(F.col("__q"))).withColumn("levels", levels.scalar()).drop("__q")

    def filter_fin(self, n: int | str | None = None, l: str | list[str] | None = None, p: str | list[str] | None = None) -> "Result":
        """Triples whose pairing is complete, cut to n rows ('min': the shortest triple's)."""
        out = self
        if l or p:
            even = out.pairing(l or LRN, p or ENV).filter("rows = levels").select(*TRIPLE)
            out = out._pruned(out.interactions.join(even, TRIPLE, "left_semi"))
        if n:
            sizes = out.interactions.groupBy(*TRIPLE).agg(F.count("*").alias("__n"))
            if n == "min":
                least = sizes.agg(F.min("__n").alias("n")).scalar()
                return replace(out, interactions=out.interactions.filter(F.col(INDEX) <= least))
            long = out.interactions.join(sizes.filter(F.col("__n") >= n), TRIPLE, "left_semi").filter(F.col(INDEX) <= n)
            out = out._pruned(long)
        return out

    def removed(self, n: int | None = None, l: str | list[str] = LRN, p: str | list[str] = ENV) -> DataFrame:
        """What filter_fin takes out, as (reason, number) rows."""
        groups = self.pairing(l, p).groupBy("__p").agg(F.first("rows").alias("rows"), F.first("levels").alias("levels"))
        out = groups.agg(F.count_if(F.expr("rows > levels")).alias("too many"), F.count_if(F.expr("rows < levels")).alias("too few"))
        out = out.unpivot([], ["too many", "too few"], "reason", "number")
        if n:
            sizes = self.filter_fin(None, l, p).interactions.groupBy(*TRIPLE).count()
            out = out.union(sizes.agg(F.count_if(F.col("count") < n)).select(F.lit("shorter"), "*")).union(sizes.agg(F.count_if(F.col("count") > n)).select(F.lit("shortened"), "*"))
        return out

    def filter_best(self, l: str | list[str], p: str | list[str], y: str = "reward", n: int | None = None, full_l: str | list[str] = LRN, full_p: str | list[str] = ENV) -> "Result":
        """For each p and l only the full_l of the largest mean; of equal means the last in order."""
        fin = self.filter_fin(None, full_l, full_p)
        heads = fin.interactions if n is None else fin.interactions.filter(F.col(INDEX) <= n)
        means = replace(fin, interactions=heads.groupBy(*TRIPLE).agg(F.avg(y).alias("__m"))).joined([*_list(l), *_list(p), *_list(full_l)])
        means = means.withColumns({"__l": F.struct(*_list(l)), "__p": F.struct(*_list(p)), "__f": F.struct(*_list(full_l))})
        best = means.groupBy("__p", "__l", "__f").agg(F.avg("__m").alias("__m"))
        best = best.groupBy("__p", "__l").agg(F.max(F.struct("__m", "__f")).alias("b")).select("__p", "__l", F.col("b.__f").alias("__f"))
        return fin._pruned(fin.interactions.join(means.join(best, ["__p", "__l", "__f"], "left_semi"), TRIPLE, "left_semi"))

    # -- analysis tables

    def faults(self, x: str | list[str], y: str) -> list[str]:
        """What keeps a table of y over x from being made."""
        out = [] if y in self.interactions.columns else [f"{y} is not a column of the interactions"]
        if INDEX in _list(x) and len(_list(x)) > 1:
            out.append("the x-axis can't be index and a parameter")
        return out + (["there is no data"] if self.interactions.isEmpty() else [])

    def _check(self, x: str | list[str], y: str) -> None:
        if found := self.faults(x, y):
            raise ValueError(found[0])

    def grouped(self, keys: list[str], y: str, func: str | None = None, span: int | None = 1) -> DataFrame:
        """keys with the values of y: a moving average a row where a key is an interaction column, else 'last' (the mean of the
        last span rows; of all rows for None) or the 'list' of a triple."""
        own = [k for k in keys if k in self.interactions.columns and k not in TRIPLE]
        if own:
            return replace(self, interactions=moving_average(self.interactions, y, span, out="__y")).joined(keys).select(*keys, F.col("__y").alias("y"))
        if func == "list":
            lists = group_table(self.interactions, TRIPLE, y).withColumnRenamed(y, "__y")
        elif span is None:
            lists = self.interactions.groupBy(*TRIPLE).agg(F.avg(y).alias("__y"))
        else:
            sizes = self.interactions.groupBy(*TRIPLE).agg(F.count("*").alias("__n"))
            last = numbered(self.interactions, TRIPLE, INDEX, "__at").join(sizes, TRIPLE).filter(F.col("__at") >= F.col("__n") - span)
            lists = last.groupBy(*TRIPLE).agg(F.avg(y).alias("__y"))
        return replace(self, interactions=lists).joined(keys).select(*keys, F.col("__y").alias("y"))

    def raw_learners(self, x: str | list[str] = INDEX, y: str = "reward", l: str | list[str] = LRN, p: str | list[str] | None = ENV, span: int | None = None, wide: bool = False) -> DataFrame:
        """Long rows (l, x, y), or one column a label with the list of y of each x, in order of environment and evaluator, or
        [NaN] where a label has none."""
        self._check(x, y)
        even = self.filter_fin("min" if x == INDEX else None, l, p) if p else self
        if not wide:
            return even.grouped([*_list(l), *_list(x)], y, span=span)
        order = [k for k in (ENV, VAL, LRN) if k not in _list(l)]
        rows = even.grouped(list(dict.fromkeys([*_list(l), *_list(x), *order])), y, span=span)
        label = F.concat_ws(", ", *[F.col(c).cast("string") for c in _list(l)])
        out = rows.withColumn("__label", label).groupBy(*_list(x)).pivot("__label")
        out = out.agg(F.sort_array(F.collect_list(F.struct(*order, "y")))["y"])
        none = F.array(F.lit(float("nan")))
        return out.select(*_list(x), *[F.when(F.size(F.col(f"`{c}`")) > 0, F.col(f"`{c}`")).otherwise(none).alias(c) for c in out.columns if c not in _list(x)]).orderBy(*_list(x))

    def raw_contrast(self, l1: Any, l2: Any, x: str | list[str] = ENV, y: str = "reward", l: str = LRN, p: str | list[str] = ENV, span: int | None = None) -> DataFrame:
        """(x, y1, y2) for each pair of rows of the two sides that agree in p; over an index also in the index."""
        self._check(x, y)
        one, two = (list(v) if isinstance(v, (list, tuple)) else [v] for v in (l1, l2))
        if set(one) & set(two):
            raise ValueError("a value can't be on both sides")
        ps, xs = _list(p), _list(x)

        def side(values: list, name: str) -> DataFrame:
            rows = self.where(**{l: values}).grouped(list(dict.fromkeys([*ps, *xs])), y, span=span)
            return rows.select(F.struct(*ps).alias("p"), (F.col(xs[0]) if len(xs) == 1 else F.struct(*xs)).alias(f"x{name}"), F.col("y").alias(f"y{name}"))

        a, b = side(one, "1"), side(two, "2")
        if x == INDEX:
            return a.withColumnRenamed("x1", "x").join(b.withColumnRenamed("x2", "x"), ["p", "x"]).select("x", "y1", "y2")
        text = lambda c: F.col(c).cast("string")
        return a.join(b, "p").select(F.when(F.col("x1").eqNullSafe(F.col("x2")), text("x1")).otherwise(F.concat(text("x2"), F.lit("-"), text("x1"))).alias("x"), "y1", "y2")

    def learner_curves(self, x: str = INDEX, y: str = "reward", l: str = LRN, p: str | list[str] | None = ENV, span: int | None = None, err: Any = None, errevery: int = 1, top_n: int | None = None) -> DataFrame:
        """(l, x, y, lower, upper, rank): a point and interval for each label and x; curves are ranked by their last y."""
        rows = self.raw_learners(x, y, l, p, span)
        points = stats.points(rows, [l, x], "y", err)
        if errevery > 1:
            shown = F.col("__at") % errevery == 0
            points = with_index(points, [l], [x], "__at", 1)
            points = points.withColumns({"lower": F.when(shown, F.col("lower")).otherwise(0.0), "upper": F.when(shown, F.col("upper")).otherwise(0.0)}).drop("__at")
        last = points.groupBy(l).agg(F.max_by("y", x).alias("__last"))
        ranks = last.withColumn("rank", F.row_number().over(Window.orderBy(F.col("__last").desc(), l)).cast("long")).drop("__last")
        if top_n:
            ranks = ranks.filter(F.col("rank") <= top_n) if top_n > 0 else ranks.filter(F.col("rank") > ranks.agg(F.max("rank").alias("m")).scalar() + top_n)
        return points.join(ranks, l)

    def contrast_points(self, l1: Any, l2: Any, x: str = ENV, y: str = "reward", l: str = LRN, p: str | list[str] = ENV, mode: Any = "diff", span: int | None = None, err: Any = None) -> DataFrame:
        """(x, y, lower, upper, outcome): the difference of the sides, or how often the second is above the first, and who wins
        by the interval against the boundary."""
        pairs = self.raw_contrast(l1, l2, x, y, l, p, span)
        value = F.col("y2") - F.col("y1") if mode == "diff" else (F.col("y2") > F.col("y1")).cast("int") if mode == "prob" else mode(F.col("y1"), F.col("y2"))
        points = stats.points(pairs.withColumn("v", value), ["x"], "v", err)
        b = 0.0 if mode == "diff" else 0.5
        outcome = F.when(F.col("y") + F.col("upper") < b, "l1").when(F.col("y") - F.col("lower") > b, "l2").otherwise("tie")
        return points.withColumn("outcome", outcome)


def _list(x: str | list[str] | tuple) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def from_logged(rows: DataFrame, env_params: list[str], lrn_params: list[str], order: list[str], include_prob: bool = False, evaluator: str = "unknown") -> Result:
    """A result of logged interactions: ids follow the first appearance of distinct parameters. Environments whose column `logged`,
    if there is one, is not true are left out; where rewards are arrays, rows are batches and their values become means."""
    from banditframe.operators.ids import first_appearance

    if "logged" in rows.columns:
        rows = rows.filter("logged").drop("logged")
    numbers = ("array<double>", "array<float>", "array<int>", "array<bigint>")
    batches = dict(rows.dtypes).get("reward") in numbers
    batched = [c for c, t in rows.dtypes if batches and t in numbers and c not in ("context", "actions", "rewards", *env_params, *lrn_params, *order)]
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), F.size(c))
    rows = rows.withColumns({c: mean(c) for c in batched})
    envs = first_appearance(rows, env_params, order, ENV)
    lrns = first_appearance(rows, lrn_params, order, LRN)
    keep = rows.join(envs, env_params).join(lrns, lrn_params).withColumn(VAL, F.lit(0))
    keep = with_index(keep, TRIPLE, order, INDEX, 1)
    gone = {"context", "actions", "rewards", *env_params, *lrn_params} | (set() if include_prob else {"probability"})
    facts = keep.select(*TRIPLE, INDEX, *[c for c in keep.columns if c not in gone and c not in (*TRIPLE, INDEX)])
    vals = rows.sparkSession.range(1).select(F.lit(0).alias(VAL), F.lit(evaluator).alias("eval_type"))
    return Result(envs.select(ENV, *env_params), lrns.select(LRN, *lrn_params), vals, facts)


def to_logged(result: Result) -> DataFrame:
    """One environment a triple, with the parameters of all its dimensions (the later table's, where names meet); columns that
    are null in every row are left out."""
    facts = result.interactions
    used = facts.agg(*[F.count(c).alias(c) for c in facts.columns]).first()
    facts = facts.select(*[c for c in facts.columns if used[c]])
    if not {"actions", "rewards"} <= set(facts.columns) and not {"action", "reward"} <= set(facts.columns):
        raise ValueError("the interactions need actions and rewards, or action and reward")
    out = facts
    for id_, dim in ((ENV, result.environments), (LRN, result.learners), (VAL, result.evaluators)):
        out = out.drop(*[c for c in dim.columns if c != id_ and c in out.columns and c not in facts.columns]).join(dim, id_)
    return out
