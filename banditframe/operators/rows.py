"""Row shaping: names, drops, labels, encodings, structure and flattening."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head(df: DataFrame, names: list[str]) -> DataFrame:
    """Positional columns get names."""
    return df.toDF(*names)


def head_sparse(m: Column, names: dict[str, str]) -> Column:
    """Keys of a sparse row get names; others stay."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(m, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def drop(df: DataFrame, cols: list[str | int] = (), rows: Column | None = None) -> DataFrame:
    """Columns by name or position, and the rows that meet the predicate."""
    df = df.filter(~F.coalesce(rows, F.lit(False))) if rows is not None else df
    return df.drop(*[df.columns[c] if isinstance(c, int) else c for c in cols])


def drop_sparse(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def label(df: DataFrame, name: str, kind: str) -> DataFrame:
    """(features, label, kind); features are a struct of the other columns."""
    rest = [c for c in df.columns if c != name]
    return df.select(F.struct(*rest).alias("features"), F.col(name).alias("label"), F.lit(kind).alias("kind"))


def label_sparse(df: DataFrame, m: str, key: str, kind: str) -> DataFrame:
    """(features, label, kind) of sparse rows; an absent label is 0."""
    value = F.coalesce(F.try_element_at(F.col(m), F.lit(key)), F.lit(0))
    return df.withColumns({"features": drop_sparse(F.col(m), [key]), "label": value, "kind": F.lit(kind)}).drop(*({m} - {"features"}))


def encode(df: DataFrame, encoders: dict[str | int, Callable[[Column], Column]]) -> DataFrame:
    """Encoders by column name or position."""
    named = {df.columns[k] if isinstance(k, int) else k: f for k, f in encoders.items()}
    return df.withColumns({k: f(F.col(k)) for k, f in named.items()})


def encode_sparse(m: Column, encoders: dict[str, Callable[[Column], Column]], zeros: dict[str, Any] = {}) -> Column:
    """Encoders by key. zeros are the encodings of an absent value that are not zero: those keys are always present."""

    def one(k: Column, v: Column) -> Column:
        out = None
        for name, f in encoders.items():
            out = F.when(k == name, f(v)) if out is None else out.when(k == name, f(v))
        return out.otherwise(v) if out is not None else v

    made = F.transform_values(m, one)
    return default_sparse(made, zeros) if zeros else made


def default_sparse(m: Column, defaults: dict[str, Any]) -> Column:
    """Absent keys get their default."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(m, k)), m)


def fit_encode(df: DataFrame, idx: str, encoders: dict[str, tuple], using: int | None = None, missing: Any = None) -> DataFrame:
    """Encoders (aggregate of a column, function of column and fitted value) fitted on the first rows, without '' and the
    missing marker. What is fitted is one row of aggregates and reaches the rows as scalars."""
    head_ = df if using is None else df.filter(F.col(idx) < using)
    usable = lambda c: F.when(~F.col(c).cast("string").isin(*[str(v) for v in ("", missing) if v is not None]), F.col(c))
    out = {}
    for name, (fit, apply) in encoders.items():
        fitted = head_.agg(fit(usable(name)).alias("f")).scalar()
        out[name] = apply(F.col(name), fitted)
    return df.withColumns(out)


def structure(template: Any, names: list[str]) -> Column:
    """A nested projection: lists become structs, names columns, None all columns that the template doesn't use."""

    def used(t: Any) -> set:
        return {x for s in t for x in used(s)} if isinstance(t, (list, tuple)) else {t}

    rest = [n for n in names if n not in used(template)]

    def build(t: Any) -> Column:
        if isinstance(t, (list, tuple)):
            return F.struct(*[build(s).alias(s if isinstance(s, str) else f"_{i}") for i, s in enumerate(t)])
        return F.struct(*rest) if t is None else F.col(t)

    return build(template)


def flatten_dense(cells: list[tuple[Column, bool]]) -> Column:
    """One array of cells; those flagged are arrays and are spliced in."""
    return F.flatten(F.array(*[c if nested else F.array(c) for c, nested in cells]))


def flatten_sparse(m: Column) -> Column:
    """A map of arrays -> a map with keys k_0, k_1, ... (k alone for a single cell), zeros left out."""
    def spread(e: Column) -> Column:
        return F.transform(e["value"], lambda v, i: F.struct(F.when(F.size(e["value"]) == 1, e["key"]).otherwise(F.concat(e["key"], F.lit("_"), i.cast("string"))).alias("key"), v.alias("value")))

    return F.map_filter(F.map_from_entries(F.flatten(F.transform(F.map_entries(m), spread))), lambda _, v: v != 0)


def flatten_interactions(df: DataFrame) -> DataFrame:
    """context and each action, arrays of arrays, become arrays."""
    out = df
    if dict(df.dtypes)["context"].startswith("array<array"):
        out = out.withColumn("context", F.flatten("context"))
    if dict(df.dtypes)["actions"].startswith("array<array<array"):
        out = out.withColumn("actions", F.transform("actions", F.flatten))
    return out
