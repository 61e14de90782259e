"""Encoders as (fit, apply) pairs: fitting is an aggregate, applying is a column expression."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(c: Column) -> Column:
    return c


def string(c: Column) -> Column:
    return c.cast("string")


def numeric(c: Column) -> Column:
    """A double; what can't be read is NaN, null stays null."""
    return F.when(c.isNotNull(), F.coalesce(c.cast("string").try_cast("double"), F.lit(float("nan"))))


def missing(c: Column, encoder=identity, values: tuple = ("?", ""), replacement=None) -> Column:
    """replacement for the marker values, the encoding of all others."""
    return F.when(c.cast("string").isin(*values), F.lit(replacement)).otherwise(encoder(c))


def levels(df: DataFrame, value: str, order: list[str] | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, levels): distinct values in order of first appearance, or sorted if no order is given. Levels of a categorical
    are few by nature: one array for each key."""
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order) if order else F.struct(value)).alias("__o"))
    lists = values.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__o", value))).alias("__l"))
    return lists.select(*keys, F.col("__l")[value].alias("levels"))


def _position(c: Column, levels_: Column, error: bool, what: str) -> Column:
    at = F.array_position(levels_, c)
    return F.when(at == 0, F.raise_error(F.concat(F.lit(f"{what}: unknown value "), c.cast("string")))).otherwise(at) if error else at


def onehot(c: Column, levels_: Column, error: bool = False) -> Column:
    """An array of 0 and 1; an unknown value is all zeros, or an error."""
    at = _position(c, levels_, error, "one-hot")
    return F.transform(levels_, lambda _, i: F.when(i + 1 == at, 1).otherwise(0))


def categorical(c: Column, levels_: Column) -> Column:
    """The 0-based level; an unknown value is an error."""
    return (_position(c, levels_, True, "categorical") - 1).cast("int")


def factor(c: Column, levels_: Column, error: bool = False) -> Column:
    """The 1-based level as a number; an unknown value is NaN, or an error."""
    at = _position(c, levels_, error, "factor")
    return F.when(at == 0, F.lit(float("nan"))).otherwise(at.cast("double"))


def bucket(key: Column, n: int) -> Column:
    """The slot of a feature name by CRC-32."""
    return (F.crc32(key) % n).cast("int")


def minimize(c: Column, dtype: str, digits: int = 5) -> Column:
    """Numbers rounded, in arrays and maps too; what isn't finite stays."""
    if dtype == "double" or dtype == "float":
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.round(c, digits))
    if dtype.startswith("array<"):
        return F.transform(c, lambda x: minimize(x, dtype[6:-1], digits))
    if dtype.startswith("map<"):
        return F.transform_values(c, lambda _, v: minimize(v, dtype[4:-1].split(",", 1)[1], digits))
    return c


# ---- crosses of namespaces


def _powers(n: int, k: int) -> list[tuple[int, ...]]:
    return list(combinations_with_replacement(range(n), k))


def crosses(names: dict[str, tuple[Column, int]], terms: list) -> Column:
    """An array of cross terms of dense namespaces: names maps a letter to (array, its width). Numbers among the terms add up to
    one constant, first; a letter repeated k times stands for all monomials of degree k with repetition, each once."""
    constant = sum(t for t in terms if not isinstance(t, str))
    out = [F.array(F.lit(float(constant)))] if constant else []
    for t in terms:
        if not isinstance(t, str):
            continue
        parts = []
        for letter in dict.fromkeys(t):
            values, width = names[letter]
            k = t.count(letter)
            if k == 1:
                parts.append(F.transform(values, lambda x: x.cast("double")))
            else:
                index = F.array(*[F.array(*[F.lit(i) for i in p]) for p in _powers(width, k)])
                parts.append(_monomials(values, index))
        cross = parts[0]
        for p in parts[1:]:
            cross = _outer(cross, p)
        out.append(cross)
    return F.flatten(F.array(*out))


def _monomials(values: Column, index: Column) -> Column:
    return F.transform(index, lambda p: F.aggregate(p, F.lit(1.0), lambda a, i: a * F.get(values, i)))


def _outer(a: Column, b: Column) -> Column:
    """Products of all pairs, the first one's elements outermost."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def sparse_crosses(names: dict[str, Column], terms: list) -> Column:
    """The same for maps: keys are joined, values multiplied; the constant has the key 'const'. Monomials of a repeated letter
    come from keys in sorted order, so each is made once."""
    constant = sum(t for t in terms if not isinstance(t, str))
    out = [F.create_map(F.lit("const"), F.lit(float(constant)))] if constant else []
    for t in terms:
        if isinstance(t, str):
            entries = None
            for letter in dict.fromkeys(t):
                own = F.sort_array(F.map_entries(names[letter]))
                part = F.transform(own, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value"), e["key"].alias("last")))
                for _ in range(t.count(letter) - 1):
                    part = F.flatten(_extend(part, own))
                entries = part if entries is None else _pairs(entries, part)
            out.append(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"]))))
    return F.map_concat(*out)


def _extend(part: Column, own: Column) -> Column:
    grow = lambda a: F.transform(F.filter(own, lambda e: e["key"] >= a["last"]), lambda e: F.struct(F.concat(a["key"], e["key"]).alias("key"), (a["value"] * e["value"]).cast("double").alias("value"), e["key"].alias("last")))
    return F.transform(part, grow)


def _pairs(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.concat(x["key"], y["key"]).alias("key"), (x["value"] * y["value"]).alias("value"), y["last"].alias("last")))))
