"""Rewards as data: a struct that says how to score an action, and the expression that does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l1(argmax: Column, action: Column) -> Column:
    """Minus the distance to the best action."""
    return -F.abs(action - argmax)


def binary(argmax: Column, action: Column, value: float | Column = 1.0) -> Column:
    """value for the best action, else 0."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.when(action.eqNullSafe(argmax), value).otherwise(F.lit(0.0))


def hamming(labels: Column, action: Column) -> Column:
    """The share of labels in common; every match in the action counts, also repeated ones."""
    common = F.size(F.filter(action, lambda a: F.array_contains(labels, a)))
    return common / (F.size(action) + F.size(labels) - common)


def discrete(actions: Column, rewards: Column, action: Column, default: float = 0.0) -> Column:
    """The reward in the action's place (the first, if it is there twice), else default; lengths must agree."""
    same = F.size(actions) == F.size(rewards)
    at = F.when(same, F.array_position(actions, action)).otherwise(F.raise_error(F.lit("actions and rewards must have the same length")))
    return F.when(at > 0, F.get(rewards, (at - 1).cast("int"))).otherwise(F.lit(float(default)))


def discrete_map(rewards: Column, action: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(rewards, action), F.lit(float(default)))


SPEC = "struct<kind:string,argmax:string,labels:array<string>,value:double,map:map<string,double>,default:double>"


def spec(kind: str, argmax: Column | None = None, labels: Column | None = None, value: float = 1.0, map_: Column | None = None, default: float = 0.0) -> Column:
    """A reward as a struct; kind is L1, Binary, Hamming or Discrete."""
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        (argmax if argmax is not None else none).cast("string").alias("argmax"),
        (labels if labels is not None else none).cast("array<string>").alias("labels"),
        F.lit(float(value)).alias("value"),
        (map_ if map_ is not None else none).cast("map<string,double>").alias("map"),
        F.lit(float(default)).alias("default"),
    )


def evaluate(rewards: Column, action: Column) -> Column:
    """The value of a reward struct at an action. A Hamming reward takes a label list, split at '|' if it is text."""
    a = action.cast("string")
    return (
        F.when(rewards["kind"] == "L1", l1(rewards["argmax"].try_cast("double"), a.try_cast("double")))
        .when(rewards["kind"] == "Binary", F.when(a.eqNullSafe(rewards["argmax"]), rewards["value"]).otherwise(0.0))
        .when(rewards["kind"] == "Hamming", hamming(rewards["labels"], F.split(a, r"\|")))
        .otherwise(F.coalesce(F.try_element_at(rewards["map"], a), rewards["default"]))
    )


def to_json(rewards: Column) -> Column:
    """{kind: state}, the form in which a result log keeps a reward."""
    state = (
        F.when(rewards["kind"] == "L1", rewards["argmax"])
        .when(rewards["kind"] == "Binary", F.to_json(F.struct(rewards["argmax"].alias("argmax"), rewards["value"].alias("value"))))
        .when(rewards["kind"] == "Hamming", F.to_json(rewards["labels"]))
        .otherwise(F.to_json(F.struct(rewards["map"].alias("map"), rewards["default"].alias("default"))))
    )
    return F.concat(F.lit('{"'), rewards["kind"], F.lit('Reward":'), state, F.lit("}"))
