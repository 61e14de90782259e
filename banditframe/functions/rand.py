"""Random numbers as column expressions: draw k of a stream is a function of the seed and k alone.

The stream is an affine map on 30-bit integers, which can be jumped: 30 pairs of factor and term, one for each bit of k, lead
to any draw in at most 30 steps. So draws need no order, no state and no shuffle, and agree with a sequential generator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator.
FACTOR, TERM, MODULUS = 116646453, 9, 1 << 30


def jumps(bits: int = 30) -> list[tuple[int, int]]:
    """(factor, term) of 2^b steps for b below bits."""
    a, c, out = FACTOR, TERM, []
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return out


def seed_of(seed) -> int:
    if isinstance(seed, int) or isinstance(seed, float) and seed.is_integer():
        return int(seed)
    return int.from_bytes(str(seed).encode(), "big") % (1 << 20)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def jump_table() -> Column:
    return F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for b, (a, c) in enumerate(jumps())])


def state(seed, k) -> Column:
    """The integer behind draw k (from 1) of the stream of seed; both may be columns."""
    s = _col(seed if isinstance(seed, Column) else seed_of(seed)).cast("long") % F.lit(MODULUS)
    k = _col(k).cast("long")
    return F.aggregate(jump_table(), s, lambda acc, p: F.when(k.bitwiseAND(p["bit"]) != 0, (acc * p["a"] + p["c"]).bitwiseAND(F.lit(MODULUS - 1))).otherwise(acc))


def u(seed, k) -> Column:
    """Draw k (from 1) in [0, 1)."""
    return state(seed, k) / F.lit(float(MODULUS))


def random(seed, k, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(low) + F.lit(high - low) * u(seed, k)


def randint(seed, k, low: int, high: int) -> Column:
    """An integer from low to high, both included."""
    return (F.lit(low) + F.floor(F.lit(high - low + 1) * u(seed, k))).cast("long")


def gauss(seed, k, mean: float = 0.0, stdev: float = 1.0) -> Column:
    """Normal draw k (from 0). Draws come in pairs: both share the uniform draws of the pair, one its cosine, one its sine."""
    k = _col(k)
    pair = F.floor(k / 2)
    r = F.sqrt(-2 * F.ln(u(seed, 2 * pair + 1)))
    t = F.lit(2 * math.pi) * u(seed, 2 * pair + 2)
    return F.lit(mean) + F.lit(stdev) * F.when(k % 2 == 0, r * F.cos(t)).otherwise(r * F.sin(t))


def choice_index(seed, k, n: Column, weights: Column | None = None) -> Column:
    """The 0-based position of a uniform or weighted choice among n elements; a zero sum of weights is an error."""
    draw = u(seed, k)
    if weights is None:
        return F.floor(n * draw).cast("int")
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    point = draw * F.when(total > 0, total).otherwise(F.raise_error(F.lit("the sum of weights must be greater than zero")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
    step = lambda a, w: F.struct((a["sum"] + w).alias("sum"), F.when((a["at"] < 0) & (a["sum"] + w >= point), a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))
    return F.aggregate(weights, start, step, lambda a: F.when(a["at"] < 0, a["i"] - 1).otherwise(a["at"]))


def choice(seed, k, values: Column, weights: Column | None = None) -> Column:
    return F.get(values, choice_index(seed, k, F.size(values), weights))
