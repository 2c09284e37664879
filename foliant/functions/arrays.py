"""Arrays of numbers: softmax, first maximum, entropy, resampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where lambdas use it for every element."""
    # A fold over no elements: its start is the value. An item of a transformed array would derive its type anew for every row.
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, use)


def softmax(x: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp((v.cast("double") - top.cast("double")) / t)))
    return let(F.struct(e.alias("e"), total(e).alias("t")), lambda s: F.transform(s["e"], lambda v: v / s["t"]))


def argmax(x: Column) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))


def entropy(x: Column) -> Column:
    """Of the array's shares, in bits over the bits of its length (1 at least); 0 of an array without weight."""
    logs = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v > 0, v * F.log2(v)).otherwise(0.0))
    bits = F.greatest(F.lit(1.0), F.log2(F.size(x).cast("double")))
    return let(total(x), lambda whole: F.when(whole > 0, (F.log2(whole) - logs / whole) / bits).otherwise(0.0))


def sign_hash(x: Column, start: int, bits: int) -> Column:
    """The signs of a run of components as the bits of a number."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft((x[start + k] > 0).cast("long"), k))
    return out


def resample(x: Column, size: int) -> Column:
    """Linear interpolation to ``size`` evenly spaced places."""

    def sampled(v: Column) -> Column:
        def at(i: Column) -> Column:
            place = i.cast("double") * (F.size(v) - 1) / max(1, size - 1)
            low = F.floor(place).cast("int")
            return v[low] + (v[F.least(low + 1, F.size(v) - 1)] - v[low]) * (place - low)

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)

    return let(x, sampled)
