"""Reducers: an accumulator type with an identity, a way to lift elements into it, and an associative operation.

A reducer with ``aggregate`` is commutative and runs as a built-in aggregate with partial sums; one with
``plan`` brings a plan of its own; any other is folded in the order of positions (see ``operators.reducing``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and largest values of the numeric types, the identities of max and min.
LIMITS = {
    "tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1),
    "float": (-3.4028234663852886e38, 3.4028234663852886e38), "double": (-1.7976931348623157e308, 1.7976931348623157e308),
}
#: The same for times, as SQL.
TIME_LIMITS = {"date": ("0001-01-01", "9999-12-31"), "timestamp": ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"), "timestamp_ntz": ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999")}
_DECIMAL = re.compile(r"decimal\((\d+),(-?\d+)\)")


def limits(kind: str) -> tuple[Column, Column]:
    """Least and largest value of an ordered type."""
    if m := _DECIMAL.fullmatch(kind):
        digits, scale = int(m[1]), int(m[2])
        most = "9" * (digits - scale) + ("." + "9" * scale if scale else "") or "0"
        return F.lit("-" + most).cast(kind), F.lit(most).cast(kind)
    if kind in TIME_LIMITS:
        lo, hi = TIME_LIMITS[kind]
        return F.lit(lo).cast(kind), F.lit(hi).cast(kind)
    if kind not in LIMITS:
        raise ValueError(f"{kind} has no least and largest value")
    lo, hi = LIMITS[kind]
    return F.lit(lo).cast(kind), F.lit(hi).cast(kind)


Over = Callable[[Column], Column]


@dataclass(frozen=True)
class Reducer:
    """identity(type) is the accumulator for no elements, combine(left, right) the operation.

    ``result(type)`` is the accumulator's type for elements of a type and ``lift`` puts an element into one. ``aggregate``
    takes lifted elements, and what to do with each built-in aggregate (nothing, or a window). ``finish`` makes the final
    value of an accumulator. With ``skip_nan`` elements that are NaN are lifted as null, which no aggregate counts.
    """

    name: str
    identity: Callable[[str], Any]
    combine: Callable[[Column, Column], Column]
    aggregate: Callable[[Column, Over], Column] | None = None
    result: Callable[[str], str] = lambda kind: kind
    lift: Callable[[Column], Column] = lambda v: v
    finish: Callable[[Column], Column] = lambda v: v
    plan: Callable[[DataFrame, str], DataFrame] | None = None
    skip_nan: bool = False

    def zero(self, kind: str) -> Column:
        value = self.identity(kind)
        return (value if isinstance(value, Column) else F.lit(value)).cast(self.result(kind))

    def lifted(self, kind: str, v: Column) -> Column:
        v = not_nan(v) if self.skip_nan and kind in ("float", "double") else v
        return self.lift(v).cast(self.result(kind))


def _simple(f: Callable[[Column], Column]) -> Callable[[Column, Over], Column]:
    return lambda v, over=lambda c: c: over(f(v))


def _wide(kind: str) -> str:
    """The type of sums: integers in 64 bits, decimals with ten more digits."""
    if m := _DECIMAL.fullmatch(kind):
        return f"decimal({min(38, int(m[1]) + 10)},{m[2]})"
    return "bigint" if kind in ("tinyint", "smallint", "int") else "double" if kind == "float" else kind


def not_nan(v: Column) -> Column:
    """A number, or null if it is NaN."""
    return F.when(~F.isnan(v.cast("double")), v)


def least(a: Column, b: Column) -> Column:
    """The left operand unless the right one is really less; null never is."""
    return F.when(b < a, b).otherwise(a)


def greatest(a: Column, b: Column) -> Column:
    return F.when(b > a, b).otherwise(a)


plus = Reducer("plus", lambda k: 0, lambda a, b: a + b, _simple(F.sum), _wide)
#: Exact for integers (overflow raises), so it is folded, not F.product, which is a double.
multiplies = Reducer("multiplies", lambda k: 1, lambda a, b: a * b, None, _wide)
product = Reducer("product", lambda k: 1.0, lambda a, b: a * b, _simple(F.product), lambda k: "double")
min_ = Reducer("min", lambda k: limits(k)[1], least, _simple(F.min), skip_nan=True)
max_ = Reducer("max", lambda k: limits(k)[0], greatest, _simple(F.max), skip_nan=True)
logical_and = Reducer("logical_and", lambda k: True, lambda a, b: a & b, _simple(F.bool_and))
logical_or = Reducer("logical_or", lambda k: False, lambda a, b: a | b, _simple(F.bool_or))
concat = Reducer("concat", lambda k: "" if k == "string" else F.array(), lambda a, b: F.concat(a, b))
#: Both extremes as one struct; without elements they are the largest and the least value.
minmax = Reducer(
    "minmax",
    lambda k: F.struct(limits(k)[1].alias("min"), limits(k)[0].alias("max")),
    lambda a, b: F.struct(least(a["min"], b["min"]).alias("min"), greatest(a["max"], b["max"]).alias("max")),
    lambda v, over=lambda c: c: F.struct(over(F.min(v["min"])).alias("min"), over(F.max(v["max"])).alias("max")),
    lambda k: f"struct<min:{k},max:{k}>",
    lambda v: F.struct(v.alias("min"), v.alias("max")),
    skip_nan=True,
)


def make_reducer(zero: Any, combine: Callable[[Column, Column], Column], name: str = "custom", result: str | None = None, lift: Callable[[Column], Column] | None = None, finish: Callable[[Column], Column] | None = None, aggregate: Callable[[Column, Over], Column] | None = None) -> Reducer:
    """A reducer from an identity and any associative, perhaps not commutative, operation.

    ``result`` is the accumulator's type where it is not the elements', ``lift`` makes an accumulator of an element,
    ``finish`` the final value. ``aggregate`` says that order does not matter and how built-in aggregates do it.
    """
    if zero is None:
        raise ValueError("a reducer needs an identity")
    same = lambda v: v
    return Reducer(name, lambda kind: zero, combine, aggregate, (lambda kind: result) if result else (lambda kind: kind), lift or same, finish or same)


def histogram_bin(v: Column, bins: int, low: float, high: float) -> Column:
    """floor((v - low) / ((high - low) / bins)); the upper bound belongs to the last bin, others give null."""
    if bins < 1 or not low < high or math.isinf(high - low):
        raise ValueError("a histogram needs bins and finite bounds")
    v = v.cast("double")
    bin_ = F.floor((v - F.lit(float(low))) / (F.lit(float(high - low)) / F.lit(float(bins)))).cast("int")
    return F.when(F.isnan(v), None).when(v.between(low, high), F.least(bin_, F.lit(bins - 1)))


def _by_slot(counted: DataFrame, out: str) -> DataFrame:
    """One row: the values by slot as an array, in order."""
    return counted.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda e: e["value"]).alias(out))


def histogram(bins: int, low: float, high: float) -> Reducer:
    """Counts of all bins as an array; values outside the bounds are ignored."""
    every = F.sequence(F.lit(0), F.lit(bins - 1))

    def plan(rows: DataFrame, out: str) -> DataFrame:
        counted = rows.select(histogram_bin(F.col("_x"), bins, low, high).alias("slot")).where("slot is not null").groupBy("slot").agg(F.count("*").alias("_n"))
        slots = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("slot")).join(counted, "slot", "left")
        return _by_slot(slots.select("slot", F.coalesce("_n", F.lit(0)).cast("bigint").alias("value")), out)

    return Reducer(
        "histogram", lambda k: F.transform(every, lambda i: F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y),
        result=lambda k: "array<bigint>", lift=lambda v: F.transform(every, lambda i: F.coalesce(i == histogram_bin(v, bins, low, high), F.lit(False)).cast("bigint")), plan=plan,
    )


UNEQUAL = "vectors of unequal sizes"


def slots_of(rows: DataFrame, aggregate: Callable[[Column], Column]) -> DataFrame:
    """``slot, value``: an aggregate of each slot of the arrays ``_x``; raises where non-empty arrays differ in size."""
    slots = rows.select(F.size("_x").alias("_size"), F.posexplode("_x").alias("slot", "_e"))
    value = F.when(F.min("_size") != F.max("_size"), F.raise_error(F.lit(UNEQUAL))).otherwise(aggregate(F.col("_e")))
    return slots.groupBy("slot").agg(value.alias("value"))


def _vec(name: str, combine: Callable[[Column, Column], Column], aggregate: Callable[[Column], Column]) -> Reducer:
    def both(a: Column, b: Column) -> Column:
        zipped = F.zip_with(a, b, combine)
        return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).when(F.size(a) == F.size(b), zipped).otherwise(F.raise_error(F.lit(UNEQUAL)))

    return Reducer(name, lambda k: F.array(), both, result=lambda k: f"array<{_wide(k[6:-1])}>", plan=lambda rows, out: _by_slot(slots_of(rows, aggregate), out))


#: Element-wise reductions of arrays; the empty array is the identity, other sizes must agree.
vec_plus = _vec("vec_plus", lambda x, y: x + y, F.sum)
vec_multiplies = _vec("vec_multiplies", lambda x, y: x * y, F.product)
vec_min = _vec("vec_min", least, lambda v: F.min(not_nan(v)))
vec_max = _vec("vec_max", greatest, lambda v: F.max(not_nan(v)))
