"""Inclusive prefix scans in levels.

Blocks of positions are scanned on their own, block totals are scanned by the same method, and the total of the
blocks before is combined from the left. With blocks of 65,536 elements a third level has a row for 2**32 elements, so
its window stays small at any size; small inputs go without it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.reducers import Reducer, plus
from rankflow.plans.policy import PAR, Policy
from rankflow.plans.positions import one_level
from rankflow.seq import Seq

#: Elements of a block of scans that go through an array, and totals that one window may hold.
ARRAY_BLOCK, ONE_WINDOW = 512, 1 << 16


def scan(seq: Seq, reducer: Reducer = plus, f: Callable[..., Column] | None = None, init: Any = None, out: str = "value", policy: Policy = PAR) -> Seq:
    """out[i] = init, f(x0), ..., f(xi) combined in order; init, an accumulator, is the identity by default."""
    x = (f(*[F.col(c) for c in seq.columns]) if f else F.col(seq.columns[0])).alias("_x")
    rows = seq.df.select("pos", x)
    kind = dict(rows.dtypes)["_x"]
    result = reducer.result(kind)
    rows = rows.withColumn("_x", reducer.lifted(kind, F.col("_x")))
    scanned = _scan(rows, reducer, policy.cutoff if reducer.aggregate is not None else max(2, min(policy.cutoff, ARRAY_BLOCK)), reducer.zero(kind), seq._length)
    start = reducer.zero(kind) if init is None else (init if isinstance(init, Column) else F.lit(init)).cast(result)
    return Seq(scanned.select("pos", reducer.finish(reducer.combine(start, F.col("_x")).cast(result)).alias(out)), length=seq._length)


def _array_scan(rows: DataFrame, reducer: Reducer, block: int) -> DataFrame:
    """Blocks as arrays, scanned in doubling steps: after step d an element holds itself and the 2d - 1 before it."""
    arrays = rows.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("pos", "_x"))).alias("_a"))  # a block at most

    def step(d: int) -> Column:
        def combined(a: Column) -> Column:
            def one(e: Column, i: Column) -> Column:
                return F.struct(e["pos"].alias("pos"), F.when(i >= d, reducer.combine(F.get(a, i - d)["_x"], e["_x"])).otherwise(e["_x"]).alias("_x"))

            return F.transform(a, one)

        return F.transform(F.array("_a"), combined)[0]  # the array as a lambda's variable is worked out once, not for each element

    d = 1
    while d < block:
        arrays, d = arrays.withColumn("_a", step(d)), 2 * d
    return arrays


def _scan(rows: DataFrame, reducer: Reducer, block: int, zero: Column, length: int | None, level: int = 0) -> DataFrame:
    blocked = rows.withColumn("_block", F.floor(F.col("pos") / block))
    if reducer.aggregate is not None:
        within = Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        local = blocked.withColumn("_x", F.coalesce(reducer.aggregate(F.col("_x"), lambda c: c.over(within)), zero))
        totals = blocked.groupBy("_block").agg(F.coalesce(reducer.aggregate(F.col("_x"), lambda c: c), zero).alias("_x"))
    else:
        arrays = _array_scan(blocked, reducer, block)
        local = arrays.select("_block", F.explode("_a").alias("_e")).select("_block", F.col("_e.pos").alias("pos"), F.col("_e._x").alias("_x"))
        totals = arrays.select("_block", F.element_at("_a", -1)["_x"].alias("_x"))
    before = totals.select(F.col("_block").alias("pos"), "_x")
    blocks = None if length is None else -(-length // block)
    if reducer.aggregate is None:
        if length is None:
            length = rows.count()
            blocks = -(-length // block)
        scanned = _scan(before, reducer, block, zero, blocks, level + 1) if blocks > 1 else before
    elif level == 0 and (blocks > ONE_WINDOW if blocks is not None else not one_level(rows)):
        scanned = _scan(before, reducer, block, zero, blocks, level + 1)
    else:
        scanned = before.withColumn("_x", F.coalesce(reducer.aggregate(F.col("_x"), lambda c: c.over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))), zero))
    left = scanned.select((F.col("pos") + 1).alias("_block"), F.col("_x").alias("_left"))
    return local.join(left, "_block", "left").select("pos", reducer.combine(F.coalesce("_left", zero), F.col("_x")).alias("_x"))
