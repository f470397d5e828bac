"""Composition of independent and recursive computations, and trees of work weights."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.seq import Seq


def one_row(*results: DataFrame) -> DataFrame:
    """Independent one-row results side by side, in one plan that Spark runs concurrently.

    A result of more than one row is an error of the plan; one without rows leaves none.
    """
    out = None
    for r in results:
        held = F.when(F.count("*") > 1, F.raise_error(F.lit("a result has more than one row"))).otherwise(F.first(F.struct("*")))
        r = r.agg(F.count("*").alias("_n"), held.alias("_r")).where("_n = 1").select("_r.*")
        out = r if out is None else out.crossJoin(r)  # one row each
    return out


def coll_exec(spark: SparkSession, f: Callable[..., Any], size: int, *arguments: Any) -> list:
    """f(rank, size, barrier, arguments) once on each of ``size`` tasks that run at the same time; results in order of rank.

    ``barrier()`` waits for all tasks. The cluster must have so many free cores. Results are pickled, one for each rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        task = BarrierTaskContext.get()
        rank = task.partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int32()), pa.array([pickle.dumps(f(rank, size, task.barrier, *arguments))], pa.binary())], ["rank", "result"])

    ranks = spark.range(size).repartitionById(size, F.col("id").cast("int"))
    return [pickle.loads(r.result) for r in ranks.mapInArrow(run, "rank int, result binary", barrier=True).orderBy("rank").collect()]


@contextmanager
def task_group(spark: SparkSession, name: str) -> Iterator[Callable[[], None]]:
    """All jobs that this thread starts in the block are one group; the value cancels it."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(name, name)
    try:
        yield lambda: context.cancelJobGroup(name)
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)


def parallel_invoke(*calls: Callable[[], Any] | tuple, threads: int = 8) -> tuple:
    """Run independent calls, (function, arguments) or functions, at once; their results in order.

    None stands for calls without a result; no calls give an empty tuple. Each call may start jobs.
    """
    if not calls:
        return ()
    tasks = [c if isinstance(c, tuple) else (c,) for c in calls]
    with ThreadPoolExecutor(min(threads, len(tasks))) as pool:
        return tuple(f.result() for f in [pool.submit(t[0], *t[1:]) for t in tasks])


def fib(spark: SparkSession, n: int) -> DataFrame:
    """fib(0) = fib(1) = 1, by a recursive query."""
    return spark.sql(f"""WITH RECURSIVE f(n, a, b) MAX RECURSION LEVEL {n + 2} AS (
        SELECT 0, 1L, 1L UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < {n}) SELECT n, a AS fib FROM f WHERE n = {n}""")


def nqueens(spark: SparkSession, n: int) -> DataFrame:
    """The number of ways to place n queens, by expanding boards level by level.

    A board is the array of its queens' columns; each level extends all boards at once, and
    only safe ones go on.
    """
    boards = spark.range(1).select(F.array().cast("array<int>").alias("b"))
    for row in range(n):
        safe = F.forall(F.transform("b", lambda c, i: F.struct(c.alias("c"), (F.lit(row) - i).alias("d"))), lambda e: (e["c"] != F.col("q")) & (F.abs(e["c"] - F.col("q")) != e["d"]))
        boards = boards.select("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q")).where(safe).select(F.concat("b", F.array("q")).alias("b"))
        if row == min(1, n - 2):
            boards = boards.repartition("b")
    return boards.agg(F.lit(n).alias("n"), F.count("*").alias("solutions"))


def weight_tree(seq: Seq, weight: Callable[..., Column], leaves: int | None = None) -> DataFrame:
    """``node, left_work, right_work`` of a complete binary tree over equal runs of positions.

    Node 1 is the root and node k has the children 2k and 2k + 1. ``leaves`` is a power of two, by
    default the least that is not below the length; positions are halved, the left half rounded down.
    """
    n = seq.length()
    leaves = leaves or 1 << max(0, n - 1).bit_length()
    if leaves & (leaves - 1) or leaves < 1:
        raise ValueError("leaves must be a power of two")
    depth = leaves.bit_length() - 1
    # the leaf of a position is found by halving; leaves are summed first, and only their sums go up the tree
    rows = seq.df.select("pos", weight(*[F.col(c) for c in seq.columns]).alias("_w"), F.lit(1).cast("long").alias("_node"), F.lit(0).cast("long").alias("_a"), F.lit(n).cast("long").alias("_b"))
    for _ in range(depth):
        mid = F.expr("_a + (_b - _a) div 2")
        right = F.col("pos") >= F.col("_mid")
        rows = rows.withColumn("_mid", mid).select("pos", "_w", (F.col("_node") * 2 + right.cast("long")).alias("_node"), F.when(right, F.col("_mid")).otherwise(F.col("_a")).alias("_a"), F.when(right, F.col("_b")).otherwise(F.col("_mid")).alias("_b"))
    sums = rows.groupBy("_node").agg(F.sum("_w").alias("_w"))
    sums = sums.select("_w", F.explode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.struct(F.call_function("shiftright", F.col("_node"), i).alias("node"), (F.call_function("shiftright", F.col("_node"), i - 1) % 2).alias("right")))).alias("_e")) if depth else sums.where(F.lit(False)).select("_w", F.struct(F.col("_node").alias("node"), F.lit(0).cast("long").alias("right")).alias("_e"))
    return sums.groupBy(F.col("_e.node").alias("node")).agg(
        F.coalesce(F.sum(F.when(F.col("_e.right") == 0, F.col("_w"))), F.lit(0)).alias("left_work"), F.coalesce(F.sum(F.when(F.col("_e.right") == 1, F.col("_w"))), F.lit(0)).alias("right_work"))


def split_by_weight(seq: Seq, weight: Callable[..., Column], parts: int) -> DataFrame:
    """The rows with the part (0 ... parts - 1) that balances the weights along the order."""
    from rankflow.functions.reducers import plus
    from rankflow.operators.scanning import scan

    ends = scan(seq, plus, weight, out="_end")
    total = ends.df.agg(F.max("_end").alias("_all"))
    rows = seq.df.join(ends.df, "pos").crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("part", F.least(F.floor((F.col("_end") - 1) * parts / F.greatest("_all", F.lit(1))), F.lit(parts - 1)).cast("int")).drop("_end", "_all")
