"""Maps and moves: projections and arithmetic on positions, without a shuffle unless sequences are zipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankflow.plans.policy import PAR, Policy
from rankflow.seq import Seq


def transform(seq: Seq, f: Callable[..., Column], out: str = "value", on: list[str] | None = None, keep: bool = False) -> Seq:
    """f of the columns ``on`` (all by default) of each element; other columns go unless kept."""
    value = f(*[F.col(c) for c in (on or seq.columns)]).alias(out)
    rows = seq.df.withColumn(out, value) if keep else seq.df.select("pos", value)
    return Seq(rows, length=seq._length)


def for_each(f: Callable[..., Column], *seqs: Seq, out: str = "value", check: bool = True) -> Seq:
    """f of the i-th elements of any number of sequences, as long as the first."""
    renamed = [Seq(s.df.select("pos", F.col(s.columns[0]).alias(f"_{i}")), length=s._length) for i, s in enumerate(seqs)]
    zipped = renamed[0].zip(*renamed[1:], check=check)
    return transform(zipped, f, out, [f"_{i}" for i in range(len(seqs))])


Batches = Iterator[pa.RecordBatch]


def _slices(batches: Batches, rows: int) -> Batches:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def transform_batches(seq: Seq, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, policy: Policy = PAR) -> Seq:
    """An opaque Python function over Arrow batches of the elements, for what built-in functions cannot express.

    f gets ``pos`` and all columns of the policy's ``checkout`` elements at most and returns as many rows in the same order,
    without ``pos``; ``schema`` has their columns.
    """
    size = policy.batch

    def run(batches: Batches) -> Batches:
        for part in _slices(batches, size):
            out = f(part)
            if len(out) != len(part):
                raise ValueError(f"the function returned {len(out)} rows for {len(part)}")
            yield pa.RecordBatch.from_arrays([part.column("pos"), *out.columns], ["pos", *out.schema.names])

    rows = seq.df.select(F.col("pos").cast("long").alias("pos"), *seq.columns)
    return Seq(rows.mapInArrow(run, f"pos long, {schema}"), length=seq._length)


def for_each_effect(seq: Seq, f: Callable[[pa.RecordBatch], None], policy: Policy = PAR) -> int:
    """Call f for its effects on Arrow batches of all elements, on the executors; returns how many there were.

    A task that is repeated calls f again for its elements, so effects should be the same when repeated.
    """
    size = policy.batch

    def run(batches: Batches) -> Batches:
        n = 0
        for part in _slices(batches, size):
            f(part)
            n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = seq.df.select(F.col("pos").cast("long").alias("pos"), *seq.columns)
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def fill(seq: Seq, column: str, value: Any, first: int = 0, last: int | None = None) -> Seq:
    """The column set to a value at positions first ... last - 1."""
    inside = F.col("pos") >= first
    inside = inside if last is None else inside & (F.col("pos") < last)
    whole = first == 0 and last is None
    new = F.lit(value).cast(dict(seq.df.dtypes)[column])
    return Seq(seq.df.withColumn(column, new if whole else F.when(inside, new).otherwise(F.col(column))), length=seq._length)


def copy(seq: Seq) -> Seq:
    """The same elements; immutable data need no copying, so moving is the same."""
    return Seq(seq.df.select("*"), length=seq._length)


move = copy


def shift(seq: Seq, by: int) -> Seq:
    """Every element by so many positions to the right; the positions before are free."""
    return Seq(seq.df.withColumn("pos", F.col("pos") + by), length=seq._length)


def _with_length(seq: Seq):
    """The rows with their number as ``_n``: a literal if it is known, else a one-row broadcast."""
    if seq._length is not None:
        return seq.df.withColumn("_n", F.lit(seq._length))
    return seq.df.crossJoin(F.broadcast(seq.length_column().withColumnRenamed("n", "_n")))  # one row on the right


def reverse(seq: Seq) -> Seq:
    return Seq(_with_length(seq).withColumn("pos", F.col("_n") - 1 - F.col("pos")).drop("_n"), length=seq._length)


def rotate(seq: Seq, middle: int) -> Seq:
    """Elements from ``middle`` on come first, those before it last."""
    return Seq(_with_length(seq).withColumn("pos", F.pmod(F.col("pos") - middle, F.col("_n"))).drop("_n"), length=seq._length)
