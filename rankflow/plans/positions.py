"""Dense positions and running sums without a global window.

Rows are dealt by ranges of their order in one exchange. Its partitions are counted as they lie, and a position is
the number of rows in earlier partitions plus the row's number in its own, sorted one. The only global step runs over one
row for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window sums up at most, for each level of running sums.
SPAN = 1 << 16
#: Bytes of an input, as Spark estimates them, up to which a sum of blocks needs no further level.
ONE_LEVEL = 64 << 30
#: Bits of a row's number in ``monotonically_increasing_id``; the partition's number is above them.
ROW_BITS = 33


def exchanged(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in its partitions, read from the exchange at its end by every plan that uses the result.

    Nothing is kept but the exchange's own files, which Spark makes again from the lineage if an executor is lost.
    """
    spark = df.sparkSession
    jdf = df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def dense_positions(df: DataFrame, keys: Sequence[str], out: str = "pos", descending: Sequence[bool] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with column ``out``: the row's rank from 0 in the order of ``keys``.

    The keys together must be unique for the result to be determined; they must not be null.
    """
    order = [F.desc(k) if d else F.asc(k) for k, d in zip(keys, descending or [False] * len(keys))]
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = exchanged(df.repartitionByRange(ranges, *order))
    counts = dealt.select(F.spark_partition_id().alias("_part")).groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # a row for each range
    numbered = dealt.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", ROW_BITS).cast("int"))
    placed = numbered.join(F.broadcast(offsets), "_part")
    return placed.withColumn(out, F.col("_offset") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)).drop("_part", "_offset", "_id")


def one_level(df: DataFrame) -> bool:
    """Whether an input is so small that a row for each of its blocks fits one window; only plans depend on it, not results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_LEVEL


def sums_before(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """``by``, and ``<column>_before`` and ``<column>_all``: the column's sum over all rows of smaller ``by``, a unique whole number, and over all.

    Runs of SPAN numbers are summed on their own, and the runs' totals in one window: a row for each SPAN rows of ``df``. A
    small input goes through one window.
    """
    small = one_level(df)
    rows = df.withColumnRenamed(by, "_run") if small else df.groupBy(F.floor(F.col(by) / SPAN).alias("_run")).agg(*[F.sum(c).alias(c) for c in columns])
    order, whole = Window.orderBy("_run"), Window.partitionBy(F.lit(1))
    totals = rows.select("_run", *[x for c in columns for x in ((F.sum(c).over(order) - F.col(c)).alias(f"{c}_before"), F.sum(c).over(whole).alias(f"{c}_all"))])
    if small:
        return totals.withColumnRenamed("_run", by)
    own = Window.partitionBy("_run").orderBy(by)
    runs = df.withColumn("_run", F.floor(F.col(by) / SPAN)).select("_run", by, *[(F.sum(c).over(own) - F.col(c)).alias(f"_{c}") for c in columns])
    joined = runs.join(totals, "_run")
    return joined.select(by, *[x for c in columns for x in ((F.col(f"_{c}") + F.col(f"{c}_before")).alias(f"{c}_before"), F.col(f"{c}_all"))])
