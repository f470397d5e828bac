"""Headerless files of fixed-width records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.plans.positions import ROW_BITS
from rankflow.seq import Seq

#: SQL types of struct codes.
TYPES = {"b": "tinyint", "h": "smallint", "i": "int", "q": "bigint", "f": "float", "d": "double"}


def _record(record: str, names: tuple[str, ...]) -> np.dtype:
    order, codes = record[:1], record[1:]
    if order not in "<>!" or not codes or set(codes) - TYPES.keys():
        raise ValueError(f"{record!r} is no byte order (< > !) and codes of {' '.join(TYPES)}")
    if len(codes) != len(names):
        raise ValueError("names and record differ in length")
    return np.dtype([(n, (">" if order == "!" else order) + np.dtype(c).str[1:]) for n, c in zip(names, codes)])


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_fixed(spark: SparkSession, path: str, record: str = "<q", names: tuple[str, ...] = ("value",)) -> Seq:
    """The records of a file as a sequence, in their order in the file.

    ``record`` is a byte order and struct codes of b h i q f d. Spark splits the file at record bounds, in any store
    that it reads; records go to Python in Arrow batches, where a batch is decoded as one array. A length that is no
    multiple of the record's raises ValueError.
    """
    kind = _record(record, names)
    fs, at = _file(spark, path)
    length = fs.getFileStatus(at).getLen()
    if length % kind.itemsize:
        raise ValueError(f"{path} has {length} bytes, no multiple of {kind.itemsize}")
    schema = ", ".join(f"`{n}` {TYPES[c]}" for n, c in zip(names, record[1:]))
    if not length:
        return Seq(spark.createDataFrame([], f"pos long, {schema}"), length=0)
    jvm = spark.sparkContext._jvm
    splits = spark._jsc.sc().binaryRecords(path, kind.itemsize, spark._jsc.hadoopConfiguration())
    raw = DataFrame(spark._jsparkSession.createDataset(splits, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("raw")
    placed = raw.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", ROW_BITS)
    last = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()  # a row for each split
    starts, total = {}, 0
    for r in sorted(last):
        starts[r["_part"]] = total
        total += r["_n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("raw"), batch.column("_id").to_numpy()
            data = np.frombuffer(column.buffers()[2], np.uint8)
            first = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
            values = data[first : first + len(batch) * kind.itemsize].view(kind)
            pos = (ids & ((1 << ROW_BITS) - 1)) + np.array([starts[p] for p in (ids >> ROW_BITS).tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pos), *(pa.array(values[n].astype(kind[n].newbyteorder("="))) for n in names)], ["pos", *names])

    return Seq(placed.mapInArrow(decode, f"pos long, {schema}"), length=length // kind.itemsize)


def write_fixed(values: list, path: str, record: str = "<q", spark: SparkSession | None = None) -> None:
    """A small file of records, written by the driver, with ``spark`` to any store that it knows."""
    rows = b"".join(struct.pack(record, *(v if isinstance(v, tuple) else (v,))) for v in values)
    if spark is None:
        with open(path, "wb") as f:
            f.write(rows)
        return
    fs, at = _file(spark, path)
    out = fs.create(at)
    try:
        out.write(bytearray(rows))
    finally:
        out.close()
