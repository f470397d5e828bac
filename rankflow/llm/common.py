"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither a space nor one of tab ... carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def _importable(spark: SparkSession) -> None:
    """Local workers find this package also where the driver was started elsewhere."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read only through Spark."""
    _importable(spark)
    set_up(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings for tables of long texts, where the session does not say otherwise: bytes of an Arrow batch between the JVM and
#: Python, of which both sides hold several, and rows of a Parquet batch, which is one piece of memory for a column.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def set_up(spark: SparkSession) -> None:
    """Apply SETTINGS where the session leaves them open."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


#: What a Python worker keeps between tasks (vocabularies and remembered words): of one operator at a time.
_held: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """The worker's object under ``key``, made when it is not there."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _enter(keep: str) -> None:
    for key in [k for k in _held if k != keep]:
        del _held[key]


def _leave() -> None:
    """Give free memory back: the worker may be idle, or run tasks of other operators next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: str = "") -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of few bytes, and workers that return their memory after each task.

    Of what :func:`held` keeps, only the entry ``keep`` outlives the start of the task.
    """
    set_up(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(keep)
        try:
            yield from run(batches)
        finally:
            _leave()

    return df.mapInArrow(task, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, local mode) a temporary folder is made.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        current = jsc.getCheckpointDir()
        if not current.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        named = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="rankflow-")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder, and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and wordless texts give an empty one."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words_of(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.size(words_of(text)).cast("long")


def seeded_md5(seed: int, *parts: Column) -> Column:
    """A reproducible pseudo-random hex key that does not depend on the partitioning."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def hex_cell(key: Column, digits: int = 3) -> Column:
    """The first hex digits of a key as an integer: 16**digits equal slices of the key order."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")
