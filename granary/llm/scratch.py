"""Tables that an operator writes between its phases.

They lie in the folder that the cluster names in ``spark.checkpoint.dir``, which every executor and
the driver share; a lost executor therefore costs a few tasks, never a phase. Where the setting is
absent (tests, a laptop) a temporary folder of this machine takes its place, under a local master only.
Shuffle files of a phase go when its table is written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession

_LOCAL: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_RUN = uuid.uuid4().hex[:12]
#: While a table is written: its shuffles go with it, and Python gets texts in batches of a few megabytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this driver process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines share when the master is {master}")
        shared = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="granary-"))
    if _RUN not in _LOCAL:
        _LOCAL[_RUN] = f"{shared.rstrip('/')}/granary-{_RUN}"
        atexit.register(_remove, spark, _LOCAL[_RUN])
    return _LOCAL[_RUN]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended before the process
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it, so that later plans start there."""
    return _write(df, name, _OPEN[-1] if _OPEN else None)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, for what an operator returns: it outlives the ``intermediate`` block around it."""
    return _write(df, name, _OPEN[-2] if len(_OPEN) > 1 else None)


def discard(df: DataFrame) -> None:
    """Drops a table of ``stored`` that nothing reads any more; a lost one costs nothing but its disk."""
    if df in _PATHS:
        _remove(df.sparkSession, _PATHS.pop(df))


def measured(df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, Row]:
    """As ``stored``, with aggregates over all rows that the same pass has made."""
    seen = Observation()
    out = stored(df.observe(seen, *figures), name)
    return out, Row(**seen.get)


def _write(df: DataFrame, name: str, owner: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if owner is not None:
        owner.append(path)
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_OPEN: list[list[str]] = []


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at the end; what leaves the block must be ``lasting``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _remove(spark, path)
