"""What the operators share: the shared scratch folder, written tables, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A group is heavy from this share of all rows on, so at most 1 / HEAVY_SHARE groups are.
HEAVY_SHARE = 1 / 1000

_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where a local master leaves it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="dyadspark-")
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/dyadspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict[Hashable, object] = {}


def drop_held() -> None:
    """Give back what this Python worker keeps for other operators; workers outlive the tasks of one."""
    _held.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held[T](key: Hashable, make: Callable[[], T]) -> T:
    """What make() gave this Python worker before, or gives it now; a worker keeps one such thing."""
    if key not in _held:
        drop_held()
        _held[key] = make()
        give_back()
    return _held[key]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what an Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with at most one row of groups for each key.

    Groups of at least HEAVY_SHARE * total rows, at most 1 / HEAVY_SHARE of them, are broadcast, so
    that none of their rows moves; no key that is left to the shuffle join has more rows than that.
    groups: a written table, as it is read twice. size: its column with the rows of the key.
    """
    least = max(1, int(total * HEAVY_SHARE))
    names = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(size) >= least)
    light = groups.where(F.col(size) < least)
    tag = "__heavy"
    marked = rows.join(F.broadcast(heavy.withColumn(tag, F.lit(True))), key, "left")
    hot = marked.where(F.col(tag)).select(*rows.columns, *names)
    cold = marked.where(F.col(tag).isNull()).select(*rows.columns).join(light, key, how).select(*rows.columns, *names)
    return hot.unionByName(cold)
