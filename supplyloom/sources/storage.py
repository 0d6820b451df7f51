"""Shared-folder helpers: where intermediate data may be written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


_OWN_FOLDERS: dict[str, str] = {}

#: Column that :func:`settle_by` stores rows by: the keys as one text, null keys included.
SLOT = "_slot"

# application -> names of the bucketed tables it has registered
_BUCKETED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a master of one process
    may go without; it gets a temporary folder of this machine, once.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.master not in _OWN_FOLDERS:
        _OWN_FOLDERS[sc.master] = tempfile.mkdtemp(prefix="supplyloom-")
    return _OWN_FOLDERS[sc.master]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used.

    All paths of one application share a parent, which may be deleted after it.
    """
    return f"{_parent(spark)}/{label}-{uuid.uuid4().hex}"


def _parent(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/supplyloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> bool:
    """Delete all stage tables of this application; frames read from them end here."""
    for name in _BUCKETED.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(_parent(spark))
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.delete(path, True)


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    Used for stage results with several readers: the work runs once, lineage
    ends, a lost executor costs no recomputation, and every reader sees the very
    same values (floating sums may differ in the last bit between evaluations).
    The stored size also lets later joins decide on broadcasting by fact.  A frame
    that is a stage table already is returned as it is.
    """
    if getattr(df, "_is_stage_table", False):
        return df
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._is_stage_table = True
    return stored


def settle_together(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Settle tables that do not need each other at the same time.

    Their jobs share the executors, so one's last tasks do not hold up the next.  An
    error of any is raised when all have ended.
    """
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        running = [pool.submit(settle, df, label) for df, label in tables]
    return [job.result() for job in running]


def settle_counted(df: DataFrame, label: str = "stage") -> tuple[DataFrame, int]:
    """Settle ``df`` and tell its rows, which are counted as they are written.

    The count is an observation on the write, so it needs no job of its own and no
    second reading.  A stage table that was settled without a count is counted.
    """
    if getattr(df, "_is_stage_table", False):
        if not hasattr(df, "_rows"):
            df._rows = df.count()
        return df, df._rows
    seen = Observation()
    stored = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    stored._rows = seen.get["rows"]
    return stored, stored._rows


def settle_by(
    df: DataFrame, keys: Sequence[str], label: str = "stage", buckets: int | None = None
) -> DataFrame:
    """Settle ``df`` bucketed by ``keys``, which :data:`SLOT` holds as one column.

    Tables stored with the same keys and number of buckets lie beside each other:
    joins on ``SLOT`` and groupings by it (and whatever follows) need no exchange.
    Unknown keys are a slot of their own.  All rows of a slot are in one bucket, read
    by one task, so store rows aggregated per key, or ask :func:`heaviest_slot`.
    ``buckets`` defaults to the session's shuffle partitions.  The table is known to
    the session until :func:`release`.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, label)
    name = f"supplyloom_{uuid.uuid4().hex}"
    slot = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    # Dealt as the buckets are, every bucket is one file.
    dealt = df.withColumn(SLOT, slot).repartition(buckets, SLOT)
    dealt.write.format("parquet").bucketBy(buckets, SLOT).sortBy(SLOT).option("path", path).saveAsTable(name)
    _BUCKETED.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def heaviest_slot(stored: DataFrame) -> int:
    """Rows of the fullest slot of a table from :func:`settle_by`."""
    return stored.groupBy(SLOT).count().agg(F.max("count")).first()[0] or 0
