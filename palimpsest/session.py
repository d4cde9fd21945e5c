"""Session-level helpers: table access, lineage cuts and sizing from plan statistics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The folder the cluster names in ``spark.checkpoint.dir`` is used as it is; only where that is unset and the master is
    local (tests, a notebook) a local one is created.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that operators write and read again."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` in bytes, without running a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bucket_count(df: DataFrame, expansion: float, bucket_bytes: int = 64 << 20) -> int:
    """Buckets for an exchange of ``expansion`` times the size of ``df``, each of about ``bucket_bytes``.

    At least one a shuffle partition, so a small input still uses every core; it grows with the data, so one bucket always
    fits in one task. Where the optimizer doesn't know the size (an RDD without statistics), it is one a partition.
    """
    partitions, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return max(partitions, int(size * expansion / bucket_bytes) + 1) if size < 1 << 60 else partitions


def by_bucket(df: DataFrame, buckets: int):
    """``df`` grouped by ``bucket`` (an int below ``buckets``), with a task of its own for every bucket."""
    return df.repartitionById(buckets, df["bucket"]).groupBy("bucket")
