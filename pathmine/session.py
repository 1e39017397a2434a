"""Session helpers: local session for tests/bench, checkpoint directory resolution."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "pathmine") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local session gets a scratch one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    scratch = tempfile.mkdtemp(prefix="pathmine-ckpt-", dir=os.environ.get("PATHMINE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); keeps the physical partitioning."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_round(df: DataFrame, round_no: int, every: int = 1) -> DataFrame:
    """Loop-round materialisation: a reliable checkpoint every ``every`` rounds (default every
    round: measured faster than caching array-heavy rows), disk-only persistence in between.
    Lineage never grows past ``every`` rounds."""
    if round_no % every == 0:
        return cut_lineage(df)
    from pyspark import StorageLevel

    return _track(df.persist(StorageLevel.DISK_ONLY))


def keep_short(df: DataFrame) -> DataFrame:
    """A table with short lineage that is read several times (normalised nodes, links):
    persisted on executor disks, not written to the shared folder; losing an executor
    recomputes it from its inputs in one step."""
    from pyspark import StorageLevel

    return _track(df.persist(StorageLevel.DISK_ONLY))


_PERSISTED: list = []


def _track(df: DataFrame) -> DataFrame:
    _PERSISTED.append(df)
    return df


def release_persisted() -> int:
    """Unpersist every table this library persisted so far. Call between independent jobs in a
    long-lived session (the registered queries do, before they start)."""
    n = len(_PERSISTED)
    while _PERSISTED:
        try:
            _PERSISTED.pop().unpersist(blocking=False)
        except Exception:  # session already stopped
            pass
    return n
