"""Stage outputs written once and reused (the original tool skips a stage whose output
file exists). Stored as parquet under the session's checkpoint directory, keyed by the
stage name, the input directory and the options, so a later stage in the same session
reads the written table instead of recomputing its lineage."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from pathmine.session import ensure_checkpoint_dir


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def input_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and modification times of the files under ``path`` (one listing call)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ""
    it = fs.listFiles(p, True)
    parts = []
    while it.hasNext():
        st = it.next()
        parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return "|".join(sorted(parts))


def stage(spark: SparkSession, name: str, key: str, build, inputs: str | None = None) -> DataFrame:
    """Read the stage table if this (name, key, input files) was written before, else build it."""
    base = ensure_checkpoint_dir(spark)
    if inputs is not None:
        key = key + "#" + input_fingerprint(spark, inputs)
    digest = hashlib.md5(key.encode()).hexdigest()[:16]
    path = os.path.join(base, "stages", f"{name}-{digest}")
    if not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
