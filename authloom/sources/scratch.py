"""Shared working folder for data that has to be written between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to this machine's temporary folder, which goes when Python ends.
    """
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="authloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    return f"{base.rstrip('/')}/authloom-{uuid.uuid4().hex}"


def materialize(df, folder: str):
    """Write once, read back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)
