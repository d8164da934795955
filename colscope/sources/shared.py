"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where there is none and Spark runs on this machine alone,
    which goes with the process."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="colscope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
    if known.isEmpty():
        sc.setCheckpointDir(found)
    return found
