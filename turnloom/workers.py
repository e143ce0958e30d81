"""Python workers of a session find this package, wherever the driver's program was started from."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of one Arrow batch on its way to Python; a batch by number of rows has no bound when texts or lists are long.
BATCH_BYTES = "2m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def reachable() -> None:
    """Put the package's folder on the path of the active session's Python workers.

    On a cluster the package is installed or sent with --py-files as usual; a folder that isn't there does no harm.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        env = spark.sparkContext.environment
        known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in known:
            env["PYTHONPATH"] = os.pathsep.join([*known, ROOT])


def bound_batches() -> None:
    """Set the size of Arrow batches in the active session, unless it is set already; workers find the package."""
    reachable()
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
