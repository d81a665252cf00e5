"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of applications without spark.checkpoint.dir.
_OWN: dict[str, str] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Without that setting a local session takes a
    temporary folder; on a cluster, whose machines share none, that is an error."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(app)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _OWN[app] = tempfile.mkdtemp(prefix="vecharbor-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
