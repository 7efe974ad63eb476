"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf: further settings, with _ for each dot."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder.

    Where none is set, a session of one machine (local mode, as in tests) takes a temporary one; on a cluster no folder of
    the driver's would do, so that is an error.
    """
    kept = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not kept:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        kept = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.sparkContext.setCheckpointDir(kept)
    return kept.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
