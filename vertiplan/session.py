"""Session settings and checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "vertiplan", **settings: str) -> SparkSession:
    """A session with adaptive execution; ``settings`` override."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"} | settings
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; where that is unset, which only a local master
    may leave so, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="vertiplan-")
        context.setCheckpointDir(root)
    return df.checkpoint()
