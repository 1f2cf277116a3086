"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (tests), a temporary one of this
    process, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "root" not in _own:
            _own["root"] = tempfile.mkdtemp(prefix="vertiplan-")
            atexit.register(shutil.rmtree, _own["root"], True)
        root = f"file://{_own['root']}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{spark.sparkContext.applicationId}")
    # with its scheme, since not only Spark reads what lies there; a local one in the form with an empty host
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, by: str | None = None, **seen: Column) -> DataFrame | tuple[DataFrame, dict]:
    """``df`` written once as Parquet and read again: cuts the lineage, so a lost executor costs a reread.
    In a folder for each value of the column ``by``, which ``drop`` can delete alone. With aggregates ``seen``, they are taken while it is written and returned beside it."""
    path = new_path(df.sparkSession, name)
    watch = Observation() if seen else None
    (df.observe(watch, *(c.alias(k) for k, c in seen.items())) if seen else df).write.parquet(path, partitionBy=by)
    if _scopes:
        _scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return (out, watch.get) if seen else out


def shuffled_anew(df: DataFrame, key: str) -> DataFrame:
    """``df``, grouped by its long column ``key``, without Spark knowing that it is dealt by it: a join on the
    key then shuffles both sides for itself, and adaptive execution can split it at a hot key."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in an Arrow batch from now on in this session: texts are long, and a worker
    holds a batch several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame, part: str = "") -> None:
    """Delete the files of kept tables that nothing reads any more, or of one folder of each."""
    for df in tables:
        _delete(df.sparkSession, f"{df.kept_path}/{part}".rstrip("/"))


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that were kept within, as far as they are still on its list: nothing may read them later."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            _delete(spark, path)
