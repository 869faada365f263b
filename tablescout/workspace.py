"""Where intermediate tables go, and how they are written.

A written Parquet table cuts lineage, survives the loss of executors and can be scanned with column
pruning by several consumers, so it is used in place of caching for anything read more than once.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured, a local one is chosen (once), if driver and executors are one process."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} has to name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tablescout-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    return configured.rstrip("/")


def cleanup(spark: SparkSession) -> None:
    """Delete what this session has written to the shared folder. Results that are read from there are gone then."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for written in _written.pop(spark.sparkContext.applicationId, []):
        path(written).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(written), True)


def new_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and return the scan of what was written."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    scan = df.sparkSession.read.schema(df.schema).parquet(path)
    scan.written_to = path
    return scan


def materialize_told(df: DataFrame, label: str, *figures: Column) -> tuple[DataFrame, dict]:
    """`materialize`, and named aggregates of the rows, which are taken while they are written instead of by a query of their own."""
    seen = Observation()
    return materialize(df.observe(seen, *figures), label), seen.get


def drop_written(scan: DataFrame) -> None:
    """Delete a table that `materialize` returned and that nothing reads any more. Other frames are left alone."""
    path = scan.__dict__.get("written_to")
    if path is None:
        return
    spark = scan.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _written[spark.sparkContext.applicationId].remove(path)


def small_frame(spark: SparkSession, schema: pa.Schema, rows: list[dict]) -> DataFrame:
    """Driver-side metadata (schemas, names) as a local relation with a known size.

    Spark knows how large it is, so it is broadcast only while it is below the session's threshold.
    """
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
