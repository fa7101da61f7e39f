"""Sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application, reachable by every executor.

    The cluster names the folder above it in ``spark.checkpoint.dir``. Only a local master, where driver
    and executors share one machine, may do without; its folder goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return _local_root(spark.sparkContext.applicationId)


@functools.cache
def _local_root(application_id: str) -> str:
    root = tempfile.mkdtemp(prefix=f"run-{application_id}-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that no other call returns."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once nothing that is still to be computed reads them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def isolated_session(spark: SparkSession) -> SparkSession:
    """A session with the same runtime settings but none of the temporary views."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of metadata, such as names and types, as a local relation."""
    struct = T.StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [()] * len(struct)
    table = pa.table([pa.array(column) for column in columns], names=struct.names)
    return spark.createDataFrame(table, schema=struct)
