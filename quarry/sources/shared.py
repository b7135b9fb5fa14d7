"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Our own folder, by application, where the session names none.
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses in the shared folder (spark.checkpoint.dir; in local runs, one of our own where that is unset)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # a running session takes no new value for it
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quarry-")
        folder = _own[app]
    return f"{folder.rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its plan starts anew, and a lost executor costs no more than what follows."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
