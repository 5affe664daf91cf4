"""Written tables that end the lineage of iterative plans."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Without spark.checkpoint.dir a session on one machine gets a folder below the system's temporary one; on a
    cluster that would lose data, so there the setting must be there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return Path(tempfile.gettempdir(), f"loomgraph-{os.getuid()}").as_uri()


#: Folders of this process's written tables, as (application, path), in order.
_made: list[tuple[str, str]] = []


def register(spark: SparkSession, path: str) -> str:
    """Note a folder of intermediate tables; it goes with ``release``, or when the process ends."""
    _made.append((spark.sparkContext.applicationId, path))
    return path


def mark() -> int:
    """A point to release from."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders noted since a mark.  Frames that read them can't be used any longer."""
    conf, app = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext.applicationId
    for owner, path in _made[since:]:
        if owner == app:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    del _made[since:]


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # noqa: BLE001  the session may be gone already, and its folders with it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write a frame below the session's shared folder and go on from the written rows."""
    spark = df.sparkSession
    path = register(spark, f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
