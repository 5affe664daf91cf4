"""Snapshots of an indexed graph: Parquet tables in a folder of their own, and a pointer that is renamed into place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nodes", "edges", "files", "meta", "postings", "class_bytes", "texts", "members", "steps")
NODE_COLUMNS = {"id", "kind", "name", "owner", "descriptor", "file_path", "start_line", "end_line", "entry_kind", "synthetic"}
POINTER = "CURRENT"


class Snapshot:
    """The tables of one snapshot, read when asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        missing = NODE_COLUMNS - set(self.nodes.columns)
        if missing:
            raise ValueError(f"{path} was written by another version: nodes lack {', '.join(sorted(missing))}; index again")
        fs, steps = _fs(spark, f"{path}/steps")
        if not fs.exists(steps):
            raise ValueError(f"{path} was written by another version: it has no steps; index again")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.path}/{name}")
        raise AttributeError(name)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> Snapshot:
    """Write all tables to a new folder, then move the pointer: readers see the old snapshot or the new one, whole."""
    name = f"snapshot-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    fs, pointer = _fs(spark, f"{root}/{POINTER}")
    _, fresh = _fs(spark, f"{root}/{POINTER}.{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = options.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(options.Options.Rename, 1)
    rename[0] = options.Options.Rename.OVERWRITE
    before = _named(spark, root)
    context.rename(fresh, pointer, rename)
    # Readers of the snapshot before keep it; the ones before that go.
    for folder in fs.listStatus(pointer.getParent()):
        found = folder.getPath().getName()
        if found.startswith("snapshot-") and found not in (name, before):
            fs.delete(folder.getPath(), True)
    return Snapshot(spark, f"{root}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _named(spark: SparkSession, root: str) -> str | None:
    """The snapshot that the pointer names."""
    fs, pointer = _fs(spark, f"{root}/{POINTER}")
    return spark.sparkContext.wholeTextFiles(f"{root}/{POINTER}").values().first() if fs.exists(pointer) else None


def open_current(spark: SparkSession, root: str) -> Snapshot:
    name = _named(spark, root)
    if not name:
        raise FileNotFoundError(f"nothing is indexed at {root}")
    return Snapshot(spark, f"{root}/{name}")
