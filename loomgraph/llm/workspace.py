"""Shared-storage tables that cut lineage, and small helpers for Arrow batches.

Every intermediate that must survive a lost executor is a Parquet table under the folder named by
``spark.checkpoint.dir``.  The setting is read from the session; only when it is unset on one machine (tests, a
laptop) is a folder below the system's temporary directory used; a cluster must set it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import register, shared_folder

#: Bytes of an Arrow batch, at most, and rows that a Parquet reader decodes at once: rows here hold whole texts, sets
#: or vectors, and a batch has several copies in a task.
BATCH_BYTES, READ_ROWS = 2_000_000, 512
#: Partitions that a driver can still schedule; tables beyond that many times their rows per partition get larger ones.
MOST_PARTITIONS = 1_000_000


class Workspace:
    """A private folder in shared storage; ``stage`` writes a table there and reads it back."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = register(spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
        prepare_workers(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, *, codec: str = "snappy", partition_by: str | None = None, rows: int | None = None, rows_per_file: int = 100_000) -> DataFrame:
        """Write once, then continue from the written rows: lineage ends here and nothing is recomputed.

        ``rows`` is a bound of the number of rows, where one is known: small tables then take few files, whatever
        the number of shuffle partitions.
        """
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(partitions_for(self.spark, rows, rows_per_file))
        writer = df.write.option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a staged table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver did, and bound the session's batches for rows of whole texts.

    Settings that are smaller already stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(key, str(1 << 30)).lower().removesuffix("b")
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))
    top = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, top])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """As many partitions as the rows need, so their number follows the data and not the session's default."""
    return max(1, min(-(-rows // rows_per_partition), MOST_PARTITIONS))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Split a stream of batches, sorted by ``keys``, into one table for each run of equal keys."""
    import numpy as np

    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(table.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)
