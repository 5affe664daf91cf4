"""Readers of rule files and path lists."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = Path(__file__).resolve().parents[1] / "rules"


def parse_rules(lines: DataFrame) -> DataFrame:
    """(kind, category, owner, name, seq) from (seq, line): kind category owner#name; comments and bad rows are skipped."""
    line = F.trim("line")
    p = F.split(line, r"\s+")
    ref = F.split(p[2], "#", 2)
    ok = (line != "") & ~line.startswith("#") & (F.size(p) >= 3)
    rows = lines.where(ok).select(F.lower(p[0]).alias("kind"), p[1].alias("category"), F.get(ref, F.lit(0)).alias("owner"), F.get(ref, F.lit(1)).alias("name"), "seq")
    return rows.where("kind in ('sink', 'source') and owner <> '' and name <> ''")


def parse_changed(lines: DataFrame) -> DataFrame:
    """(path) from (line): one path a line, forward slashes, comments skipped."""
    line = F.trim("line")
    return lines.where((line != "") & ~line.startswith("#")).select(F.translate(line, "\\", "/").alias("path"))


def read_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rule file at ``path``, or the built-in rules (also where that file is missing); a rule's number is its line."""
    text = (_text(spark, path) if path else None) or (RULES / "rules.txt").read_text()
    return parse_rules(spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "seq int, line string"))


def _text(spark: SparkSession, path: str) -> str | None:
    """A whole small file, by Spark's readers; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.sparkContext.wholeTextFiles(path).values().first()


def read_changed(spark: SparkSession, path: str) -> DataFrame:
    return parse_changed(spark.read.text(path).withColumnRenamed("value", "line"))


def git_changed(spark: SparkSession, folder: str, ref: str) -> DataFrame:
    """(path) of what differs between a ref's merge base and the head of a working copy on the driver."""
    out = subprocess.run(["git", "-C", folder, "diff", "--name-only", f"{ref}...HEAD"], capture_output=True, text=True, check=True).stdout
    return parse_changed(spark.createDataFrame([(x,) for x in out.splitlines()], "line string"))


def read_json_rules(path: str | Path | None, spark: SparkSession | None = None) -> list[dict]:
    """Sanitizer or propagation rules: {"rules": [...]}; a missing or bad file has none."""
    try:
        text = None if not path else _text(spark, str(path)) if spark and not isinstance(path, Path) else Path(path).read_text()
        found = json.loads(text)["rules"] if text else []
    except (OSError, ValueError, KeyError, TypeError):
        return []
    return [r for r in found if isinstance(r, dict)] if isinstance(found, list) else []
