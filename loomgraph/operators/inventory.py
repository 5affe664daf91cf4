"""File inventory, staleness and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GREP_HITS, FILES_SHOWN, FILES_MOST = 300, 300, 1000


def route(path):
    """archive, class or java by the extension's lower case; null for anything else."""
    low = F.lower(path)
    archive = low.endswith(".jar") | low.endswith(".war") | low.endswith(".jmod") | low.endswith(".ear")
    return F.when(archive, "archive").when(low.endswith(".class"), "class").when(low.endswith(".java"), "java")


def changed(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, errors): stored files whose content differs (changed) or is gone (missing); rows without a hash are skipped."""
    met = stored.where("content_hash is not null").join(current.select("path", F.col("content_hash").alias("now")), "path", "left")
    return met.where("now is null or now <> content_hash").select("path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("errors"))


def added(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path): current .java and .class files that are not stored."""
    return current.where(F.lower("path").endswith(".java") | F.lower("path").endswith(".class")).select("path").distinct().join(stored.select("path"), "path", "left_anti")


def is_stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """One row: numbers of changed, missing and added files, and whether there is any."""
    c = changed(stored, current).agg(F.coalesce(F.sum((F.col("errors") == "changed").cast("long")), F.lit(0)).alias("n_changed"), F.coalesce(F.sum((F.col("errors") == "missing").cast("long")), F.lit(0)).alias("n_missing"))
    a = added(stored, current).agg(F.count("*").alias("n_added"))
    return c.crossJoin(a).withColumn("stale", (F.col("n_changed") + F.col("n_missing") + F.col("n_added")) > 0)


def counts_by(files: DataFrame, column: str) -> DataFrame:
    """(key, n) for origin or language; null counts under the empty key."""
    if column not in ("origin", "language"):
        raise ValueError(f"files are not counted by {column}")
    return files.groupBy(F.coalesce(column, F.lit("")).alias("key")).agg(F.count("*").alias("n"))


def listed(files: DataFrame, *, origin: str | None = None, language: str | None = None, limit: int = 0) -> DataFrame:
    """Files in order of language and path, filtered exactly; a positive limit holds up to 1000, else 300."""
    if origin:
        files = files.where(F.col("origin") == origin)
    if language:
        files = files.where(F.col("language") == language)
    return files.orderBy(F.col("language").asc_nulls_first(), "path").limit(min(limit, FILES_MOST) if limit > 0 else FILES_SHOWN)


def ending_in(rows: DataFrame, path_col: str, suffixes: DataFrame) -> DataFrame:
    """Rows whose path ends with any of the (suffix), wherever that starts in a name; null paths never do.

    One equi-join on the path's end of each length that a suffix has; lengths are few, whatever the number of suffixes.
    """
    lengths = sorted(r.n for r in suffixes.select(F.length("suffix").alias("n")).where("n > 0").distinct().collect())
    if not lengths:
        return rows.where("false")
    ends = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length("met_path") >= n, F.right(F.col("met_path"), n)))
    paths = rows.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("met_path")).distinct().select("met_path", F.explode(ends).alias("suffix"))
    met = paths.join(suffixes.select("suffix"), "suffix", "left_semi").select("met_path").distinct()
    return rows.join(met, F.col(path_col) == F.col("met_path"), "left_semi")


def lines(texts: DataFrame) -> DataFrame:
    """(path, line, text) of (path, text), lines counted from 1."""
    return texts.select("path", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text")


def grep(texts: DataFrame, pattern: str, *, prefix: str | None = None, limit: int | None = GREP_HITS) -> DataFrame:
    """Lines that hold the pattern, case folded; with a prefix only files under it."""
    if prefix:
        texts = texts.where(F.concat(F.lit("/"), F.translate("path", "\\", "/")).contains(f"/{prefix}"))
    out = lines(texts).where(F.contains(F.lower("text"), F.lit(pattern.lower())))
    return out.orderBy("path", "line").limit(limit) if limit else out


def sliced(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, start_line, text): the lines start_line to end_line of each file."""
    parts = F.split("text", "\n")
    return texts.join(ranges, "path").select("path", "start_line", F.array_join(F.slice(parts, F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n").alias("text"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals; classes are what is neither method nor field."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") == "field").alias("fields"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "calls").alias("calls"))
    return n.crossJoin(e).withColumn("classes", F.greatest(F.col("nodes") - F.col("methods") - F.col("fields"), F.lit(0)))
