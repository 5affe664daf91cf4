"""Index-time merges: first-wins and last-wins upserts, call linking, source resolution, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def first_known(value: str) -> Column:
    return F.expr(f"min_by({value}, seq) filter (where {value} is not null)").alias(value)


def last_positive(value: str) -> Column:
    return F.coalesce(F.expr(f"max_by({value}, seq) filter (where {value} > 0)"), F.expr(f"min_by({value}, seq)")).alias(value)


def merge_nodes(rows: DataFrame, policy: str = "first") -> DataFrame:
    """One row per id from rows in order of seq: kind and name of the first, first known owner, descriptor and file, last positive lines, last entry kind, synthetic if any is.

    By the policy "source_first" the file, too, is the last known, so that file and lines are of one row where a
    source was read after its class file.
    """
    if policy not in ("first", "source_first"):
        raise ValueError(f"no merge policy {policy}")
    if policy == "source_first":
        rows = rows.groupBy("id").agg(F.max_by("file_path", F.when(F.col("file_path").isNotNull(), F.col("seq"))).alias("source_path")).join(rows, "id").withColumn("file_path", F.col("source_path")).drop("source_path")
    return rows.groupBy("id").agg(
        F.min_by("kind", "seq").alias("kind"),
        F.min_by("name", "seq").alias("name"),
        first_known("owner"),
        first_known("descriptor"),
        first_known("file_path"),
        last_positive("start_line"),
        last_positive("end_line"),
        F.expr("max_by(entry_kind, seq) filter (where entry_kind is not null)").alias("entry_kind"),
        F.max("synthetic").alias("synthetic"),
    )


def first_edges(rows: DataFrame) -> DataFrame:
    """One edge per (source, target, kind), the first."""
    return rows.groupBy("source", "target", "kind").agg(F.min_by(F.struct("line", "origin", "provenance"), "seq").alias("e")).select("source", "target", "kind", "e.*")


def last_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, the last."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("r")).select(key, "r.*")


def first_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, the first."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), "seq").alias("r")).select(key, "r.*")


def duplicates(rows: DataFrame, key: str, container: str) -> DataFrame:
    """(key, kept, other, seq): later rows of a key with the first one's container and their own."""
    first = rows.groupBy(key).agg(F.min("seq").alias("first_seq"), F.min_by(container, "seq").alias("kept"))
    return rows.join(first, key).where("seq > first_seq").select(key, "kept", F.col(container).alias("other"), "seq")


def link_calls(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Placeholder call targets M:owner#name(L?;...)? rewritten where owner, name and number of parameters have exactly one descriptor.

    Ambiguous and unknown targets, and those without owner ("?"), stay as they are.  Other columns (line,
    origin) ride along.
    """
    also = [c for c in edges.columns if c not in ("source", "target", "kind", "provenance")]
    known = methods.select("owner", "name", names.arity(F.col("descriptor")).alias("n"), "descriptor").distinct()
    unique = known.groupBy("owner", "name", "n").agg(F.count("*").alias("k"), F.min("descriptor").alias("descriptor")).where("k = 1").select("owner", "name", "n", "descriptor")
    parts = names.method_parts(F.col("target"))
    open_call = (F.col("kind") == "calls") & (F.col("target").endswith(")?") | F.col("target").contains("(L?;"))
    rows = edges.withColumn("p", F.when(open_call, parts))
    rows = rows.withColumn("owner", F.col("p.owner")).withColumn("name", F.col("p.name")).withColumn("n", F.when(open_call, F.size(F.regexp_extract_all("p.descriptor", F.lit(r"L\?;"), F.lit(0)))))
    rows = rows.join(unique, ["owner", "name", "n"], "left")
    found = F.col("descriptor").isNotNull() & (F.col("owner") != "?")
    return rows.select("source", F.when(found, names.method_id(F.col("owner"), F.col("name"), F.col("descriptor"))).otherwise(F.col("target")).alias("target"), "kind", F.when(found, "source-resolved").otherwise(F.col("provenance")).alias("provenance"), *[F.col(f"`{c}`") for c in also])


def resolve_source_calls(found: DataFrame, methods: DataFrame, imports: DataFrame) -> DataFrame:
    """Targets of call expressions (caller_owner, scope, name, n), by the first rung that holds.

    No scope or "this" and one method of that name and number in the class; a call through "super", whose
    class is not looked up; a scope that is an imported simple name; a capitalised scope, taken as a type of the
    same package; else a reference to M:?#name.
    """
    own = methods.select(F.col("owner").alias("caller_owner"), "name", names.arity(F.col("descriptor")).alias("n"), "descriptor").distinct()
    own = own.groupBy("caller_owner", "name", "n").agg(F.count("*").alias("k"), F.min("descriptor").alias("own_descriptor")).where("k = 1").drop("k")
    rows = found.join(own, ["caller_owner", "name", "n"], "left").join(imports.select("caller_owner", F.col("simple").alias("scope"), "internal"), ["caller_owner", "scope"], "left")
    holes = F.concat(F.lit("("), F.repeat(F.lit("L?;"), F.col("n").cast("int")), F.lit(")?"))
    bare = F.col("scope").isNull() | (F.col("scope") == "this")
    typed = ~bare & F.col("scope").rlike(r"^\p{Lu}")
    in_package = names.internal_name(F.col("scope"), F.create_map().cast("map<string,string>"), F.regexp_extract("caller_owner", r"^(.*)/", 1))
    target = (
        F.when(bare & F.col("own_descriptor").isNotNull(), names.method_id(F.col("caller_owner"), F.col("name"), F.col("own_descriptor")))
        .when(~bare & F.col("internal").isNotNull(), names.method_id(F.col("internal"), F.col("name"), holes))
        .when(typed, names.method_id(in_package, F.col("name"), holes))
        .otherwise(names.method_id(F.lit("?"), F.col("name"), holes))
    )
    provenance = F.when(bare & F.col("own_descriptor").isNotNull(), "source-self").when(~bare & F.col("internal").isNotNull(), "source-static-import").when(typed, "source-static-best-effort").when(F.col("scope") == "super", "source-super-unresolved").otherwise("source-unresolved")
    return rows.select("caller_owner", "scope", "name", "n", target.alias("target"), provenance.alias("provenance"), F.when(provenance.endswith("unresolved"), "references").otherwise("calls").alias("kind"))


def enrich_positions(methods: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, file_path, start_line[, end_line]): by owner, name and descriptor; else by the number of parameters if that is unique."""
    place = [c for c in ("file_path", "start_line", "end_line") if c in positions.columns]
    keyed = positions.select("owner", "name", F.col("descriptor").alias("at_descriptor"), names.arity(F.col("descriptor")).alias("n"), *place)
    exact = keyed.groupBy("owner", "name", F.col("at_descriptor").alias("descriptor")).agg(F.min(F.struct(*place)).alias("exact"))
    loose = keyed.groupBy("owner", "name", "n").agg(F.count("*").alias("k"), F.min(F.struct(*place)).alias("loose")).where("k = 1").drop("k")
    met = methods.withColumn("n", names.arity(F.col("descriptor"))).join(exact, ["owner", "name", "descriptor"], "left").join(loose, ["owner", "name", "n"], "left")
    return met.select("id", F.coalesce("exact", "loose").alias("p")).select("id", *[F.col(f"p.{c}") for c in place])


def place_in_sources(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``nodes`` with file and lines of the source that declares them, where there is one.

    ``sources`` has the node rows of source files.  Types and fields are found by id, methods as by
    ``enrich_positions``; what has no place there keeps its own.
    """
    place = ["file_path", "start_line", "end_line"]
    plain = sources.where("kind <> 'method'").groupBy("id").agg(F.min(F.struct(*place)).alias("p"))
    methods = nodes.where("kind = 'method'").select("id", "owner", "name", "descriptor")
    found = enrich_positions(methods, sources.where("kind = 'method'")).where("start_line > 0").select("id", F.struct(*place).alias("p"))
    met = nodes.join(plain.unionByName(found), "id", "left")
    return met.select(*[F.coalesce(F.col(f"p.{c}"), F.col(c)).alias(c) if c in place else F.col(c) for c in nodes.columns])


def numbered(rows: DataFrame, partition: list[str], order: list) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
