"""The engine: index artifacts, then ask for symbols, callers, impact, scans, traces and verified flows.

Every question returns a DataFrame; text and JSON are made in ``streaming.server``.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph, inventory, merge, search, security, taint
from ..sources import artifacts, rules as rule_source
from . import store

DUPLICATES_SHOWN, NODE_HITS, NODE_METHODS, IMPACT_SHOWN, ERRORS_KEPT, STALE_SHOWN = 10, 10, 20, 200, 10, 20


@dataclass(frozen=True)
class Scope:
    """A package prefix and changed paths; both empty: everything."""

    prefix: str | None = None
    paths: tuple[str, ...] = ()

    @classmethod
    def of(cls, prefix: str | None = None, paths: list[str] | None = None) -> Scope:
        return cls(names.scope_prefix(prefix), tuple(names.changed_paths(paths or [])))

    def keep(self, df: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
        """Rows whose id lies under the prefix and, if paths are given, whose node is in a changed file."""
        df = df.where(names.in_prefix(F.col(id_col), self.prefix))
        if self.paths:
            changed = nodes.where(names.on_paths(F.col("file_path"), list(self.paths))).select(F.col("id").alias(id_col))
            df = df.join(changed, id_col, "left_semi")
        return df


def index(spark: SparkSession, source: str, root: str, *, merge_policy: str = "first") -> store.Snapshot:
    """Read artifacts below ``source`` and write a snapshot to ``root``.

    Every class and source is read once; nodes, edges, texts and errors come from that one pass.
    """
    files = artifacts.read_files(spark, source)
    work = f"{root}/work-{uuid.uuid4().hex}"
    try:
        return _index(spark, source, root, files, work, merge_policy)
    finally:
        store.remove(spark, work)


def _index(spark: SparkSession, source: str, root: str, files: DataFrame, work: str, merge_policy: str) -> store.Snapshot:
    def staged(df: DataFrame, name: str, **how) -> DataFrame:
        df.write.parquet(f"{work}/{name}", **how)
        return spark.read.parquet(f"{work}/{name}")

    members = staged(artifacts.members(files), "members").withColumn("seq", F.col("path"))
    # The first copy of each class by key, then its bytes by a semi-join: bytes are not sorted or shuffled.
    slim = members.where("kind = 'class' and error is null").select("internal", "path", "container", "seq")
    first = slim.groupBy("internal").agg(F.min("path").alias("path")).select("path")
    classes = members.where("kind = 'class' and error is null").join(first, "path", "left_semi").select("internal", "path", "container", "kind", "content")
    sources = members.where("kind = 'java' and error is null").select("path", "container", "kind", "content")
    doubles = merge.duplicates(slim, "internal", "container")
    parsed = staged(artifacts.parsed(classes.select("path", "kind", "content").unionByName(sources.select("path", "kind", "content"))), "parsed", partitionBy="part")
    raw_nodes = parsed.where("part = 'node'").select("node.*").withColumn("from_source", F.lower("file_path").endswith(".java"))
    raw_edges = parsed.where("part = 'edge'").select("edge.*")
    kind = lambda s: security.entry_kind(F.col("name"), F.coalesce("descriptor", F.lit("")), F.col("access"), F.col("annotations"), F.col("class_annotations"), from_source=s)
    entry = F.when(F.col("kind") == "method", F.when(F.col("from_source"), kind(True)).otherwise(kind(False)))
    tagged = raw_nodes.withColumn("entry_kind", entry).withColumn("seq", F.col("from_source").cast("int"))

    # Hierarchy and overrides come from class files, where descriptors are exact.
    supers = raw_edges.where("kind in ('extends', 'implements')").select(F.substring("source", 3, 1 << 20).alias("t"), F.substring("target", 3, 1 << 20).alias("a")).distinct()
    closure = graph.ancestor_closure(supers)
    methods = tagged.where("kind = 'method' and not from_source").select("owner", "name", "descriptor", "access", "entry_kind")
    overrides = graph.override_edges(closure, methods)
    by_override = security.entries_by_override(methods, closure, security.override_rules(spark))
    nodes = merge.merge_nodes(tagged.drop("access", "annotations", "class_annotations", "from_source"), merge_policy)
    nodes = nodes.join(by_override.select("id", F.col("entry_kind").alias("by_override")), "id", "left").withColumn("entry_kind", F.coalesce("entry_kind", "by_override")).drop("by_override")
    placed_nodes = merge.place_in_sources(nodes, raw_nodes.where("from_source"))
    known = tagged.where("kind = 'method'").select("owner", "name", "descriptor")
    linked = merge.link_calls(raw_edges.where("kind = 'calls'"), known)
    hierarchy = overrides.select("source", "target", F.lit("overrides").alias("kind"), F.lit(0).alias("line"), F.lit("bytecode").alias("origin"), F.lit("hierarchy").alias("provenance"))
    every = linked.unionByName(raw_edges.where("kind <> 'calls'")).unionByName(hierarchy)
    rank = F.when(F.col("provenance").startswith("source"), 1).otherwise(0)
    edges = merge.first_edges(every.withColumn("seq", F.struct(rank.alias("a"), F.col("provenance").alias("b"), F.col("line").alias("c"))))

    now = int(time.time() * 1000)
    failed = parsed.where("part = 'error'").select("path", "error").unionByName(members.where("error is not null").select("path", "error"))
    failed = failed.groupBy(F.substring_index("path", "!/", 1).alias("path")).agg(F.concat_ws("; ", F.slice(F.sort_array(F.collect_list(F.concat("path", F.lit(": "), "error"))), 1, ERRORS_KEPT)).alias("errors"))
    rows = files.select("path", F.when(F.col("route") == "java", "source").otherwise("bytecode").alias("origin"), F.lit(None).cast("string").alias("container"), F.col("route").alias("language"), "content_hash", "size", "modified_at", F.lit(now).alias("indexed_at")).join(failed, "path", "left")
    shown = [f"{r.internal}: {r.kept or r.internal} / {r.other or r.internal}" for r in doubles.orderBy("internal", "seq").limit(DUPLICATES_SHOWN).collect()]
    # Classes whose top-level type has a source file need no skeleton.
    top = lambda c: F.substring_index(F.substring_index(c, "$", 1), "/", -1)
    covered = raw_nodes.where("from_source and kind not in ('method', 'field')").select(F.substring("id", 3, 1 << 20).alias("internal")).distinct()
    bare = classes.select("internal", "path").join(covered, "internal", "left_anti").where(top("internal") == F.substring_index("internal", "/", -1)).select(F.concat(F.regexp_replace("path", r"\\.class$", ""), F.lit(".java")).alias("path"))
    texts = parsed.where("part = 'text'").select("path", "text").join(bare.unionByName(sources.select("path")), "path", "left_semi")

    nodes, edges = staged(placed_nodes, "nodes"), staged(edges, "edges")
    post = search.indexed(nodes)
    tokens = nodes.agg(F.count("*")).first()[0], post.count()
    step = graph.caller_step(edges.where("kind = 'calls'").select("source", "target"), edges.where("kind = 'overrides'").select("source", "target"))
    meta = [("input", source), ("work_dir", root), ("materialize", "true"), ("indexed_at", str(now)), ("duplicate_classes", str(doubles.count())), ("duplicate_classes_sample", "\n".join(shown)), ("schema_version", "2"), ("nodes", str(tokens[0])), ("tokens", str(tokens[1]))]
    base = {"nodes": nodes, "edges": edges, "files": rows, "meta": spark.createDataFrame(meta, "key string, value string"), "class_bytes": classes.select("internal", "path", "content"), "texts": texts}
    # Sorted by what they are asked for, so a question reads few row groups.
    return store.write(spark, root, base | {"postings": post.repartitionByRange("token").sortWithinPartitions("token"), "steps": step.repartitionByRange("m").sortWithinPartitions("m"), "members": members.select("path", "container", "kind", "internal")})


class Engine:
    """Questions to a snapshot."""

    def __init__(self, spark: SparkSession, root: str, *, rules: str | None = None, sanitizers: str | None = None, propagation: str | None = None, virtual_hops: bool = False) -> None:
        self.spark, self.root = spark, root
        self._given = {"rules": rules, "sanitizers": sanitizers, "propagation": propagation, "virtual_hops": virtual_hops}
        self.snapshot = store.open_current(spark, root)
        self.meta = {r.key: r.value for r in self.snapshot.meta.collect()}  # about ten rows
        self.nodes, self.edges = self.snapshot.nodes, self.snapshot.edges
        self.calls = self.edges.where("kind = 'calls'").select("source", "target")
        self.overrides = self.edges.where("kind = 'overrides'").select("source", "target")
        self.rules = rule_source.read_rules(spark, rules)
        self._sanitizers = rule_source.read_json_rules(sanitizers, spark) if sanitizers else rule_source.read_json_rules(rule_source.RULES / "sanitizers.json")
        self._propagation = rule_source.read_json_rules(propagation, spark)
        self.step = self.snapshot.steps
        self.sites = security.call_sites(self.calls, self.rules)
        self.source_methods = security.source_methods(self.sites)

    def status(self) -> DataFrame:
        return inventory.overview(self.nodes, self.edges).crossJoin(self.staleness())

    def _current(self) -> DataFrame:
        return artifacts.read_files(self.spark, self.meta["input"])

    def staleness(self) -> DataFrame:
        """One row: changed, missing and added files, and whether the index is stale."""
        return inventory.is_stale(self.snapshot.files, self._current())

    def touched(self) -> bool:
        """Whether the input itself was modified after it was indexed; False if it is not there."""
        fs, path = store._fs(self.spark, self.meta["input"])
        return fs.exists(path) and fs.getFileStatus(path).getModificationTime() > int(self.meta["indexed_at"])

    def stale_files(self) -> DataFrame:
        """(path, errors): the first changed, missing and added files."""
        current = self._current()
        changed = inventory.changed(self.snapshot.files, current).orderBy("path").limit(STALE_SHOWN)
        added = inventory.added(self.snapshot.files, current).select("path", F.lit("added").alias("errors")).orderBy("path").limit(STALE_SHOWN)
        return changed.unionByName(added)

    def sync(self) -> bool:
        """Index again with the recorded input if any file changed; whether it did."""
        if not self.staleness().first().stale:
            return False
        index(self.spark, self.meta["input"], self.root)
        self.__init__(self.spark, self.root, **self._given)
        return True

    def files(self, origin: str | None = None, language: str | None = None, limit: int = 0) -> DataFrame:
        return inventory.listed(self.snapshot.files, origin=origin, language=language, limit=limit)

    def search(self, query: str, *, escape: bool = False) -> DataFrame:
        stored = {"index": self.snapshot.postings, "totals": (int(self.meta["nodes"]), int(self.meta["tokens"]))}
        return search.combined(self.nodes, query, escape=escape, **stored).join(self.nodes, "id").orderBy("pos")

    def define(self, name: str) -> DataFrame:
        """What is called so: an exact id or simple name where there is one, else all that a search finds; with descriptors."""
        hits = self.search(name)
        exact = hits.where((F.col("id") == name) | (F.lower("name") == name.lower()))
        return exact if not exact.isEmpty() else hits

    def methods_of(self, name_or_id: str) -> DataFrame:
        """(id) of the methods meant: the id itself if it exists, else all methods the search finds."""
        if name_or_id.startswith("M:"):
            return self.nodes.where(F.col("id") == name_or_id).select("id")
        return self.search(name_or_id).where("kind = 'method'").select("id")

    def node(self, name_or_id: str) -> DataFrame:
        hits = self.search(name_or_id).limit(NODE_HITS)
        methods = self.nodes.where("kind = 'method'").select(names.class_id(F.col("owner")).alias("id"), F.col("id").alias("method"), F.col("name").alias("method_name"))
        listed = merge.numbered(methods, ["id"], ["method_name", "method"]).where(F.col("k") <= NODE_METHODS).groupBy("id").agg(F.sort_array(F.collect_list("method")).alias("methods"))
        return hits.join(listed, "id", "left").orderBy("pos")

    def callers(self, name_or_id: str, scope: Scope = Scope()) -> DataFrame:
        meant = security.small(self.methods_of(name_or_id).select(F.col("id").alias("method")))
        direct = graph.callers_direct(self.calls.join(meant.withColumnRenamed("method", "target"), "target", "left_semi"), self.nodes).select("method", "caller", F.lit("direct").alias("how"))
        virtual = graph.callers_virtual(self.calls, self.overrides, meant).select("method", "caller", F.lit("virtual").alias("how"))
        return scope.keep(direct.unionByName(virtual), self.nodes, "caller")

    def callees(self, name_or_id: str, scope: Scope = Scope()) -> DataFrame:
        meant = security.small(self.methods_of(name_or_id).select(F.col("id").alias("method")))
        direct = graph.callees_direct(self.calls.join(meant.withColumnRenamed("method", "source"), "source", "left_semi"), self.nodes).select("method", "callee", F.when(F.col("external"), "external").otherwise("direct").alias("how"))
        virtual = graph.callees_virtual(self.calls, self.overrides, meant).select("method", "callee", F.lit("virtual").alias("how"))
        return scope.keep(direct.unionByName(virtual), self.nodes, "callee")

    def impact(self, name_or_id: str, depth: int = 0, scope: Scope = Scope()) -> DataFrame:
        starts = self.methods_of(name_or_id).select(F.col("id").alias("start"))
        if starts.isEmpty():
            classes = self.search(name_or_id).where("kind not in ('method', 'field')").select(F.substring("id", 3, 1 << 20).alias("owner"))
            starts = self.nodes.where("kind = 'method'").join(classes, "owner", "left_semi").select(F.col("id").alias("start"))
        reached = graph.impact(self.step, starts, depth, written=True).groupBy("id").agg(F.min("depth").alias("depth"))
        reached = reached.join(starts.select(F.col("start").alias("id")), "id", "left_anti")
        return scope.keep(reached, self.nodes, "id").orderBy("depth", "id").limit(IMPACT_SHOWN)

    def context(self, task: str, hits: int = 8, methods: int = 4, near: int = 5) -> DataFrame:
        found = self.search(task).limit(hits)
        own = self.nodes.where("kind = 'method'").select(names.class_id(F.col("owner")).alias("class_id"), F.col("id").alias("member"))
        of_class = found.join(own, F.col("id") == F.col("class_id")).select("pos", F.col("member").alias("method"))
        chosen = found.where("kind = 'method'").select("pos", F.col("id").alias("method")).unionByName(of_class).groupBy("method").agg(F.min("pos").alias("pos")).orderBy("pos", "method").limit(methods)
        callers = chosen.join(self.step, F.col("method") == F.col("m")).groupBy("method").agg(F.count("*").alias("n_callers"), F.slice(F.sort_array(F.collect_set("caller")), 1, near).alias("callers"))
        callees = chosen.join(self.calls, F.col("method") == F.col("source")).groupBy("method").agg(F.count("*").alias("n_callees"), F.slice(F.sort_array(F.collect_set("target")), 1, near).alias("callees"))
        return chosen.join(callers, "method", "left").join(callees, "method", "left").orderBy("pos", "method")

    def grep(self, pattern: str, scope: Scope = Scope()) -> DataFrame:
        texts = self.snapshot.texts.where(names.on_paths(F.col("path"), list(scope.paths)))
        return inventory.grep(texts, pattern, prefix=scope.prefix)

    def outline(self, class_name: str) -> DataFrame:
        owner = class_name.strip().replace(".", "/")
        return self.nodes.where((F.col("id") == f"C:{owner}") | ((F.col("owner") == owner) & (F.col("kind") == "method"))).orderBy(F.col("owner").asc_nulls_first(), "name", "id")

    def source(self, class_name: str) -> DataFrame:
        """The text of the class's source file, or its skeleton: by the file of its outermost type, else by a path that ends so."""
        top = class_name.strip().replace(".", "/").partition("$")[0]
        own = self.nodes.where(F.col("id") == f"C:{top}").select(F.regexp_replace("file_path", r"\.class$", ".java").alias("path"))
        found = self.snapshot.texts.join(own, "path", "left_semi")
        return found if not found.isEmpty() else self.snapshot.texts.where(F.col("path").endswith(f"/{top}.java"))

    def method_source(self, class_name: str, method: str, *, descriptor: str | None = None, arity: int | None = None) -> DataFrame:
        """(path, start_line, text, method, note): the bodies of a method's overloads.

        A descriptor picks the overload it names; where none has it, its number of parameters (or ``arity``) picks,
        and if several have that the first is shown with a note that says so.
        """
        owner = class_name.strip().replace(".", "/")
        own = self.nodes.where((F.col("owner") == owner) & (F.col("kind") == "method") & (F.col("name") == method))
        note = F.lit(None).cast("string")
        if descriptor is not None:
            exact = own.where(F.col("descriptor") == descriptor)
            if not exact.isEmpty():
                own = exact
            else:
                arity = own.sparkSession.range(1).select(names.arity(F.lit(descriptor))).first()[0]
        if arity is not None:
            alike = own.where(names.arity(F.col("descriptor")) == arity).where("start_line > 0")
            several = alike.count()
            own = alike.orderBy("start_line", "id").limit(1) if several > 1 else alike
            if several > 1:
                note = F.lit(f"ambiguous: {several} overloads of {method} take {arity} parameters; the first is shown")
        at = own.where("start_line > 0").select("start_line", F.greatest("end_line", "start_line").alias("end_line"), F.col("id").alias("method"))
        # The class's own source file, also where the node's file is an archive; one class has one or two.
        files = self.source(class_name).select("path")
        bodies = inventory.sliced(self.snapshot.texts, at.select("start_line", "end_line").distinct().crossJoin(files))
        return bodies.join(at.select("start_line", "method"), "start_line").select("path", "start_line", "text", "method", note.alias("note"))

    def overview(self, scope: Scope = Scope()) -> DataFrame:
        sites = scope.keep(self.sites, self.nodes, "source") if scope.paths else self.sites
        counts = [security.histogram(sites, self.nodes, k, prefix=scope.prefix).select(F.lit(k).alias("kind"), "category", "n") for k in ("sink", "source")]
        return counts[0].unionByName(counts[1]).orderBy("kind", "category")

    def totals(self) -> DataFrame:
        return inventory.overview(self.nodes, self.edges)

    def sinks(self, category: str | None = None, scope: Scope = Scope()) -> DataFrame:
        return scope.keep(security.scan(self.sites, self.nodes, "sink", category=category), self.nodes, "source")

    def sources(self, category: str | None = None, scope: Scope = Scope()) -> DataFrame:
        return scope.keep(security.scan(self.sites, self.nodes, "source", category=category), self.nodes, "source")

    def trace(self, name_or_id: str, scope: Scope = Scope()) -> DataFrame:
        paths = graph.trace(self.step, self.source_methods, self.methods_of(name_or_id).select(F.col("id").alias("start")))
        if scope.prefix or scope.paths:
            hops = paths.select("start", "k", F.explode("path").alias("hop"))
            paths = paths.join(scope.keep(hops, self.nodes, "hop").select("start", "k").distinct(), ["start", "k"], "left_semi")
        return paths

    def _taint_rules(self) -> taint.Rules:
        sources = {(r.owner, r.name) for r in self.rules.where("kind = 'source'").collect()}  # a rule file
        return taint.Rules(sources, [(r["className"], r["methodName"], r.get("methodDesc", "*"), int(r.get("paramIndex", 0))) for r in self._sanitizers], [(r["className"], r["methodName"], r.get("methodDesc", "*"), str(r.get("from", "any")), str(r.get("to", "ret"))) for r in self._propagation], self._given["virtual_hops"])

    def taint_scan(self, category: str | None = None, scope: Scope = Scope(), depth: int = security.SCAN_DEPTH, paths: int = security.SCAN_PATHS, budget: int = security.SCAN_BUDGET) -> DataFrame:
        """Candidate chains of the sinks, each followed through the bytecode; urgent entries first."""
        sites = self.sites if not category else self.sites.where(F.lower("category") == category.lower())
        chains = security.candidate_chains(scope.keep(sites, self.nodes, "source"), self.step, self.source_methods, depth=depth, paths=paths, budget=budget)
        rows = chains.withColumn("chain_id", F.col("seq").cast("long"))
        verified = taint.verify_chains(rows.select("chain_id", "chain", "sink"), self.snapshot.class_bytes, self._taint_rules())
        entries = self.nodes.select(F.col("id").alias("entry"), "entry_kind")
        met = rows.select("chain_id", "category", "total", F.element_at("chain", 1).alias("entry")).join(verified, "chain_id").join(entries, "entry", "left")
        return met.withColumn("priority", security.flow_priority(F.col("entry_kind"), F.size("sanitizers") > 0)).orderBy("priority", "chain_id")

    def verify_chain(self, chain: list[str], sink: str) -> DataFrame:
        one = self.spark.createDataFrame([(1, chain, sink)], "chain_id long, chain array<string>, sink string")
        return taint.verify_chains(one, self.snapshot.class_bytes, self._taint_rules())
