"""Rules, call sites, scans, histograms, candidate chains and entry classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans.lineage import cut
from . import graph
from .graph import trace

#: Rule tables are files written by people; up to this many rows they are broadcast, else shuffled.
BROADCAST_RULES = 50_000
SCAN_DEPTH, SCAN_PATHS, SCAN_BUDGET = 8, 3, 600
#: How urgent an entry kind is, lower first.
ENTRY_PRIORITY = {"HTTP": 0, "SERVLET": 1, "FILTER": 2, "MQ": 3, "MAIN": 4, "ASYNC": 5}
OTHER_ENTRY, NO_ENTRY, SANITIZED = 50, 100, 10


def small(table: DataFrame, most: int = BROADCAST_RULES) -> DataFrame:
    """The table, to be broadcast if it is as small as such tables are."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def call_sites(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, category, owner, name, seq, source, target): calls whose target is the rule's method, any descriptor.

    One equi-join on the folded owner and name instead of a prefix scan for each rule.
    """
    keyed = rules.select("kind", "category", "owner", "name", "seq", F.lower(F.concat(F.lit("M:"), "owner", F.lit("#"), "name")).alias("call_key"))
    found = calls.where(F.col("target").contains("(")).select("source", "target", names.call_key(F.col("target")).alias("call_key"))
    return found.join(small(keyed), "call_key").select("kind", "category", "owner", "name", "seq", "source", "target").distinct()


def first_rule(ids: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, kind, category, seq): for each method id the first rule in file order, case kept."""
    keyed = rules.select("kind", "category", "seq", F.concat(F.lit("M:"), "owner", F.lit("#"), "name").alias("exact"))
    met = ids.where(F.col("id").contains("(")).withColumn("exact", F.substring_index("id", "(", 1)).join(small(keyed), "exact")
    return met.groupBy("id").agg(F.min_by(F.struct("kind", "category", "seq"), "seq").alias("r")).select("id", "r.*")


def _visible(sites: DataFrame, nodes: DataFrame, prefix: str | None) -> DataFrame:
    """Sites with their callers' nodes (left: a caller without a node stays), scope applied, compiler-made callers hidden."""
    met = sites.where(names.in_prefix(F.col("source"), prefix)).join(nodes.select(F.col("id").alias("source"), F.col("id").alias("node"), "entry_kind", "synthetic"), "source", "left")
    return met.where(F.coalesce(F.col("synthetic"), F.lit(0)) == 0)


def scan(sites: DataFrame, nodes: DataFrame, kind: str, *, category: str | None = None, prefix: str | None = None) -> DataFrame:
    """(category, source, api, target, entry_kind) of a kind's call sites; category compared without case."""
    rows = sites.where(F.col("kind") == kind)
    if category:
        rows = rows.where(F.lower("category") == category.lower())
    return _visible(rows, nodes, prefix).select("category", "source", F.concat("owner", F.lit("#"), "name").alias("api"), "target", "entry_kind")


def histogram(sites: DataFrame, nodes: DataFrame, kind: str, *, prefix: str | None = None) -> DataFrame:
    """(category, n): sites per category; callers without a node do not count here."""
    return _visible(sites.where(F.col("kind") == kind), nodes, prefix).where("node is not null").groupBy("category").agg(F.count("*").alias("n"))


def source_methods(sites: DataFrame) -> DataFrame:
    """(m): methods that read a source."""
    return sites.where("kind = 'source'").select(F.col("source").alias("m")).distinct()


def candidate_chains(sites: DataFrame, step: DataFrame | graph.Reverse, sources: DataFrame, *, depth: int = SCAN_DEPTH, paths: int = SCAN_PATHS, budget: int = SCAN_BUDGET) -> DataFrame:
    """(category, sink, sink_method, chain, seq, total): distinct chains from entry to sink, the first ``budget`` of them.

    A sink method that reads a source itself is a chain of one.  ``total`` counts all chains there are.
    """
    sinks = sites.where("kind = 'sink'").select("category", F.col("source").alias("sink_method"), F.col("target").alias("sink")).distinct()
    found = trace(step, sources, sinks.select(F.col("sink_method").alias("start")).distinct(), depth=depth, paths=paths).select(F.col("start").alias("sink_method"), F.col("path").alias("chain"))
    own = sinks.join(sources.select(F.col("m").alias("sink_method")), "sink_method", "left_semi").select("sink_method", F.array("sink_method").alias("chain"))
    chains = sinks.join(found.unionByName(own).distinct(), "sink_method").distinct()
    order = ["category", "sink", "sink_method", "chain"]
    chains = cut(chains)  # counted and ranked from one written table
    total = chains.agg(F.count("*").alias("total"))
    first = chains.orderBy(*order).limit(budget)
    return first.withColumn("seq", F.row_number().over(Window.orderBy(*order))).crossJoin(total).select(*order, "seq", "total")


def flow_priority(entry_kind: Column, sanitized: Column) -> Column:
    rank = F.when(entry_kind.isNull(), NO_ENTRY)
    for kind, value in ENTRY_PRIORITY.items():
        rank = rank.when(entry_kind == kind, value)
    return rank.otherwise(OTHER_ENTRY) + F.when(sanitized, SANITIZED).otherwise(0)


# Annotations by which frameworks mark entry points, on methods and on classes.
HTTP_METHOD_ANNOTATIONS = (
    "Lorg/springframework/web/bind/annotation/RequestMapping;",
    "Lorg/springframework/web/bind/annotation/GetMapping;",
    "Lorg/springframework/web/bind/annotation/PostMapping;",
    "Lorg/springframework/web/bind/annotation/PutMapping;",
    "Lorg/springframework/web/bind/annotation/DeleteMapping;",
    "Lorg/springframework/web/bind/annotation/PatchMapping;",
    "Ljavax/ws/rs/Path;",
    "Ljakarta/ws/rs/Path;",
    "Ljavax/ws/rs/GET;",
    "Ljavax/ws/rs/POST;",
    "Ljavax/ws/rs/PUT;",
    "Ljavax/ws/rs/DELETE;",
    "Ljakarta/ws/rs/GET;",
    "Ljakarta/ws/rs/POST;",
    "Ljakarta/ws/rs/PUT;",
    "Ljakarta/ws/rs/DELETE;",
)
HTTP_CLASS_ANNOTATIONS = (
    "Lorg/springframework/web/bind/annotation/RestController;",
    "Lorg/springframework/stereotype/Controller;",
    "Lorg/springframework/web/bind/annotation/RequestMapping;",
    "Ljavax/ws/rs/Path;",
    "Ljakarta/ws/rs/Path;",
)
MQ_METHOD_ANNOTATIONS = (
    "Lorg/springframework/kafka/annotation/KafkaListener;",
    "Lorg/springframework/amqp/rabbit/annotation/RabbitListener;",
    "Lorg/springframework/jms/annotation/JmsListener;",
    "Lorg/springframework/cloud/stream/annotation/StreamListener;",
    "Lorg/springframework/messaging/handler/annotation/MessageMapping;",
)
ASYNC_METHOD_ANNOTATIONS = (
    "Lorg/springframework/scheduling/annotation/Scheduled;",
    "Lorg/springframework/scheduling/annotation/Async;",
)
# Overridden methods that make an entry: (type, method name, descriptor or null for any, kind); "*" ends the start of a name.
OVERRIDE_ENTRIES = (
    ("javax/servlet/http/HttpServlet", "do*", None, "SERVLET"),
    ("javax/servlet/http/HttpServlet", "service", None, "SERVLET"),
    ("jakarta/servlet/http/HttpServlet", "do*", None, "SERVLET"),
    ("jakarta/servlet/http/HttpServlet", "service", None, "SERVLET"),
    ("javax/servlet/Filter", "doFilter", None, "FILTER"),
    ("jakarta/servlet/Filter", "doFilter", None, "FILTER"),
    ("javax/jms/MessageListener", "onMessage", None, "MQ"),
    ("jakarta/jms/MessageListener", "onMessage", None, "MQ"),
    ("java/lang/Runnable", "run", "()V", "ASYNC"),
    ("java/util/concurrent/Callable", "call", None, "ASYNC"),
)
MAIN = "([Ljava/lang/String;)V"


def _annotated(found: Column, kinds: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    out = F.lit(None).cast("string")
    for kind, listed in reversed(kinds):
        out = F.when(F.arrays_overlap(F.coalesce(found, F.array().cast("array<string>")), F.array(*map(F.lit, listed))), kind).otherwise(out)
    return out


def entry_kind(name: Column, descriptor: Column, access: Column, method_annotations: Column, class_annotations: Column, *, from_source: bool) -> Column:
    """Entry kind of a method.

    In class files a method annotation wins over main; in sources main wins.  A class annotation marks the
    public instance methods that are not initialisers.
    """
    main = F.when((name == "main") & (descriptor == MAIN) & (access.bitwiseAND(F.lit(0x0008)) != 0), "MAIN")
    method = _annotated(method_annotations, (("HTTP", HTTP_METHOD_ANNOTATIONS), ("MQ", MQ_METHOD_ANNOTATIONS), ("ASYNC", ASYNC_METHOD_ANNOTATIONS)))
    able = (access.bitwiseAND(F.lit(0x0001)) != 0) & (access.bitwiseAND(F.lit(0x0008)) == 0) & ~name.startswith("<")
    by_class = F.when(able, _annotated(class_annotations, (("HTTP", HTTP_CLASS_ANNOTATIONS),)))
    return F.coalesce(main, method, by_class) if from_source else F.coalesce(method, main, by_class)


def override_rules(spark, entries=OVERRIDE_ENTRIES) -> DataFrame:
    return spark.createDataFrame(list(entries), "a string, rule_name string, wanted string, kind string")


def entries_by_override(methods: DataFrame, supers: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, entry_kind) for methods without one that override an entry method of an ancestor, known or not.

    Initialisers never do, nor, where ``methods`` has an access column, static and private methods.
    ``supers`` has all (t, a), also for types outside the graph; ``rules`` has a, rule_name, wanted and kind.
    """
    known = supers.join(small(rules), "a")  # the few types with a rule, before any method
    met = graph.overriding(methods.where("entry_kind is null")).join(known, F.col("owner") == F.col("t"))
    met = met.where("(name = rule_name or (endswith(rule_name, '*') and startswith(name, substring(rule_name, 1, length(rule_name) - 1)))) and (wanted is null or wanted = descriptor)")
    return met.groupBy(names.method_id(F.col("owner"), F.col("name"), F.col("descriptor")).alias("id")).agg(F.min("kind").alias("entry_kind"))
