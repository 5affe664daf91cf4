"""Callers, callees, hierarchy, reverse impact and bounded reverse paths, all set-at-a-time.

Frames: ``calls`` and ``overrides`` (source, target), ``nodes`` (id, kind, ...), ``step`` (m, caller, rk): the
expanded reverse step, direct callers (0) and callers of overridden methods (1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans.lineage import cut

DEEPEST_HIERARCHY = 64
MOST_IMPACT_DEPTH, IMPACT_DEPTH = 8, 2
TRACE_DEPTH, TRACE_PATHS = 12, 20
#: Methods, and callers, of one parent that are paired at once; pairs that a task makes, roughly.
BLOCK, TASK_PAIRS, MOST_TASKS = 2048, 8_000_000, 20_000


def callers_direct(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method, caller, kind): callers without a node row vanish."""
    return calls.join(nodes.select("id", "kind"), F.col("source") == F.col("id")).select(F.col("target").alias("method"), F.col("source").alias("caller"), "kind")


def callees_direct(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method, callee, external): raw targets stay, with a mark if they have no node."""
    return calls.join(nodes.select("id"), F.col("target") == F.col("id"), "left").select(F.col("source").alias("method"), F.col("target").alias("callee"), F.col("id").isNull().alias("external"))


def callers_virtual(calls: DataFrame, overrides: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """(method, caller) through an overridden method, without direct callers; only of ``methods`` (method), if given."""
    through = overrides.select(F.col("source").alias("method"), F.col("target").alias("parent"))
    direct = calls.select(F.col("target").alias("method"), F.col("source").alias("caller"))
    if methods is None:
        return _virtual_pairs(calls, overrides)
    # The few meant first, so neither join meets the whole graph.
    through, direct = through.join(methods, "method", "left_semi"), direct.join(methods, "method", "left_semi")
    through = through.join(calls.select(F.col("target").alias("parent"), F.col("source").alias("caller")), "parent")
    return through.select("method", "caller").distinct().join(direct, ["method", "caller"], "left_anti")


def _virtual_pairs(calls: DataFrame, overrides: DataFrame) -> DataFrame:
    """(method, caller): all callers of what a method overrides, each once, without the method's direct callers.

    There are as many as a parent's overriding methods times its callers, so they are never shuffled: blocks of
    callers meet blocks of methods, and a pair is made where it is returned.  A pair that meets under several
    parents is made under the least of them; what has to be left out is listed for a method or a block beforehand.
    """
    through = overrides.select(F.col("source").alias("method"), F.col("target").alias("parent")).where("parent is not null").distinct()
    called = calls.join(through.select(F.col("parent").alias("target")).distinct(), "target", "left_semi").select(F.col("target").alias("parent"), F.col("source").alias("caller")).distinct()
    called = cut(called)
    parents = through.join(called.select("parent").distinct(), "parent", "left_semi").groupBy("method").agg(F.collect_set("parent").alias("parents"))
    parents = parents.select("method", "parents", F.explode("parents").alias("parent"))
    through = cut(parents.select("method", "parent", F.filter("parents", lambda p: p < F.col("parent")).alias("lower")))
    sizes = through.groupBy("parent").agg(F.count("*").alias("m")).join(called.groupBy("parent").agg(F.count("*").alias("c")), "parent")
    sizes = cut(sizes.select("parent", (F.col("m") * F.col("c")).alias("pairs"), F.ceil(F.col("m") / BLOCK).alias("method_blocks"), F.ceil(F.col("c") / BLOCK).alias("caller_blocks")))
    tasks = min((sizes.agg(F.sum("pairs")).first()[0] or 0) // TASK_PAIRS + 1, MOST_TASKS)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    # Lower parents that share a method with a parent and are called by its caller too.
    beside = called.join(through.select("parent", F.explode("lower").alias("lower")).distinct(), "parent").alias("x")
    beside = beside.join(called.alias("y"), (F.col("x.lower") == F.col("y.parent")) & F.col("x.caller").eqNullSafe(F.col("y.caller"))).groupBy("x.parent", "x.caller").agg(F.collect_set("x.lower").alias("lower"))
    told = called.alias("x").join(beside.alias("y"), (F.col("x.parent") == F.col("y.parent")) & F.col("x.caller").eqNullSafe(F.col("y.caller")), "left").select("x.parent", "x.caller", "y.lower")
    told = told.join(sizes, "parent").groupBy("parent", "method_blocks", deal("caller", "caller_blocks").alias("cb"))
    blocks = told.agg(F.collect_list(F.struct("caller")).alias("held"), F.collect_list(F.when(F.col("lower").isNotNull(), F.struct("caller", "lower"))).alias("repeated"))
    blocks = blocks.select("parent", "cb", every("method_blocks").alias("mb"), F.col("held.caller").alias("callers"), "repeated")

    direct = through.select("method", "parent").join(calls.select(F.col("target").alias("method"), F.col("source").alias("caller")), "method").join(called, ["parent", "caller"], "left_semi")
    direct = direct.join(sizes, "parent").groupBy("method", "parent", deal("caller", "caller_blocks").alias("cb")).agg(F.collect_set("caller").alias("direct"))
    methods = through.join(sizes, "parent").select("method", "parent", "lower", deal("method", "method_blocks").alias("mb"), every("caller_blocks").alias("cb")).join(direct, ["method", "parent", "cb"], "left")

    met = methods.repartition(tasks, "parent", "mb", "cb").join(blocks, ["parent", "mb", "cb"])
    twice = F.transform(F.filter("repeated", lambda r: F.arrays_overlap(r["lower"], F.col("lower"))), lambda r: r["caller"])
    some = F.array_except("callers", F.concat(F.coalesce("direct", F.array().cast("array<string>")), twice))
    whole = F.col("direct").isNull() & ((F.size("lower") == 0) | (F.size("repeated") == 0))
    return met.select("method", F.explode(F.when(whole, F.col("callers")).otherwise(some)).alias("caller"))


def callees_virtual(calls: DataFrame, overrides: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """(method, callee) through an overriding method, without direct callees; only of ``methods`` (method), if given."""
    if methods is None:
        return _virtual_pairs(calls, overrides).select(F.col("caller").alias("method"), F.col("method").alias("callee"))
    own = calls.select(F.col("source").alias("method"), "target").join(methods, "method", "left_semi")
    through = own.join(overrides.select("target", F.col("source").alias("callee")), "target")
    return through.select("method", "callee").distinct().join(own.withColumnRenamed("target", "callee"), ["method", "callee"], "left_anti")


def caller_step(calls: DataFrame, overrides: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """(m, caller, rk): distinct direct callers (0) and other callers of overridden methods (1); only of ``methods`` (method), if given."""
    direct = calls.select(F.col("target").alias("m"), F.col("source").alias("caller"))
    if methods is not None:
        direct = direct.join(methods.withColumnRenamed("method", "m"), "m", "left_semi")
    direct = direct.distinct()
    virtual = callers_virtual(calls, overrides, methods).select(F.col("method").alias("m"), "caller")
    # Among callers_virtual a null never equals another; here they do.
    nulls = direct.where("m is null or caller is null")
    if not calls.where("source is null or target is null").isEmpty():
        again = virtual.where("m is null or caller is null").alias("v").join(nulls.alias("n"), F.col("v.m").eqNullSafe(F.col("n.m")) & F.col("v.caller").eqNullSafe(F.col("n.caller")), "left_anti")
        virtual = virtual.where("m is not null and caller is not null").unionByName(again)
    return direct.withColumn("rk", F.lit(0)).unionByName(virtual.withColumn("rk", F.lit(1)))


def ancestor_closure(supers: DataFrame) -> DataFrame:
    """All (t, a) with a a transitive supertype of t, t itself excluded; cycles end; semi-naive rounds."""
    supers = supers.where("t is not null and a is not null and t <> a").select("t", "a").distinct()
    supers = cut(supers)
    found = frontier = supers
    for _ in range(DEEPEST_HIERARCHY):
        new = frontier.alias("f").join(supers.alias("s"), F.col("f.a") == F.col("s.t")).select("f.t", "s.a").where("t <> a").distinct().join(found, ["t", "a"], "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)  # each part is a written table
    raise ValueError(f"the type hierarchy is deeper than {DEEPEST_HIERARCHY}")


def overriding(methods: DataFrame) -> DataFrame:
    """Methods that can override: no initialisers and, where access is known, neither static nor private."""
    if "access" in methods.columns:
        methods = methods.where(F.coalesce(F.col("access"), F.lit(0)).bitwiseAND(F.lit(0x0008 | 0x0002)) == 0)
    return methods.where(~F.col("name").isin("<init>", "<clinit>"))


def override_edges(closure: DataFrame, methods: DataFrame) -> DataFrame:
    """(source, target): methods that can override, against the same signature in every ancestor, whatever its access there.

    ``methods`` has owner, name, descriptor and, if known, access.
    """
    sub = closure.join(overriding(methods).select(F.col("owner").alias("t"), "name", "descriptor"), "t")
    sup = methods.select(F.col("owner").alias("a"), "name", "descriptor")
    return sub.join(sup, ["a", "name", "descriptor"]).select(names.method_id(F.col("t"), F.col("name"), F.col("descriptor")).alias("source"), names.method_id(F.col("a"), F.col("name"), F.col("descriptor")).alias("target")).distinct()


@dataclass(frozen=True)
class Reverse:
    """The reverse step of calls and overrides, followed without being written out: as many rows as calls and overrides."""

    calls: DataFrame
    overrides: DataFrame

    def callers(self, frontier: DataFrame) -> DataFrame:
        """(start, caller) one step before (start, id), distinct; starts share what they override."""
        above = frontier.join(self.overrides.select(F.col("source").alias("id"), "target"), "id").select("start", F.col("target").alias("id"))
        calls = self.calls.select(F.col("target").alias("id"), F.col("source").alias("caller"))
        return frontier.select("start", "id").unionByName(above).distinct().join(calls, "id").select("start", "caller").distinct()

    def nearest(self, starts: DataFrame, most: int) -> DataFrame:
        """(cur, callers): the first ``most`` callers, as (rk, caller) in sibling order, of starts and of methods that call.

        The first ``most`` callers of each parent hold the first virtual ones: where fewer than ``most`` are direct,
        as many of a parent's at most are direct ones too.  Methods that override the same share one list.
        """
        order = Window.partitionBy("cur").orderBy("caller")
        calls = self.calls.select(F.col("target").alias("cur"), F.col("source").alias("caller")).where("cur is not null and caller is not null")

        def first(rows: DataFrame) -> DataFrame:
            rows = rows.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
            return rows.groupBy("cur").agg(F.sort_array(F.collect_list("caller")).alias("list"))

        direct = cut(first(calls))
        asked = calls.select(F.col("caller").alias("cur")).unionByName(starts.select(F.col("start").alias("cur"))).distinct()
        through = self.overrides.select(F.col("source").alias("cur"), F.col("target").alias("parent")).join(direct.select(F.col("cur").alias("parent")), "parent", "left_semi").join(asked, "cur", "left_semi")
        heirs = cut(through.groupBy("cur").agg(F.sort_array(F.collect_set("parent")).alias("parents")))
        above = heirs.select("parents").distinct().select("parents", F.explode("parents").alias("parent")).join(direct.select(F.col("cur").alias("parent"), "list"), "parent")
        above = first(above.select(F.col("parents").alias("cur"), F.explode("list").alias("caller"))).select(F.col("cur").alias("parents"), F.col("list").alias("virtual"))
        nothing = F.array().cast("array<string>")
        ranked = lambda c, rk: F.transform(c, lambda x: F.struct(F.lit(rk).alias("rk"), x.alias("caller")))
        own = F.coalesce("list", nothing)
        both = direct.join(heirs.join(above, "parents").select("cur", "virtual"), "cur", "full")
        return both.select("cur", F.slice(F.concat(ranked(own, 0), ranked(F.array_except(F.coalesce("virtual", nothing), own), 1)), 1, most).alias("callers"))


def impact(step: DataFrame | Reverse, starts: DataFrame, depth: int = IMPACT_DEPTH, *, written: bool = False) -> DataFrame:
    """(start, id, depth): everything that reaches a start in at most ``depth`` reverse steps, starts excluded.

    ``starts`` has one column start.  Breadth first, so depth is the first level reached.  ``written`` says that
    ``step`` is a table already; else it is written once, not planned anew at every level.  A ``Reverse`` is followed as it is.
    """
    depth = IMPACT_DEPTH if depth <= 0 else min(depth, MOST_IMPACT_DEPTH)
    frontier = cut(starts.select("start", F.col("start").alias("id")).distinct())
    seen = frontier.withColumn("depth", F.lit(0))
    if not isinstance(step, Reverse):
        edges = (step if written else cut(step.select("m", "caller"))).select(F.col("m").alias("id"), F.col("caller"))
    for level in range(1, depth + 1):
        met = step.callers(frontier) if isinstance(step, Reverse) else frontier.join(edges, "id").select("start", "caller").distinct()
        new = met.select("start", F.col("caller").alias("id")).join(seen, ["start", "id"], "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return seen.where("depth > 0")


def adjacency(step: DataFrame, sources: DataFrame, *, most: int) -> DataFrame:
    """(cur, callers, callers_cut, is_source): a method's callers in sibling order, the first ``most`` of them.

    A path of the beam has at most ``TRACE_DEPTH`` methods, so callers beyond paths + depth never matter.
    """
    order = Window.partitionBy("m").orderBy("rk", "caller")
    first = step.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    lists = first.groupBy(F.col("m").alias("cur")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "caller"))), lambda s: F.struct(F.concat(s["rk"].cast("string"), s["caller"]).alias("key"), s["caller"].alias("id"))).alias("callers"))
    marked = sources.select(F.col("m").alias("cur"), F.lit(True).alias("is_source")).distinct()
    return lists.join(marked, "cur", "full").select("cur", "callers", F.coalesce("is_source", F.lit(False)).alias("is_source"))


#: Methods at the ends of paths whose callers are looked up by a broadcast at most; more are joined by a shuffle.
BROADCAST_ENDS = 100_000


def _ends(step: DataFrame | Reverse, sources: DataFrame, starts: DataFrame, *, most: int) -> DataFrame:
    """The adjacency of a step, written."""
    if not isinstance(step, Reverse):
        return cut(adjacency(step, sources, most=most))
    keyed = F.transform("callers", lambda s: F.struct(F.concat(s["rk"].cast("string"), s["caller"]).alias("key"), s["caller"].alias("id")))
    marked = sources.select(F.col("m").alias("cur"), F.lit(True).alias("is_source")).distinct()
    return cut(step.nearest(starts, most).join(marked, "cur", "full").select("cur", keyed.alias("callers"), F.coalesce("is_source", F.lit(False)).alias("is_source")))


def trace(step: DataFrame | Reverse, sources: DataFrame, starts: DataFrame, *, depth: int = TRACE_DEPTH, paths: int = TRACE_PATHS) -> DataFrame:
    """(start, path, terminal, depth): the first ``paths`` reverse paths of each start in depth-first order.

    A path ends at a method without callers (entry), at one that reads a source (source), at full depth
    (depth), or where all callers are on it already (cycle).  Siblings are in order of (rank, id).
    ``path`` is written from the end found to the start.

    Every partial path ends in some full path and none is a prefix of another, so keeping the ``paths``
    smallest by sort key at every level keeps exactly the paths wanted.
    """
    near = _ends(step, sources, starts, most=paths + depth)
    best = Window.partitionBy("start").orderBy("key")
    nothing = F.lit(None).cast("string")
    rows = cut(starts.select("start").distinct()).select("start", F.array("start").alias("path"), F.array(F.lit("")).alias("key"), nothing.alias("terminal"))
    for level in range(1, depth + 1):
        # Ended paths ride along as they are, so a level is one join and one explode over one input.
        live = rows.withColumn("cur", F.when(F.col("terminal").isNull(), F.element_at("path", -1)))
        met = near
        if isinstance(step, Reverse):  # rows are a table here: only the lists that this level meets are moved
            ends = live.where("cur is not null").select("cur").distinct()
            met = near.join(F.broadcast(ends) if ends.count() <= BROADCAST_ENDS else ends, "cur", "left_semi")
        live = live.join(met, "cur", "left")
        live = live.withColumn("next", F.filter(F.coalesce("callers", F.array().cast("array<struct<key:string,id:string>>")), lambda c: ~F.array_contains(F.col("path"), c["id"])))
        ended = (
            F.when(F.col("terminal").isNotNull(), F.col("terminal"))
            .when(F.lit(level > 1) & F.coalesce("is_source", F.lit(False)), "source")
            .when(F.lit(level >= depth), F.when(F.col("callers").isNull(), "entry").otherwise("depth"))
            .when(F.col("callers").isNull(), "entry")
            .when(F.size("next") == 0, "cycle")
        )
        live = live.withColumn("ended", ended)
        same = F.array(F.struct("path", "key", F.col("ended").alias("terminal")))
        grown = F.transform(F.slice("next", 1, paths), lambda n: F.struct(F.concat(F.col("path"), F.array(n["id"])).alias("path"), F.concat(F.col("key"), F.array(n["key"])).alias("key"), nothing.alias("terminal")))
        rows = live.select("start", F.explode(F.when(F.col("ended").isNotNull(), same).otherwise(grown)).alias("r")).select("start", "r.*")
        rows = rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= paths).drop("k")
        if level % 4 == 0 or isinstance(step, Reverse):
            rows = cut(rows)
            if rows.where("terminal is null").isEmpty():
                break
    return rows.select("start", F.reverse("path").alias("path"), "terminal", F.size("path").alias("depth"), F.row_number().over(best).alias("k"))
