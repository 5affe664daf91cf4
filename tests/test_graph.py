import random

import pytest

from loomgraph.operators import graph, search


def depth_first(step, sources, start, depth, most):
    """Paths in depth-first order, as a plain program finds them."""
    out = []

    def walk(path):
        if len(out) >= most:
            return
        cur = path[-1]
        callers = [c for _, c in sorted((r, c) for m, c, r in step if m == cur)]
        nxt = [c for c in callers if c not in path]
        if len(path) > 1 and cur in sources:
            return out.append((path[::-1], "source"))
        if not callers:
            return out.append((path[::-1], "entry"))
        if len(path) >= depth:
            return out.append((path[::-1], "depth"))
        if not nxt:
            return out.append((path[::-1], "cycle"))
        for c in nxt:
            walk([*path, c])
        return None

    walk([start])
    return out[:most]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trace_as_depth_first_search(spark, seed):
    rng = random.Random(seed)
    ids = [f"m{k}" for k in range(9)]
    step = sorted({(a, b): (a, b, rng.randint(0, 1)) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(22))}.values())
    sources = set(rng.sample(ids, 2))
    df = spark.createDataFrame(step, "m string, caller string, rk int")
    src = spark.createDataFrame([(s,) for s in sources], "m string")
    starts = spark.createDataFrame([(i,) for i in ids], "start string")
    for depth, most in ((5, 4), (12, 20)):
        rows = graph.trace(df, src, starts, depth=depth, paths=most).collect()
        for s in ids:
            mine = [(r.path, r.terminal) for r in sorted((r for r in rows if r.start == s), key=lambda r: r.k)]
            assert mine == depth_first(step, sources, s, depth, most)


def test_impact_levels(spark):
    step = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("c", "d", 1), ("a", "c", 1)], "m string, caller string, rk int")
    rows = {(r.id, r.depth) for r in graph.impact(step, spark.createDataFrame([("a",)], "start string"), 8).collect()}
    assert rows == {("b", 1), ("c", 1), ("d", 2)}


def test_diamond(spark):
    supers = spark.createDataFrame([("C", "A"), ("C", "B"), ("A", "I"), ("B", "I"), ("I", "I"), ("X", "Y"), ("Y", "X")], "t string, a string")
    closure = graph.ancestor_closure(supers)
    assert {tuple(r) for r in closure.collect()} == {("C", "A"), ("C", "B"), ("C", "I"), ("A", "I"), ("B", "I"), ("X", "Y"), ("Y", "X")}
    methods = spark.createDataFrame([("C", "m", "()V", 1), ("I", "m", "()V", 1), ("A", "m", "()V", 8), ("B", "m", "(I)V", 1), ("C", "<init>", "()V", 1), ("I", "<init>", "()V", 1), ("C", "s", "()V", 8), ("I", "s", "()V", 1), ("C", "p", "()V", 2), ("I", "p", "()V", 1)], "owner string, name string, descriptor string, access int")
    assert {tuple(r) for r in graph.override_edges(closure, methods).collect()} == {("M:C#m()V", "M:I#m()V"), ("M:C#m()V", "M:A#m()V")}  # an ancestor's access does not matter


def nodes(spark):
    rows = [("C:demo/Demo", "class", "Demo", None, None), ("M:demo/Demo#run()V", "method", "run", "demo/Demo", "()V"), ("M:demo/Demo#my_field()V", "method", "my_field", "demo/Demo", "()V"), ("M:demo/Other#field_my()V", "method", "field_my", "demo/Other", "()V")]
    return spark.createDataFrame(rows, "id string, kind string, name string, owner string, descriptor string")


def test_words_may_be_in_different_columns(spark):
    assert [r.id for r in search.combined(nodes(spark), "demo run").collect()] == ["M:demo/Demo#run()V"]
    assert [r.id for r in search.combined(nodes(spark), "C:demo/Demo").collect()] == ["C:demo/Demo"]
    assert search.combined(nodes(spark), "C:demo/Nothing").count() == 0


def test_a_term_with_separators_is_a_phrase(spark):
    hits = {r.id for r in search.term_hits(search.postings(nodes(spark)), "my_field").collect()}
    assert hits == {"M:demo/Demo#my_field()V"}


def test_scores_as_in_sqlite(spark):
    import sqlite3

    rows = [(f"n{i}", "method", n, o, "()V") for i, (n, o) in enumerate([("alpha beta", "x"), ("alpha", "beta y"), ("gamma", "alpha"), ("beta", "beta"), ("delta alpha alpha", "z beta w v u")])]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, name, owner, descriptor)")
    con.executemany("insert into f values (?, ?, ?, ?)", [(r[0], *r[2:]) for r in rows])
    want = {i: round(s, 4) for i, s in con.execute("select id, bm25(f) from f where f match '\"alpha\" AND \"beta\"'")}
    df = spark.createDataFrame(rows, "id string, kind string, name string, owner string, descriptor string")
    assert {r.id: round(r.score, 4) for r in search.bm25(df, "alpha beta").collect()} == want


def test_letters_with_marks_are_folded(spark):
    rows = [("M:a/Café#prüfe()V", "method", "prüfe", "a/Café", "()V"), ("M:a/Cafe#other()V", "method", "other", "a/Cafe", "()V")]
    df = spark.createDataFrame(rows, "id string, kind string, name string, owner string, descriptor string")
    assert [r.id for r in search.combined(df, "PRUFE cafe").collect()] == [rows[0][0]]
    assert {r.id for r in search.term_hits(search.postings(df), "CAFE").collect()} == {r[0] for r in rows}
    assert search.fold("ÀŽ") == "az"


def test_an_escaped_search_takes_wildcards_as_they_are(spark):
    rows = [("M:a/B#x_y()V", "method", "x_y", "a/B", "()V"), ("M:a/B#xzy()V", "method", "xzy", "a/B", "()V")]
    df = spark.createDataFrame(rows, "id string, kind string, name string, owner string, descriptor string")
    assert search.like_hits(df, "x_y").count() == 2 and search.like_hits(df, "x_y", escape=True).count() == 1


def test_a_stored_index_scores_as_a_made_one(spark):
    df = nodes(spark)
    index = search.indexed(df)
    made = {r.id: r.score for r in search.bm25(df, "demo run").collect()}
    assert made == {r.id: r.score for r in search.bm25(df, "demo run", index=index, totals=(df.count(), index.count())).collect()}


def test_suffixes_may_start_in_a_name(spark):
    from loomgraph.operators import inventory

    paths = spark.createDataFrame([("/s/BA.java",), ("/s/A.java",), ("/s/B.java",), (None,), ("a",)], "p string")
    found = inventory.ending_in(paths, "p", spark.createDataFrame([("A.java",), ("",), ("/s/A.javax",)], "suffix string"))
    assert {r.p for r in found.collect()} == {"/s/BA.java", "/s/A.java"}
    assert inventory.ending_in(paths, "p", spark.createDataFrame([], "suffix string")).count() == 0


def test_entries_by_override_need_a_method_that_overrides(spark):
    from loomgraph.operators import security

    methods = [("A", "doIt", "()V", 1, None), ("A", "service", "()V", 8, None), ("A", "undo", "()V", 1, None), ("R", "run", "()V", 2, None), ("R", "run", "(I)V", 1, None), ("S", "run", "()V", 1, None), ("S", "call", "()V", 1, "HTTP")]
    df = spark.createDataFrame(methods, "owner string, name string, descriptor string, access int, entry_kind string")
    supers = spark.createDataFrame([("A", "javax/servlet/http/HttpServlet"), ("R", "java/lang/Runnable"), ("S", "java/lang/Runnable"), ("S", "java/util/concurrent/Callable")], "t string, a string")
    got = {tuple(r) for r in security.entries_by_override(df, supers, security.override_rules(spark)).collect()}
    assert got == {("M:A#doIt()V", "SERVLET"), ("M:S#run()V", "ASYNC")}


def test_virtual_neighbours_of_the_methods_meant(spark):
    calls = spark.createDataFrame([("x", "I.m"), ("y", "A.m"), ("A.m", "z"), ("x", "B.m")], "source string, target string")
    overrides = spark.createDataFrame([("A.m", "I.m"), ("B.m", "I.m")], "source string, target string")
    meant = spark.createDataFrame([("A.m",), ("x",)], "method string")
    for f in (graph.callers_virtual, graph.callees_virtual):
        whole = {tuple(r) for r in f(calls, overrides).collect()}
        assert {tuple(r) for r in f(calls, overrides, meant).collect()} == {r for r in whole if r[0] in ("A.m", "x")}


def test_virtual_pairs_are_made_in_blocks(spark, monkeypatch):
    """Against plain sets: several parents for a pair, direct callers left out, nulls, repeats; no step deals pairs out."""
    monkeypatch.setattr(graph, "BLOCK", 3)
    rng = random.Random(4)
    ids = [f"m{k}" for k in range(14)]
    pick = lambda n: [(rng.choice(ids), rng.choice(ids)) for _ in range(n)]
    calls, overrides = [*pick(60), (None, "m1"), (None, "m2"), ("m3", None)], [*pick(30), ("m5", "m1"), ("m5", "m2"), (None, "m2"), ("m4", None)]
    want = {(o, c) for o, p in overrides for c, t in calls if t is not None and t == p and (c is None or o is None or (c, o) not in calls)}
    frames = [spark.createDataFrame(rows, "source string, target string") for rows in (calls, overrides)]
    got = graph.callers_virtual(*frames)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate explode")[0]


def test_virtual_callees_are_the_same_pairs(spark):
    calls = spark.createDataFrame([("x", "I.m"), ("x", "A.m"), ("y", "I.m"), ("y", "J.m")], "source string, target string")
    overrides = spark.createDataFrame([("A.m", "I.m"), ("B.m", "I.m"), ("B.m", "J.m")], "source string, target string")
    got = graph.callees_virtual(calls, overrides)
    assert sorted(tuple(r) for r in got.collect()) == [("x", "B.m"), ("y", "A.m"), ("y", "B.m")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]


def test_the_step_makes_virtual_callers_in_place(spark):
    calls = [("x", "I.m"), ("x", "A.m"), ("x", "A.m"), (None, "I.m"), (None, "A.m"), ("z", None)]
    overrides = [("A.m", "I.m"), ("B.m", "I.m"), (None, "I.m")]
    frames = [spark.createDataFrame(rows, "source string, target string") for rows in (calls, overrides)]
    got = graph.caller_step(*frames)
    want = [("I.m", "x", 0), ("A.m", "x", 0), ("I.m", None, 0), ("A.m", None, 0), (None, "z", 0), ("B.m", "x", 1), ("B.m", None, 1), (None, "x", 1), (None, None, 1)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "Generate explode" in got._jdf.queryExecution().executedPlan().toString()
    few = graph.caller_step(*frames, spark.createDataFrame([("B.m",)], "method string"))
    assert sorted(map(repr, map(tuple, few.collect()))) == sorted(map(repr, [r for r in want if r[0] == "B.m"]))


def test_the_context_takes_the_step_of_its_hits_only(spark):
    from loomgraph.plans import fixture, registry

    g = fixture.Fixture(spark, "/root/testdata/sf0.001")
    assert registry.context_bundle(g).count() == 4 and "step" not in g._made


def hierarchy(spark, seed):
    """Calls and overrides by chance, and the step written out from them."""
    rng = random.Random(seed)
    ids = [f"m{k}" for k in range(10)]
    pick = lambda n: [(rng.choice(ids), rng.choice(ids)) for _ in range(n)]
    calls, overrides = pick(20), pick(7)
    step = {(p, c): 1 for p, t in overrides for c, m in calls if m == t} | {(m, c): 0 for c, m in calls}
    frames = [spark.createDataFrame(rows, "source string, target string") for rows in (calls, overrides)]
    return ids, rng, graph.Reverse(*frames), [(m, c, rk) for (m, c), rk in step.items()]


@pytest.mark.parametrize("seed", [5, 6])
def test_impact_without_a_written_step(spark, seed):
    ids, _, reverse, step = hierarchy(spark, seed)
    starts = spark.createDataFrame([(i,) for i in ids[:4]], "start string")
    want = graph.impact(spark.createDataFrame(step, "m string, caller string, rk int"), starts, 4).collect()
    assert sorted(map(tuple, graph.impact(reverse, starts, 4).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("seed", [5, 6])
def test_trace_without_a_written_step(spark, seed, monkeypatch):
    ids, rng, reverse, step = hierarchy(spark, seed)
    sources = set(rng.sample(ids, 2))
    src = spark.createDataFrame([(s,) for s in sources], "m string")
    starts = spark.createDataFrame([(i,) for i in ids], "start string")
    monkeypatch.setattr(graph, "BROADCAST_ENDS", 5)
    for depth, most in ((4, 2), (7, 20)):  # few: callers beyond most + depth are cut
        rows = graph.trace(reverse, src, starts, depth=depth, paths=most).collect()
        for s in ids:
            mine = [(r.path, r.terminal) for r in sorted((r for r in rows if r.start == s), key=lambda r: r.k)]
            assert mine == depth_first(step, sources, s, depth, most)


def test_nearest_callers_hold_the_first_virtual_ones(spark):
    """Direct callers that are a parent's first callers too do not push later virtual ones out."""
    calls = [(f"c{k}", "I") for k in range(6)] + [("c0", "A"), ("c1", "A"), ("A", "c5"), ("d", "J")]
    frames = [spark.createDataFrame(rows, "source string, target string") for rows in (calls, [("A", "I"), ("A", "J"), ("B", "I")])]
    found = {r.cur: [tuple(c) for c in r.callers] for r in graph.Reverse(*frames).nearest(spark.createDataFrame([("B",)], "start string"), 4).collect()}
    assert found["A"] == [(0, "c0"), (0, "c1"), (1, "c2"), (1, "c3")] and found["B"] == [(1, "c0"), (1, "c1"), (1, "c2"), (1, "c3")]


def test_graph_queries_store_no_step(spark):
    from loomgraph.plans import fixture, registry

    g = fixture.Fixture(spark, "/root/testdata/sf0.001")
    assert registry.taint_candidates(g).count() > 0 and "step" not in g._made and "step" not in fixture.STORED
