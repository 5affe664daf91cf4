import io
import json
import shutil
import subprocess
import zipfile

import pytest

from loomgraph.operators import taint
from loomgraph.plans import engine, store
from loomgraph.sources import artifacts, classfile, javasource, rules
from loomgraph.streaming import server

pytestmark = pytest.mark.skipif(not shutil.which("javac"), reason="no compiler here")

JAVA = """
package p;
import java.util.*;
public class Web extends Base implements Runnable {
    private int val;
    static native String read(String key);
    static int clean(String s) { return Integer.parseInt(s); }
    public static void main(String[] args) { new Web().pass(args[0] + "x", 3L); }
    void pass(String s, long n) { String t = n > 2 ? s : "none"; helper(n, t); }
    void helper(double d, String s) { try { Runtime.getRuntime().exec((String) (Object) s); } catch (Exception e) { throw new RuntimeException(e); } }
    void lost(String s) { helper(1, String.valueOf(clean(s))); }
    void number(String s, int k) { switch (k) { case 1: s = "a"; break; case 900: s = s + k; break; default: } helper(k, s); }
    void source() { helper(0, System.getProperty("a")); }
    void viaInterface(Face f, String s) { f.face(s); }
    public void run() { Supplier2 x = this::run; for (int i = 0; i < 3; i++) { val += i; } List<String> l = new ArrayList<>(); l.forEach(q -> helper(1, q)); }
    interface Supplier2 { void get(); }
    interface Face { void face(String s); }
    static class Impl implements Face { public void face(String s) { new Web().helper(2, s); } }
    enum Kind { A, B }
}
abstract class Base { public void run() { } abstract void pass(String s, long n); }
"""


@pytest.fixture(scope="module")
def built(tmp_path_factory):
    d = tmp_path_factory.mktemp("java")
    (d / "Web.java").write_text(JAVA)
    subprocess.run(["javac", "-d", str(d), str(d / "Web.java")], check=True, capture_output=True)
    return d


@pytest.fixture(scope="module")
def classes(built):
    return {(c := classfile.read_class(f.read_bytes())).name: f.read_bytes() for f in built.rglob("*.class")}


def test_class_reader(classes):
    nodes, edges = classfile.graph_rows(classfile.read_class(classes["p/Web"]), "/Web.class")
    ids = {n["id"]: n for n in nodes}
    have = {(e["source"], e["target"], e["kind"]) for e in edges}
    assert ids["C:p/Web"]["kind"] == "class" and ids["M:p/Web#main([Ljava/lang/String;)V"]["start_line"] > 0
    assert ("C:p/Web", "C:p/Base", "extends") in have and ("C:p/Web", "C:java/lang/Runnable", "implements") in have
    assert ("M:p/Web#pass(Ljava/lang/String;J)V", "M:p/Web#helper(DLjava/lang/String;)V", "calls") in have
    assert ("M:p/Web#run()V", "M:p/Web#run()V", "calls") in have  # a method reference
    assert any(n["synthetic"] for n in nodes if n["name"].startswith("lambda$"))
    base, _ = classfile.graph_rows(classfile.read_class(classes["p/Base"]), "/Base.class")
    assert [n["name"] for n in base] == ["Base", "<init>", "run", "pass"]
    kind, _ = classfile.graph_rows(classfile.read_class(classes["p/Web$Kind"]), "/Kind.class")
    assert (kind[0]["kind"], kind[0]["name"]) == ("enum", "Kind")
    for data in classes.values():
        for m in classfile.read_class(data).methods:
            if m.code:
                got = classfile.instructions(m.code)
                assert [i.at for i in got] == sorted({i.at for i in got}) and all(t in {i.at for i in got} for i in got for t in i.targets)
    with pytest.raises(ValueError):
        classfile.read_class(b"\xca\xfe\xba\xbf")


SINK = "M:java/lang/Runtime#exec(Ljava/lang/String;)Ljava/lang/Process;"
HELPER = "M:p/Web#helper(DLjava/lang/String;)V"
RULES = taint.Rules({("java/lang/System", "getProperty")}, [("p/Web", "clean", "*", 0)], [])


@pytest.mark.parametrize(
    ("chain", "passed"),
    [
        ([HELPER], True),
        (["M:p/Web#pass(Ljava/lang/String;J)V", HELPER], True),
        (["M:p/Web#main([Ljava/lang/String;)V", "M:p/Web#pass(Ljava/lang/String;J)V", HELPER], False),  # an array element is not followed
        (["M:p/Web#lost(Ljava/lang/String;)V", HELPER], False),
        (["M:p/Web#number(Ljava/lang/String;I)V", HELPER], True),
        (["M:p/Web#source()V", HELPER], True),
        (["M:p/Web#viaInterface(Lp/Web$Face;Ljava/lang/String;)V", "M:p/Web$Face#face(Ljava/lang/String;)V", "M:p/Web$Impl#face(Ljava/lang/String;)V", HELPER], True),
        (["M:p/Nowhere#x(Ljava/lang/String;)V", HELPER], False),
        (["no id"], False),
    ],
)
def test_flows(classes, chain, passed):
    got = taint.verify(chain, SINK, classes, RULES)
    assert got.passed == passed, got.log


def test_a_sanitizer_is_reported(classes):
    got = taint.verify(["M:p/Web#lost(Ljava/lang/String;)V", HELPER], SINK, classes, RULES)
    assert got.sanitizers == ["p/Web#clean"]


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(classes):
    web = classes["p/Web"]
    inner = archive({"p/Web.class": web, "q/A.java": "class A {}"})
    outer = archive({"p/Web.class": web, "../evil.class": web, "module-info.class": web, "lib/in.jar": inner, "note.txt": "x"})
    found = [(path, kind) for path, _, kind, _ in artifacts.expand("o.jar", outer)]
    assert found == [("o.jar!/p/Web.class", "class"), ("o.jar!/lib/in.jar!/p/Web.class", "class"), ("o.jar!/lib/in.jar!/q/A.java", "java")]
    deep = inner
    for _ in range(9):
        deep = archive({"n.jar": deep})
    assert list(artifacts.expand("d.jar", deep)) == [] == list(artifacts.expand("bad.jar", b"not a zip"))


def test_source_scanner():
    nodes, edges = javasource.graph_rows(JAVA, "/Web.java")
    ids = {n["id"] for n in nodes}
    assert {"C:p/Web", "C:p/Web$Face", "C:p/Web$Kind", "C:p/Base", "F:p/Web#val", "M:p/Web#pass(Ljava/lang/String;J)V", "M:p/Web$Impl#face(Ljava/lang/String;)V"} <= ids
    have = {(e["source"], e["target"], e["provenance"]) for e in edges}
    assert ("M:p/Web#pass(Ljava/lang/String;J)V", HELPER, "source-self") in have
    assert ("M:p/Web#main([Ljava/lang/String;)V", "M:p/Web#<init>()?", "source-ctor") in have
    assert javasource.graph_rows("class {{{", "/x") == ([], [])


@pytest.fixture(scope="module")
def indexed(spark, built, tmp_path_factory):
    src, db = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("db")
    (src / "a.jar").write_bytes(archive({f.name: f.read_bytes() for f in built.rglob("*.class")}))
    (src / "b.jar").write_bytes(archive({f.name: f.read_bytes() for f in built.rglob("*.class")}))
    (src / "p").mkdir()
    (src / "p" / "Web.java").write_text(JAVA)
    engine.index(spark, src.as_uri(), db.as_uri())
    return src, db


def test_index_and_questions(spark, indexed):
    src, db = indexed
    e = engine.Engine(spark, db.as_uri())
    assert int(e.snapshot.meta.where("key = 'duplicate_classes'").first().value) == 6
    assert e.nodes.count() == e.nodes.select("id").distinct().count()
    edges = {(r.source, r.target, r.kind) for r in e.edges.collect()}
    assert ("M:p/Web#run()V", "M:p/Base#run()V", "overrides") in edges and ("M:p/Web#run()V", "M:java/lang/Runnable#run()V", "overrides") not in edges
    kinds = {r.id: r.entry_kind for r in e.nodes.collect()}
    assert kinds["M:p/Web#main([Ljava/lang/String;)V"] == "MAIN" and kinds["M:p/Web#run()V"] == "ASYNC"
    assert {r.caller for r in e.callers(HELPER).collect()} >= {"M:p/Web#pass(Ljava/lang/String;J)V", "M:p/Web$Impl#face(Ljava/lang/String;)V"}
    assert "M:p/Web#main([Ljava/lang/String;)V" in {r.id for r in e.impact(HELPER, 2).collect()}
    assert [r.source for r in e.sinks("EXEC").collect()] == [HELPER]
    assert e.sinks(scope=engine.Scope.of("q")).count() == 0
    assert {r.terminal for r in e.trace(HELPER).collect()} >= {"entry"}
    scan = e.taint_scan("exec").collect()
    assert any(r.passed for r in scan) and [r.priority for r in scan] == sorted(r.priority for r in scan)
    assert e.grep("runtime.getruntime").first().line == 10
    assert e.method_source("p.Web", "clean").first().text.strip().startswith("static int clean")
    assert e.staleness().first().stale is False and e.sync() is False
    (src / "p" / "New.java").write_text("package p; class New {}")
    assert tuple(e.staleness().first()) == (0, 0, 1, True)
    assert e.sync() is True and e.nodes.where("id = 'C:p/New'").count() == 1
    (src / "p" / "New.java").unlink()


def test_a_class_without_source_has_a_skeleton(classes):
    text = artifacts.skeleton(classes["p/Web$Impl"])
    assert "class Web$Impl implements p.Web$Face {" in text and "p/Web.helper(DLjava/lang/String;)V;" in text


def test_changed_paths_from_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.java").write_text("1")
    git("add", ".")
    git("commit", "-qm", "a")
    git("checkout", "-qb", "next")
    (tmp_path / "b.java").write_text("2")
    git("add", ".")
    git("commit", "-qm", "b")
    assert [r.path for r in rules.git_changed(spark, str(tmp_path), "main").collect()] == ["b.java"]


def test_requests(spark, indexed):
    e = engine.Engine(spark, indexed[1].as_uri())
    ask = lambda *lines: [json.loads(x) for x in server.serve(e, [json.dumps(x) if isinstance(x, dict) else x for x in lines])]
    got = ask({"id": 1, "method": "initialize"}, "no json", {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "x"}, {"id": 4, "method": "tools/call", "params": {"name": "y"}}, {"id": 5, "method": "tools/call", "params": {"name": "outline", "arguments": {"class": "p.Web"}}}, {"id": 6, "method": "tools/call", "params": {"name": "sinks", "arguments": {"format": "json"}}}, {"id": 7, "method": "tools/call", "params": {"name": "search"}})
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 6, 7]
    assert len(got[1]["result"]["tools"]) == 18 and got[2]["error"]["code"] == -32601 and got[3]["error"]["code"] == got[6]["error"]["code"] == -32602
    assert "M:p/Web#run()V" in got[4]["result"]["content"][0]["text"]
    assert json.loads(got[5]["result"]["content"][0]["text"])[0]["category"] == "exec"
    assert server.shorten("a" * 10 + "\n" + "b" * 2, 12) == ("a" * 10, True) and server.shorten("abc", 5) == ("abc", False)


def test_an_older_index_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.open_current(spark, tmp_path.as_uri())
    with pytest.raises(ValueError, match="synthetic"):
        store.write(spark, tmp_path.as_uri(), {"nodes": spark.createDataFrame([("x",)], "id string")})
    columns = ", ".join(f"{c} string" for c in sorted(store.NODE_COLUMNS))
    with pytest.raises(ValueError, match="steps"):
        store.write(spark, tmp_path.as_uri(), {"nodes": spark.createDataFrame([], columns)})


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# x\nsink a b/C#d\nbad\n")
    assert [tuple(r) for r in rules.read_rules(spark, str(tmp_path / "r.txt")).collect()] == [("sink", "a", "b/C", "d", 2)]
    assert rules.read_rules(spark).count() > 50
    assert rules.read_rules(spark, str(tmp_path / "none.txt")).count() == rules.read_rules(spark).count()
    (tmp_path / "p.json").write_text('{"rules": [{"className": "a/B", "methodName": "c", "from": "any", "to": "ret"}]}')
    assert len(rules.read_json_rules((tmp_path / "p.json").as_uri(), spark)) == 1 and rules.read_json_rules((tmp_path / "q.json").as_uri(), spark) == []
    assert rules.read_json_rules(tmp_path / "none.json") == [] and rules.read_json_rules(rules.RULES / "sanitizers.json")


def test_lines_errors_and_places(spark, indexed):
    """What the index keeps besides the graph: lines of linked calls, errors of files, places in sources."""
    e = engine.Engine(spark, indexed[1].as_uri())
    node = e.nodes.where(f"id = '{HELPER}'").first()
    assert node.file_path.endswith("Web.java") and (node.start_line, node.end_line) == (10, 10)
    assert e.nodes.where("id = 'F:p/Web#val'").first().file_path.endswith("Web.java")
    assert e.nodes.where("id = 'C:p/Web$Face'").first().start_line == 17
    assert {"work_dir", "materialize", "input", "indexed_at", "duplicate_classes"} <= set(e.meta)


def test_unreadable_files_are_reported(spark, classes, tmp_path):
    src, db = tmp_path / "in", tmp_path / "db"
    src.mkdir()
    web = classes["p/Web"]
    at = web.rindex(b"\xb1")  # somewhere in a body: the pool parses, the code does not
    (src / "Cut.class").write_bytes(web[: len(web) // 2])
    (src / "Short.class").write_bytes(b"\xca\xfe")
    (src / "bad.jar").write_bytes(b"no archive")
    (src / "ok.jar").write_bytes(archive({"p/Base.class": classes["p/Base"], "p/Broken.java": "class {{{"}))
    assert at
    engine.index(spark, src.as_uri(), db.as_uri())
    e = engine.Engine(spark, db.as_uri())
    errors = {r.path.rpartition("/")[2]: r.errors for r in e.snapshot.files.collect()}
    assert errors["Cut.class"] and errors["Short.class"] and errors["bad.jar"] and "Broken.java" in errors["ok.jar"]
    assert e.nodes.where("id = 'C:p/Base'").count() == 1
    assert "[" in server.as_text(e, "files", {}) and not list(db.glob("work-*"))


def test_texts_of_answers(spark, indexed, tmp_path, capsys):
    e = engine.Engine(spark, indexed[1].as_uri())
    text = lambda tool, **a: server.as_text(e, tool, a)
    got = text("status")
    assert "files by origin: bytecode" in got and "duplicate classes: 6" in got and "stale:" in got and "indexed_at: 20" in got
    assert "more files" not in text("files") and "... " in text("files", limit=1) and text("files", origin="x") == "no indexed files match"
    assert "classes " in text("overview") and "exec: " in text("overview")
    assert text("sinks", category="exec").count("->") == 1 and "[exec] (1)" in text("sinks") and text("sinks", category="none").startswith("no sinks")
    assert "descriptor: (DLjava/lang/String;)V" in text("def", name=HELPER)
    assert text("callers", name=HELPER).startswith("callers: ") and "direct" in text("callers", name=HELPER)
    assert "verified flows" in text("taint", category="exec") and "budget=5" in text("taint", category="exec", budget="5")
    assert text("method", **{"class": "p.Web", "method": "helper"}).count("void helper") == 1
    one = e.method_source("p.Web", "helper", descriptor="(DLjava/lang/String;)V").collect()
    assert len(one) == 1 and one[0].note is None
    assert e.method_source("p.Web", "helper", arity=7).count() == 0
    changed = tmp_path / "changed.txt"
    changed.write_text("# c\np/Web.java\n")
    assert server.main(["sinks", "--db", indexed[1].as_uri(), "--changed-files", changed.as_uri()]) == 0
    assert "exec" in capsys.readouterr().out
    changed.write_text("q/None.java\n")
    assert server.main(["sinks", "--db", indexed[1].as_uri(), "--changed-files", changed.as_uri()]) == 0
    assert "no sinks" in capsys.readouterr().out
    assert server.main(["status", "--db", indexed[1].as_uri(), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["nodes"] > 0


def test_an_input_touched_later_is_stale(spark, tmp_path):
    import os
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "One.java").write_text("class One { }")
    engine.index(spark, (tmp_path / "in").as_uri(), (tmp_path / "db").as_uri())
    e = engine.Engine(spark, (tmp_path / "db").as_uri())
    assert not e.touched() and "stale: no" in server.as_text(e, "status", {})
    later = time.time() + 100
    os.utime(tmp_path / "in", (later, later))
    assert e.touched() and "input changed" in server.as_text(e, "status", {})
    engine.index(spark, (tmp_path / "in").as_uri(), (tmp_path / "db").as_uri())
    engine.index(spark, (tmp_path / "in").as_uri(), (tmp_path / "db").as_uri())
    assert len(list((tmp_path / "db").glob("snapshot-*"))) == 2  # the one before stays for its readers


def test_overloads_of_one_arity_are_told(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "B.java").write_text("package q;\nclass B {\n  void g() {\n    One.h(1);\n  }\n}\n")
    (tmp_path / "in" / "One.java").write_text("package q;\nclass One {\n  void f(int a) { }\n  void f(long a) { }\n  void f() { }\n  static void h(int a) { }\n}\n")
    engine.index(spark, (tmp_path / "in").as_uri(), (tmp_path / "db").as_uri())
    e = engine.Engine(spark, (tmp_path / "db").as_uri())
    linked = e.edges.where("provenance = 'source-resolved'").first()
    assert (linked.source, linked.target, linked.line, linked.origin) == ("M:q/B#g()V", "M:q/One#h(I)V", 4, "source")
    assert e.method_source("q.One", "f").count() == 3
    assert e.method_source("q.One", "f", descriptor="(J)V").first().text.strip() == "void f(long a) { }"
    told = e.method_source("q.One", "f", descriptor="(Ljava/lang/Void;)V").collect()
    assert len(told) == 1 and told[0].note.startswith("ambiguous: 2") and "int a" in told[0].text


def test_propagation_rules_and_virtual_hops(classes):
    chain = ["M:p/Web#viaInterface(Lp/Web$Face;Ljava/lang/String;)V", "M:p/Web$Impl#face(Ljava/lang/String;)V", HELPER]
    assert not taint.verify(chain, SINK, classes, RULES).passed
    assert taint.verify(chain, SINK, classes, taint.Rules(RULES.sources, RULES.sanitizers, [], True)).passed
    stop = [("java/lang/String", "valueOf", "*", "this", "ret")]
    lost = ["M:p/Web#lost(Ljava/lang/String;)V", HELPER]
    assert taint.verify(lost, SINK, classes, taint.Rules(set(), [], [])).passed
    assert not taint.verify(lost, SINK, classes, taint.Rules(set(), [], stop)).passed
    assert taint.verify(lost, SINK, classes, taint.Rules(set(), [], [("java/lang/String", "valueOf", "*", "this, any", "1,ret")])).passed


def test_a_merge_policy_by_source(spark):
    from loomgraph.operators import merge

    rows = spark.createDataFrame([("a", "class", "A", None, None, "/A.class", 0, 0, None, 0, 0), ("a", "class", "A", None, None, "/A.java", 3, 9, None, 0, 1)], "id string, kind string, name string, owner string, descriptor string, file_path string, start_line int, end_line int, entry_kind string, synthetic int, seq int")
    assert [merge.merge_nodes(rows, p).first().file_path for p in ("first", "source_first")] == ["/A.class", "/A.java"]
