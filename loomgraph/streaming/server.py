"""A line-by-line JSON-RPC loop over the engine, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..operators import security
from ..plans.engine import Engine, Scope, index
from ..sources import rules
from . import render
from .render import rows_as_json

TEXT_LIMIT, KEEP_WHOLE_LINES = 15_000, 0.8
VERSION = "2024-11-05"
_SCOPE = {"scope": "package prefix", "changed": "list of changed paths"}
_BOUNDS = {"depth": "longest chain", "paths": "chains of a sink", "budget": "chains in all"}
TOOLS: dict[str, tuple[str, dict[str, str], Callable[[Engine, dict], DataFrame]]] = {
    "status": ("Counts and staleness of the index", {}, lambda e, a: e.status()),
    "files": ("Indexed files", {"origin": "bytecode or source", "language": "language", "limit": "most rows"}, lambda e, a: e.files(a.get("origin"), a.get("language"), _int(a.get("limit"), 0))),
    "search": ("Find symbols", {"query": "words or id"}, lambda e, a: e.search(a["query"])),
    "def": ("Find definitions", {"name": "name or id"}, lambda e, a: e.define(a["name"])),
    "node": ("Details of a symbol", {"name": "name or id"}, lambda e, a: e.node(a["name"])),
    "callers": ("Who calls a method", {"name": "name or id", **_SCOPE}, lambda e, a: e.callers(a["name"], _scope(a))),
    "callees": ("What a method calls", {"name": "name or id", **_SCOPE}, lambda e, a: e.callees(a["name"], _scope(a))),
    "impact": ("What a change reaches", {"name": "name or id", "depth": "steps", **_SCOPE}, lambda e, a: e.impact(a["name"], _int(a.get("depth"), 0), _scope(a))),
    "context": ("Symbols around a task", {"task": "words"}, lambda e, a: e.context(a["task"])),
    "grep": ("Search source lines", {"pattern": "text", **_SCOPE}, lambda e, a: e.grep(a["pattern"], _scope(a))),
    "outline": ("Members of a class", {"class": "class name"}, lambda e, a: e.outline(a["class"])),
    "source": ("Source of a class", {"class": "class name"}, lambda e, a: e.source(a["class"])),
    "method": ("Source of a method", {"class": "class name", "method": "method name", "descriptor": "descriptor of the overload", "arity": "number of parameters"}, lambda e, a: e.method_source(a["class"], a["method"], descriptor=a.get("descriptor"), arity=_int(a.get("arity"), None))),
    "overview": ("Sinks and sources by category", _SCOPE, lambda e, a: e.overview(_scope(a))),
    "sinks": ("Dangerous call sites", {"category": "category", **_SCOPE}, lambda e, a: e.sinks(a.get("category"), _scope(a))),
    "sources": ("Untrusted input call sites", {"category": "category", **_SCOPE}, lambda e, a: e.sources(a.get("category"), _scope(a))),
    "trace": ("Reverse paths to entries", {"name": "name or id", **_SCOPE}, lambda e, a: e.trace(a["name"], _scope(a))),
    "taint": ("Verify flows", {"category": "category", "chain": "method ids", "sink": "sink id", **_BOUNDS, **_SCOPE}, lambda e, a: e.verify_chain(a["chain"], a["sink"]) if a.get("chain") and a.get("sink") else e.taint_scan(a.get("category"), _scope(a), **_bounds(a))),
}
#: Tools whose text is more than their rows.
TEXTS: dict[str, Callable[[Engine, dict], str]] = {
    "status": lambda e, a: render.status(e),
    "files": lambda e, a: render.files(e, a.get("origin"), a.get("language"), _int(a.get("limit"), 0)),
    "search": lambda e, a: render.nodes(e.search(a["query"])),
    "def": lambda e, a: render.nodes(e.define(a["name"]), descriptors=True),
    "callers": lambda e, a: render.near(e, e.callers(a["name"], _scope(a)), "caller", "callers"),
    "callees": lambda e, a: render.near(e, e.callees(a["name"], _scope(a)), "callee", "callees"),
    "outline": lambda e, a: render.nodes(e.outline(a["class"])),
    "overview": lambda e, a: render.overview(e, _scope(a)),
    "sinks": lambda e, a: render.sites(e, "sink", a.get("category"), _scope(a)),
    "sources": lambda e, a: render.sites(e, "source", a.get("category"), _scope(a)),
    "taint": lambda e, a: render.rows(TOOLS["taint"][2](e, a)) if a.get("chain") and a.get("sink") else render.flows(TOOLS["taint"][2](e, a), **_bounds(a)),
}
JSON_TOOLS = {"callers", "callees", "impact", "grep", "sinks", "sources", "taint"}


def _int(value: object, default: int | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def _scope(a: dict) -> Scope:
    changed = a.get("changed") or []
    return Scope.of(a.get("scope"), changed.splitlines() if isinstance(changed, str) else changed)


def _bounds(a: dict) -> dict[str, int]:
    return {k: _int(a.get(k), most) for k, most in (("depth", security.SCAN_DEPTH), ("paths", security.SCAN_PATHS), ("budget", security.SCAN_BUDGET))}


def as_text(engine: Engine, name: str, args: dict) -> str:
    return TEXTS[name](engine, args) if name in TEXTS else render.rows(TOOLS[name][2](engine, args))


def shorten(text: str, limit: int = TEXT_LIMIT) -> tuple[str, bool]:
    """At most ``limit`` characters, cut after a line if that keeps most of them."""
    if len(text) <= limit:
        return text, False
    at = text.rfind("\n", 0, limit)
    return text[: at if at >= KEEP_WHOLE_LINES * limit else limit], True


def answer(engine: Engine, request: dict) -> dict | None:
    """The response to a request; none to a notification."""
    method, params, id_ = request.get("method"), request.get("params") or {}, request.get("id")
    reply = lambda **x: {"jsonrpc": "2.0", "id": id_, **x}
    fail = lambda code, message: reply(error={"code": code, "message": message})
    if "id" not in request:
        return None
    if method == "initialize":
        return reply(result={"protocolVersion": params.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "1"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"description": v} for k, v in p.items()}}} for n, (d, p, _) in TOOLS.items()]})
    if method != "tools/call":
        return fail(-32601, f"unknown method {method}")
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return fail(-32602, f"unknown tool {name}")
    try:
        if args.get("format") == "json" and name in JSON_TOOLS:
            return reply(result={"content": [{"type": "text", "text": json.dumps(rows_as_json(TOOLS[name][2](engine, args)), ensure_ascii=False)}]})
        text, cut = shorten(as_text(engine, name, args))
        return reply(result={"content": [{"type": "text", "text": text}], **({"_meta": {"truncated": True}} if cut else {})})
    except KeyError as e:
        return fail(-32602, f"{e.args[0]} is missing")
    except Exception as e:  # noqa: BLE001  a failed question must not end the loop
        return fail(-32603, str(e)[:500])


def serve(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """Responses to lines of JSON; other lines are ignored."""
    for line in lines:
        try:
            request = json.loads(line)
        except ValueError:
            continue
        if isinstance(request, dict) and (out := answer(engine, request)) is not None:
            yield json.dumps(out, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph")
    parser.add_argument("command", choices=["index", "sync", "serve", *TOOLS])
    parser.add_argument("words", nargs="*")
    parser.add_argument("--db", default="loomgraph-index")
    for option in ("category", "scope", "changed", "depth", "paths", "budget", "limit", "origin", "language", "chain", "sink", "format", "descriptor", "arity", "rules", "sanitizers", "propagation"):
        parser.add_argument(f"--{option}")
    parser.add_argument("--changed-files", help="a file of changed paths, one a line")
    parser.add_argument("--since", help="a git ref: paths that differ between it and HEAD here")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "index":
        index(spark, args.words[0], args.db)
        return 0
    engine = Engine(spark, args.db, rules=args.rules, sanitizers=args.sanitizers, propagation=args.propagation)
    if args.command == "sync":
        print("indexed again" if engine.sync() else "up to date")
    elif args.command == "serve":
        for out in serve(engine, sys.stdin):
            print(out, flush=True)
    else:
        given = {k: v for k, v in vars(args).items() if v is not None}
        if args.chain:
            if not args.sink:
                print("--chain needs --sink", file=sys.stderr)
                return 2
            given["chain"] = args.chain.split(",")
        changed = (args.changed or "").splitlines()
        if args.changed_files:
            changed += [r.path for r in rules.read_changed(spark, args.changed_files).collect()]
        if args.since:
            changed += [r.path for r in rules.git_changed(spark, ".", args.since).collect()]
        if args.changed_files or args.since:
            given["changed"] = changed
        own = [k for k in TOOLS[args.command][1] if k not in _SCOPE]
        given |= dict(zip(own, args.words, strict=False))
        print(json.dumps(rows_as_json(TOOLS[args.command][2](engine, given)), ensure_ascii=False) if args.format == "json" else as_text(engine, args.command, given))
    return 0


if __name__ == "__main__":
    sys.exit(main())
