"""Answers as text: bounded numbers of lines, whatever the size of the graph."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import inventory
from ..plans.engine import STALE_SHOWN, Engine, Scope

SITES_SHOWN, FLOWS_SHOWN, ROWS_SHOWN = 200, 60, 5_000


def when(millis: str | None) -> str:
    """Milliseconds since 1970 as date and time; what is no number stays as it is, nothing is a dash."""
    try:
        return datetime.fromtimestamp(int(millis) / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S") if millis else "-"
    except (ValueError, OverflowError, OSError):
        return millis


def rows_as_json(df: DataFrame) -> list[dict]:
    """Rows without their nulls."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]


def rows(df: DataFrame) -> str:
    """A line a row, at most ``ROWS_SHOWN``: a text of the usual limit holds no more."""
    lines = ["  ".join(f"{k}={json.dumps(v, ensure_ascii=False) if not isinstance(v, str) else v}" for k, v in row.items()) for row in rows_as_json(df.limit(ROWS_SHOWN))]
    return "\n".join(lines) or "nothing found"


def _nodes(df: DataFrame) -> DataFrame:
    return df.withColumn("line", names.rendered(F.col("kind"), F.col("id"), F.col("file_path"), F.col("start_line"), F.col("entry_kind")))


def nodes(df: DataFrame, *, descriptors: bool = False) -> str:
    """Symbols, a line each; with their descriptors below, if asked."""
    found = _nodes(df).select("line", "descriptor").limit(ROWS_SHOWN).collect()
    return "\n".join(r.line + (f"\n    descriptor: {r.descriptor}" if descriptors and r.descriptor else "") for r in found) or "nothing found"


def status(e: Engine) -> str:
    files, meta = e.snapshot.files, e.meta
    total = e.totals().first()
    out = ["status", f"  input: {meta.get('input') or '-'}", f"  work_dir: {meta.get('work_dir') or '-'}", f"  indexed_at: {when(meta.get('indexed_at'))}", f"  nodes: {total.nodes}  edges: {total.edges}  files: {files.count()}"]
    for column in ("origin", "language"):
        groups = inventory.counts_by(files, column).orderBy("key").collect()  # a row for each kind of file
        out.append(f"  files by {column}: " + (", ".join(f"{r.key or '-'} {r.n}" for r in groups) or "none"))
    if meta.get("duplicate_classes", "0") != "0":
        out.append(f"  duplicate classes: {meta['duplicate_classes']} (one name in several archives; the first is indexed)")
        out += [f"    {x}" for x in meta.get("duplicate_classes_sample", "").splitlines()]
    stale, touched = e.stale_files().collect(), e.touched()
    if not stale and not touched:
        return "\n".join([*out, "  stale: no"])
    out.append("  stale: yes" + (" (input changed since it was indexed)" if touched else ""))
    out += [f"    {r.errors}: {r.path}" for r in stale]
    if sum(r.errors == "added" for r in stale) == STALE_SHOWN:
        out.append(f"    ... more added files ({STALE_SHOWN} are shown)")
    return "\n".join([*out, "  hint: sync indexes again"])


def files(e: Engine, origin: str | None = None, language: str | None = None, limit: int = 0) -> str:
    met = e.snapshot.files
    for column, wanted in (("origin", origin), ("language", language)):
        met = met.where(F.col(column) == wanted) if wanted else met
    matched, shown = met.count(), e.files(origin, language, limit).collect()
    if not matched:
        return "no indexed files match"
    head = "files" + (f" origin={origin}" if origin else "") + (f" language={language}" if language else "")
    out = [head, *[f"  {r.language or ''}  <{r.origin or ''}>  {r.path}" + (f"  [{r.errors}]" if r.errors else "") for r in shown]]
    return "\n".join(out + ([f"  ... {matched - len(shown)} more files"] if matched > len(shown) else []))


def near(e: Engine, found: DataFrame, other: str, label: str) -> str:
    """Callers or callees, with how many there are of each kind."""
    counts = {r.how: r.n for r in found.groupBy("how").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return f"no {label}"
    head = f"{label}: {sum(counts.values())} (" + ", ".join(f"{n} {how}" for how, n in sorted(counts.items())) + ")"
    lines = found.join(_nodes(e.nodes).select(F.col("id").alias(other), "line"), other, "left").orderBy("method", "how", other).limit(ROWS_SHOWN).collect()
    return "\n".join([head, *[f"  {r.method}: {r.line or r[other]}  [{r.how}]" for r in lines]])


def overview(e: Engine, scope: Scope = Scope()) -> str:
    total = e.totals().first()
    out = [f"input: {e.meta.get('input') or '-'}", f"indexed: {when(e.meta.get('indexed_at'))}", f"nodes: {total.nodes} (classes {total.classes}, methods {total.methods}, fields {total.fields})  edges: {total.edges}"]
    if e.meta.get("duplicate_classes", "0") != "0":
        out.append(f"duplicate classes: {e.meta['duplicate_classes']}")
    found = e.overview(scope).collect()  # a row for each category of rules
    for kind in ("sink", "source"):
        own = [r for r in found if r.kind == kind]
        out.append(f"{kind}s by category ({sum(r.n for r in own)} call sites):" if own else f"{kind}s: none")
        out += [f"  {r.category}: {r.n}" for r in own]
    return "\n".join(out)


def sites(e: Engine, kind: str, category: str | None = None, scope: Scope = Scope()) -> str:
    """Call sites by category: every line once, the first ``SITES_SHOWN`` of them."""
    found = (e.sinks if kind == "sink" else e.sources)(category, scope)
    found = found.join(_nodes(e.nodes).select(F.col("id").alias("source"), "line"), "source", "left").withColumn("line", F.concat(F.coalesce("line", "source"), F.lit("  ->  "), "api"))
    counts = found.groupBy("category").agg(F.count("*").alias("sites"), F.count_distinct("line").alias("distinct_lines")).orderBy("category").collect()
    if not counts:
        return f"no {kind}s found" + (f" in category {category}" if category else "")
    shown = found.select("category", "api", "line").distinct().orderBy("category", "api", "line").limit(SITES_SHOWN).collect()
    out = [f"{kind}s: {sum(r.sites for r in counts)} call sites in {len(counts)} categories"]
    for r in counts:
        lines = [f"    {x.line}" for x in shown if x.category == r.category]
        out += [f"[{r.category}] ({r.distinct_lines})", *lines] if lines else []
    if sum(r.distinct_lines for r in counts) > len(shown):
        out.append(f"... {len(shown)} lines are shown; narrow by category ({'|'.join(r.category for r in counts)}) or scope")
    return "\n".join(out)


def flows(df: DataFrame, *, depth: int, paths: int, budget: int) -> str:
    """Verified flows of a scan by category, the first ``FLOWS_SHOWN``; ``df`` has at most the budget's rows."""
    found = df.collect()
    total = max((r.total for r in found), default=0)
    passed = [r for r in found if r.passed]
    head = f"(checked {len(found)} of {total} chains; depth={depth}, paths={paths}, budget={budget})"
    if not passed:
        return f"no verified flows {head}; a chain that fails is not proven, not safe"
    out, shown = [f"{len(passed)} verified flows {head}"], 0
    for category in sorted({r.category for r in passed}):
        own = [r for r in passed if r.category == category]
        out.append(f"[{category}] ({len(own)})")
        for r in own[: FLOWS_SHOWN - shown]:
            out.append(f"    {' > '.join(r.chain)} > {r.sink}" + (f"  [entry:{r.entry_kind}]" if r.entry_kind else "") + (f"  [sanitizers: {', '.join(r.sanitizers)}]" if r.sanitizers else ""))
            shown += 1
    if shown < len(passed):
        out.append(f"... {shown} of {len(passed)} flows are shown; narrow by category")
    if total > len(found):
        out.append(f"{total - len(found)} chains were not checked; raise the budget")
    return "\n".join(out)
