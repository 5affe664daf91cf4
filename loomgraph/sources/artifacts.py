"""Artifacts to rows: files through Spark's binary reader, archives and class files in Arrow batches."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import route
from . import classfile, javasource

DEEPEST_ARCHIVE = 6
#: Bytes and rows of an Arrow batch that a reader gives back, about.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 20_000
MEMBERS = "path string, container string, kind string, internal string, content binary, error string"
NODES = "id string, kind string, name string, owner string, descriptor string, file_path string, start_line int, end_line int, synthetic int, access int, annotations array<string>, class_annotations array<string>"
EDGES = "source string, target string, kind string, line int, origin string, provenance string"
PARSED = f"part string, path string, node struct<{NODES.replace(' ', ':').replace(',:', ',')}>, edge struct<{EDGES.replace(' ', ':').replace(',:', ',')}>, text string, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Regular files below a folder, or one file: path, size, modified_at, content, content_hash, route."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), "content", F.sha2("content", 256).alias("content_hash"), route(F.col("path")).alias("route")).where("route is not null")


def expand(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, str, str, bytes]]:
    """(path, container, kind, content) of the classes and sources in an archive; nested jars and wars too, to a depth of 6.

    Names that climb out of the archive are skipped, and so are module descriptors and repeats of a name.  A
    jmod's header is stepped over by the reader of its central directory.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError):
        return
    seen = set()
    for entry in archive.infolist():
        member, low = entry.filename, entry.filename.lower()
        if entry.is_dir() or member in seen or ".." in member.split("/") or low.endswith("module-info.class"):
            continue
        seen.add(member)
        if low.endswith((".jar", ".war")):
            if depth < DEEPEST_ARCHIVE:
                yield from expand(f"{name}!/{member}", archive.read(entry), depth + 1)
        elif low.endswith((".class", ".java")):
            yield f"{name}!/{member}", name, low.rpartition(".")[2], archive.read(entry)


def _batched(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (row, bytes), bounded by bytes and rows."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def members(files: DataFrame) -> DataFrame:
    """One row per class or source, alone or in an archive, with a class's internal name from its bytes.

    An unreadable class has no name and content, but an error; so has an archive that cannot be opened.
    """
    schema = _arrow(files.sparkSession, MEMBERS)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            row = lambda *x: dict(zip(schema.names, x, strict=True))
            for batch in batches:
                for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == "archive" and not zipfile.is_zipfile(io.BytesIO(content)):
                        yield row(path, None, kind, None, None, "not an archive"), 0
                    try:
                        for member, container, what, data in expand(path, content) if kind == "archive" else [(path, None, kind, content)]:
                            try:
                                yield row(member, container, what, classfile.internal_name(data) if what == "class" else None, data, None), len(data)
                            except ValueError as e:
                                yield row(member, container, what, None, None, str(e)), 0
                    except (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, EOFError, RuntimeError, NotImplementedError, zlib.error) as e:
                        yield row(path, None, kind, None, None, f"damaged archive: {e}"), 0

        yield from _batched(rows(), schema)

    return files.select("path", "route", "content").mapInArrow(unpack, MEMBERS)


def skeleton(data: bytes | classfile.ClassFile) -> str:
    """What a class file declares and calls, as text: it stands in for source where there is none."""
    cls = classfile.read_class(data) if isinstance(data, bytes) else data
    package, _, simple = cls.name.rpartition("/")
    kind = "interface" if cls.access & classfile.ACC_INTERFACE else "class"
    dotted = lambda names: ", ".join(x.replace("/", ".") for x in names)
    parent = f" extends {dotted([cls.super_name])}" if cls.super_name and cls.super_name != "java/lang/Object" else ""
    out = [f"package {package.replace('/', '.')};"] if package else []
    out.append(f"{kind} {simple}{parent}{' implements ' + dotted(cls.interfaces) if cls.interfaces else ''} {{")
    out += [f"    {name} : {descriptor};" for name, descriptor, _ in cls.fields]
    for m in cls.methods:
        out.append(f"    {m.name}{m.descriptor} {{")
        out += [f"        {'.'.join(cls.ref(i.index)[:2])}{cls.ref(i.index)[2]};" for i in classfile.instructions(m.code or b"") if 0xB6 <= i.op <= 0xB9]
        out.append("    }")
    return "\n".join([*out, "}"])


def parsed(found: DataFrame) -> DataFrame:
    """Everything a class or source tells, each read once: rows of part node, edge, text or error.

    A source's text is itself, a class's its skeleton, under the class's own path ending in .java.  What
    cannot be read has one row, its error.
    """
    schema = _arrow(found.sparkSession, PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        if kind == "class":
                            cls = classfile.read_class(content)
                            (nodes, edges), text, at = classfile.graph_rows(cls, path), skeleton(cls), path.removesuffix(".class") + ".java"
                        else:
                            text, at = content.decode("utf-8", "replace"), path
                            nodes, edges = javasource.scan(text, path)
                    except Exception as e:  # noqa: BLE001  any malformed input
                        yield {"part": "error", "path": path, "error": f"{type(e).__name__}: {e}"[:200]}, 0
                        if kind == "java":
                            yield {"part": "text", "path": path, "text": content.decode("utf-8", "replace")}, len(content)
                        continue
                    for node in nodes:
                        yield {"part": "node", "path": path, "node": node}, 0
                    for edge in edges:
                        yield {"part": "edge", "path": path, "edge": edge}, 0
                    yield {"part": "text", "path": at, "text": text}, len(text)

        yield from _batched(rows(), schema)

    return found.select("path", "kind", "content").mapInArrow(run, PARSED)
