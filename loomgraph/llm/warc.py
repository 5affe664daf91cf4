"""WARC archives of pages, and a globally ordered capture index by external merge.

Writing: one record per page.  Of pages with equal payloads the one with the smallest id is a response
record, the others are revisit records that refer to it.  Archives are plain WARC/1.1 files, written by
Spark's text writer with the blank lines between records as its separator, so any file system that Spark
writes will do.  A writing task goes on to the next archive when one has ``ROLL`` bytes, so an archive is of
bounded size (one page more at most), whatever the size of a task.

Reading: every archive is parsed by its Content-Length fields; digests are recomputed from payload bytes,
revisits are resolved against the responses that were read.

Index: each archive gives one run of captures, sorted locally by URL key and timestamp.  Split points
from the runs divide the key space into ranges of bounded size (a single key may span ranges), every run is
cut at them, and each range merges its k slices with a loser tree.  Range after range, the captures are in
global order of (URL key, timestamp, page).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, partitions_for

#: Capture times are not part of the pages: page n counts as captured n seconds after this.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
BETWEEN = "\r\n\r\n"
#: Captures to a merge range, and split candidates that a run offers for each of its ranges.
RANGE, OFFERS = 50_000, 8
#: Repeated payloads that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_PAYLOADS = 200_000
#: Copies of a looked-up payload that its pages are dealt to, where they are joined by a shuffle.
SALTS = 16
#: Bytes from which an archive takes no more records, and archives that a task writes without sorting its records first.
ROLL, OPEN_ARCHIVES = 64_000_000, 64
_HEAD_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower case; no scheme, "www.", port or fragment."""
    if not url:
        return ")"
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url.strip().lower()}"
    return f"{','.join(reversed(host.split('.')))}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


def capture_time(page_id: int | None) -> datetime:
    """Far-off ids wrap after a hundred years, so every id has a time."""
    return EPOCH + timedelta(seconds=(page_id or 0) % 3_153_600_000)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> str:
    """The record without the blank lines that end it.  Header values take no line breaks."""
    plain = re.sub(r"[\x00-\x20\x7f]+", "%20", url.strip()) if url else ""
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    when = capture_time(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {when}", f"WARC-Target-URI: {plain}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines) + BETWEEN + payload.decode()


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def write_archives(pages: DataFrame, workspace: Workspace, *, name: str = "archives", least_bytes: int = 0, roll_bytes: int = ROLL) -> str:
    """Write a record per page (page_id, url, html); returns the folder of WARC files.

    Payloads of fewer than ``least_bytes`` bytes are always responses.  A page with a null id is always a
    response.  Rows that repeat an id are records of their own; equal payload and id: all are responses.
    """
    slim = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha1"), F.octet_length("html").alias("bytes"))
    firsts = slim.where(F.col("page_id").isNotNull() & (F.col("bytes") >= least_bytes)).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    firsts = workspace.stage(firsts.select("sha1", "first"), f"{name}-firsts")
    known = pages.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    # Only payloads that repeat are looked up.  While they are few, pages stay where they are read.
    typed = _looked_up(known, firsts, ["sha1"], firsts.count(), F.col("page_id"))
    typed = typed.select("page_id", "url", "html", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = roll = 0
        for batch in batches:
            out, rolls = [], []
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                record = _record(page, url, payload, payload_digest(payload), first)
                out.append(record)
                rolls.append(roll)
                written += len(record) if record.isascii() else len(record.encode())
                if written >= roll_bytes:
                    written, roll = 0, roll + 1
            yield pa.RecordBatch.from_arrays([pa.array(rolls, pa.int32()), pa.array(out, pa.string())], names=["roll", "value"])

    path, conf, key = workspace.path(name), pages.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key, "0")
    conf.set(key, str(OPEN_ARCHIVES))
    try:
        typed.mapInArrow(records, "roll int, value string").write.option("lineSep", BETWEEN).partitionBy("roll").text(path)
    finally:
        conf.set(key, before)
    return path


def _looked_up(rows: DataFrame, table: DataFrame, on: list[str], n: int, by: Column) -> DataFrame:
    """``rows`` left-joined with a written table of ``n`` rows: by a broadcast while it is small, else by a shuffle that deals a frequent key's rows to ``SALTS`` copies by the hash of ``by``."""
    if n <= BROADCAST_PAYLOADS:
        return rows.join(F.broadcast(table), on, "left")
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS).cast("long"))).join(copies, [*on, "salt"], "left").drop("salt")


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of a WARC file."""
    at, size = 0, len(data)
    while at < size:
        end = data.index(_HEAD_END, at)
        head = data[at:end].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head[1:])
        start = end + len(_HEAD_END)
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != _HEAD_END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, fields, data[start:stop]
        at = stop + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: archive, record_offset, page_id, record_type, refers_to, url_key, captured_at, payload_bytes, payload_digest.

    A response's payload fields come from its bytes, and must agree with its header; a revisit's are left
    null here.
    """
    schema = "archive string, record_offset long, page_id long, record_type string, refers_to long, url_key string, captured_at string, payload_bytes long, payload_digest string, named_digest string"
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cols: list[list] = [[] for _ in names]
                for at, f, block in parse_archive(data):
                    named = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = f["WARC-Type"] == "response"
                    digest = payload_digest(block) if whole else None
                    if whole and digest != named:
                        raise ValueError(f"{archive}: the payload at byte {at} is damaged")
                    row = ("/".join(archive.split("/")[-2:]), at, _page(f["WARC-Record-ID"]), f["WARC-Type"], _page(f.get("WARC-Refers-To")), url_key(f["WARC-Target-URI"]), re.sub(r"\D", "", f["WARC-Date"]), len(block) if whole else None, digest, named)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    # One value an archive: at most ROLL bytes and a page.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, schema)


def resolve(records: DataFrame, workspace: Workspace, *, name: str = "targets") -> DataFrame:
    """Fill revisits with the payload size and digest of the response they refer to; a missing one fails the read.

    ``records`` is a written table, as by ``read_archives``.  Responses stay as they are.
    """
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    found = records.where("record_type = 'response'").join(wanted, "page_id", "left_semi").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("named_digest"), F.col("payload_bytes").alias("target_bytes")).distinct()
    found = workspace.stage(found, name)
    met = _looked_up(records, found, ["refers_to", "named_digest"], found.count(), F.col("record_offset"))
    revisit = F.col("record_type") == "revisit"
    lost = F.raise_error(F.lit("a revisit record refers to a response that is not there"))
    met = met.withColumn("payload_bytes", F.when(revisit, F.coalesce("target_bytes", lost.cast("long"))).otherwise(F.col("payload_bytes")))
    return met.withColumn("payload_digest", F.when(revisit, F.col("named_digest")).otherwise(F.col("payload_digest"))).select(*[c for c in records.columns if c != "named_digest"])


class LoserTree:
    """k-way merge: inner nodes keep the loser of each match, so the next item costs one path of matches."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[b] is None:
            return True
        return self.heads[a] is not None and (self.heads[a], a) <= (self.heads[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held == -1:
                self.tree[node] = winner
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


_ENTRY = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("captured_at", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("archive", T.StringType()), T.StructField("record_offset", T.LongType())])


def merge_index(records: DataFrame, workspace: Workspace, *, name: str = "index", range_rows: int = RANGE) -> DataFrame:
    """Captures in global order: _ENTRY columns, merge_range, merge_pos; sorted by (merge_range, merge_pos).

    Each archive is a run.  Split points come from every run's quantiles, so a range has about ``range_rows``
    captures; equal keys are told apart by time, page, archive and offset, so a hot key is split too.  A null
    page counts as -1.  No records: no captures.
    """
    spark = records.sparkSession
    key = ["url_key", "captured_at", "page_id", "archive", "record_offset"]
    slim = records.select("url_key", "captured_at", F.coalesce("page_id", F.lit(-1).cast("long")).alias("page_id"), "archive", "record_offset")
    total = slim.count()
    ranges = partitions_for(spark, total, range_rows)
    # Local sort: an archive's records are in one task already.  A run offers evenly spaced entries.
    runs = workspace.stage(slim.sortWithinPartitions(*key).withColumn("run", F.spark_partition_id()), f"{name}-runs")
    step = max(1, total // (ranges * OFFERS))

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            take = pa.array(np.arange((-at) % step, batch.num_rows, step))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([c.take(take) for c in batch.columns[:5]], names=key)

    # At most OFFERS + runs / range rows for each range: it follows the number of ranges, not the captures.
    offered = sorted(tuple(r) for r in runs.select(*key).mapInArrow(offers, _ENTRY).collect()) if ranges > 1 else []
    splits = [offered[len(offered) * i // ranges] for i in range(1, ranges)] if offered else []
    shared = spark.sparkContext.broadcast(splits)
    packed = T.StructType([T.StructField("merge_range", T.IntegerType()), T.StructField("slices", T.ArrayType(_ENTRY))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted runs' slices, one row for each run and range.

        A task reads several small runs one after another, and a batch may hold the end of one and the start
        of the next; a run ends where ``run`` changes or the key goes down.
        """
        splits = shared.value

        def packed_slice(r: int, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"merge_range": r, "slices": [dict(zip(key, x, strict=True)) for x in rows]}], schema=_arrow(packed))

        held: list[tuple] = []  # the slice that the next batch may go on with
        held_range = held_run = None
        for batch in batches:
            numbers = batch.column(5).to_pylist()
            rows = list(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True))
            starts = [i for i in range(1, len(rows)) if numbers[i] != numbers[i - 1] or rows[i] < rows[i - 1]]
            for at, stop in zip([0, *starts], [*starts, len(rows)], strict=True):
                while at < stop:
                    r = bisect_right(splits, rows[at])
                    end = stop if r == len(splits) else _first_at_least(rows, splits[r], at, stop)
                    if held and (held_range != r or held_run != numbers[at] or rows[at] < held[-1]):
                        yield packed_slice(held_range, held)
                        held = []
                    held_range, held_run = r, numbers[at]
                    held += rows[at:end]
                    at = end
        if held:
            yield packed_slice(held_range, held)

    slices = runs.select(*key, "run").mapInArrow(cut, packed).groupBy("merge_range").agg(F.collect_list("slices").alias("runs"))
    out = T.StructType([*_ENTRY.fields, T.StructField("merge_range", T.IntegerType()), T.StructField("merge_pos", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, runs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sources = [iter(zip(*(s.field(c).to_pylist() for c in key), strict=True)) for s in (x.values for x in runs.values)]
                rows = list(LoserTree(sources))
                yield pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_arrow(_ENTRY))], pa.array([r] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())], names=out.names)

    return workspace.stage(slices.mapInArrow(merge, out), name)


def _first_at_least(rows: list[tuple], bound: tuple, start: int, stop: int) -> int:
    lo, hi = start, stop
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if rows[mid] < bound else (lo, mid)
    return lo


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def merge_sorted(runs: list[list]) -> list:
    """A plain k-way merge, to hold the loser tree against."""
    return list(heapq.merge(*runs))


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, read back and index; per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at, archive, record_offset, merge_range, merge_pos.

    Null html is an empty payload; a null url has the key of an empty host; a null id is a response
    of its own.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    workspace = Workspace(spark, "warc")
    path = write_archives(_rows(pages, id_col, url_col, html_col), workspace)
    records = workspace.stage(resolve(workspace.stage(read_archives(spark, path), "read"), workspace), "records")
    index = merge_index(records, workspace).select("archive", "record_offset", "merge_range", "merge_pos")
    return records.join(index, ["archive", "record_offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "record_offset", "merge_range", "merge_pos")
