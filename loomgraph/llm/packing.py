"""Best-fit packing of tokenised documents into sequences of bounded length.

Method: bulk-synchronous best fit over two distributed tables, the pieces that wait (documents, cut into
pieces of at most ``capacity`` ids) and the gaps (open sequences with their free space).  A superstep:

* The longest waiting pieces (down to ``CLASS`` of the longest) and the gaps that hold any of them are
  range-sorted together by size.
* Successor sweep: going up the sizes, a gap takes the largest piece before it that no smaller gap took; a
  gap with room for several of the longest takes several.  That is the matching of brackets, pieces opening
  and gaps closing them.  Every range is swept by its own task; what it leaves are gaps, then pieces.
* Conflicts between ranges are resolved by rank: from the two numbers that each range leaves, the driver
  matches the gaps left over in one range with the pieces left over in ranges below, in the same bracket
  order, as intervals of ranks.  Those are at most two rows a range; the rows themselves find their partner by a join.
* Gaps are updated.  Pieces longer than every gap open sequences: each one over half the capacity, and of the
  others as many as their ids fill, the longest first.
* Repeat, until no piece waits.  Once pieces and gaps fit into one range, its task goes on by itself:
  the supersteps are the same, and so is the result.

A sequence has the number of the piece that opened it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder, tokenizer_path
from .workspace import Workspace, partitions_for

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces and gaps to a range, in one task.
RANGE_ROWS = 500_000
#: Rows to a partition of the result.
ROWS_PER_FILE = 100_000
#: A superstep takes the pieces of at least this share (4/5) of the longest one's length.
CLASS = (4, 5)


def piece_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document; a null or empty text is the end id alone.

    Only documents of more than ``capacity`` ids are cut; the last piece may be shorter.  Other columns
    of ``docs`` are not read, so their names cannot clash.  Null and repeated ids are kept as they are.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    schema = piece_schema(docs.schema[id_col].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            row, start, length, crc = [], [], [], []
            for i, ids in enumerate(enc.documents(batch.column(1).cast(pa.binary()).to_pylist())):
                ids = ids.astype("<u4")  # noqa: PLW2901
                for a in range(0, ids.size, capacity):
                    part = ids[a : a + capacity]
                    row.append(i)
                    start.append(a)
                    length.append(part.size)
                    crc.append(zlib.crc32(part))
            start_of = np.array(start, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array((start_of // capacity).astype(np.int32)), pa.array(start_of), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def sweep(is_gap: list[int], slots: list[int]) -> tuple[list[int], list[int], list[int], list[tuple[int, int]]]:
    """Bracket matching of entries sorted by size, pieces before gaps of their size.

    Gives the matched pieces and their gaps, the pieces left over (ascending), and the gaps left over with
    their free slots; all as places in the input.
    """
    stack: list[int] = []
    pieces: list[int] = []
    gaps: list[int] = []
    spare: list[tuple[int, int]] = []
    for k, gap in enumerate(is_gap):
        if not gap:
            stack.append(k)
            continue
        n = slots[k]
        taken = stack[-n:]
        if taken:
            del stack[-n:]
            pieces += taken
            gaps += [k] * len(taken)
        if len(taken) < n:
            spare.append((k, n - len(taken)))
    return pieces, gaps, stack, spare


def carry(left: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Match what ranges leave over: (range, slots, pieces) in ascending order of size.

    Gives intervals (pieces' range, first rank, end rank, gaps' range, first slot), the piece of the highest rank
    taking the first slot; and how many pieces stay in each range, the lowest ranks.
    """
    stack: list[list[int]] = []
    out = []
    for part, slots, pieces in left:
        at = 0
        while at < slots and stack:
            below = stack[-1]
            n = min(slots - at, below[1])
            out.append((below[0], below[1] - n, below[1], part, at))
            at += n
            below[1] -= n
            if not below[1]:
                stack.pop()
        if pieces:
            stack.append([part, pieces])
    return out, dict(map(tuple, stack))


def openings(over_half: int, others: int, ids_of_others: int, capacity: int) -> int:
    """How many of the pieces that no gap holds open a sequence."""
    return over_half + min(others, -(-ids_of_others // capacity))


def finish(ids: np.ndarray, length: np.ndarray, sequence: np.ndarray, free: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All remaining supersteps over one range of pieces and gaps: (piece, sequence, offset) of every piece."""
    placed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.lexsort((ids, length))
    ids, length = ids[order], length[order]
    while ids.size:
        longest = int(length[-1])
        least = _least(longest)
        low = int(np.searchsorted(length, least))
        use = np.flatnonzero(free >= least)
        use = use[np.lexsort((sequence[use], free[use]))]
        # Entries in the order of (size, pieces first): where each gap comes among the pieces.
        at = np.searchsorted(length[low:], free[use], side="right")
        n = length.size - low
        place = np.concatenate([np.arange(n) + np.searchsorted(free[use], length[low:], side="left"), at + np.arange(use.size)])
        entry = np.empty(n + use.size, dtype=np.int64)
        entry[place] = np.arange(n + use.size)
        entry = entry[: int(place[n - 1]) + 1 + n]  # behind the last piece, at most one gap for each piece is of use
        is_gap = entry >= n
        slots = np.ones(entry.size, dtype=np.int64)
        slots[is_gap] = np.maximum(1, free[use[entry[is_gap] - n]] // longest)
        pieces, gaps, rest, _ = sweep(is_gap.tolist(), slots.tolist())
        got, by = entry[pieces] + low, use[entry[gaps] - n]
        left = np.concatenate([np.arange(low), entry[rest] + low])
        if got.size:
            # A gap's pieces of this superstep stand together: longest first, as everywhere.
            first = np.lexsort((ids[got], -length[got], by))
            got, by = got[first], by[first]
            upto = np.cumsum(length[got]) - length[got]
            start = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
            placed.append((ids[got], sequence[by], capacity - free[by] + upto - np.repeat(upto[start], np.diff([*start, by.size]))))
            free = free - np.bincount(by, length[got], free.size).astype(np.int64)
        most = int(free.max()) if free.size else 0
        waiting = left[low:][length[left[low:]] > most]
        if waiting.size:
            half = 2 * length[waiting] > capacity
            k = openings(int(half.sum()), int((~half).sum()), int(length[waiting[~half]].sum()), capacity)
            new = waiting[waiting.size - k :]
            placed.append((ids[new], ids[new], np.zeros(k, dtype=np.int64)))
            sequence, free = np.concatenate([sequence, ids[new]]), np.concatenate([free, capacity - length[new]])
            left = left[: left.size - k]
        ids, length = ids[left], length[left]
        if ids.size:
            keep = free >= length[0]
            sequence, free = sequence[keep], free[keep]
    if not placed:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*placed, strict=True))


def _least(longest: int) -> int:
    """The shortest piece that takes part in a superstep."""
    return -(-CLASS[0] * longest // CLASS[1])


_SWEPT = "part int, role int, piece long, length long, sequence long, free long, rank long, slots long"


def _swept(entries: DataFrame) -> DataFrame:
    """Sweep each range: matches (role 0), pieces left over with their rank (1), gaps left over with their first slot and slots (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        size, gap, ident, slots, part = (np.concatenate([np.empty(0, dtype=np.int64), *[b.column(k).to_numpy() for b in held]]) for k in range(5))
        if not size.size:
            return
        pieces, gaps, rest, spare = (np.array(x, dtype=np.int64) for x in sweep(gap.tolist(), slots.tolist()))
        spare = spare.reshape(-1, 2)
        none = lambda n: pa.nulls(n, pa.int64())
        arr = lambda x: pa.array(x.astype(np.int64))
        for role, n, columns in (
            (0, pieces.size, [arr(ident[pieces]), arr(size[pieces]), arr(ident[gaps]), arr(size[gaps]), none(pieces.size), none(pieces.size)]),
            (1, rest.size, [arr(ident[rest]), arr(size[rest]), none(rest.size), none(rest.size), arr(np.arange(rest.size)), none(rest.size)]),
            (2, len(spare), [none(len(spare)), none(len(spare)), arr(ident[spare[:, 0]]), arr(size[spare[:, 0]]), arr(np.cumsum(spare[:, 1]) - spare[:, 1]), arr(spare[:, 1])]),
        ):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part[0], dtype=np.int32)), pa.array(np.full(n, role, dtype=np.int32)), *columns], names=[x.split()[0] for x in _SWEPT.split(", ")])

    return entries.mapInArrow(run, _SWEPT)


def _superstep(waiting: DataFrame, gaps: DataFrame, longest: int, entries: int, capacity: int, workspace: Workspace, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One distributed superstep: what is placed, what waits, and the gaps after it."""
    spark = waiting.sparkSession
    least = _least(longest)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = waiting.where(F.col("length") >= least).select(F.col("length").alias("size"), zero.alias("gap"), F.col("pack_id").alias("ident"), one.alias("slots"))
    rows = rows.unionByName(gaps.where(F.col("free") >= least).select(F.col("free").alias("size"), one.alias("gap"), F.col("sequence_id").alias("ident"), F.greatest(one, F.expr(f"free div {longest}")).alias("slots")))
    order = ["size", "gap", "ident"]
    ranged = rows.repartitionByRange(partitions_for(spark, entries, RANGE_ROWS), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    swept = workspace.stage(_swept(ranged), f"{name}-swept")

    # Two numbers for each range, and at most two intervals for each.
    met = swept.groupBy("part").agg(F.coalesce(F.sum(F.when(F.col("role") == 2, F.col("slots"))), zero).alias("slots"), F.count(F.when(F.col("role") == 1, 1)).alias("pieces")).collect()
    links, stay = carry(sorted(tuple(r) for r in met))
    taken: dict[int, int] = {}
    for _, lo, hi, part, at in links:
        taken[part] = max(taken.get(part, 0), at + hi - lo)
    table = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    left = swept.where("role = 1").select("part", "piece", "length", "rank")
    asking = left.join(table(links, "of int, lo long, hi long, part_of_gap int, at long"), F.expr("part = of and rank >= lo and rank < hi")).select("piece", "length", "part_of_gap", F.expr("at + hi - 1 - rank").alias("slot"))
    spare = swept.where("role = 2").join(table(list(taken.items()), "of int, taken long"), F.expr("part = of and rank < taken"))
    spare = spare.select(F.col("part").alias("part_of_gap"), "sequence", "free", F.explode(F.expr("sequence(rank, least(rank + slots, taken) - 1)")).alias("slot"))
    matched = swept.where("role = 0").select("piece", "length", "sequence", "free").unionByName(asking.join(spare, ["part_of_gap", "slot"]).select("piece", "length", "sequence", "free"))
    before = Window.partitionBy("sequence").orderBy(F.col("length").desc(), "piece").rowsBetween(Window.unboundedPreceding, -1)  # a sequence has at most `capacity` pieces
    placed = workspace.stage(matched.select(F.col("piece").alias("pack_id"), F.col("sequence").alias("sequence_id"), (capacity - F.col("free") + F.coalesce(F.sum("length").over(before), zero)).alias("offset"), "length"), f"{name}-placed")
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    gaps = gaps.join(used, "sequence_id", "left").select("sequence_id", (F.col("free") - F.coalesce("used", zero)).alias("free")).where("free > 0")
    gaps = workspace.stage(gaps, f"{name}-gaps")

    # The pieces left over are ranked over all ranges, so the longest of them can be named by rank.
    below, rows = 0, []
    for part, n in sorted(stay.items()):
        rows.append((part, n, below))
        below += n
    left = left.join(table(rows, "of int, stay long, below long"), F.expr("part = of and rank < stay")).select("piece", "length", (F.col("below") + F.col("rank")).alias("rank"))
    most = gaps.agg(F.max("free")).first()[0] or 0
    half = 2 * F.col("length") > capacity
    over, others, ids = left.where(F.col("length") > most).agg(F.count(F.when(half, 1)), F.count(F.when(~half, 1)), F.coalesce(F.sum(F.when(~half, F.col("length"))), zero)).first()
    first_new = below - openings(over, others, ids, capacity)
    new = left.where(F.col("rank") >= first_new)
    placed = placed.select("pack_id", "sequence_id", "offset").unionByName(new.select(F.col("piece").alias("pack_id"), F.col("piece").alias("sequence_id"), zero.alias("offset")))
    gaps = gaps.unionByName(new.select(F.col("piece").alias("sequence_id"), (capacity - F.col("length")).alias("free")))
    waiting = waiting.where(F.col("length") < least).unionByName(left.where(F.col("rank") < first_new).select(F.col("piece").alias("pack_id"), "length"))
    return placed, waiting, gaps


def _finished(waiting: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    both = waiting.select(F.lit(0).alias("gap"), F.col("pack_id").alias("ident"), F.col("length").alias("size")).unionByName(gaps.select(F.lit(1).alias("gap"), F.col("sequence_id").alias("ident"), F.col("free").alias("size")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        gap, ident, size = (np.concatenate([np.empty(0, dtype=np.int64), *[b.column(k).to_numpy() for b in held]]).astype(np.int64) for k in range(3))
        out = finish(ident[gap == 0], size[gap == 0], ident[gap == 1], size[gap == 1], capacity)
        for at in range(0, out[0].size, 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]) for x in out], names=["pack_id", "sequence_id", "offset"])

    # At most RANGE_ROWS rows of 20 bytes.
    return both.repartition(1).mapInArrow(run, "pack_id long, sequence_id long, offset long")


def pack(rows: DataFrame, workspace: Workspace, *, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of known length (1 to ``capacity``; others, nulls included, raise ValueError).

    Every row is placed; sequences are gapless from offset 0 and never exceed ``capacity``.  Equal rows
    are separate pieces; ties in length go by their place in the written table.  An empty input gives an empty
    result.  The rows' own columns must not be named pack_id, sequence_id or offset.
    """
    kept = rows.columns
    rows = workspace.stage(rows.withColumn("pack_id", F.monotonically_increasing_id()), "pieces")
    length = F.col(length_col).cast("long")
    wrong = rows.where(length.isNull() | (length < 1) | (length > capacity)).limit(1).count()
    if wrong:
        raise ValueError("piece lengths must be between 1 and the capacity")
    whole = rows.where(length == capacity)
    placed = [whole.select("pack_id", F.col("pack_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    waiting = rows.where(length < capacity).select("pack_id", length.alias("length"))
    gaps = waiting.where("false").select(F.col("pack_id").alias("sequence_id"), F.col("length").alias("free"))
    step = 0
    while True:
        n, shortest, longest = waiting.agg(F.count("*"), F.min("length"), F.max("length")).first()
        if not n:
            break
        gaps = gaps.where(F.col("free") >= shortest)
        entries = n + gaps.count()
        if entries <= RANGE_ROWS:
            placed.append(_finished(waiting, gaps, capacity))
            break
        step += 1
        done, waiting, gaps = _superstep(waiting, gaps, longest, entries, capacity, workspace, f"step-{step}")
        placed.append(workspace.stage(done, f"step-{step}-done"))
        waiting, gaps = workspace.stage(waiting, f"step-{step}-waiting"), workspace.stage(gaps, f"step-{step}-open")
        for name in ("swept", "placed", "gaps"):
            workspace.drop(f"step-{step}-{name}")
        for name in ("waiting", "open"):
            workspace.drop(f"step-{step - 1}-{name}")
    places = placed[0]
    for more in placed[1:]:
        places = places.unionByName(more)
    return rows.join(places, "pack_id").coalesce(partitions_for(rows.sparkSession, rows.count(), ROWS_PER_FILE)).select(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents; one row per piece with its sequence and offset.

    A null or empty text is one piece, its end id.  Null and repeated ids stay as they are.  An empty table gives
    an empty result.
    """
    workspace = Workspace(docs.sparkSession, "packing")
    return pack(pieces(docs, capacity=capacity, tokenizer=tokenizer, id_col=id_col, text_col=text_col), workspace, capacity=capacity)
