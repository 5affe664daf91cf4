"""Embedding near-dedup with a pivot-permutation index.

A bounded sample gives reference points (pivots) that are far from one another.  Every vector is described
by its nearest pivots in order; an inverted list per pivot holds the vectors that have it among their
``PREFIX`` nearest.  Two vectors that share at least ``SHARED`` listed pivots are candidates, and a link if
their cosine, in double precision, reaches the threshold.  A pair is compared in one list only, that of its
smallest shared pivot.  A list of more than ``SPLIT`` blocks is split by its vectors' other pivots, and a pair is then
compared in the part of its second smallest shared pivot, so parts stay short while the corpus grows.

What is still long, a dense group, is cut into blocks of bounded size and compared block against block.  A block comparison gives
back the number of links of each vector and a spanning forest of its links, never the pairs, so even one
large group of near copies makes no more rows than its lists have members.  Equal vectors are one entry
with a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .workspace import Workspace, grouped

THRESHOLD = 0.95
PREFIX, SHARED = 8, 2
#: Pivots are the square root of the rows; the driver chooses among them, which bounds their number.
LEAST_PIVOTS, MOST_PIVOTS = 64, 16_384
#: Rows read to choose pivots: this many for each pivot, and at most (8 bytes a component on the driver).
SAMPLE_PER_PIVOT, MOST_SAMPLE = 16, 32_768
#: Lists whose lengths are broadcast at most (about 24 bytes each); more are joined by a shuffle.
BROADCAST_LISTS = 1_000_000
#: Pivots are at most this similar, so a dense group does not take many of them.
APART = 0.7
BLOCK = 1024
#: Lists of more than so many blocks are split.
SPLIT = 4
#: The second pivot of a list that is not split.
WHOLE = -(1 << 31)


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors (double) of the usable rows: no null, zero or non-finite components."""
    at, out = [], []
    for i, v in enumerate(rows):
        if not v or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max()
        if top == 0:
            continue
        x = x / top  # so that squares neither overflow nor vanish
        at.append(i)
        out.append(x / np.sqrt(x @ x))
    return np.array(at, dtype=np.int64), out


def choose_pivots(sample: list[np.ndarray], wanted: int, apart: float = APART) -> np.ndarray:
    """Greedily, in the given order: vectors at most ``apart`` similar to all taken before; then the rest."""
    if not sample:
        return np.empty((0, 0))
    kept, n, spare = np.empty((wanted, sample[0].size)), 0, []
    for v in sample:
        if n == wanted:
            break
        if n and (kept[:n] @ v).max() > apart:
            spare.append(v)
        else:
            kept[n] = v
            n += 1
    return np.array([*kept[:n], *spare[: wanted - n]])


def pivots_for(rows: int) -> int:
    """As the square root of the rows: lists and their number grow together."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 ** round(np.log2(max(rows, 1) ** 0.5)))))


def _describe(vectors: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """vec_id, the vector's own bytes, a digest of its direction, and listed pivots, nearest first; null where unusable."""
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("raw", T.BinaryType()), T.StructField("digest", T.BinaryType()), T.StructField("listed", T.ArrayType(T.IntegerType()))])
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    item = _item(vectors)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            n = batch.num_rows
            raw, digests, listed = [None] * n, [None] * n, [None] * n
            values = batch.column(1).to_pylist()
            at, found = _unit(values)
            sizes = np.array([x.size for x in found], dtype=np.int64)
            for size in np.unique(sizes).tolist():  # vectors of different lengths never meet
                own = np.flatnonzero(sizes == size)
                x = np.array([found[i] for i in own])
                if pivots.size and size == pivots.shape[1]:
                    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]
                else:
                    near = np.tile(np.arange(min(SHARED, prefix)), (own.size, 1)) - size * SHARED - SHARED
                for i, v, p in zip(own.tolist(), x, near, strict=True):
                    raw[at[i]], listed[at[i]] = np.array(values[at[i]], dtype=item).tobytes(), p.tolist()
                    digests[at[i]] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(digests, pa.binary()), pa.array(listed, pa.list_(pa.int32()))], names=schema.names)

    return vectors.mapInArrow(describe, schema)


def _item(vectors: DataFrame) -> str:
    """Bytes kept of a component: as many as the column has."""
    return "<f4" if isinstance(vectors.schema["vector"].dataType.elementType, T.FloatType) else "<f8"


def _forest(links: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, each row's smallest connected row."""
    label = np.arange(links.shape[0])
    while True:
        new = np.where(links, label[None, :], links.shape[0]).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(entries: DataFrame, threshold: float, shared: int, item: str) -> DataFrame:
    """Per block comparison and vector: links found (weights added up), and a neighbour in its forest."""
    kind = entries.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("vec_id", kind), T.StructField("links", T.LongType()), T.StructField("root", kind)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["pivot", "second", "i", "j"]):
            batch = table.combine_chunks().to_batches()[0]
            pivot, second, i, j = (batch.column(k)[0].as_py() for k in range(4))
            block = batch.column(4).to_numpy()
            ids, weight = batch.column(5), batch.column(6).to_numpy()
            x = np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=item).reshape(batch.num_rows, -1).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            listed = np.array(batch.column(8).to_pylist())
            names, coded = np.unique(listed, return_inverse=True)
            member = np.zeros((batch.num_rows, names.size), dtype=np.float32)
            np.put_along_axis(member, coded.reshape(listed.shape), 1, axis=1)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            common = member[left] @ member[right].T
            # Only where no smaller pivot is shared, nor one between the two of a part: every pair belongs to one list.
            smaller = member[:, (names < (pivot if second == WHOLE else second)) & (names != pivot)]
            candidate = (common >= shared) & (smaller[left] @ smaller[right].T == 0)
            if i == j:
                candidate = np.triu(candidate, 1)
            a, b = np.nonzero(candidate)
            if not a.size:
                continue
            linked = np.zeros(a.size, dtype=bool)
            for k in range(0, a.size, 65_536):
                part = slice(k, k + 65_536)
                linked[part] = np.einsum("ij,ij->i", x[left[a[part]]], x[right[b[part]]]) >= threshold
            a, b = left[a[linked]], right[b[linked]]
            if not a.size:
                continue
            count = np.bincount(a, weight[b], batch.num_rows) + np.bincount(b, weight[a], batch.num_rows)
            rows = np.flatnonzero(count)
            back = np.full(batch.num_rows, -1)
            back[rows] = np.arange(rows.size)
            links = np.zeros((rows.size, rows.size), dtype=bool)
            links[back[a], back[b]] = links[back[b], back[a]] = True
            root = rows[_forest(links)]
            yield pa.RecordBatch.from_arrays([batch.column(9).take(pa.array(rows)), ids.take(pa.array(rows)), pa.array(count[rows].astype(np.int64)), ids.take(pa.array(root))], names=schema.names)

    return entries.mapInArrow(compare, schema)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable, itself included), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
    vectors of different lengths with one another.  Equal vectors (up to scale) are linked; repeated ids are
    vectors of their own that share a component.  A row without id links with nothing and is kept.
    Other columns are not read.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    workspace = Workspace(spark, "neighbors")
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    if not isinstance(vectors.schema["vector"].dataType.elementType, T.FloatType):
        vectors = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    n = vectors.count()
    wanted = pivots or pivots_for(n)
    limit = max(wanted, min(SAMPLE_PER_PIVOT * wanted, MOST_SAMPLE))
    draw = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1_000_000_007))
    usable_rows = part = vectors.where("vector is not null")
    if n > limit:
        part = part.where(draw < int(1_000_000_007 * min(1.0, 1.5 * limit / n)))
    sample = [r.vector for r in part.orderBy(draw, "vec_id").limit(limit).collect()]
    if len(sample) < min(n, wanted):  # equal rows are drawn or left out together; then as they are read
        sample += [r.vector for r in usable_rows.limit(limit).collect()]
    usable = _unit(sample)[1]
    width = max({x.size for x in usable}, key=[x.size for x in usable].count) if usable else 0
    points = choose_pivots([x for x in usable if x.size == width], wanted)

    described = workspace.stage(_describe(vectors, points, prefix), "described")
    valid = described.where("digest is not null and vec_id is not null")
    equal = workspace.stage(valid.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "equal")
    entries = valid.join(equal.select(F.col("rep").alias("vec_id"), "digest", "weight"), ["vec_id", "digest"]).dropDuplicates(["vec_id", "digest"])
    entries = workspace.stage(entries, "entries")

    posted = entries.select("vec_id", "digest", "listed", F.explode("listed").alias("pivot"))
    lengths = posted.groupBy("pivot").agg(F.count("*").alias("n"))  # a row for each pivot
    # A pair whose smallest shared pivot is this one shares a larger one, too.
    parts = F.filter("listed", lambda q: q > F.col("pivot")) if shared >= 2 else F.array(F.lit(WHOLE))
    split = posted.join(F.broadcast(lengths), "pivot").select("vec_id", "digest", "pivot", F.explode(F.when(F.col("n") > SPLIT * BLOCK, parts).otherwise(F.array(F.lit(WHOLE)))).alias("second"))
    # Blocks are dealt by hash, as many as a list's length asks for.
    lists = workspace.stage(split.groupBy("pivot", "second").agg(F.count("*").alias("n")).where("n > 1").select("pivot", "second", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lists")
    dealt = split.join(F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists, ["pivot", "second"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    met = dealt.select("vec_id", "digest", "pivot", "second", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).join(entries, ["vec_id", "digest"])
    keys = ["pivot", "second", "i", "j"]
    placed = met.select("pivot", "second", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "weight", "raw", "listed", "digest").repartition(*keys).sortWithinPartitions(*keys, "vec_id")
    found = workspace.stage(_compare(placed, threshold, shared, _item(vectors)), "found")

    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), workspace, "parts")
    per_rep = equal.join(links, "digest", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    per_rep = per_rep.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    ok = F.col("vec_id").isNotNull()
    return (
        described.select("vec_id", "digest")
        .join(per_rep, "digest", "left")
        .select("vec_id", F.when(ok, F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(0).alias("n_links"), F.when(ok, F.coalesce("component_id", "vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
