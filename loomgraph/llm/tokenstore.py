"""Token ids as binary files: a content-addressed store with recipes and Merkle manifests.

A rolling hash over the ids cuts every document's id stream into chunks at places that depend on nearby
ids only, so texts that share passages share chunks.  Each distinct chunk is stored once under the digest
of its bytes.  Layout of a store (all Parquet, so any file system that Spark writes will do):

* ``chunks``    digest, n, ids (little-endian unsigned 16- or 32-bit integers)
* ``recipes``   one row per document, files in ascending document order: part, ordinal, doc_id, start (ids
  of the part before it), n_tokens, lengths and digests of its chunks, root (Merkle root of the digests)
* ``manifest``  for every recipe part: rows, tokens, the ids before it, Merkle root of its documents' roots

Reading recomputes every chunk's digest from its bytes and every Merkle root, and fails on a difference.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder, tokenizer_path
from .workspace import Workspace, partitions_for

TOKENIZER = "byte_bpe_50k.json"
#: Chunk bounds in ids; a cut needs the rolling hash's top CUT_BITS bits to be zero.
LEAST, MOST, WINDOW, CUT_BITS = 64, 2048, 16, 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ROWS_PER_PARTITION = 50_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up as it is; no leaves: the digest of nothing."""
    if not leaves:
        return digest(b"")
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream; the last is its length."""
    return cut_all([ids])[0]


def cut_all(streams: list[np.ndarray]) -> list[list[int]]:
    """``cut_points`` of several streams, hashed together.

    A window that reaches back into the stream before ends nearer to its own stream's start than any cut may be.
    """
    sizes = np.array([x.size for x in streams], dtype=np.int64)
    if not sizes.sum():
        return [[] for _ in streams]
    x = (np.concatenate(streams).astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    power, width = int(_MULTIPLIER), 1
    while width < WINDOW:  # doubling: the hash of 2w ids from two hashes of w ids
        x[width:] += x[:-width] * np.uint64(power)
        power, width = power * power % (1 << 64), width * 2
    found = np.flatnonzero(x >> np.uint64(64 - CUT_BITS) == 0) + 1
    starts = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(found, [starts, starts + sizes]).T.tolist()
    out = []
    for start, n, (a, b) in zip(starts.tolist(), sizes.tolist(), bounds, strict=True):
        ends, last = [], 0
        for c in found[a:b].tolist() if n > LEAST else []:
            c -= start  # noqa: PLW2901
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST and c < n:
                ends.append(c)
                last = c
        while n - last > MOST:
            last += MOST
            ends.append(last)
        out.append([*ends, n] if n else [])
    return out


def _staged_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("kind", T.IntegerType()),
            T.StructField("doc_id", id_type),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("digests", T.ArrayType(T.BinaryType())),
            T.StructField("root", T.BinaryType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )


def _encode(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Recipe rows (kind 0) and, once for each task, the chunks they name (kind 1)."""
    schema = _staged_schema(docs.schema[id_col].dataType)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), set()
        size = enc.item.itemsize
        for batch in batches:
            n_tokens, lengths, digests, roots, new_digest, new_n, new_ids = [], [], [], [], [], [], []
            streams = list(enc.documents(batch.column(1).cast(pa.binary()).to_pylist()))
            for ids, ends in zip(streams, cut_all(streams), strict=True):
                last, own, whole = 0, [], ids.tobytes()
                for end in ends:
                    data = whole[last * size : end * size]
                    own.append(d := digest(data))
                    if d not in known:
                        known.add(d)
                        new_digest.append(d)
                        new_n.append(end - last)
                        new_ids.append(data)
                    last = end
                n_tokens.append(ids.size)
                lengths.append([b - a for a, b in zip([0, *ends], ends, strict=False)])
                digests.append(own)
                roots.append(merkle_root(own))
            rows, news = batch.num_rows, len(new_n)
            none = lambda kind, n: pa.nulls(n, kind)
            id_kind, ints, bins = batch.column(0).type, pa.list_(pa.int32()), pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * rows, pa.int32()), batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(lengths, ints), pa.array(digests, bins), pa.array(roots, pa.binary()), none(pa.binary(), rows), none(pa.int32(), rows), none(pa.binary(), rows)],
                names=schema.names,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * news, pa.int32()), none(id_kind, news), none(pa.int64(), news), none(ints, news), none(bins, news), none(pa.binary(), news), pa.array(new_digest, pa.binary()), pa.array(new_n, pa.int32()), pa.array(new_ids, pa.binary())],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)


def _number(recipes: DataFrame) -> DataFrame:
    """Running start and ordinal within each range partition."""
    schema = T.StructType([*recipes.schema.fields, T.StructField("ordinal", T.LongType()), T.StructField("start", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = tokens = 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(rows, rows + n.size, dtype=np.int64)), pa.array((tokens + np.cumsum(n) - n).astype(np.int64))], names=schema.names)
            rows, tokens = rows + n.size, tokens + int(n.sum())

    return recipes.mapInArrow(number, schema)


def _roots_by_part(recipes: DataFrame) -> DataFrame:
    """One row per recipe part: rows, tokens and the Merkle root of its documents' roots, in order.

    A part is one task's range of documents (at most ``ROWS_PER_PARTITION`` or so): 16 bytes a document.
    """
    grouped = recipes.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("ordinal", "root"))).alias("leaves"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("root", T.BinaryType())])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [merkle_root(leaves.values.field("root").to_pylist()) for leaves in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=schema.names)

    return grouped.mapInArrow(roots, schema)


def write_store(docs: DataFrame, workspace: Workspace, *, name: str = "store", tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text (null: empty), append the end id, and write a store; returns its path.

    Documents are written in ascending id order, null ids first, equal ids in order of their roots.
    Repeated rows are documents of their own with the same recipe.  Columns other than id and text are
    not read.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path(TOKENIZER)
    staged = workspace.stage(_encode(docs, path, id_col, text_col), f"{name}-staged", codec="zstd", partition_by="kind")
    # Tasks have dropped their own repeats already, so rows are dealt by digest at once, without another
    # pass over each task's chunks.
    chunks = staged.where("kind = 1").select("digest", "n", "ids").repartition("digest").dropDuplicates(["digest"])
    chunks.write.option("compression", "zstd").parquet(workspace.path(f"{name}/chunks"))
    recipes = staged.where("kind = 0").select("doc_id", "n_tokens", "lengths", "digests", "root")
    parts = partitions_for(spark, recipes.count(), ROWS_PER_PARTITION)
    order = ["doc_id", "root"]
    recipes = recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    _number(recipes).write.option("compression", "zstd").parquet(workspace.path(f"{name}/recipes"))
    written = spark.read.parquet(workspace.path(f"{name}/recipes"))
    before, rows = 0, []
    for r in sorted(_roots_by_part(written).collect()):  # one row for each part
        rows.append((*r, before))
        before += r.tokens
    manifest = spark.createDataFrame(rows, "part int, rows long, tokens long, root binary, tokens_before long")
    manifest.coalesce(1).write.parquet(workspace.path(f"{name}/manifest"))
    workspace.drop(f"{name}-staged")
    return workspace.path(name)


def _shift_tables() -> list[np.ndarray]:
    """Columns of the matrices that carry a CRC-32 over 1, 2, 4, ... zero bytes."""
    one = []
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        one.append(c)
    tables = [np.array(one, dtype=np.uint32)]
    while len(tables) < 48:
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where((x >> np.uint32(i)) & np.uint32(1), matrix[i], np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _tables() -> list[np.ndarray]:
    return _shift_tables()


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The part of a message's CRC-32 that a block gives when ``zeros`` bytes follow it.

    CRC-32 is linear: the checksum of a concatenation is the exclusive or of its blocks' shifted ones.
    """
    crc = crc.astype(np.uint32)
    for k, matrix in enumerate(_tables()):
        if not (zeros >> k).any():
            break
        at = np.flatnonzero((zeros >> k) & 1)
        crc[at] = _apply(matrix, crc[at])
    return crc


def _checked_chunks(spark: SparkSession, store: str, item: str) -> DataFrame:
    """Read the chunk files; for each chunk its length and CRC-32 from the bytes, under a recomputed digest."""
    chunks = spark.read.parquet(f"{store}/chunks").select("digest", "ids")
    schema = "digest binary, n int, crc long"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(data, dtype=item)
                n.append(ids.size)
                crc.append(zlib.crc32(ids.astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    return chunks.mapInArrow(check, schema)


def verify_manifest(spark: SparkSession, store: str) -> DataFrame:
    """The manifest, after its Merkle roots have been recomputed from the recipes."""
    manifest = spark.read.parquet(f"{store}/manifest")
    found = {r.part: (r.rows, r.tokens, bytes(r.root)) for r in _roots_by_part(spark.read.parquet(f"{store}/recipes")).collect()}
    if found != {r.part: (r.rows, r.tokens, bytes(r.root)) for r in manifest.collect()}:
        raise ValueError("the recipes do not match the manifest")
    return manifest


def read_digests(spark: SparkSession, store: str, *, item: str = "<u2") -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32 of its reconstructed ids, all from the files.

    Chunk bytes are read and checked where they lie; only (digest, n, crc) meets the recipes.  A
    document whose lengths, digests or root do not agree with its chunks fails the read.
    """
    manifest = verify_manifest(spark, store)
    recipes = spark.read.parquet(f"{store}/recipes").join(F.broadcast(manifest.select("part", "tokens_before")), "part")  # a row for each part
    schema = "part int, ordinal long, digest binary, length int, after long"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ordinal, lengths, digests, root = batch.columns
            for own, r in zip(digests.to_pylist(), root.to_pylist(), strict=True):
                if merkle_root(own) != r:
                    raise ValueError("a recipe does not match its Merkle root")
            counts = np.array([len(x) for x in lengths], dtype=np.int64)
            row = np.repeat(np.arange(counts.size), counts)
            flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(flat)
            last = np.cumsum(counts) - 1
            after = (upto[last][row] - upto) * 4 if flat.size else flat
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.take(take), ordinal.take(take), digests.flatten(), pa.array(flat.astype(np.int32)), pa.array(after)], names=["part", "ordinal", "digest", "length", "after"])

    links = recipes.select("part", "ordinal", "lengths", "digests", "root").mapInArrow(explode, schema)
    met = links.join(_checked_chunks(spark, store, item), "digest", "left")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, ordinal, length, after, n, crc = batch.columns
            if n.null_count or not n.equals(length):
                raise ValueError("a recipe names a chunk that is missing or of another length")
            out = shift_crc(crc.to_numpy(zero_copy_only=False), after.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part, ordinal, n.cast(pa.int64()), pa.array(out.astype(np.int64))], names=["part", "ordinal", "n", "crc"])

    sums = met.select("part", "ordinal", "length", "after", "n", "crc").mapInArrow(shift, "part int, ordinal long, n long, crc long").groupBy("part", "ordinal").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"))
    return (
        recipes.select("part", "ordinal", "doc_id", (F.col("tokens_before") + F.col("start")).alias("start"), "n_tokens")
        .join(sums, ["part", "ordinal"], "left")
        .select("doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a document's chunks do not add up")).cast("long")).alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    )


def read_ids(spark: SparkSession, store: str, *, item: str = "<u2") -> DataFrame:
    """The documents' ids themselves: doc_id, start, ids (array of int), one row per document, null ids and repeats included.

    A store of no documents gives no rows.
    """
    manifest = verify_manifest(spark, store)
    recipes = spark.read.parquet(f"{store}/recipes").join(F.broadcast(manifest.select("part", "tokens_before")), "part")
    pieces = recipes.select("part", "ordinal", F.posexplode("digests").alias("k", "digest")).join(spark.read.parquet(f"{store}/chunks").select("digest", "ids"), "digest")
    joined = pieces.groupBy("part", "ordinal").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("chunks"))
    rows = recipes.select("part", "ordinal", "doc_id", (F.col("tokens_before") + F.col("start")).alias("start"), "n_tokens").join(joined, ["part", "ordinal"])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(c.values.field("ids").to_pylist()), dtype=item).astype(np.int32) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return rows.select("doc_id", "start", "chunks").mapInArrow(rebuild, schema)


def store_documents(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store of all documents, read it back, and return the per-document digests.

    A null or empty text is the end id alone.  Null ids come first, repeated ids and rows are documents of
    their own.  An empty table gives an empty result.
    """
    workspace = Workspace(docs.sparkSession, "tokenstore")
    path = tokenizer or tokenizer_path(TOKENIZER)
    store = write_store(docs, workspace, tokenizer=path, id_col=id_col, text_col=text_col)
    return read_digests(docs.sparkSession, store, item=encoder(path).item.str)
