"""Near-duplicate documents: universal hash minima, banding, signature verification, star components.

Words are maximal runs without ASCII white space, A-Z lower-cased.  A document's set is its distinct
5-word shingles; with fewer words the whole sequence is its one shingle; without words the set is empty
and links with nothing.  Two documents are linked if 100 * |A & B| >= 75 * |A | B|, confirmed on the full
sets.  With 64 bands of 6 minima a pair at the threshold shares a band with probability 1 - 4e-6.

* Equal sets are one vertex before banding, so copies never meet in a bucket.
* A bucket's members are first compared with its smallest id only, and linked ones become components.
* Documents in a bucket that still holds two components are open.  Their remaining links are between
  components, and an exact filter finds where those can be: a document's shingles are put into one common
  order, those that only its own component has first, then rare ones first.  At its i-th shingle of n, a
  partner whose first common shingle this is has at most 4/3 (more exactly (100 + t) / t) times n - i + 1 less n
  shingles, and at least t n / 100.  Where that leaves no size, the document is not posted.  Members of a dense
  group, whose own shingles come first, hardly post at all, so no step emits the pairs of a group.
* What is posted under one shingle by different components, with sizes that fit both ways, is compared by
  signature in blocks of bounded size, and by full sets where signatures agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .workspace import Workspace, grouped, partitions_for

WORDS, BANDS, ROWS = 5, 64, 6
THRESHOLD = 75  # per cent
#: Signatures must agree as for this similarity: the threshold less four standard errors of 384 minima.
SIGNATURE_FLOOR = 0.66
#: Postings of one shingle that are compared at once.
BLOCK = 512
#: Documents of one component whose sets a task holds at once, and others that are held against them there.
CHUNK, ASKERS = 1024, 8192
#: Ids of documents to be read again that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


_BLANK = np.array([c in b" \t\n\v\f\r" for c in range(256)])
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word: from its bytes and length up to 16 bytes, by xxhash beyond."""
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    padded = np.frombuffer(data + bytes(24), dtype=np.uint8)
    eight = np.ndarray(shape=(padded.size - 7,), dtype="<u8", buffer=padded, strides=(1,))
    n = end - start
    low = eight[start] & _MASKS[np.minimum(n, 8)]
    high = eight[start + 8 * (n > 8)] & _MASKS[np.clip(n - 8, 0, 8)]
    out = _mix(_mix(low + _ODD) ^ (high * _ODD) ^ n.astype(np.uint64))
    for k in np.flatnonzero(n > 16).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]])
    return out


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles."""
    h = word_hashes(text.encode().lower()) if text else np.empty(0, dtype=np.uint64)
    if not h.size:
        return h
    size = min(words, h.size)
    rolled = np.full(h.size - size + 1, size, dtype=np.uint64)
    for k in range(size):
        rolled = rolled * _ODD + h[k : h.size - size + 1 + k]
    return np.unique(_mix(rolled))


class Minima:
    """A family of universal hash functions x -> a x + b on 32 bits, fixed by its seed."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self.weights = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.buffer = np.empty((256, bands * rows), dtype=np.uint32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.a.size, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, x.size, 256):
            part = x[i : i + 256, None]
            held = self.buffer[: part.size]
            np.multiply(part, self.a, out=held)
            held += self.b
            np.minimum(out, held.min(axis=0), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        grouped_rows = minima.reshape(self.bands, self.rows).astype(np.uint64)
        return _mix((grouped_rows * self.weights).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)


def _describe(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
            T.StructField("signature", T.BinaryType()),
        ]
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Minima(bands, rows)
        for batch in batches:
            n, digests, keys, signatures = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(s.size)
                if not s.size:
                    for x in (digests, keys, signatures):
                        x.append(None)
                    continue
                digests.append(hashlib.blake2b(s, digest_size=16).digest())
                minima = family.of(s)
                keys.append(family.band_keys(minima))
                signatures.append(minima.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=schema.names)

    return docs.mapInArrow(describe, schema)


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated from the share of equal low bytes; unequal minima agree in one case of 256."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _matrix(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1)


def _alike(pairs: DataFrame, signatures: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose signatures pass, with the estimate."""
    met = pairs.join(signatures.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb")
    schema = T.StructType([met.schema["a"], met.schema["b"], T.StructField("estimate", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            est = _similarity(_matrix(batch.column(2)), _matrix(batch.column(3)))
            keep = pa.array(np.flatnonzero(est >= floor))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(est[keep.to_numpy()])], names=schema.names)

    return met.mapInArrow(compare, schema)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with the ids; texts stay where they are read unless the ids are too many to broadcast."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _buckets(described: DataFrame, equal: DataFrame) -> DataFrame:
    """(doc_id, key) of the representatives; their keys, half a kilobyte each, stay where they are read like texts."""
    vertices = _only(described.where("digest is not null").select("doc_id", "keys"), equal.select(F.col("rep").alias("doc_id")))
    return vertices.select("doc_id", F.explode("keys").alias("key"))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) with the full set of each whole text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(sets, schema)


def _confirm(pairs: DataFrame, docs: DataFrame, words: int, threshold: int, workspace: Workspace, name: str, most: int) -> DataFrame:
    """The pairs (at most ``most``) whose full shingle sets are similar enough; only documents in a pair are read again."""
    pairs = workspace.stage(pairs.select("a", "b").distinct(), f"{name}-pairs", rows=most)
    n = pairs.count()
    if not n:
        return pairs
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = workspace.stage(_sets(_only(docs, involved), words), f"{name}-sets")
    met = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    linked = T.StructType([met.schema["a"], met.schema["b"]])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), dtype=np.uint64) for k in (2, 3))
                both = np.intersect1d(x, y, assume_unique=True).size
                if 100 * both >= threshold * (x.size + y.size - both):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=linked.names)

    links = workspace.stage(met.mapInArrow(confirm, linked), f"{name}-links", rows=n, rows_per_file=2_000)
    workspace.drop(f"{name}-sets")
    return links


#: Rows that one Arrow batch of shingles holds.
_SLICE = 65_536


def _open(open_ids: DataFrame, described: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Open documents: doc_id, component, weight (open members of the component), chunk, n, signature, shingles.

    A chunk holds at most about ``CHUNK`` members of one component.
    """
    sizes = open_ids.groupBy("component").agg(F.count("*").alias("weight"))
    chunk = F.xxhash64("component", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("weight") / CHUNK)))
    placed = open_ids.join(sizes, "component").select("doc_id", "component", "weight", chunk.alias("chunk"))
    signed = placed.join(described.select("doc_id", "signature"), "doc_id").dropDuplicates(["doc_id"])
    return signed.join(_sets(_only(docs, open_ids.select("doc_id")), words).dropDuplicates(["doc_id"]), "doc_id").withColumn("n", (F.octet_length("shingles") / 8).cast("long"))


def _postings(held: DataFrame, threshold: int) -> DataFrame:
    """(key, doc_id, component, n, least, most): shingles under which a document can have its first in common with another component, and the partner's sizes there."""
    kind, of = held.schema["doc_id"].dataType, held.schema["component"].dataType
    single = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", kind), T.StructField("component", of), T.StructField("n", T.LongType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.int64)
            row = np.repeat(np.arange(n.size), n)
            for at in range(0, keys.size, _SLICE):
                take = pa.array(row[at : at + _SLICE])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + _SLICE]), *[batch.column(k).take(take) for k in range(3)]], names=single.names)

    spreaded = held.select("doc_id", "component", "n", "shingles").mapInArrow(spread, single)
    common = spreaded.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("many")).where("x < y").select("key", "many")
    own = spreaded.join(common, "key").groupBy("doc_id", "component", "n").agg(F.collect_list(F.struct("many", "key")).alias("common"))
    posting = T.StructType([*single.fields, T.StructField("least", T.LongType()), T.StructField("most", T.LongType())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys, most, least = [], [], [], []
            for k, (n, shingles) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                many, key = (shingles.values.field(f).to_numpy() for f in ("many", "key"))
                key = key[np.lexsort((key, many))]
                left = key.size - np.arange(key.size)  # shingles from this one on
                top = (100 + threshold) * left // threshold - n
                low = -(-threshold * n // 100)
                stop = int(np.count_nonzero(top >= low))  # it falls along the order
                row += [k] * stop
                keys.append(key[:stop])
                most.append(top[:stop])
                least += [low] * stop
            take = pa.array(row, pa.int64())
            whole = lambda parts: pa.array(np.concatenate([np.empty(0, dtype=np.int64), *parts]))
            yield pa.RecordBatch.from_arrays([whole(keys), *[batch.column(c).take(take) for c in range(3)], pa.array(least, pa.int64()), whole(most)], names=posting.names)

    return own.mapInArrow(post, posting)


def _lists(postings: DataFrame) -> DataFrame:
    """(key, shared, large) of the keys that two components or more post: how many blocks the small components share, and the large ones' blocks."""
    counts = postings.groupBy("key", "component").agg(F.count("*").alias("c"))
    large = F.col("c") >= BLOCK
    keys = counts.groupBy("key").agg(
        F.count("*").alias("components"),
        F.ceil(F.coalesce(F.sum(F.when(~large, F.col("c"))), F.lit(0)) / BLOCK).alias("shared"),
        # At most a BLOCK-th of the key's postings.
        F.collect_list(F.when(large, F.struct(F.col("component").alias("of"), F.ceil(F.col("c") / BLOCK).alias("parts")))).alias("large"),
    )
    return keys.where("components > 1").drop("components")


def _blocks(postings: DataFrame, lists: DataFrame) -> DataFrame:
    """Postings dealt to comparisons: key, i, j and block beside what a posting holds.

    A component with ``BLOCK`` postings or more under a key has blocks of its own, which never meet each other;
    the small ones share blocks.  A row meets the blocks that can hold other components.
    """
    rows = postings.join(lists, "key")
    code = lambda of, part: -1 - F.pmod(F.xxhash64(of, part), F.lit(1 << 62))
    parts = F.try_element_at(F.filter("large", lambda x: x["of"] == F.col("component")), F.lit(1))["parts"]
    block = F.when(parts.isNotNull(), code(F.col("component"), F.pmod(F.xxhash64("doc_id"), parts))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
    nothing = F.array().cast("array<bigint>")
    own = F.filter("large", lambda x: x["of"] != F.col("component"))
    others = F.flatten(F.transform(own, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda part: code(x["of"], part))))
    met = F.array_distinct(F.concat(F.when(F.col("shared") > 0, F.sequence(F.lit(0).cast("long"), F.col("shared") - 1)).otherwise(nothing), others))
    rows = rows.select("key", "doc_id", "component", "n", "least", "most", block.alias("block"), F.explode(met).alias("other"))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component", "n", "least", "most")


def _candidates(dealt: DataFrame, held: DataFrame, floor: float) -> DataFrame:
    """(a, chunk, others): documents of one chunk that look like ``a``; and a row with null others for each document in an array.

    The document of the smaller component asks, so a few stragglers of a large group make a few long arrays
    and not one array for each member.
    """
    keys = ["key", "i", "j"]
    rows = dealt.join(held.select("doc_id", "weight", "chunk", "signature"), "doc_id").select(*keys, "block", "doc_id", "component", "n", "least", "most", "weight", "chunk", "signature")
    kind = rows.schema["doc_id"].dataType
    packed = T.StructType([T.StructField("a", kind), T.StructField("chunk", T.LongType()), T.StructField("others", T.ArrayType(kind))])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            batch = table.combine_chunks().to_batches()[0]
            i, j, block, n, least, most, weight, chunk = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("i", "j", "block", "n", "least", "most", "weight", "chunk"))
            of = batch.column(5).dictionary_encode().indices.to_numpy()
            left, right = np.flatnonzero(block == i[0])[:, None], np.flatnonzero(block == j[0])[None, :]
            fits = (of[left] != of[right]) & (n[right] >= least[left]) & (n[right] <= most[left]) & (n[left] >= least[right]) & (n[left] <= most[right])
            if i[0] == j[0]:
                fits &= left < right
            x, y = np.nonzero(fits)
            if not x.size:
                continue
            x, y = left[x, 0], right[0, y]
            m = _matrix(batch.column(11))
            alike = np.concatenate([_similarity(m[x[k : k + _SLICE // 8]], m[y[k : k + _SLICE // 8]]) for k in range(0, x.size, _SLICE // 8)]) >= floor
            ids = batch.column(4)
            names = ids.to_pylist()
            by: dict[tuple[int, int], list] = {}
            used = set()
            for p, q in zip(x[alike].tolist(), y[alike].tolist(), strict=True):
                a, b = (q, p) if (weight[q], names[q]) < (weight[p], names[p]) else (p, q)
                used.add(b)
                by.setdefault((a, int(chunk[b])), []).append(names[b])
            if by:
                askers, chunks, others = [names[k] for k, _ in by], [c for _, c in by], list(by.values())
                for q in used:
                    askers.append(names[q])
                    chunks.append(int(chunk[q]))
                    others.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(askers, ids.type), pa.array(chunks, pa.int64()), pa.array(others, pa.list_(ids.type))], names=packed.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "component", "doc_id").mapInArrow(lists, packed)


def _confirm_lists(packed: DataFrame, held: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) found in packed candidates, one for each document and component it links with.

    A task holds the sets of a chunk's documents (about ``CHUNK``) and streams the arrays past them, at most
    about ``ASKERS`` of them, so no row is made for a pair and a set travels once for each component it is held against.
    """
    asked = packed.where("others is not null").groupBy("a", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    salts = asked.groupBy("chunk").agg(F.ceil(F.count("*") / ASKERS).alias("salts"))
    lent = packed.where("others is null").select("a", "chunk").distinct().join(salts, "chunk").select("a", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"), F.lit(None).cast(packed.schema["others"].dataType).alias("others"))
    asking = asked.join(salts, "chunk").select("a", "chunk", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("turn"), "others")
    rows = lent.unionByName(asking).join(held.select(F.col("doc_id").alias("a"), "component", "shingles"), "a").select("chunk", "salt", "turn", "a", "component", "others", "shingles")
    rows = rows.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "turn", "a")
    kind = packed.schema["a"].dataType
    linked = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            x, y = [], []
            for chunk, salt, turn, a, component, others, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (chunk, salt) != now:
                    now, sets = (chunk, salt), {}
                own = np.frombuffer(data, dtype=np.uint64)
                if turn == 0:
                    sets[a] = (component, own)
                    continue
                done = set()
                for b in others:
                    component, other = sets[b]
                    if component in done:
                        continue
                    both = np.intersect1d(own, other, assume_unique=True).size
                    if 100 * both >= threshold * (own.size + other.size - both):
                        done.add(component)
                        x.append(a)
                        y.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.column(3).type), pa.array(y, batch.column(3).type)], names=["a", "b"])

    return rows.mapInArrow(confirm, linked)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable, itself included), kept.

    Null or empty texts have no shingles and stay alone.  Rows that repeat an id are one vertex.  A row
    without id links with nothing: its component is null and it is kept.  Other columns are not read.
    ``threshold`` and the signature floor belong together; for a lower one pass more bands.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "minhash")
    floor = SIGNATURE_FLOOR - (THRESHOLD - threshold) / 100
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = workspace.stage(_describe(docs, words, bands, rows), "described")

    n = described.count()
    # Equal sets: one representative, the smallest id.
    equal = workspace.stage(described.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "equal", rows=n)
    buckets = _buckets(described, equal)
    ends = buckets.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last"), F.count("*").alias("size")).where("center < last")
    # Most buckets have one member; the others' centres are written, so that a frequent bucket can be split in the join.
    ends = workspace.stage(ends.select("key", "center", "size"), "centers", rows=bands * n, rows_per_file=250_000)
    shared = workspace.stage(buckets.join(ends, "key"), "shared", rows=bands * n, rows_per_file=250_000)
    star = workspace.stage(_alike(shared.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), described, floor), "star", rows=shared.count(), rows_per_file=10_000)

    # Each vertex's most promising centre first.
    first = _confirm(star.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")), docs, words, threshold, workspace, "first", most=n)
    parts = connected_components(first, workspace, "parts")

    # Open documents: in a bucket of two components or more, or in a star pair between components.
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    placed = shared.where("size > 2").join(of("doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("of_doc_id", "doc_id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    pairs = star.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")).where("of_a <> of_b")
    ends_of_pairs = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("of_a").alias("component")), F.struct(F.col("b").alias("doc_id"), F.col("of_b").alias("component")))).alias("end")).select("end.*")
    open_ids = workspace.stage(placed.join(split.select("key"), "key", "left_semi").select("doc_id", "component").unionByName(ends_of_pairs).distinct(), "open", rows=n)
    for name in ("centers", "shared", "star", "first-pairs", "first-links"):
        workspace.drop(name)

    if not open_ids.isEmpty():
        held = workspace.stage(_open(open_ids, described, docs, words), "held", rows=open_ids.count(), rows_per_file=2_000)
        # A document posts under the quarter of its shingles that the threshold leaves, at most.
        most = held.agg(F.sum("n")).first()[0] * (100 - threshold) // 100 + held.count()
        postings = workspace.stage(_postings(held, threshold), "postings", rows=most, rows_per_file=50_000)
        posted = postings.count()
        lists = workspace.stage(_lists(postings), "lists", rows=posted)  # written, so that a frequent key's postings can be split in the join
        packed = workspace.stage(_candidates(_blocks(postings, lists), held, floor), "packed", rows=posted, rows_per_file=20_000)
        rest = workspace.stage(_confirm_lists(packed, held, threshold), "rest", rows=packed.count(), rows_per_file=1_000)
        for name in ("postings", "lists", "packed", "held"):
            workspace.drop(name)
        if not rest.isEmpty():
            parts = connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest), workspace, "rest-parts")

    of_rep = equal.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        described.select("doc_id", "n_shingles", "digest")
        .join(of_rep, "digest", "left")
        .coalesce(partitions_for(spark, n, 100_000))
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were; of rows that repeat an id one stays.

    Null and empty texts and rows without id stay.  An empty table gives an empty result.
    """
    workspace = Workspace(docs.sparkSession, "dedup")
    dropped = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias("near_duplicate_id")).distinct()
    dropped = workspace.stage(dropped, "dropped", rows=docs.count())
    # Texts stay where they are read while the ids that go can be broadcast.
    few = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    rest = docs.join(few, docs[id_col] == few["near_duplicate_id"], "left_anti")
    repeated = docs.groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1))
    if repeated.isEmpty():
        return rest
    alone, again = rest.join(repeated.select(id_col), id_col, "left_anti"), rest.join(repeated.select(id_col), id_col, "left_semi")
    return alone.unionByName(again.dropDuplicates([id_col])).select(docs.columns)
