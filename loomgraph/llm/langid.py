"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2- to 4-byte pieces of the lower-cased words of a text, each word between blanks and
without ASCII digits or marks.  A text's representation is the mean of its subwords' embeddings; a softmax
layer gives the languages.  Embeddings and layer are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows: at most ``SAMPLE`` rows, dealt evenly to the labels, and at least
``LABEL_ROWS`` of each label that has so many, so rare ones are learned.  Their whole texts are counted where
they are read; only the shares of their subwords (at most 6 bytes a bucket) reach the driver.  A held-out
part of the sample sets the softmax temperature, and the rejection threshold: the lowest confidence from
which the accepted part errs at most ``MOST_ERRORS`` of the time, but at least the one midway, in log-odds,
between chance and the ``LOW`` quantile of the rightly named part.  So texts in no learned language are
rejected even if the learned ones never err.  A model of one language gives it the probability 1 and cannot reject.

Prediction reads whole texts.  As mean and layer are linear, the embeddings are folded into one score per
subword and language, so a document costs a table lookup per byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import prepare_workers

SAMPLE, LABEL_ROWS = 4_000, 20
#: Words of the short excerpt that each sampled text also gives.
EXCERPT = 8
BUCKET_BITS, DIMENSION, EPOCHS, RATE = 15, 16, 6, 0.5
MOST_ERRORS = 0.01
LOW = 0.01
UNKNOWN = "und"
_CHUNK = 1 << 20
_KEYS = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA6B), 4: np.uint32(0xC2B2AE35)}
#: ASCII apart from letters becomes a blank.
_BLANKED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a whole text's subwords, in parts of bounded size."""
    data = b" " + text.lower().encode().translate(_BLANKED) + b" "
    for at in range(0, len(data), _CHUNK):
        x = np.frombuffer(data[at : at + _CHUNK + 3], dtype=np.uint8).astype(np.uint32)
        blank = x == 32
        inner = np.zeros(x.size, dtype=bool)  # a blank inside a piece, other than at its ends
        key = x.copy()
        for n in (2, 3, 4):
            if n > 2:
                inner = inner[: x.size - n + 1] | blank[n - 2 : x.size - 1]
            else:
                inner = blank[:-1] & blank[1:]
            if x.size < n:
                break
            key = key[: x.size - n + 1] | (x[n - 1 :] << np.uint32(8 * (n - 1)))
            own = key[:_CHUNK][~inner[:_CHUNK]]
            yield (own * _KEYS[n]) >> np.uint32(32 - BUCKET_BITS)


class Features(NamedTuple):
    """Buckets of a text's subwords with their shares, and the same of a short excerpt."""

    buckets: np.ndarray
    shares: np.ndarray
    short_buckets: np.ndarray
    short_shares: np.ndarray


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for part in subwords(text):
        counts += np.bincount(part, minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(1, counts.sum())).astype(np.float32)


def features(text: str) -> Features:
    """Of a whole text; the excerpt is ``EXCERPT`` words from a place that a checksum of the text gives."""
    words = text.split()
    a = zlib.crc32(text.encode()) % max(1, len(words) - EXCERPT)
    return Features(*_shares(text), *_shares(" ".join(words[a : a + EXCERPT])))


class Model:
    """Languages, folded subword scores, bias, temperature and rejection threshold."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.languages, self.scores, self.bias, self.temperature, self.threshold = languages, scores, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in subwords(text):
            total += np.bincount(h, minlength=1 << BUCKET_BITS).astype(np.float32) @ self.scores if h.size > 1 << BUCKET_BITS else self.scores[h].sum(axis=0, dtype=np.float64)
            n += h.size
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 without text, letter or learned language."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def accepts(self, language: str, score: float) -> bool:
        return language != UNKNOWN and score >= self.threshold


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _least_confidence(right: np.ndarray, k: int) -> float:
    """Midway between chance among k languages and the confidence of rightly named rows; without rows, and certainty."""
    if k < 2:
        return 1.0
    if not right.size:
        return (1 + 1 / k) / 2
    odds = lambda p: np.log(p / (1 - p))
    low = float(np.clip(np.quantile(right, LOW), 1 / k, 1 - 1e-12))
    return float(1 / (1 + np.exp(-(odds(1 / k) + odds(low)) / 2)))


def train(rows: list[tuple[str | Features, str]], seed: int = 7) -> Model:
    """Fit on (text or its features, language) rows; every fifth of a language only calibrates.

    Texts without a letter are passed over.  Rows without a subword teach nothing.  No rows: a model of no language.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    code = {lang: i for i, lang in enumerate(languages)}
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    checks: list[tuple[Features, int]] = []
    met: dict[str, int] = {}
    for text, lang in rows:
        if isinstance(text, str):
            if not has_letter(text):
                continue
            text = features(text)  # noqa: PLW2901
        met[lang] = met.get(lang, 0) + 1
        if met[lang] % 5 == 0:
            checks.append((text, code[lang]))
            continue
        examples += [(at, share, code[lang]) for at, share in (text[:2], text[2:]) if at.size]  # short texts occur too
    k = len(languages)
    embed = rng.normal(0, 1 / DIMENSION, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32)
    layer, bias = np.zeros((k, DIMENSION), dtype=np.float32), np.zeros(k, dtype=np.float32)
    steps, total = 0, max(1, EPOCHS * len(examples))
    for _ in range(EPOCHS):
        for e in rng.permutation(len(examples)):
            at, share, y = examples[e]
            rate = RATE * (1 - steps / total)
            z = share @ embed[at]
            g = _softmax(layer @ z + bias)
            g[y] -= 1
            back = layer.T @ g
            layer -= rate * np.outer(g, z)
            bias -= rate * g
            # The mean's gradient is spread over few thousand subwords; a larger step keeps up with the layer.
            embed[at] -= (20 * rate * share)[:, None] * back
            steps += 1
    model = Model(languages, embed @ layer.T, bias.astype(float), 1.0, _least_confidence(np.zeros(0), k))
    if checks:
        logits, y = np.array([f.shares.astype(float) @ model.scores[f.buckets] + model.bias for f, _ in checks]), np.array([c for _, c in checks])
        grid = np.exp(np.linspace(-0.7, 2, 55))
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(y.size), y] + 1e-12).mean()))
        p = _softmax(logits / model.temperature)
        model.threshold = _least_confidence(p.max(axis=1)[p.argmax(axis=1) == y], k)
        order = np.argsort(-p.max(axis=1), kind="stable")
        wrong = np.cumsum(p.argmax(axis=1)[order] != y[order])
        fine = np.flatnonzero(wrong <= MOST_ERRORS * np.arange(1, y.size + 1))
        if fine.size and fine[-1] + 1 < y.size:
            model.threshold = max(model.threshold, float(p.max(axis=1)[order[fine[-1]]]))
    return model


def _quotas(sizes: dict[str, int]) -> dict[str, int]:
    """Rows of each label: even shares of ``SAMPLE``, what small labels leave goes to the others, ``LABEL_ROWS`` at least."""
    out, left = {}, SAMPLE
    for k, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[lang] = min(sizes[lang], max(LABEL_ROWS, left // (len(sizes) - k)))
        left = max(0, left - out[lang])
    return out


def sample(rows: DataFrame) -> list[tuple[Features, str]]:
    """(features, label) of the fit sample of rows (i, t, l), in the order of a hash of id and text.

    Rows that are equal in both have one hash and are drawn or left out together; a label that the draw
    leaves short of ``LABEL_ROWS`` is filled from its rows as they are read.
    """
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}  # one row a label
    quotas = _quotas(sizes)
    drawn = rows.select("t", "l", F.pmod(F.xxhash64("i", "t"), F.lit(1_000_000_007)).alias("h"))
    found = []
    if sum(sizes.values()) > SAMPLE:
        # A hash bound leaves little more than the wanted rows of a label before any row moves.
        bounds = [(lang, q, int(1_000_000_007 * min(1.0, (1.2 * q + 40) / sizes[lang]))) for lang, q in quotas.items()]
        wanted = rows.sparkSession.createDataFrame(bounds, "of string, quota int, bound long")
        near = drawn.join(F.broadcast(wanted), (F.col("l") == F.col("of")) & (F.col("h") < F.col("bound")))
        order = Window.partitionBy("l").orderBy("h", "t")
        found = _described(near.withColumn("k", F.row_number().over(order)).where("k <= quota")).collect()
        got: dict[str, int] = {}
        for r in found:
            got[r.l] = got.get(r.l, 0) + 1
        for lang in sizes:
            if got.get(lang, 0) < min(LABEL_ROWS, sizes[lang]):
                found = [r for r in found if r.l != lang] + _described(drawn.where(F.col("l") == lang).limit(quotas[lang])).collect()
    elif sizes:
        found = _described(drawn).collect()
    whole = lambda r: Features(*(np.frombuffer(r[k], dtype=kind) for k, kind in enumerate(("<u2", "<f4", "<u2", "<f4"))))
    return [(whole(r), r.l) for r in sorted(found, key=lambda r: (r.h, r.l, bytes(r.buckets), bytes(r.shares)))]


def _described(drawn: DataFrame) -> DataFrame:
    """Features of the drawn texts that have a letter, computed where they are read."""
    prepare_workers(drawn.sparkSession)
    schema = "buckets binary, shares binary, short_buckets binary, short_shares binary, l string, h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [i for i, t in enumerate(batch.column(0)) if has_letter(t.as_py())]
            rows = [[x.tobytes() for x in features(batch.column(0)[i].as_py())] for i in at]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.binary()) for k in range(4)], batch.column(1).take(pa.array(at, pa.int64())), batch.column(2).take(pa.array(at, pa.int64()))], names=["buckets", "shares", "short_buckets", "short_shares", "l", "h"])

    return drawn.select("t", "l", "h").mapInArrow(run, schema)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_fold: int | None = None) -> Model:
    """Train on a bounded sample of each label, chosen by a hash of id and text; rows of the held-out fold are never read.

    Rows without text or label are passed over; a null id is in no fold.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    if held_out_fold is not None:
        rows = rows.where(F.coalesce(F.crc32("i") % 4, F.lit(-1)) != held_out_fold)
    return train(sample(rows))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` packed in ``doc``, with lang_pred, score and accepted; no column of ``docs`` can clash with them.

    A text that is null or has no letter is ``und`` with score 0 and not accepted, and so is every text for a
    model of no language.  Of languages with equal scores the first in order is named.
    """
    at = docs.columns.index(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = T.StructType([*packed.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(0).field(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([model.accepts(*x) for x in found], pa.bool_())], names=schema.names)

    return packed.mapInArrow(run, schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_fold: int | None = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if no row has a language.
    Only the text enters a prediction.  A null id is never held out.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, held_out_fold=held_out_fold)
    rows = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), model)
    held = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 4 == (held_out_fold if held_out_fold is not None else -1), F.lit(False))
    return rows.select("doc.doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language the model accepts, with all their columns.

    Null, empty and letterless texts go, and so do all documents where no row has a language.  Rows that are
    repeated stay or go together.  An empty table gives an empty result.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, text_col=text_col).where("accepted").select("doc.*")
