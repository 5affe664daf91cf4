"""Quality rules as weak supervision.

Each rule votes good, bad, or abstains on a document.  Expectation-maximisation estimates every rule's
accuracies and the share of good documents from the votes alone; a document is kept if its posterior
probability of being good reaches ``KEEP_FROM``.  Only the number of documents with each pattern of votes
is needed for that: at most 3 to the power of the number of rules, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

SYMBOLS = "#*$%&|<>"
KEEP_FROM = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words
_BLANKS = " \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
#: ASCII marks become a full stop, white space a blank, all else a letter.
_SHAPE = bytes(32 if c in b" \t\n\v\f\r" else 46 if 32 < c < 127 and not chr(c).isalnum() else 97 for c in range(256))


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_distinct: int
    n_upper: int
    n_exclaim: int
    n_marks: int
    n_marked_words: int


def measure(text: str | None) -> Measures:
    """Counts over a whole text.  Words are runs without ASCII white space; null counts as empty.

    ``n_repeat_words`` counts each word once that lies in a 3-word window found twice or more.
    """
    if not text:
        return Measures(*[0] * len(Measures._fields))
    data = text.encode()
    words = data.split()
    ids: dict[bytes, int] = {}
    seq = np.fromiter([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64, count=len(words))
    repeats = 0
    if seq.size > 3:
        # Pairs of words are numbered first, so a window's number fits 64 bits for any vocabulary.
        _, pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)
        window = pair[:-1] * len(ids) + seq[2:]
        order = np.argsort(window, kind="stable")
        equal = window[order[1:]] == window[order[:-1]]
        if equal.any():
            found = np.zeros(window.size, dtype=bool)
            found[order[1:][equal]] = True
            found[order[:-1][equal]] = True
            covered = np.zeros(seq.size, dtype=bool)
            for k in range(3):
                covered[k : k + window.size] |= found
            repeats = int(covered.sum())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    shape = data.translate(_SHAPE) + b" "
    return Measures(
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(ids),
        len(data) - len(data.translate(None, _UPPER)),
        text.count("!"),
        shape.count(b"."),
        shape.count(b". "),
    )


class Rule(NamedTuple):
    """Votes bad at or above ``bad``, good at or below ``good`` (or the reverse if bad < good), else abstains."""

    name: str
    value: object
    bad: float
    good: float

    def vote(self, m: Measures) -> int:
        x = self.value(m)
        if self.bad > self.good:
            return -1 if x >= self.bad else 1 if x <= self.good else 0
        return -1 if x <= self.bad else 1 if x >= self.good else 0


RULES = (
    Rule("symbols", lambda m: m.n_symbols / max(m.n_words, 1), 0.1, 0.03),
    Rule("repeated lines", lambda m: m.n_dup_lines / max(m.n_lines, 1), 0.4, 0.2),
    Rule("repeated words", lambda m: m.n_repeat_words / max(m.n_words, 1), 0.4, 0.2),
    Rule("shouting", lambda m: m.n_upper / max(m.word_chars, 1), 0.35, 0.12),
    Rule("exclamation", lambda m: m.n_exclaim / max(m.n_words, 1), 0.5, 0.2),
    Rule("marks", lambda m: m.n_marks / max(m.word_chars, 1), 0.09, 0.06),
    Rule("marked words", lambda m: m.n_marked_words / max(m.n_words, 1), 0.4, 0.3),
    Rule("long words", lambda m: m.word_chars / max(m.n_words, 1), 10.0, 7.5),
    Rule("short words", lambda m: m.word_chars / max(m.n_words, 1), 2.5, 3.5),
    Rule("few words", lambda m: m.n_words, 10, 100),
    Rule("narrow vocabulary", lambda m: m.n_distinct / max(m.n_words, 1), 0.05, 0.3),
)


def pattern(m: Measures, rules: tuple[Rule, ...] = RULES) -> int:
    """The votes as digits to base 3."""
    out = 0
    for r in rules:
        out = out * 3 + r.vote(m) + 1
    return out


def votes_of(patterns: np.ndarray, rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(rules - 1, -1, -1) % 3 - 1


class Verdict(NamedTuple):
    prior: float
    sensitivity: np.ndarray  # share of bad votes among the votes on bad documents
    specificity: np.ndarray  # share of good votes among the votes on good documents
    patterns: np.ndarray
    posterior: np.ndarray


def expectation_maximisation(counts: dict[int, int], rules: int = len(RULES), rounds: int = 200) -> Verdict:
    """Fit the share of good documents and each rule's two accuracies to the counts of vote patterns.

    Junk comes in kinds and a rule knows one of them, so its accuracies on bad and on good documents are
    estimated apart: a good vote says little, a bad one much.  Abstaining says nothing.  A rule is taken
    to be right about good documents at least 19 times in 20, and never certain.
    """
    found = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(p)] for p in found], dtype=float)
    votes = votes_of(found, rules)
    bad, good = votes < 0, votes > 0
    prior, sensitivity, specificity = 0.8, np.full(rules, 0.3), np.full(rules, 0.99)
    posterior = np.zeros(found.size)
    for _ in range(rounds):
        for_good = good @ np.log(specificity) + bad @ np.log(1 - specificity)
        for_bad = bad @ np.log(sensitivity) + good @ np.log(1 - sensitivity)
        posterior = 1 / (1 + np.exp(np.clip(for_bad - for_good - np.log(prior / (1 - prior)), -500, 500)))
        of_good, of_bad = n * posterior, n * (1 - posterior)
        new_specificity = np.clip((of_good @ good + 99) / (of_good @ (good | bad) + 100), 0.95, 0.9999)
        new_sensitivity = np.clip((of_bad @ bad + 3) / (of_bad @ (good | bad) + 10), 0.1, 0.99)
        share = float(np.clip((of_good.sum() + 8) / (n.sum() + 10), 0.05, 0.95))
        moved = max(abs(share - prior), np.abs(new_specificity - specificity).max(), np.abs(new_sensitivity - sensitivity).max())
        prior, specificity, sensitivity = share, new_specificity, new_sensitivity
        if moved < 1e-10:
            break
    return Verdict(prior, sensitivity, specificity, found, posterior)


_OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("votes", T.IntegerType()),
]


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` as one struct column ``doc``, with its measures beside it: no names can clash."""
    at = docs.columns.index(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = T.StructType([*packed.schema.fields, *_OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            found = [measure(t.as_py()) for t in doc.field(at)]
            cols = [pa.array([m[k] for m in found], pa.int64()) for k in range(5)]
            failed = [m.n_words < LEAST_WORDS or 100 * m.n_repeat_words > MOST_REPEATED * m.n_words for m in found]
            yield pa.RecordBatch.from_arrays([doc, *cols, pa.array(failed, pa.bool_()), pa.array([pattern(m) for m in found], pa.int32())], names=schema.names)

    return packed.mapInArrow(run, schema)


def _judged(measured: DataFrame, workspace: Workspace, keep_from: float) -> DataFrame:
    """Measured rows with quality (posterior) and kept: measured once, fitted to the counts of patterns."""
    rows = workspace.stage(measured, "measured")
    counts = {r.votes: r["count"] for r in rows.groupBy("votes").count().collect()}  # 3 ** rules at most
    fit = expectation_maximisation(counts)
    table = rows.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(fit.patterns, fit.posterior, strict=True)], "votes int, quality double")
    return rows.join(F.broadcast(table), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def score(docs: DataFrame, *, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` packed in ``doc``, with counts, base_failed, votes, quality (posterior) and kept.

    Null and empty texts have no words and fail the base.  Ties at ``keep_from`` are kept.  Repeated rows
    count as often as they occur.  An empty table gives an empty result.
    """
    return _judged(_measured(docs, text_col), Workspace(docs.sparkSession, "quality"), keep_from)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept.

    Nulls, ties, repeats and empty tables as in ``score``; null ids stay null.
    """
    # The text goes no further than the measuring task: only the id is written.
    at = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _judged(_measured(at, "text").select("doc.doc_id", *[f.name for f in _OUT]), Workspace(docs.sparkSession, "quality"), KEEP_FROM).drop("votes")


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Null, empty and short texts go; repeated rows stay or go together; a posterior of exactly ``KEEP_FROM``
    stays.  An empty table gives an empty result.
    """
    return score(docs, text_col=text_col).where("kept").select("doc.*")
