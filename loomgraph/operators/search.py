"""Symbol search: postings, AND and phrase queries under BM25, substring fallback, combined ranking."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("name", "owner", "descriptor")
K1, B = 1.2, 0.75
HITS = 100


def query_terms(query: str | None) -> list[str]:
    """The query's terms; one with separators inside is a phrase."""
    return [t for t in re.split(r"[^A-Za-z0-9_$<>]+", query or "") if t]


def query_terms_of(query: Column) -> Column:
    """The terms of a column of queries, by the same rule."""
    return F.filter(F.split(F.coalesce(query, F.lit("")), r"[^A-Za-z0-9_$<>]+"), lambda t: t != "")


#: Letters with a mark and the plain letter each folds to, from their canonical decompositions.
_FOLDED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(map(unicodedata.combining, d[1:]))}


def fold(text: str) -> str:
    return "".join(_FOLDED.get(c, c) for c in text.lower())


def term_tokens(term: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", fold(term)) if t]


def _tokens(column: str) -> Column:
    folded = F.translate(F.lower(F.coalesce(F.col(column), F.lit(""))), "".join(_FOLDED), "".join(_FOLDED.values()))
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def indexed(nodes: DataFrame) -> DataFrame:
    """(id, field, pos, token, len): folded runs of letters and digits of each indexed column, with the number of tokens of the whole row."""
    lists = nodes.select("id", *[_tokens(c).alias(c) for c in FIELDS])
    lists = lists.withColumn("len", sum((F.size(c) for c in FIELDS), F.lit(0)).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("tokens")) for c in FIELDS]))
    return lists.select("id", "len", each.alias("f")).select("id", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("pos", "token"), "len")


def postings(nodes: DataFrame) -> DataFrame:
    """(id, field, pos, token)."""
    return indexed(nodes).drop("len")


def _term_rows(post: DataFrame, terms: list[list[str]]) -> DataFrame:
    """(id, term, tf[, len]) of each term alone.  Several tokens of a term must stand side by side in one column."""
    also = ["len"] if "len" in post.columns else []
    wanted = post.sparkSession.createDataFrame([(k, o, t, len(ts)) for k, ts in enumerate(terms) for o, t in enumerate(ts)], "term int, at int, token string, n int")
    # A filter that reaches the scan: a stored index is sorted by token.
    near = post.where(F.col("token").isin(sorted({t for ts in terms for t in ts}))).join(F.broadcast(wanted), "token")
    starts = near.groupBy("id", "field", "term", (F.col("pos") - F.col("at")).alias("start"), "n", *also).agg(F.count_distinct("at").alias("met")).where("met = n")
    return starts.groupBy("id", "term", *also).agg(F.count("*").alias("tf"))


def _terms(query: str) -> list[list[str]]:
    return [t for t in map(term_tokens, query_terms(query)) if t]


def term_hits(post: DataFrame, query: str) -> DataFrame:
    """(id, term, tf): nodes that have all terms of the query, in any columns, with each term's occurrences."""
    terms = _terms(query)
    if not terms:
        return post.sparkSession.createDataFrame([], "id string, term int, tf long")
    hits = _term_rows(post, terms)
    full = hits.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") == len(terms)).select("id")
    return hits.join(full, "id", "left_semi").select("id", "term", "tf")


def bm25(nodes: DataFrame, query: str, *, index: DataFrame | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """(id, score): lower is better, as a negated BM25 over the whole row's tokens.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6.  ``index`` (as by ``indexed``) and ``totals`` (rows,
    tokens) are what an index has stored; without them they are made from the nodes.
    """
    post = index if index is not None else indexed(nodes)
    terms = _terms(query)
    if not terms:
        return nodes.where("false").select("id", F.lit(0.0).alias("score"))
    if totals is None:
        totals = nodes.agg(F.count("*"), F.coalesce(F.sum(sum((F.size(_tokens(c)) for c in FIELDS), F.lit(0))), F.lit(0))).first()
    rows, tokens = totals
    hits = _term_rows(post, terms)
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    idf = F.greatest(F.log((rows - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("len") / (tokens / max(rows, 1) or 1))
    met = hits.join(F.broadcast(frequency), "term").groupBy("id").agg(F.count("*").alias("k"), (-F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))).alias("score"))
    return met.where(F.col("k") == len(terms)).select("id", "score")


def like_hits(nodes: DataFrame, query: str, *, escape: bool = False) -> DataFrame:
    """Nodes whose name equals the query, or whose name, owner, id or descriptor holds it; wildcards are live unless ``escape``."""
    q = query.lower()
    if escape:
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        return nodes.where((low("name") == q) | low("name").contains(q) | low("owner").contains(q) | low("id").contains(q) | low("descriptor").contains(q))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return nodes.where((low("name") == q) | low("name").like(f"%{q}%") | low("owner").like(f"%{q}%") | low("id").like(f"%{q}%") | low("descriptor").like(f"%{q}%"))


def like_ranked(nodes: DataFrame, query: str, *, escape: bool = False) -> DataFrame:
    """The first hits: equal names, then by length of the name, then by id."""
    rank = F.when(F.lower("name") == query.lower(), 0).otherwise(1)
    return like_hits(nodes, query, escape=escape).withColumn("rank", rank).orderBy("rank", F.length("name"), "id").limit(HITS)


def fts_ranked(nodes: DataFrame, query: str, **stored) -> DataFrame:
    """The first full-text hits: score, equal names first, kind, id."""
    met = nodes.join(bm25(nodes, query, **stored), "id")
    return met.withColumn("rounded", F.round("score", 4)).orderBy("rounded", (F.col("name") == query).desc(), "kind", "id").limit(HITS)


def combined(nodes: DataFrame, query: str, *, escape: bool = False, **stored) -> DataFrame:
    """(pos, id): an exact id alone; else full-text hits, then substring hits that are not among them.

    ``stored`` is what ``bm25`` takes from an index.
    """
    if query[:2] in ("C:", "M:", "F:"):
        return nodes.where(F.col("id") == query).select(F.lit(1).alias("pos"), "id")
    one = Window.orderBy("rounded", F.desc("same"), "kind", "id")  # at most HITS rows
    first = fts_ranked(nodes, query, **stored).withColumn("same", F.col("name") == query).select(F.row_number().over(one).alias("pos"), "id")
    two = Window.orderBy("rank", F.length("name"), "id")
    second = like_ranked(nodes, query, escape=escape).select((F.row_number().over(two) + HITS).alias("pos"), "id")
    both = first.unionByName(second).groupBy("id").agg(F.min("pos").alias("pos"))
    return both.select(F.row_number().over(Window.orderBy("pos")).alias("pos"), "id")
