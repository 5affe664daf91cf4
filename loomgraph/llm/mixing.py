"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's target repetition rate is its share of the wanted output over its own size.  Every document
draws its number of copies from the Poisson distribution with that mean, by inverting the distribution
function at a uniform number hashed from the seed, the id and the text; the copies are then put into one
global order by a second hash.  Decisions need no state beyond one size per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import partitions_for, shuffle_partitions

SEED = "mix-1"
#: Sizes to the power ``FLATTEN`` give the default weights: 1 keeps the sources' shares, 0 makes them equal.
FLATTEN = 0.5
#: Largest mean that is drawn at once.
PART = 500
#: Copies to a partition of the result, about.
PARTITION_ROWS = 20_000
#: Source tables up to this many rows are broadcast (about 100 bytes a row); larger ones are shuffled.
BROADCAST_SOURCES = 10_000


def _text_key(doc: Column, text: Column) -> Column:
    return F.concat_ws("|", F.lit(SEED), F.coalesce(doc.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


def _hash52(text: Column) -> Column:
    """52 bits of an MD5 digest as a long."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _uniform(text: Column) -> Column:
    return _hash52(text) / F.lit(float(1 << 52))


def _inverse(rate: Column, uniform: Column) -> Column:
    """Smallest k with uniform < P(X <= k) for a Poisson X of a mean of at most ``PART``.

    Terms follow from one another; the sum stops at the first k that exceeds the draw.
    """
    state = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.lit(False).alias("done"))
    # The upper tail beyond these copies is under 1e-16, less than one step of the draw.
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))

    def step(s: Column, k: Column) -> Column:
        done = s["done"] | (uniform < s["sum"])
        term = s["term"] * rate / k
        return F.struct(
            F.when(done, s["k"]).otherwise(k).alias("k"),
            F.when(done, s["term"]).otherwise(term).alias("term"),
            F.when(done, s["sum"]).otherwise(s["sum"] + term).alias("sum"),
            done.alias("done"),
        )

    return F.aggregate(steps, state, step, lambda s: s["k"].cast("long"))


def poisson_count(rate: Column, uniform: Column, key: Column | None = None) -> Column:
    """A Poisson draw of the given mean by inversion at a uniform number (a null or zero mean: 0).

    Means over ``PART`` would underflow at the first term; they are sums of independent draws of equal means up to
    ``PART``, which is Poisson again: the first at the number itself, the others at numbers hashed from ``key``
    (the uniform number's own digits, where none is given).
    """
    parts = F.ceil(rate / PART).cast("int")
    seed = key if key is not None else uniform.cast("string")

    def own(part: Column) -> Column:
        return F.when(part == 1, uniform).otherwise(_uniform(F.concat_ws("|", seed, F.lit("part"), part.cast("string"))))

    # Hashed before the sums, which would hash anew at each of their steps.
    numbers = F.transform(F.sequence(F.lit(1), parts), own)
    many = F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + _inverse(rate / parts, x))
    return F.when(rate > PART, many).when(rate > 0, _inverse(rate, uniform)).otherwise(F.lit(0).cast("long"))


def source_rates(docs: DataFrame, *, weights: DataFrame | None = None, source_col: str = "source", size: Column | None = None, factor: float = 1.0) -> DataFrame:
    """(source, rate, docs): mean copies per document so that sources take their target shares, and documents.

    ``weights`` has source and weight (any positive scale); without it a weight is size ** FLATTEN.  Sizes
    are documents, or sums of ``size``.  ``factor`` scales the output against the input.  Null is a
    source of its own; sources without a weight, or of size 0, have rate 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(size if size is not None else F.lit(1.0)), F.lit(0.0)).cast("double").alias("size"), F.count("*").alias("docs"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(FLATTEN)))
    else:
        given = weights.select(F.col("source").alias("weight_of"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("weight_of")), "left").select("source", "size", "docs", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), factor * (F.col("weight") / F.col("all_weight")) * F.col("all_size") / F.col("size")).otherwise(0.0)
    return weighed.crossJoin(F.broadcast(totals)).select("source", rate.alias("rate"), "docs")


def mix(docs: DataFrame, *, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, factor: float = 1.0) -> DataFrame:
    """Replicated and shuffled documents: ``doc`` (all input columns), copy, copies, rate, shuffle_key.

    The result is sorted by (shuffle_key, copy, id).  Equal rows draw equal numbers.  Null ids, texts and
    sources take part like any value; an empty table gives an empty result.
    """
    rates = source_rates(docs, weights=weights, source_col=source_col, size=size, factor=factor)
    sources, copies = rates.agg(F.count("*"), F.coalesce(F.sum(F.col("docs") * F.col("rate")), F.lit(0.0))).first()
    rates = rates.select(F.col("source").alias("rate_of"), "rate")
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    source, doc_id, text = (F.col("doc").getField(c) for c in (source_col, id_col, text_col))
    drawn = (
        packed.join(rates, source.eqNullSafe(F.col("rate_of")))
        .withColumn("draw_key", _text_key(doc_id, text))
        .withColumn("uniform", _uniform(F.col("draw_key")))
        .withColumn("copies", poisson_count(F.col("rate"), F.col("uniform"), F.col("draw_key")))
        .where("copies > 0")
    )
    copied = drawn.select("doc", "rate", "copies", "draw_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    keyed = copied.withColumn("shuffle_key", _hash52(F.concat_ws("|", "draw_key", F.col("copy").cast("string"))))
    # The key is uniform, so its high bits deal the rows evenly and in order: no pass to sample them first.
    parts = max(shuffle_partitions(docs.sparkSession), partitions_for(docs.sparkSession, int(copies), PARTITION_ROWS))
    part = F.floor(F.col("shuffle_key") / F.lit(float(1 << 52)) * parts).cast("int")
    return keyed.select("doc", "copy", "copies", "rate", "shuffle_key").repartitionById(parts, part).sortWithinPartitions("shuffle_key", "copy", F.col("doc").getField(id_col))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as drawn, in shuffled order, with their own columns only.

    Nulls in id, text or source are values like others; repeated rows are drawn alike.  An empty table gives an
    empty result.
    """
    return mix(docs, **how).select("doc.*")


def shares(mixed: DataFrame, source_col: str = "source") -> DataFrame:
    """Documents and share of each source in a mixture, for reports."""
    counts = mixed.groupBy(F.col("doc").getField(source_col).alias("source")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


ORACLE = """
with src as (select source, count(*)::double as size, pow(count(*)::double, 0.5) as weight from documents group by source),
tot as (select sum(size) as all_size, sum(weight) as all_weight from src),
rates as (select source, (weight / all_weight) * all_size / size as rate from src, tot),
keyed as (select d.*, rate, concat_ws('|', 'mix-1', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, ''))) as draw_key
  from documents d join rates on d.source is not distinct from rates.source),
drawn as (select *, cast(('0x' || substr(md5(draw_key), 1, 13)) as bigint) / pow(2.0, 52) as u from keyed),
parts as (select source, cast(greatest(ceil(rate / 500), 1) as bigint) as parts, rate / greatest(ceil(rate / 500), 1) as mean from rates),
cdf as (select source, k, sum(p) over (partition by source order by k) as c from (
  select source, mean, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) as p from (select source, mean, unnest(range(0, cast(ceil(mean + 12 * sqrt(mean) + 41) as bigint))) as k from parts))),
draws as (select d.source, d.draw_key, t.part, case when t.part = 1 then u else cast(('0x' || substr(md5(concat_ws('|', draw_key, 'part', cast(t.part as varchar))), 1, 13)) as bigint) / pow(2.0, 52) end as u
  from (select distinct source, draw_key, u from drawn) d join (select source, unnest(range(1, parts + 1)) as part from parts) t on t.source is not distinct from d.source),
counts as (select source, draw_key, cast(sum((select count(*) from cdf where cdf.source is not distinct from w.source and cdf.c <= w.u)) as bigint) as copies from draws w group by 1, 2),
drawn2 as (select d.doc_id, d.source, d.text, d.rate, d.draw_key, n.copies from drawn d join counts n on n.source is not distinct from d.source and n.draw_key = d.draw_key)
select doc_id, source, text, cast(round(rate, 9) as double) as rate, cast(copies as bigint) as copies, cast(copy as bigint) as copy,
  cast(('0x' || substr(md5(concat_ws('|', draw_key, cast(copy as varchar))), 1, 13)) as bigint) as shuffle_key
from (select *, unnest(range(1, copies + 1)) as copy from drawn2)
"""
