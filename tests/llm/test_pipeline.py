import hashlib
import math
import random
import zlib

import corpus_pipeline
from loomgraph.llm import langid, mixing, packing, quality, tokens

from test_near_duplicates import brute
from test_quality_and_language import plain, plain_em


def corpus():
    rng = random.Random(1)
    syllables = {"xx": ["lo", "mi", "nar", "teo"], "yy": ["grk", "sht", "pfl", "tzk"]}
    rows = []
    for i in range(120):
        lang = "xx" if i % 2 else "yy"
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 150))]
        rows.append((i, " ".join(words), lang, f"s{i % 3 and 1}"))
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "s1") for i in range(10)]
    rows += [(300, "### " * 90, "xx", "s0"), (301, None, "xx", "s0"), (302, "12345 67890 " * 40, None, "s0"), (5, rows[5][1], "xx", "s1"), (None, rows[7][1] + " no id", "xx", None)]
    return [(*r, len(r[1] or "")) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def poisson(rate, u):
    """Smallest k with u < P(X <= k)."""
    k, total = 0, math.exp(-rate)
    while u >= total:
        k += 1
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    return k


def plain_pipeline(rows, model):
    """The five stages over a list of rows, one document after another; gives the pieces of all copies."""
    from tokenizers import Tokenizer

    votes = [[r.vote(quality.measure(t)) for r in quality.RULES] for _, t, *_ in rows]
    good = []
    for row, p in zip(rows, plain_em(votes), strict=True):
        n = plain(row[1])
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and p >= 0.5:
            good.append(row)
    named = [r for r in good if model.accepts(*model.predict(r[1]))]
    groups = brute([(r[0], r[1]) for r in named])
    seen, kept = set(), []
    for r in named:
        if r[0] is None or (groups[r[0]][1] == r[0] and r[0] not in seen):
            seen.add(r[0])
            kept.append(r)
    sizes = {}
    for r in kept:
        sizes[r[3]] = sizes.get(r[3], 0) + 1
    weights = {s: n**0.5 for s, n in sizes.items()}
    out, tokenizer = [], Tokenizer.from_file(tokens.tokenizer_path(packing.TOKENIZER))
    for doc_id, text, _, source, _ in kept:
        rate = weights[source] / sum(weights.values()) * len(kept) / sizes[source]
        key = f"{mixing.SEED}|{'' if doc_id is None else doc_id}|{hashlib.md5(text.encode()).hexdigest()}"
        copies = poisson(rate, int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52)
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for _ in range(copies):
            for k, a in enumerate(range(0, len(ids), 2048)):
                part = ids[a : a + 2048]
                out.append((doc_id, k, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return out


def test_run_as_by_a_plain_program(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(quality.keep_good(docs))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = plain_pipeline(rows, model)
    assert expected and sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(by) <= math.ceil(sum(r.length for r in got) / packing.CAPACITY * 1.1) + 1


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.createDataFrame([r for r in corpus() if r[0] is not None], SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = at
        at = stage(spark, before, str(tmp_path))
        if k < 4:
            assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids = sorted(r.doc_id for r in at.collect())
        if k == 0:
            kept = {r.doc_id for r in quality.measures(before).collect() if r.kept}
            assert set(ids) == kept and {*range(120)} <= kept and not kept & {300, 301}
        if k == 1:
            model = langid.fit(before)
            assert set(ids) == {r.doc_id for r in before.collect() if model.accepts(*model.predict(r.text))}
        if k == 2:
            assert ids == list(range(120))
        if k == 3:
            expected = mixing.mix(before)
            assert ids == sorted(r.doc.doc_id for r in expected.collect())
        if k == 4:
            assert at.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= packing.CAPACITY
            assert set(ids) == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(at)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    clash = SCHEMA + ", component_id string, kept string, copies int, copy int, rate double, sequence_id string, offset string, near_duplicate_id long, count int, doc string, votes int, quality double, lang_pred string, accepted boolean"
    extra = ("c", "k", 1, 2, 0.5, "s", "o", 7, 3, "d", 4, 0.1, "l", False)
    for name, rows in (("none", []), ("all", [(*r, *extra) for r in corpus()])):
        docs = spark.createDataFrame(rows, clash)
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        at = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, str(tmp_path / name))
            if k < 4:
                assert at.columns == docs.columns
            at.write.parquet(str(tmp_path / name / f"out{k}"))
            at = spark.read.schema(at.schema).parquet(str(tmp_path / name / f"out{k}"))
        assert (at.count() == 0) == (not rows)
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == at.count()
