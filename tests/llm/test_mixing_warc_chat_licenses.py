import base64
import hashlib
import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, entries, licenses, mixing, warc
from loomgraph.llm.workspace import Workspace


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    out = con.sql(sql)
    left, right = sorted(df.columns), sorted(out.columns)
    assert left == right
    rows = lambda names, got: sorted(repr([r[names.index(c)] for c in left]) for r in got)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(out.columns, out.fetchall())


def test_poisson_counts_follow_the_distribution(spark):
    u = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"))
    for rate in (0.3, 2.5, 40.0, 700.0):
        n = u.select(mixing.poisson_count(F.lit(rate), F.col("u")).alias("k"))
        mean, var = n.agg(F.avg("k"), F.var_pop("k")).first()
        assert abs(mean - rate) < 0.02 * rate + 0.01
        assert abs(var - rate) < 0.05 * rate + 0.01
    k = spark.range(1).select(mixing.poisson_count(F.lit(1.0), F.lit(math.exp(-1) - 1e-9)).alias("a"), mixing.poisson_count(F.lit(1.0), F.lit(math.exp(-1) + 1e-9)).alias("b"), mixing.poisson_count(F.lit(0.0), F.lit(0.9)).alias("c")).first()
    assert tuple(k) == (0, 1, 0)


def test_large_poisson_counts_follow_the_distribution(spark):
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    for rate in (501.0, 1400.0):
        mean, var = u.select(mixing.poisson_count(F.lit(rate), F.col("u")).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
        assert abs(mean - rate) < 0.01 * rate
        assert abs(var - rate) < 0.15 * rate


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rows = [(i, f"text {i}", None, "big" if i % 10 else "small" if i % 20 else None, i) for i in range(800)] + [(None, None, None, None, None), (3, "text 3", None, "big", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("x"))


def test_mixture_and_its_sql(spark, mixed_docs):
    docs = mixed_docs.drop("copies")
    got = mixing.mix(docs).select("doc.doc_id", "doc.source", "doc.text", F.round("rate", 9).alias("rate"), "copies", "copy", "shuffle_key")
    same(got, mixing.ORACLE, documents=docs)
    keys = [r.shuffle_key for r in got.collect()]
    assert keys == sorted(keys)
    assert mixing.mix_documents(mixed_docs).columns == mixed_docs.columns
    assert mixing.mix(docs.where("false")).count() == 0


def test_large_rates_and_many_sources(spark, monkeypatch):
    """A rate over two draws' means, and the plan that joins sources by a shuffle."""
    rows = [(0, "only one", "rare")] + [(i, f"text {i}", "big") for i in range(1, 1201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("rare", 1.0), ("big", 1.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights=weights, factor=2.0)
    (copies,) = {r.copies for r in mixed.where("doc.source = 'rare'").collect()}
    assert abs(copies - 1201) < 6 * 1201**0.5
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    key = lambda df: sorted((r.doc.doc_id, r.copy, r.shuffle_key) for r in df.collect())
    assert key(mixing.mix(docs, weights=weights, factor=2.0)) == key(mixed)
    sql = mixing.ORACLE.replace("pow(count(*)::double, 0.5) as weight", "1.0 as weight").replace("(weight / all_weight) * all_size", "2.0 * (weight / all_weight) * all_size")
    same(mixed.select("doc.doc_id", "doc.source", "doc.text", F.round("rate", 9).alias("rate"), "copies", "copy", "shuffle_key"), sql, documents=docs)


def test_given_weights(spark, mixed_docs):
    weights = spark.createDataFrame([("small", 3.0), ("big", 1.0)], "source string, weight double")
    mixed = mixing.mix(mixed_docs, weights=weights, factor=4.0)
    n = {r.source: r.n for r in mixing.shares(mixed).collect()}
    assert None not in n and abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.04


def test_rotation_and_its_sql(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    monkeypatch.setattr(chat, "RANGE", 4)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Ann", None, " "]), rng.choice(["hi", "", None, "a\nb", "é"]), "x") for c in (1, 2, None) for t in [*range(11), None, 4]]
    rows += [rows[0], (5, 0, "user", "alone", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    got = chat.rotate(turns)
    same(got, chat.ORACLE, conversations=turns)
    for (_, _), part in got.toPandas().groupby(["conv_id", "perspective"], dropna=False):
        part = part.sort_values("position")
        whole = "".join(part.segment)
        for r in part.itertuples():
            assert whole[r.seg_start : r.seg_end] == r.segment
            if r.trained:
                assert whole[int(r.target_start) : int(r.target_end)].endswith("<|end|>\n") and r.speaker == r.perspective
    assert chat.rotate(turns.where("false")).count() == 0


def test_licenses_and_their_sql(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.replace("sublicense", "sub-license").upper()
    rows = [(1, mit), (2, licenses.BSD_HEAD + licenses.BSD_TAIL), (3, "Text.\nLicensed under the Apache Licence, Version 2.0.\nmore"), (4, None), (5, ""), (6, licenses.MIT + " more"), (7, "released under the mit license"), (7, "released under the mit license"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, license_id string, digest string")
    got = licenses.scan(docs)
    found = {r.doc_id: (r.license_id, r.notices) for r in got.collect()}
    assert found == {1: ("MIT", ""), 2: ("BSD-2-Clause", ""), 3: (None, "Apache-2.0"), 4: (None, ""), 5: (None, ""), 6: (None, ""), 7: ("MIT", "MIT"), None: (None, "")}
    alone = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates()
    same(licenses.scan(alone), licenses.oracle(), documents=alone)
    assert licenses.scan(docs.where("false")).count() == 0


LONG = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not (LONG / "Apache-2.0").exists(), reason="no licence texts here")
def test_whole_texts_of_long_licenses(spark):
    ids = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl"}
    whole = {spdx: (LONG / name).read_text() for name, spdx in ids.items() if (LONG / name).exists()}
    rows = [(i, t.upper().replace("LICENSE", "Licence") if i % 2 else "\n".join(" ".join(x.split()) for x in t.splitlines()), spdx) for i, (spdx, t) in enumerate(whole.items()) if i % 2 or spdx not in ("Apache-2.0",)]
    rows += [(100, licenses.UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>", "Unlicense"), (101, licenses.BOOST, "BSL-1.0"), (102, next(iter(whole.values()))[:-40], None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(docs).collect()} == {i: spdx for i, _, spdx in rows}
    same(licenses.scan(docs), licenses.oracle(), documents=docs)


def test_licenses_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_KNOWN", 0)
    docs = spark.createDataFrame([(1, "my own terms"), (2, "Released under CC0 1.0"), (2, "Released under CC0 1.0"), (None, licenses.MIT)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.license_id, r.notices) for r in licenses.scan(docs, texts=[("own", "My own, terms!")]).collect())
    assert got == [("1", "own", ""), ("2", "CC0-1.0", "CC0-1.0"), ("2", "CC0-1.0", "CC0-1.0"), ("None", "MIT", "")]


def test_notices_in_any_spacing(spark):
    lines = ["Released  under CC BY 4.0.", "Released\tunder CC0 1.0", "* Released-under: CC BY-SA 4.0 *", "released under MIT Licence", "released"]
    docs = spark.createDataFrame(list(enumerate(f"a\n{x}\nb" for x in lines)), "doc_id long, text string")
    assert {r.doc_id: r.notices for r in licenses.scan(docs).collect()} == {0: "CC-BY-4.0", 1: "CC0-1.0", 2: "CC-BY-SA-4.0", 3: "MIT", 4: ""}
    kept = spark.createDataFrame(licenses._notices(), "spdx string, t string").select(licenses.canonical(F.col("t")).alias("t"))
    assert kept.where("not (contains(t, 'licen') or contains(t, 'released'))").count() == 0


def test_archives_round_trip(spark):
    rows = [(5, "http://www.B.example/x?q=1#f", "same é"), (2, "https://b.example:80/x", "same é"), (9, "http://a.example", None), (4, None, ""), (7, "bad url\r\nWARC-Type: x", "a\r\n\r\nWARC/1.1\r\n"), (None, "http://a.example/n", "same é"), (8, "http://c.example", "z" * 100_000), (5, "http://d.example", "other")]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.archive_pages(pages).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    expected = []
    for i, _, h in rows:
        first = min((p for p, _, x in rows if p is not None and (x or "") == (h or "")), default=i)
        revisit = i is not None and first < i
        expected.append(str((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", first if revisit else None)))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(expected)
    order = [(r.url_key, r.captured_at, r.page_id if r.page_id is not None else -1) for r in sorted(got, key=lambda r: (r.merge_range, r.merge_pos))]
    assert order == sorted(order)
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_small_archives_and_the_shuffled_plan_give_the_same(spark, monkeypatch, tmp_path):
    """A frequent payload, archives that roll over, and lookups by a shuffle instead of a broadcast."""
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 7}.example/{i}", "the same page" if i % 3 else f"page {i} " + "x" * rng.randint(0, 400)) for i in range(400)] + [(400, None, "é" * 3000), (401, "http://x", None), (402, "http://y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    # The number of archives is drawn from the tasks, so only what does not name them is compared.
    key = lambda: sorted(tuple(r)[:7] for r in warc.archive_pages(pages).collect())
    plain = key()
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    assert key() == plain
    work = Workspace(spark, "roll")
    path = warc.write_archives(warc._rows(pages, "page_id", "url", "html"), work, roll_bytes=4000)
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert len(sizes) > 10 and max(sizes) < 4000 + 7000  # at most one record over the limit
    read = warc.read_archives(spark, path).collect()
    assert sorted(r.page_id for r in read) == sorted(r[0] for r in rows)
    assert len({r.archive for r in read}) == len(sizes)


def test_very_long_texts(spark):
    long = "é" * 1_500_000
    turns = spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", "x")], "conv_id long, turn long, role string, text string")
    assert max(r.seg_end for r in chat.rotate(turns).collect()) > 1_500_000
    docs = spark.createDataFrame([(1, "line\n" * 300_000 + "Released under CC0 1.0\n"), (2, "x" * 3_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.notices for r in licenses.scan(docs).collect()} == {1: "CC0-1.0", 2: ""}
    pages = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long)], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in warc.archive_pages(pages).collect()} == {(1, 3_000_000, None), (2, 3_000_000, 1)}


def test_index_in_many_ranges(spark):
    rows = [(f"run{i % 5}", i, i % 97, "response", None, f"host{(i % 3) * (i % 7)}", f"{i % 11:014d}") for i in range(3000)]
    records = spark.createDataFrame(rows, "archive string, record_offset long, page_id long, record_type string, refers_to long, url_key string, captured_at string").repartition(5, "archive")
    got = warc.merge_index(records, Workspace(spark, "t"), range_rows=100).collect()
    assert len({r.merge_range for r in got}) > 15 and len(got) == 3000
    order = [tuple(r)[:5] for r in sorted(got, key=lambda r: (r.merge_range, r.merge_pos))]
    assert order == sorted(order)


def test_index_of_many_more_archives_than_cores(spark):
    rows = [(f"run{i % 40:02d}", i, i % 97, "response", None, f"host{(i % 3) * (i % 7)}", f"{i % 11:014d}") for i in range(4000)]
    schema = "archive string, record_offset long, page_id long, record_type string, refers_to long, url_key string, captured_at string"
    records = spark.createDataFrame(rows, schema).repartitionByRange(40, "archive")
    got = warc.merge_index(records, Workspace(spark, "many"), range_rows=200).collect()
    assert len(got) == 4000 and len({r.merge_range for r in got}) > 10
    order = [tuple(r)[:5] for r in sorted(got, key=lambda r: (r.merge_range, r.merge_pos))]
    assert order == sorted(order)


@pytest.mark.parametrize("seed", range(5))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 9))]
    assert list(warc.LoserTree([iter(r) for r in runs])) == warc.merge_sorted(runs)


def test_records_are_read_by_length():
    data = b"".join((warc._record(1, "http://x", p, warc.payload_digest(p), None) + warc.BETWEEN).encode() for p in (b"", b"a\r\n\r\nb"))
    assert [block for _, _, block in warc.parse_archive(data)] == [b"", b"a\r\n\r\nb"]
    with pytest.raises(ValueError):
        list(warc.parse_archive(data[:-2]))


def test_every_operator_has_a_query():
    names = entries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert set(entries.oracle_sql()) <= set(names)
