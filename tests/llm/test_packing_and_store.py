import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing, tokens, tokenstore
from loomgraph.llm.workspace import Workspace

from run_length_plan import supersteps

TEXTS = [(1, "Hello, it's a test.\nNew  line"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (5, "é über\tcafé"), (None, "no id"), (6, "x" * 20000), (7, " lead and trail "), (8, "a <|endoftext|> b"), (9, "x<|EndOfText|>y <|startoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", "b", "c") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id string, start string").repartition(3)


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cut_texts_have_the_ids_of_whole_texts(name):
    from tokenizers import Tokenizer

    e, plain = tokens.TextEncoder(tokens.tokenizer_path(name)), Tokenizer.from_file(tokens.tokenizer_path(name))
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Ab", "é", "é", "ß", "1", ".", ",", "'s", "!!", " ", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "日本", "Σ", "İ", " ", "\x1c", "\x85", "µ", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert e.ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_covers_every_id_without_gaps(docs):
    rows = packing.pack_documents(docs).collect()
    expected = []
    for i, t in TEXTS:
        ids = ids_of(packing.TOKENIZER, t)
        expected += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, free in enumerate(bins) if free >= n]
        if fit:
            k = min(fit, key=lambda k: bins[k])
            bins[k] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_supersteps_place_each_rank_once_and_need_few_sequences(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = supersteps(counts, 64)
    taken = set()
    for n, c in counts.items():
        sequence, offset = plan.place(n, np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            cells = {(s, x) for x in range(o, o + n)}
            assert o + n <= 64 and not cells & taken
            taken |= cells
    assert plan.sequences <= first_fit_decreasing(lengths, 64) + 1
    assert {s for s, _ in taken} == set(range(plan.sequences))


def best_fit_brackets(is_gap, slots):
    """The sweep's rule, entry by entry: a gap takes the largest free pieces before it."""
    free, matched = [], []
    for k, gap in enumerate(is_gap):
        if not gap:
            free.append(k)
        else:
            for _ in range(min(slots[k], len(free))):
                matched.append((free.pop(), k))
    return matched, free


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 3)), max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_sweeps_of_ranges_and_their_carry_are_one_sweep(entries, cuts):
    is_gap, slots = [int(g) for g, _ in entries], [n for _, n in entries]
    matched, free = best_fit_brackets(is_gap, slots)
    p, g, rest, _ = packing.sweep(is_gap, slots)
    assert sorted(zip(p, g, strict=True)) == sorted(matched) and rest == free
    ends = sorted({0, len(entries), *[min(c, len(entries)) for c in cuts]})
    found, pieces, gaps, left = [], {}, {}, []
    for part, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        p, g, rest, spare = packing.sweep(is_gap[a:b], slots[a:b])
        found += [(x + a, y + a) for x, y in zip(p, g, strict=True)]
        pieces[part] = [x + a for x in rest]
        gaps[part] = [k + a for k, n in spare for _ in range(n)]
        left.append((part, len(gaps[part]), len(rest)))
    links, stay = packing.carry(left)
    assert len(links) <= 2 * len(left)
    for of, lo, hi, part, at in links:
        found += [(pieces[of][hi - 1 - k], gaps[part][at + k]) for k in range(hi - lo)]
    assert sorted(found) == sorted(matched)
    assert [x for part, n in sorted(stay.items()) for x in pieces[part][:n]] == free


def check_places(rows, capacity):
    by = {}
    for n, sequence, offset in rows:
        by.setdefault(sequence, []).append((offset, n))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    return by


@pytest.mark.parametrize("capacity", [64, 2048])
@settings(max_examples=30, deadline=None)
@given(data=st.data())
def test_one_range_places_all_in_few_sequences(capacity, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, capacity - 1), max_size=200)), dtype=np.int64)
    ids = np.arange(lengths.size)
    none = np.empty(0, dtype=np.int64)
    piece, sequence, offset = packing.finish(ids, lengths, none, none, capacity)
    assert sorted(piece.tolist()) == ids.tolist()
    by = check_places(zip(lengths[piece].tolist(), sequence.tolist(), offset.tolist(), strict=True), capacity)
    assert len(by) <= 1.02 * first_fit_decreasing(lengths.tolist(), capacity) + 2


@pytest.mark.parametrize("kind", ["lognormal", "tiny", "half", "ties"])
def test_many_ranges_give_what_one_range_gives(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    lengths = {"lognormal": np.clip(rng.lognormal(6.3, 1, 1200), 1, 2048), "tiny": np.clip(rng.lognormal(2, 1, 2000), 1, 2048), "half": rng.integers(700, 1300, 1200), "ties": rng.choice([2048, 1024, 512, 300, 1], 1500)}[kind].astype(int).tolist()
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "size_of long, length int").repartition(5)
    whole = packing.pack(rows, Workspace(spark, "one")).collect()
    monkeypatch.setattr(packing, "RANGE_ROWS", {"tiny": 1500, "lognormal": 800}.get(kind, 400))
    parts = packing.pack(rows, Workspace(spark, "many")).collect()
    assert sorted(r.size_of for r in parts) == list(range(len(lengths)))
    one, many = (check_places([(r.length, r.sequence_id, r.offset) for r in got], 2048) for got in (whole, parts))
    assert sorted(sorted(x) for x in one.values()) == sorted(sorted(x) for x in many.values())
    # The best-fit bound of a sequential pass, and the ids themselves.
    assert len(many) <= 1.01 * first_fit_decreasing(lengths, 2048) + 1
    assert len(many) <= 1.01 * supersteps({n: lengths.count(n) for n in set(lengths)}, 2048).sequences + 1


def test_lengths_out_of_bounds_are_refused(spark):
    for wrong in (0, 2049, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 5), (2, wrong)], "i long, length int"), Workspace(spark, "wrong"))


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert packing.pack_documents(none).count() == 0
    assert tokenstore.store_documents(none).count() == 0


def test_store_round_trip(spark, docs):
    work = Workspace(spark, "test")
    store = tokenstore.write_store(docs, work)
    rows = sorted(tokenstore.read_digests(spark, store).collect(), key=lambda r: r.start)
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for r, (i, _) in zip(rows, order, strict=True):
        assert (r.doc_id, r.start) == (i, start)
        start += r.n_tokens
    expected = sorted((str(i), len(x := ids_of(tokenstore.TOKENIZER, t)), zlib.crc32(x)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == expected
    whole = sorted((str(r.doc_id), list(r.ids)) for r in tokenstore.read_ids(spark, store).collect())
    assert whole == sorted((str(i), ids_of(tokenstore.TOKENIZER, t).tolist()) for i, t in TEXTS)
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_damage_is_found(spark, docs, tmp_path):
    work = Workspace(spark, "test")
    store = tokenstore.write_store(docs, work)
    recipes = spark.read.parquet(f"{store}/recipes").collect()
    bad = spark.createDataFrame([r.asDict() | {"root": bytearray(16)} for r in recipes], spark.read.parquet(f"{store}/recipes").schema)
    work.drop("store/recipes")
    bad.write.parquet(f"{store}/recipes")
    with pytest.raises(ValueError):
        tokenstore.read_digests(spark, store)


def plain_cuts(ids):
    """Cut points id by id, with every window hashed on its own."""
    multiplier, mask = int(tokenstore._MULTIPLIER), (1 << 64) - 1
    mixed = [((int(x) + 1) * multiplier & mask) for x in ids]
    mixed = [x ^ (x >> 29) for x in mixed]
    ends, last = [], 0
    for c in range(1, len(ids) + 1):
        if c - last > tokenstore.MOST:
            last += tokenstore.MOST
            ends.append(last)
        window = mixed[max(0, c - tokenstore.WINDOW) : c]
        rolled = sum(x * pow(multiplier, k, 1 << 64) for k, x in enumerate(reversed(window))) & mask
        if c - last >= tokenstore.LEAST and c < len(ids) and rolled >> (64 - tokenstore.CUT_BITS) == 0:
            ends.append(c)
            last = c
    return [*ends, len(ids)] if len(ids) else []


def test_cuts_of_many_streams():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 50_000, n).astype("<u2") for n in (0, 1, 63, 64, 65, 900, 5000, 0, 3)] + [np.zeros(9000, dtype="<u2")]
    assert tokenstore.cut_all(streams) == [tokenstore.cut_points(x) for x in streams] == [plain_cuts(x) for x in streams]
    assert tokenstore.cut_all([]) == []


@given(st.lists(st.integers(0, 50_000), max_size=3000), st.integers(0, 5))
@settings(max_examples=30, deadline=None)
def test_cuts_and_checksums(ids, k):
    x = np.array(ids, dtype="<u2")
    ends = tokenstore.cut_points(x)
    sizes = np.diff([0, *ends])
    assert (ends[-1] if ends else 0) == x.size and (sizes[:-1] >= tokenstore.LEAST).all() and (sizes <= tokenstore.MOST).all()
    crc, after, at = 0, [], 0
    for end in ends:
        after.append((zlib.crc32(x[at:end].astype("<u4")), (x.size - end) * 4))
        at = end
    if after:
        for one in tokenstore.shift_crc(np.array([c for c, _ in after], dtype=np.int64), np.array([a for _, a in after])):
            crc ^= int(one)
    assert crc == zlib.crc32(x.astype("<u4"))
