import random

import numpy as np
import pytest

from loomgraph.llm import minhash, neighbors
from loomgraph.llm.components import connected_components
from loomgraph.llm.workspace import Workspace


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and a is not None and b is not None and 100 * len(x & y) >= 75 * len(x | y)]
    return {i: (len(s), g) for (i, s) in sets for g in [groups([i for i, _ in sets if i is not None], links).get(i)]}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, base = [], [[rng.choice(vocab) for _ in range(120)] for _ in range(12)]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 30])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    hub = [rng.choice(vocab) for _ in range(60)]
    for i in range(200, 240):  # one passage in many documents that are otherwise different
        rows.append((i, " ".join(hub + [rng.choice(vocab) for _ in range(80)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_by_brute_force(spark, seed):
    rows = corpus(seed) + [(300, None), (301, ""), (302, "one TWO"), (303, "One two"), (304, "one two three"), (305, " \n "), (None, "one two"), (302, "one TWO")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component_id string, key string")
    got = minhash.near_duplicates(docs).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted({str(r.doc_id) for r in got if r.kept})


def test_a_dense_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "CHUNK", 16)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocab) for _ in range(100)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(1 + i % 6):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: g for i, (_, g) in brute(rows).items()}


def test_the_shuffled_plan_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    expected = brute(rows)
    assert got == {i: g for i, (_, g) in expected.items()}
    assert sorted(r.doc_id for r in minhash.deduplicate(docs).collect()) == sorted(i for i, (_, g) in expected.items() if i == g)


def test_large_components_in_one_list(spark, monkeypatch):
    """Two dense groups and stragglers that share most shingles: large blocks, shared blocks and many askers."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "CHUNK", 5)
    monkeypatch.setattr(minhash, "ASKERS", 3)
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocab) for _ in range(120)]
    other = base[:70] + [rng.choice(vocab) for _ in range(50)]
    rows = []
    for i in range(120):
        words = list(base if i % 2 else other)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 7])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words[: rng.choice([120, 120, 110, 95])])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: g for i, (_, g) in brute(rows).items()}


def test_very_long_texts(spark):
    words = [f"word{i % 90_000}x{i % 7}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:299_000], *[f"new{i}" for i in range(900)]])), (3, "z" * 2_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2][1] == 1 and got[3] == (1, 3) and got[1][0] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    family = minhash.Minima(64, 6)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = x[:3000], x[1000:]
    assert abs((family.of(a) == family.of(b)).mean() - 0.5) < 0.09


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0 == minhash.deduplicate(none).count()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    ids = sorted({x for e in links for x in e})
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    assert {i: found.get(i, i) for i in ids} == groups(ids, links)


def vectors(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(40):
        x[k] = x[0] + rng.normal(size=d) * 0.07
    for k in range(50, 90, 2):
        x[k + 1] = x[k] + rng.normal(size=d) * 0.05 * np.linalg.norm(x[k]) / d**0.5
    x[95] = x[94]
    x[96] = x[94] * 2
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    x = vectors(4)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] + [0.0] * 14, 0), (1004, [float("inf")] * 16, 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (1007, [], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, digest int")
    got = neighbors.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    cos = unit @ unit.T
    links = [(i, j) for i in range(len(x)) for j in range(i) if cos[i, j] >= 0.95]
    total = sum(r.n_links for r in got if r.vec_id is not None and r.vec_id < 1000)
    assert total <= 2 * len(links) and total >= 0.9 * 2 * len(links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(x))
    truth = groups(range(len(x)), links)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        elif r.vec_id < 1000:
            assert r.n_links <= degree[r.vec_id] and truth[r.component_id] == truth[r.vec_id]
        elif r.vec_id in (1005, 1006):
            assert (r.n_links, r.component_id) == (1, 1005)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert neighbors.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_at_two_sizes(spark, monkeypatch, n):
    """Links found among all links of brute force, with lists that are split by second pivots."""
    monkeypatch.setattr(neighbors, "BLOCK", 128)
    monkeypatch.setattr(neighbors, "SPLIT", 1)
    if n == 1500:
        monkeypatch.setattr(neighbors, "BROADCAST_LISTS", 0)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24))
    for k in range(0, n // 2, 5):  # groups of near copies, and one large group
        x[k + 1 : k + 4] = x[k] + rng.normal(size=(3, 24)) * 0.16
    x[n - n // 6 :] = x[0] + rng.normal(size=(n // 6, 24)) * 0.12
    x = x.astype(np.float32)
    got = neighbors.near_duplicates(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    degree = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])
    assert (found <= degree).all() and found.sum() >= 0.98 * degree.sum() > 0


def test_vectors_without_ids_still_choose_pivots(spark):
    x = vectors(9)
    rows = [(None, [float(v) for v in row]) for row in x] + [(i, [float(v) for v in x[i]]) for i in range(40)]
    got = neighbors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert all((r.n_links, r.component_id, r.kept) == (0, None, True) for r in got if r.vec_id is None)
    assert any(r.n_links for r in got if r.vec_id is not None)


def test_forest_keeps_connectivity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 12
        m = rng.random((n, n)) < 0.12
        m |= m.T
        np.fill_diagonal(m, False)
        expected = groups(range(n), [(int(a), int(b)) for a, b in zip(*np.nonzero(m), strict=True)])
        assert neighbors._forest(m).tolist() == [expected[i] for i in range(n)]


def test_keys_of_representatives_are_not_shuffled(spark):
    """Whatever Spark's own limit of broadcasts is: ids are few enough here."""
    from loomgraph.llm import minhash

    described = spark.createDataFrame([(1, b"x", [5, 6]), (2, b"x", [5, 6]), (3, b"y", [6, 7]), (4, None, None)], "doc_id long, digest binary, keys array<long>")
    equal = spark.createDataFrame([(b"x", 1, 2), (b"y", 3, 1)], "digest binary, rep long, copies long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash._buckets(described, equal)
        assert sorted(map(tuple, got.collect())) == [(1, 5), (1, 6), (3, 6), (3, 7)]
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
