import collections
import random
import re
import string
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import langid, quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n = collections.Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if n[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\t|é \x0b", max_size=60))
def test_measures(text):
    assert tuple(quality.measure(text))[:5] == plain(text)


GOOD = " ".join(f"word{i} and thing{i * 7}" for i in range(60))
JUNK = " ".join(f"w{i}###" for i in range(80))
LOUD = " ".join(f"SHOUT{i}!!" for i in range(80))


def test_junk_goes_and_clean_documents_stay(spark):
    rows = [(i, GOOD.replace("word", f"w{i}x"), "x") for i in range(60)] + [(100 + i, JUNK + str(i), "x") for i in range(6)] + [(200 + i, LOUD + str(i), "x") for i in range(6)]
    rows += [(300, None, "x"), (301, "", "x"), (302, "too short", "x"), (302, "too short", "x"), (None, GOOD, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality.measures(docs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {*range(60), None}
    for r in got:
        if r.doc_id in (300, 301, 302):
            assert r.base_failed and not r.kept
    stayed = quality.keep_good(docs)
    assert stayed.columns == docs.columns and stayed.count() == 61
    assert quality.measures(docs.where("false")).count() == 0 == quality.keep_good(docs.where("false")).count()


def test_votes_round_trip():
    import numpy as np

    m = quality.measure(JUNK)
    votes = quality.votes_of(np.array([quality.pattern(m)]), len(quality.RULES))[0]
    assert votes.tolist() == [r.vote(m) for r in quality.RULES]


def corpus():
    words = {"xx": "lo mi nar teo sul".split(), "yy": "grk sht pfl tzk bru".split()}
    out = []
    for i in range(300):
        lang = "xx" if i % 2 else "yy"
        w = words[lang]
        out.append((i, " ".join(w[(i * 7 + k * k) % 5] for k in range(5 + i % 40)) + ".", lang))
    return out


def test_language_of_held_out_documents(spark):
    rows = corpus() + [(1000, None, "xx"), (1001, "", None), (1002, "123 !!", None), (1003, "lo " * 50_000, None), (None, "grk sht", "yy"), (3, "mi nar", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as score", "1 as held_out")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in corpus()}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.accepted) == ("und", False)
        if r.doc_id == 1003:
            assert r.lang_pred == "xx"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got} - {1000, 1001, 1002}
    assert langid.identify(docs.where("false")).count() == 0
    nobody = langid.identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in nobody.collect()} == {"und"}


def test_unlearned_languages_and_random_letters_are_rejected(spark):
    rng = random.Random(5)
    letters = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (8, 20, 60, 200) for _ in range(10)]
    unlearned = ["wod vek paj hud quc " * 6, "Все люди рождаются свободными и равными", "人人生而自由,在尊严和权利上一律平等", "def run(batches): for batch in batches: found"]
    rows = corpus() + [(2000 + i, t, None) for i, t in enumerate(letters + unlearned)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train([(t, lang) for _, t, lang in corpus()]).threshold > 0.5
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == set(range(300))


def test_rare_labels_are_in_the_sample(spark):
    spoken = "lo mi nar teo sul", "grk sht pfl tzk bru", "wod vek paj hud quc"
    lang = lambda i: 2 if i % 4000 == 1 else i % 2
    rows = spark.range(60_000).selectExpr("cast(id as string) as i", "id").rdd.map(lambda r: (r.i, spoken[lang(r.id)], "xyz"[lang(r.id)])).toDF("i string, t string, l string")
    n = collections.Counter(lang for _, lang in langid.sample(rows))
    assert n["z"] == 15 and n["x"] + n["y"] + n["z"] == langid.SAMPLE and abs(n["x"] - n["y"]) <= 1
    model = langid.train(langid.sample(rows.limit(9000)))
    assert model.predict("vek hud paj quc wod")[0] == "z"


def test_model_is_the_same_each_time():
    rows = [(t, lang) for _, t, lang in corpus()]
    a, b = langid.train(rows), langid.train(rows)
    assert (a.scores == b.scores).all() and a.temperature == b.temperature


def test_long_texts_are_read_in_parts_without_a_difference():
    import numpy as np

    text = ("abc défg " * 300_000)[: (1 << 20) + 500_001]
    old = langid._CHUNK
    whole = np.sort(np.concatenate([*langid.subwords(text)]))
    langid._CHUNK = 1000
    try:
        parts = np.sort(np.concatenate([*langid.subwords(text)]))
    finally:
        langid._CHUNK = old
    assert whole.size == parts.size and (whole == parts).all()


def plain_em(votes):
    """Expectation-maximisation document by document, as the model is written down: no patterns, no arrays."""
    import math

    k = len(votes[0])
    prior, sens, spec = 0.8, [0.3] * k, [0.99] * k
    for _ in range(200):
        post = []
        for v in votes:
            good = sum(math.log(spec[j]) if v[j] > 0 else math.log(1 - spec[j]) if v[j] < 0 else 0 for j in range(k))
            bad = sum(math.log(sens[j]) if v[j] < 0 else math.log(1 - sens[j]) if v[j] > 0 else 0 for j in range(k))
            post.append(1 / (1 + math.exp(min(500, max(-500, bad - good - math.log(prior / (1 - prior)))))))
        clip = lambda x, a, b: min(b, max(a, x))
        spec = [clip((sum(p for p, v in zip(post, votes, strict=True) if v[j] > 0) + 99) / (sum(p for p, v in zip(post, votes, strict=True) if v[j]) + 100), 0.95, 0.9999) for j in range(k)]
        sens = [clip((sum(1 - p for p, v in zip(post, votes, strict=True) if v[j] < 0) + 3) / (sum(1 - p for p, v in zip(post, votes, strict=True) if v[j]) + 10), 0.1, 0.99) for j in range(k)]
        prior = clip((sum(post) + 8) / (len(votes) + 10), 0.05, 0.95)
    return post


def test_posteriors_as_by_a_plain_program(spark):
    rng = random.Random(8)
    texts = [rng.choice([GOOD, JUNK, LOUD, "short and sweet", "line again\n" * 30, "a b c " * 40]) + f" {i}" * rng.randint(0, 3) for i in range(90)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.measures(docs).collect()}
    votes = [[r.vote(quality.measure(t)) for r in quality.RULES] for t in texts]
    for i, p in enumerate(plain_em(votes)):
        n = plain(texts[i])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert got[i].base_failed == failed and abs(got[i].quality - p) < 1e-6
        assert got[i].kept == (not failed and p >= quality.KEEP_FROM)


def test_a_posterior_at_the_bound_is_kept(spark):
    docs = spark.createDataFrame([(1, GOOD, "x"), (2, JUNK, "y")], "doc_id long, text string, quality string")
    found = {r.doc.doc_id: r.quality for r in quality.score(docs).collect()}
    at = {r.doc.doc_id: r.kept for r in quality.score(docs, keep_from=found[1]).collect()}
    assert at[1] and not {r.doc.doc_id: r.kept for r in quality.score(docs, keep_from=found[1] + 1e-9).collect()}[1]


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 50_000}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, "x" * 3_000_000), (3, "\n" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.measures(docs).collect()}
    assert got[1].n_words == 400_000 and got[1].n_repeat_words == 400_000 and got[2].n_words == 1 and got[3].n_words == 0


def plain_logits(model, text):
    """Mean of the scores of each word's pieces, word by word."""
    import numpy as np

    total, n = np.zeros(len(model.languages)), 0
    for word in text.lower().encode().translate(langid._BLANKED).split():
        padded = b" " + word + b" "
        for size in (2, 3, 4):
            for i in range(len(padded) - size + 1):
                key = int.from_bytes(padded[i : i + size], "little")
                h = (key * int(langid._KEYS[size]) & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)
                total += model.scores[h]
                n += 1
    return total / max(n, 1) + model.bias


def test_predictions_as_by_a_plain_program():
    import numpy as np

    model = langid.train([(t, lang) for _, t, lang in corpus()])
    for text in ["lo mi", "GRK, sht! 12 pfl", "a", "é lo teo ü", "x y z grk", " lo  mi\tnar\n"]:
        assert np.allclose(model.logits(text), plain_logits(model, text), atol=1e-4), text


def test_rows_without_ids_train_the_model(spark):
    rows = [(None, t, lang) for _, t, lang in corpus()] * 20 + [(None, "vek hud paj", "zz")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    model = langid.fit(docs)
    assert model.languages == ["xx", "yy", "zz"] and model.predict("teo nar mi lo")[0] == "xx"
