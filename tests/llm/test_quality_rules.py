from collections import Counter

from helpers import TEXTS, TWINS, WORDS, frame, keyed, real

from motes.llm.quality_rules import fit, judged


def plain(doc_id, text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), failed


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark):
    assert keyed(judged(frame(spark)).select(COLUMNS).collect()) == keyed(plain(*r) for r in TEXTS)
    docs = real(spark)
    assert keyed(judged(docs).select(COLUMNS).collect()) == keyed(plain(r.doc_id, r.text) for r in docs.collect())


def test_sequences_that_a_product_hash_confuses(spark):
    assert keyed(judged(frame(spark, TWINS)).select(COLUMNS).collect()) == keyed(plain(*r) for r in TWINS)


def test_words_under_one_hash_are_told_apart():
    import numpy as np

    from motes.llm.textops import interned

    raw = np.frombuffer(b"aabbaacc", np.uint8)
    at = np.arange(0, 8, 2)
    assert interned(raw, at, at + 2, np.zeros(4, np.uint64)).tolist() == [0, 1, 0, 2]


def test_verdict_follows_base_and_posterior(spark):
    for r in judged(real(spark, "0.01")).collect():
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_agrees_with_labels(spark):
    docs = real(spark, "0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = judged(docs).join(labels, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.94
    assert sum(bad) / len(bad) < 0.05


def test_em_recovers_accuracies():
    import random

    rng = random.Random(7)
    votes = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes[tuple((1 if good else -1) * (1 if rng.random() < p else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.8, 0.6))] += 1
    prior, weights = fit(sorted(votes.items()), 3, 500)
    assert 0.4 < prior < 1.3
    assert weights[0][1] > weights[1][1] > weights[2][1] > 0
    assert fit([], 3)[0] == 0.0


def test_empty(spark):
    assert judged(frame(spark).limit(0)).count() == 0
