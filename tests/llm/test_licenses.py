import random

import numpy as np
from helpers import ALNUM, TEXTS, UPPER, frame, keyed, real

from motes.llm.licenses import _PATTERNS, BASE, NOTICES, _Slice, license_scan


def plain(doc_id, text):
    w = ALNUM.findall((text or "").translate(UPPER))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def test_base_places(spark):
    assert keyed(license_scan(frame(spark)).select(COLUMNS).collect()) == keyed(plain(*r) for r in TEXTS)
    docs = real(spark, "0.01")
    assert keyed(license_scan(docs).select(COLUMNS).collect()) == keyed(plain(r.doc_id, r.text) for r in docs.collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bounded_errors(spark):
    rows = [
        (1, "words before; GNU Generel Pubic License after"),
        (2, "Apache Licence"),
        (3, "the mut license"),
        (4, "gnu gxnxrxl public license"),
        (5, "Redistribtion and use in source or binary forms"),
        (6, "a cc by-nc thing, licensed under CC BY-NC 4.0"),
        (7, "plain prose about nothing at all"),
        (8, None),
    ]
    found = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k].labels for k in range(1, 9)] == ["gpl", "apache", "mit", "gpl", "bsd", "cc-by,cc-by-nc", "", ""]
    assert (found[1].matches[0].first_word, found[1].matches[0].last_word, found[1].matches[0].edits) == (2, 5, 2)
    assert found[7].score == 0.0 and found[6].score == 1.0 and 0.8 < found[1].score < 1
    by = {n.label: n for n in NOTICES}
    for r in found.values():
        words = ALNUM.findall((dict(rows)[r.doc_id] or "").translate(UPPER))
        for m in r.matches:
            assert m.edits <= max(n.edits for n in NOTICES if n.label == m.label)
            if m.label in ("gpl", "apache"):
                assert distance(" ".join(words[m.first_word : m.last_word + 1]), by[m.label].text) == m.edits


def whole(text):
    """The patterns over all of a normalised text."""
    flat = " " + " ".join(ALNUM.findall(text.translate(UPPER)))
    found = set()
    for n in NOTICES:
        for m in _PATTERNS[n].finditer(flat):
            start, errors = flat.count(" ", 1, m.start()), sum(m.fuzzy_counts)
            found.add((n.label, start, start + m.group().count(" "), errors, 1 - errors / len(n.text)))
    return sorted(found)


def scanned(texts):
    raws = [t.encode() for t in texts]
    got = _Slice(b"".join(raws), np.cumsum([0, *map(len, raws)])).fuzzy
    return [got.get(k, []) for k in range(len(texts))]


def test_seeds_lose_no_match_of_the_patterns():
    rng = random.Random(11)
    letters = "aeiglnrstu cmb-\n.éß日🙂😀𝔊"
    texts = ["see the 😀😀😀 general public license", "the gnu general public 𝔩𝔦𝔠ense", "mit licens" + "e" * 300, "", " mit license", "x" * 90 + " mit license"]
    for _ in range(900):
        parts = []
        for _ in range(rng.randint(1, 5)):
            t = list(rng.choice(NOTICES).text)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), rng.choice(letters) * 2])
            parts += ["".join(t), "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    expected = [whole(t) for t in texts]
    assert scanned(texts) == expected
    assert expected[0] and expected[1] and sum(map(bool, expected)) > 200


def test_a_match_does_not_depend_on_what_stands_before_it():
    texts = ["xbsd license", "abc xbsd license", "licece 😀bsd license", "see mit license, xbsd license"]
    assert [[m[0] for m in found if m[0] == "bsd"] for found in scanned(texts)] == [["bsd"]] * 4
    assert scanned(texts) == [whole(t) for t in texts]
    (only,) = (m for m in scanned(texts)[1] if m[0] == "bsd")
    assert only[1:4] == (1, 2, 1)


def test_given_rows_against_the_patterns(spark):
    texts = [r.text or "" for r in real(spark, "0.01").collect()]
    assert scanned(texts) == [whole(t) for t in texts]


def test_empty(spark):
    assert license_scan(frame(spark).limit(0)).count() == 0
