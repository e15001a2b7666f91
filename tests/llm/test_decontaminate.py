import hashlib

import pytest
from helpers import ALNUM, LONG, TEXTS, UPPER, frame, keyed, real

from motes.llm.decontaminate import contamination


def words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return keyed(out)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog the quick brown fox jumps"),
    (2, "A null, ID"),
    (3, None),
    (4, " -- "),
    (None, "gnu general public"),
    (5, " ".join(LONG.split()[100:140])),
    (5, "apache license"),
    (6, "the quick brown fox jumps over the lazy dog the quick brown fox jumps"),
    (7, "dog"),
]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_awkward_rows(spark, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert keyed(contamination(frame(spark), items, most).select(COLUMNS).collect()) == plain(TEXTS, ITEMS)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_given_rows(spark, most):
    docs, items = real(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = contamination(docs, items, most).select(COLUMNS).collect()
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert keyed(got) == expected
    assert any(r.contaminated for r in got)


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(frame(spark).limit(0), items).count() == 0
    assert not any(r.n_hit for r in contamination(frame(spark), items.limit(0)).collect())
