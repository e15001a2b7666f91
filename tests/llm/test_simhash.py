import xxhash
from helpers import TEXTS, UPPER, WORDS, frame, keyed, real

from motes.llm import simhash
from motes.llm.simhash import near_duplicates_removed, simhash_components


def plain_fp(text):
    w = WORDS.findall((text or "").translate(UPPER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_fp(t) for _, t in rows]
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    own = sorted(parent)
    for i, p in enumerate(own):
        for q in own[:i]:
            if (p ^ q).bit_count() <= 2:
                parent[root(p)] = root(q)
    low = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            low[root(p)] = min(low.get(root(p), d), d)
    return keyed((d, p - (1 << 64) if p >> 63 else p, low.get(root(p))) for (d, _), p in zip(rows, prints, strict=True))


def test_awkward_rows(spark):
    assert keyed(simhash_components(frame(spark)).collect()) == plain_components(TEXTS)


def test_given_rows(spark):
    docs = real(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert keyed(simhash_components(docs).collect()) == plain_components(rows)


def test_dense_cells_lose_no_link(spark, monkeypatch):
    prints = sorted({(0x1234567890ABCDEF ^ (1 << a) ^ (1 << b)) & (1 << 62) - 1 for a in range(20) for b in range(20)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    from motes.llm.components import components

    for pairs in (simhash.CELL_PAIRS, 2):
        monkeypatch.setattr(simhash, "CELL_PAIRS", pairs)
        assert {r.root for r in components(simhash.near_links(df)).collect()} == {prints[0]}


def test_one_of_each_class_stays(spark):
    kept = near_duplicates_removed(frame(spark))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8, 10, 11]
    assert kept.columns == frame(spark).columns
    assert simhash_components(frame(spark).limit(0)).count() == 0
