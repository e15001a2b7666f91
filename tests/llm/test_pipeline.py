import hashlib

import public_tokenizers
from helpers import real
from pyspark.sql import functions as F
from test_bpe import RANKS
from test_decontaminate import plain as plain_contamination
from test_simhash import plain_fp
from test_substrings import WORDS

import corpus_pipeline as P
from motes.llm import bpe, quality_model


def keep_one_each(rows):
    """Rows left of each class of fingerprints that differ in two bits at most, one step after another."""
    prints = {d: plain_fp(t) for d, t in rows}
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[a] < group[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[b], changed = group[a], True
    return [(d, t) for d, t in rows if group[d] == d]


def cut_repeats(rows):
    first = {}
    words = {d: WORDS.findall(t) for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - 12):
            t = tuple(w[i : i + 13])
            first[t] = min(first.get(t, d), d)
    out = []
    for d, text in rows:
        w = words[d]
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}
        out.append((d, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else text))
    return out


def test_stages_against_plain_readings(spark):
    sf = "/root/testdata/sf0.001"
    docs = real(spark)
    assert [name for name, _ in P.STAGES] and len(P.STAGES) == 5
    quality = {r.doc_id: r.predicted for r in quality_model.quality(docs, P.table(spark, sf, "labels")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if quality[r.doc_id]]
    out = docs
    items = [(r.item_id, r.text) for r in P.table(spark, sf, "benchmark").collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        out = P.written(stage(spark, out, sf), f"test{k}")
        if k == 1:
            rows = keep_one_each(rows)
        if k == 2:
            rows = cut_repeats(rows)
        if k == 3:
            bad = {r[0] for r in plain_contamination(rows, items) if r[-1]}
            rows = [r for r in rows if r[0] not in bad]
        if k < 4:
            assert out.columns == docs.columns
            assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
            assert out.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.length("text") != F.col("n_chars")).count()
    coded = {r.doc_id: r for r in out.collect()}
    assert {d: r.decoded_sha256 for d, r in coded.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows}
    own = bpe.codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    assert all(coded[d].ids == own.encode([t])[0].tolist() for d, t in rows)
    assert {r.doc_id: r.n_tokens for r in P.run(spark, sf).collect()} == {d: len(coded[d].ids) for d in coded}
