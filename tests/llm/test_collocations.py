import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import TEXTS, UPPER, keyed

from motes.llm import collocations as C


def plain(rows, first=2000):
    """The contract, read word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    long = {k: a for k, a in f.items() if len(k) > 2 and a >= 30}
    explained = Counter()
    for (lang, *w), a in long.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                k = (lang, *w[i : i + m])
                explained[k] = max(explained[k], a)
    out = {}
    for (lang, *w), a in long.items():
        if 100 * explained[(lang, *w)] >= 80 * a and (lang, *w) in explained:
            continue
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return keyed((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:first]))


def check(spark, rows, first=2000):
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("1 as shard", "2 as n", "lang", "3 as word", "text", "4 as k1", "5 as seq")
    got = keyed(C.collocations(docs).collect())
    assert got == plain(rows, first)
    return got


def drawn(seed, docs, vocabulary=25):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["Ünï", "THE", "the", "a\x1cb", "x\xa0y", "' '"]
    phrases = [[rng.choice(words) for _ in range(rng.randint(2, 6))] for _ in range(8)]
    out = []
    for _ in range(docs):
        w = []
        for _ in range(rng.randint(0, 30)):
            w += rng.choice([rng.choice(phrases), [rng.choice(words)], [rng.choice(words), rng.choice([". ", "\n", "!?", " ", "\t", "\r", "\x0b"])]])
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t "]).join(w)))
    return out


def test_drawn_and_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 100)
    monkeypatch.setattr(C, "shards", lambda docs, f=C.shards: f(docs, 200))
    rows = drawn(1, 300)
    assert len(check(spark, rows)) > 20
    check(spark, rows + [("en", t) for _, t in TEXTS] + [("en", None), (None, ""), ("fr", "a " * 500), ("fr", "... . ,")])


def test_the_first_rows_with_ties(spark, monkeypatch):
    monkeypatch.setattr(C, "FIRST", 7)
    monkeypatch.setattr(C, "BUCKET", 3)
    rows = [("en", f"tie{k} with{k}. ") for k in range(20) for _ in range(30)] + drawn(2, 200)
    assert len(check(spark, rows, 7)) > 14


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0
    assert check(spark, [("en", "just one line")]) == []


@pytest.mark.parametrize("seed", range(6))
def test_intervals_of_both_directions_are_counts(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([[0], rng.choice([0, 3, 5, 9, 2**31 - 1], 400, p=[0.1, 0.4, 0.3, 0.1, 0.1]), [0]])
    text = ids.tolist()
    counts = {m: Counter(tuple(text[i : i + m]) for i in range(len(text) - m + 1) if 0 not in text[i : i + m]) for m in range(1, 5)}
    for steps in ("lll", "rrr", "lrl", "rlr", "llr"):
        index = C.WordIndex(ids, 3)
        level = index.words()
        for m, step in enumerate(steps, 2):
            level = index.left(level) if step == "l" else index.right(level)
            words, n = index.counted(level)
            assert dict(zip(map(tuple, words.tolist()), n.tolist(), strict=True)) == counts[m]


def test_numbers_survive_packing():
    ids = np.array([0, 1, 2**31 - 1, 70_000, 0], np.int64)
    assert C.unpacked(C.packed(ids), 5).tolist() == ids.tolist()


def test_given_documents_equal_the_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    duckdb.sql(f"create or replace temp view documents as select * from '{path}'")
    want = keyed(duckdb.sql(C.SQL).fetchall())
    assert keyed(C.collocations(spark.read.parquet(path)).collect()) == want and len(want) > 20
