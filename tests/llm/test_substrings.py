import hashlib
import random

from helpers import TEXTS, TWINS, WORDS, frame, keyed, real

from motes.llm import substrings as S


def plain(rows):
    first = {}
    words = [WORDS.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            t = tuple(w[i : i + 13])
            if d is not None:
                first[t] = min(first.get(t, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return keyed(out)


COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert keyed(S.substring_dedup(docs).select(COLUMNS).collect()) == plain(rows)


def test_awkward_and_given_rows(spark):
    assert keyed(S.substring_dedup(frame(spark)).select(COLUMNS).collect()) == plain(TEXTS)
    docs = real(spark, "0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = keyed(S.substring_dedup(docs).select(COLUMNS).collect())
    assert got == plain(rows)
    assert sum(r[2] > 0 for r in got) > 50


def test_passages_in_many_contexts(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 13, 14, 30]))] for _ in range(12)]
    rows = []
    for d in range(80):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice([rng.choice(passages), [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))], [rng.choice(vocabulary[:3])] * rng.randint(0, 40)])
        rows.append((rng.choice([d, d // 2, None]) if d % 9 == 0 else d, " ".join(w)))
    check(spark, rows)


def test_documents_without_repeats_stay(spark):
    docs = frame(spark, [(1, "a  b\nc"), (2, " ".join(map(str, range(40)))), (3, "x " + " ".join(map(str, range(40))) + " y")])
    got = {r.doc_id: r.text for r in S.without_repeats(docs).collect()}
    assert got[1] == "a  b\nc" and got[3] == "x y" and len(got) == 3
    assert S.substring_dedup(frame(spark).limit(0)).count() == 0


def test_two_signs_and_clashing_names(spark):
    check(spark, TWINS)
    rng = random.Random(5)
    lead = [rng.choice(["a", "b"]) for _ in range(40)]
    check(spark, [(k, " ".join(lead[: rng.randint(13, 40)] + [f"t{k}"] * 3 + lead[rng.randint(0, 20) :])) for k in range(60)])
    text = " ".join(map(str, range(40)))
    docs = frame(spark, [(1, text), (2, f"x {text} y")]).selectExpr("*", "'m' as marks", "7 as marked_id", "8 as c0", "9 as content")
    got = S.without_repeats(docs)
    assert got.columns == docs.columns
    assert [(r.doc_id, r.text, r.marks, r.marked_id, r.n_chars) for r in got.orderBy("doc_id").collect()] == [(1, text, "m", 7, len(text)), (2, "x y", "m", 7, 3)]
