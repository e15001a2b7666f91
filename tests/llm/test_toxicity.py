import itertools
import zlib

import numpy as np
import pytest
from helpers import TEXTS, frame, real

from motes.llm import toxicity as T


@pytest.fixture(scope="module")
def language():
    counts = {}
    for text in ("you are such a loser and an idiot ", "what worthless stupid trash is this ", "the lost rose is on the table "):
        raw = b" " + (text * 30).encode()
        for k in range(len(raw) - 2):
            code = (raw[k] << 16) | (raw[k + 1] << 8) | raw[k + 2]
            counts[code] = counts.get(code, 0) + 1
    return T.Language(np.array(list(counts)), np.array(list(counts.values())))


def test_viterbi_finds_the_best_path(language):
    for span in (b"l0$er", b"1d!ot", b"tr@ssh", b"l o s3"):
        best = None
        for path in itertools.product(*T.lattice(span)):
            a = b = 32
            score, read = 0.0, b""
            for c, cost in path:
                score -= cost
                if c < 0 or (c == 32 and b == 32):
                    continue
                score += language.log(a, b, c)
                a, b, read = b, c, read + bytes([c])
            score += language.log(a, b, 32)
            best = max(best or (score, read), (score, read))
        assert T.decode(span, language) == best[1]


@pytest.mark.parametrize(("span", "meant"), [(b"l0ser", b"loser"), (b"1d10t", b"idiot"), (b"$tup!d", b"stupid"), (b"looooser", b"loser"), (b"tr@sh", b"trash"), (b"s-t-u-p-i-d", b"stupid"), (b"l o s e r", b"loser")])
def test_disguises(language, span, meant):
    assert meant in T.restored(span, language).split()


@pytest.mark.parametrize(
    ("text", "meant"),
    [("so $tupid", "stupid"), ("an 1diot", "idiot"), ("a stuupid", "stupid"), ("such a looser", "loser"), ("+rash", "trash"), ("lo$$", "los"), ("y o u a r e s u c h a s t u p i d i d i o t", "idiot")],
)
def test_the_gate_passes_disguises_whole(language, text, meant):
    low = text.encode()
    spans = T.disguised(T.Words(low, np.array([0, len(low)]), T.SPACE))
    assert spans and any(meant.encode() in T.restored(low[a:b], language) for _, a, b in spans)


def test_letters_apart_stay_in_their_row():
    texts = [b"x y a b c d", b"e f g", b"h i", b"j sa", b"$b"]
    spans = T.disguised(T.Words(b"".join(texts), np.cumsum([0, *map(len, texts)]), T.SPACE))
    assert spans == [(0, 0, 11), (1, 11, 16), (4, 23, 25)]


def test_disguised_texts_score_as_plain_ones(spark):
    docs = real(spark, "0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    more = spark.createDataFrame(
        [(10_000_001, "the then of w0rthl3ss and other things here"), (10_000_002, "the then of i d i o t and other things here"), (10_000_003, "the then of stuuupid and other things"), (10_000_004, "the then of and other things here")],
        "doc_id long, text string",
    )
    out = T.toxicity(docs.select("doc_id", "text").unionByName(more), labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[10_000_000 + k].predicted for k in (1, 2, 3, 4)] == [1, 1, 1, 0]
    held = [(rows[r.doc_id], r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(a.predicted == t for a, t in held) / len(held) > 0.96
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())


def test_awkward_rows(spark):
    own = spark.createDataFrame([(1, 0, 1), (5, 0, 0), (5, 1, 0), (None, 0, 0), (7, 1, None), (10, 0, 0)], "doc_id long, quality int, toxic int")
    got = T.toxicity(frame(spark), own).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[2] == by[3] and by[1] == by[9]
    assert len({r.score for r in T.toxicity(frame(spark), own.limit(0)).collect()}) == 1
    assert T.toxicity(frame(spark).limit(0), own).count() == 0
