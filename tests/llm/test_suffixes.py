import hashlib
import random

import numpy as np
from helpers import TEXTS, frame, keyed, real

from motes.llm import suffixes as S


def plain(rows):
    count = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - 199):
            h = hash(raw[i : i + 200])
            count[h] = count.get(h, 0) + 1
    out = []
    for (d, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - 199):
            if count[hash(raw[i : i + 200])] > 1:
                gone[i] += 1
                gone[min(i + 200, len(raw))] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return keyed(out)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_long_prefixes_match_sorted_suffixes():
    rng = random.Random(1)
    for length in (1, 2, 5, 9):
        for _ in range(40):
            body = [rng.choice([1, 2, 3]) + 10 for _ in range(rng.randint(1, 80))]
            cut = rng.randint(0, len(body))
            text = np.array(body[:cut] + [1] + body[cut:] + [0])
            order, shared = S.long_prefixes(text, length)
            own = [tuple(text[k : k + length]) for k in order]
            assert own == sorted(own)
            assert shared.tolist() == [False] + [a == b and len(a) == length for a, b in zip(own, own[1:])]


def test_awkward_and_given_rows(spark):
    assert keyed(S.suffix_dedup(frame(spark)).select(COLUMNS).collect()) == plain(TEXTS)
    docs = real(spark, "0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = keyed(S.suffix_dedup(docs).select(COLUMNS).collect())
    assert got == plain(rows)
    assert sum(r[2] > 0 for r in got) > 50


def test_passages_in_many_contexts(spark, monkeypatch):
    rng = random.Random(4)

    def junk(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passages = [junk(n) for n in (60, 120, 199, 200, 201, 260, 500)] + ["abc" * 120, "z" * 350]
    rows = []
    for d in range(60):
        parts = [rng.choice([rng.choice(passages), junk(rng.randint(0, 300))]) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([d, d // 2, None]) if d % 9 == 0 else d, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (S.BUCKET, 700):
        monkeypatch.setattr(S, "BUCKET", bucket)
        assert keyed(S.suffix_dedup(docs).select(COLUMNS).collect()) == plain(rows)


def test_empty(spark):
    assert S.suffix_dedup(frame(spark).limit(0)).count() == 0


def test_windows_of_one_key_are_told_apart(monkeypatch):
    """Keys of whole windows made to clash: the digest keeps different strings apart."""
    import pyarrow as pa

    rng = random.Random(3)
    gram = bytes(rng.choices(b"abcdefgh", k=S.GRAM))
    texts = [bytes(rng.choices(b"abcdefgh", k=S.SPARE)) + gram for _ in range(3)]
    texts.append(texts[0])
    anchor = int(S.gram_hashes(np.frombuffer(gram, np.uint8)).view(np.int64)[0])
    monkeypatch.setattr(S, "context_key", lambda data, place, left, right: left)
    left = S.SPARE - 1
    cols = {
        "key": pa.array([left] * 4), "wide": pa.array([left] * 4, pa.int32()), "narrow": pa.array([0] * 4, pa.int32()), "anchor": pa.array([anchor] * 4),
        "content": pa.array([bytes([k]) for k in range(4)]), "single": pa.array([True] * 4), "data": pa.array(texts, pa.binary()),
    }
    (out,) = S._longer(iter([pa.record_batch(list(cols.values()), list(cols))]))
    rows = out.to_pylist()
    assert {r["places"][0] for r in rows} == {0} and all(r["data"] is None and r["wide"] + r["narrow"] == S.SPARE for r in rows)
    assert {r["key"] for r in rows} == {rows[0]["key"]}
    assert rows[0]["string"] == rows[3]["string"] and len({r["string"] for r in rows}) == 3


def test_marks_are_read_as_columns():
    """Marks of sliced batches, null, empty, whole and by places, and no Python value a mark."""
    import pyarrow as pa

    kinds = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("places", pa.list_(pa.int32()))]))
    marks = [None, [], [{"start": 3, "windows": 2, "places": None}], None, [{"start": 10, "windows": 90, "places": [0, 50]}, {"start": 300, "windows": 1, "places": None}], None]
    texts = [b"x" * 250, None, bytes(range(250)), b"", bytes(range(250)) * 3, b"abc"]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts, pa.binary()), pa.array(marks, kinds)], ["doc_id", "text", "marks"])
    out = pa.Table.from_batches(S._kept(True, iter([batch.slice(0, 1), batch.slice(1, 0), batch.slice(1, 3), batch.slice(4)]))).to_pydict()
    assert out["n_removed"] == [0, 0, 201, 0, 450, 0] and out["n_spans"] == [0, 0, 1, 0, 2, 0]
    assert out["kept"][2] == bytes([0, 1, 2]) + bytes(range(204, 250)) and out["kept"][4] == texts[4][:10] + texts[4][260:300] + texts[4][500:]
    values, ends = S._flat(batch.column(2).slice(4))
    assert len(values) == 2 and ends.tolist() == [0, 2, 2]
