import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import TEXTS, frame, keyed, real
from tokenizers import Tokenizer

from motes.llm import token_shards as S

MODEL = public_tokenizers.path("word_bpe_49k.json")
MORE = [
    (-5, "It's we'll THEY'D x'y don't 123 4567 a1b2 ... !?! €uro ﬁne Ünï ́ ́b Å \x1c\x1d \x85 \xa0 　 ß İ Σας ΟΔΟΣ"),
    (-4, "<|endoftext|> a<|startoftext|>b end\"of\"text \" \" \""),
    (2**62, "x" * 3000 + " 中文字符 हिन्दी 한국어 👩‍👩‍👧 é é"),
    (50, "Zalgo t̴̛e̶x̷t ́lead ᅡᆨ   sep​zero"),
]


def plain(rows):
    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    seen = []
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        seen.append((d, text, len(ids), zlib.crc32(ids.tobytes())))
    return seen


def test_signs_behind_words():
    encoder = S.Encoder(Path(MODEL).read_text(), False)
    assert encoder.direct
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    tails = [a + b for a in signs for b in ["", *signs]] + ["'''", "%%%,", "<|endoftext|>", "<||>", "'s'", "'" * 40]
    texts = [f"{w}{t}" for w in ("word", "it", "été", "ßa", "a") for t in tails]
    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    for text, ids in zip(texts, encoder.texts([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def check(rows, got):
    """Rows equal but for ``start``; starts fill the whole range in ascending order of ids."""
    want = plain(rows)
    assert keyed((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == keyed((d, n, c) for d, _, n, c in want)
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_awkward_texts(spark):
    docs = frame(spark, TEXTS + MORE)
    check(TEXTS + MORE, S.token_shards(docs, MODEL).collect())
    assert S.token_shards(docs.limit(0), MODEL).count() == 0


def test_given_documents(spark):
    docs = real(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], S.token_shards(docs, MODEL).collect())


def test_repeated_and_null_ids_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 64)
    rows = [(None if k % 3 else 7, f"text {k % 5} of some words " * 9) for k in range(90)] + [(k, f"own {k}") for k in range(-20, 20)]
    docs = frame(spark, rows)
    folder = S.new_path(spark, "few")
    width = S.write_shards(docs, MODEL, folder, shard_bytes=2000)
    assert width == 2 and S.shard_files(spark, folder).count() > 5
    listed = S.listing(spark, folder, width)
    known = keyed((r.doc_id, r.occurrence) for r in listed.collect())
    assert known == keyed({(d, k) for d in {d for d, _ in rows} for k in range(sum(x == d for x, _ in rows))})
    found, parts = S.index(listed, part_keys=20)
    assert parts > 3
    keys = listed.select("doc_id", "occurrence").unionAll(spark.createDataFrame([(1234, 0), (7, 31), (None, 60)], "doc_id long, occurrence long"))
    got = S.fetch(spark, folder, width, S.locate(found, parts, keys))
    assert keyed((r.doc_id, r.occurrence) for r in got.collect()) == known
    check(rows, S.token_shards(docs, MODEL).collect())


def test_raw_ids_stand_in_the_files(spark):
    rows = [(3, 'say "hi" twice'), (1, ""), (2, "abc def")]
    folder = S.new_path(spark, "raw")
    width = S.write_shards(frame(spark, rows), MODEL, folder)
    raw = b"".join(bytes(r.content) for r in S.shard_files(spark, folder).collect())
    t = Tokenizer.from_file(MODEL)
    want = [i for _, text in sorted(rows) for i in [*t.encode(text, add_special_tokens=False).ids, 1]]
    assert np.frombuffer(raw, "<u2", len(want)).tolist() == want
    with pytest.raises(ValueError, match="end id"):
        S.write_shards(frame(spark, rows), MODEL, folder + "x", end_id=49407)
    with pytest.raises(ValueError, match="directory"):
        S.directory(raw[:-10], width)


def test_perfect_hash_is_minimal_and_lists_equal_keys(spark):
    for n in (0, 1, 2, 1000, 30_000):
        keys = S.mix(np.arange(n, dtype=np.uint64))
        slots = S.PerfectHash.of(keys).slots(keys)
        assert sorted(slots.tolist()) == list(range(n))
    twice = np.array([5, 5, 9], np.uint64)
    assert S.PerfectHash.of(twice).slots(twice).tolist()[:2] == [-1, -1]
    import pyarrow as pa

    rows = {"part": [0] * 3, "doc_id": [1, None, 3], "occurrence": [0] * 3, "shard": [0, 1, 2], "at": [0, 4, 8], "n": [1, 2, 3], "start": [0, 40, 80], "name": [1 << 40, 2 << 40, 3 << 40], "key": [5, 5, 9]}
    part = S._indexed(pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()}))
    got = S._found(pa.table({k: pa.array(rows[k], pa.int64()) for k in ("doc_id", "occurrence", "name", "key")}), part)
    assert keyed(zip(*(got.column(c).to_pylist() for c in ("doc_id", "shard", "start")), strict=True)) == keyed([(1, 0, 0), (None, 1, 40), (3, 2, 80)])
