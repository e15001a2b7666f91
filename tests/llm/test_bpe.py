import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import LONG, TEXTS, frame, keyed, real

from motes.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def raw():
    with open(RANKS, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        coded = " ".join(map(str, ids)).encode()
        out.append((doc_id, len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    return keyed(out)


def test_awkward_and_given_rows(spark, library):
    got = bpe.encoded(frame(spark), RANKS, public_tokenizers.PATTERN)
    assert keyed(got.collect()) == expected(library, TEXTS)
    docs = real(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    coded = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    assert keyed(coded.collect()) == expected(library, rows)
    back = bpe.decoded(coded, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.raw).decode() for r in back.collect()} == dict(rows)


def test_odd_texts(raw, library):
    rng = random.Random(5)
    texts = ["", "x" * 5000, "a" * 37, "don't  \n\n  we'll  　x \x1c y\t\tz 12345 日本語テキスト 🙂🙂 'S 're's", " ", "\n", "  a"]
    pools = ["abcdeest", "aA1 '\n\t.,", "é中اa  ", "".join(chr(k) for k in range(33, 127))]
    texts += ["".join(rng.choice(p) for _ in range(rng.randint(1, 400))) for p in pools for _ in range(60)] + [LONG[:50_000]]
    own = bpe.Codec(raw, public_tokenizers.PATTERN)
    coded = own.encode(texts)
    assert [x.tolist() for x in coded] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(coded) == [t.encode() for t in texts]


def test_long_words_in_several_recursions(raw, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP_ROWS", 20_000)
    rng = random.Random(6)
    texts = ["".join(rng.choice("aeioust") for _ in range(n)) for n in (33, 100, 2000)]
    assert [x.tolist() for x in bpe.Codec(raw, public_tokenizers.PATTERN).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(raw, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    own = bpe.Codec(raw, public_tokenizers.PATTERN)
    texts = [LONG[k : k + 600] for k in range(0, 6000, 600)]
    for t in texts:
        assert own.encode([t])[0].tolist() == library.encode_ordinary(t)
        assert own.decode(own.encode([t])) == [t.encode()]
        own.rest()
        assert max(map(len, (own.recent, own.older))) <= 50 + 600


def test_sequences_that_a_product_hash_confuses(raw, library):
    """Thue-Morse words over two letters, and over two tokens, are told apart."""
    for one, two in (("\x01", "\x02"), ("a", "b"), (" a", "\n")):
        for n in (1024, 2048):
            signs = [bin(k).count("1") % 2 for k in range(n)]
            texts = ["".join((one, two)[s ^ flip] for s in signs) for flip in (0, 1)]
            own = bpe.Codec(raw, public_tokenizers.PATTERN)
            coded = own.encode(texts)
            assert [x.tolist() for x in coded] == [library.encode_ordinary(t) for t in texts]
            assert own.decode(coded) == [t.encode() for t in texts]


def test_another_pattern_is_kept_to(raw):
    pattern = r"[a-z ]+|[^a-z ]"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = "the quick brown fox, 12 times\nover the lazy dog"
    assert bpe.Codec(raw, pattern).encode([text])[0].tolist() == other.encode_ordinary(text)


def test_unknown_ids_raise(raw):
    with pytest.raises(ValueError):
        bpe.Codec(raw, public_tokenizers.PATTERN).decode([np.array([1, 60_000])])


def test_empty(spark):
    assert bpe.encoded(frame(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_very_long_texts_are_decoded_in_parts():
    """Millions of characters, many distinct words and numbers: more tokens than one query of bounded memory holds."""
    own = bpe.codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    texts = ["".join(f" w{k % 4999} {k % 100_003}" for k in range(500_000)), "", " ".join(f"{k * 7919 % 1_000_003:x}é" for k in range(120_000))]
    ids = own.encode(texts)
    assert len(ids[0]) > 8 * bpe.DECODE_ROWS and [x.decode() for x in own.decode(ids)] == texts


def test_pairs_that_are_never_met_are_left_out(raw, library):
    """One pair a token at most, with which the contraction of its own bytes ends; the ids stay those of the library."""
    own = bpe.Codec(raw, public_tokenizers.PATTERN)
    assert len(set(own.merges["rank"].to_pylist())) == own.merges.num_rows
    rng = random.Random(9)
    names = [t.decode("utf-8", "ignore") for t in own.ranks]
    texts = ["".join(rng.choice(names) for _ in range(40)) for _ in range(500)]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_texts_of_a_part_are_decoded_together(raw, monkeypatch):
    """One aggregation a part, cut at the texts; parts that end anywhere and empty texts change nothing."""
    own, seen = bpe.Codec(raw, public_tokenizers.PATTERN), []
    texts = ["", "a" * 300, "", " x  y\n z", "日本語テキスト" * 20, LONG[:500], ""]
    ids, put = own.encode(texts), own._table
    monkeypatch.setattr(own, "_table", lambda name, rows: (seen.append(rows.column_names), put(name, rows)))
    assert own.decode(ids) == [t.encode() for t in texts] and seen == [["pos", "tok"]]
    monkeypatch.setattr(bpe, "DECODE_ROWS", 7)
    assert own.decode(ids) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        own.decode([np.array([-1])])
