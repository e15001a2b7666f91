import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import math
import random

import duckdb
import numpy as np
import pytest
from helpers import keyed

from motes.llm import negatives as N


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def plain(rows):
    """The contract, read row by row; rows are told apart by their place."""
    own = []
    for vec_id, v, label in rows:
        v = whole(v)
        if v is not None and label is not None:
            own.append((vec_id, v, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (a, va, la) in enumerate(own):
        if a is None or a % 100:
            continue
        ranked = sorted(((-dot(va, vb), b is None, b or 0, j, b, lb) for j, (b, vb, lb) in enumerate(own) if j != k), key=lambda t: t[:4])
        for p in [t for t in ranked if t[5] == la][:5]:
            ps = -p[0]
            fit = [t for t in ranked if t[5] != la and 30 * ps <= -100 * t[0] <= 90 * ps][:10]
            out += [(a, p[4], r + 1, t[4], ps, -t[0]) for r, t in enumerate(fit)]
    return keyed(out)


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return docs.selectExpr("embedding", "1 as uid", "2 as list", "3 as block", "label", "4 as score", "vec_id")


def check(spark, rows):
    got = keyed(N.hard_negatives(frame(spark, rows)).collect())
    assert got == plain(rows)
    return got


def drawn(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    labels = rng.integers(0, 4, n)
    return [(int(k * 25), (centres[labels[k]] + spread * rng.normal(size=width)).tolist(), int(labels[k])) for k in range(n)]


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 150)
    monkeypatch.setattr(N, "STEP", 7)
    monkeypatch.setattr(N, "CLUSTER", 10)


def test_drawn_vectors(spark):
    assert len(check(spark, drawn(1, 500, 8, 0.3))) > 1000
    check(spark, drawn(2, 300, 3, 1.5))


def test_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(100 * (k % 4) if k % 3 else None, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(rng.choice([2, 3]))], rng.choice([0, 0, 1, None])) for k in range(80)]
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 0), (300, [float("inf"), 1.0], 0), (700, [], 1), (0, [0.0, 0.0], 1), (-700, [1.0, 1.0], 9), (-100, [-1.0, 2.0], 0)]
    check(spark, rows)
    assert N.hard_negatives(frame(spark, rows).limit(0)).count() == 0
    assert N.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(50 * k, [rng.choice([1.0, -1.0]) * rng.randint(1, 10**6) / 3 * 10 ** rng.randint(0, 1) for _ in range(3)], k % 3) for k in range(40)]
    assert check(spark, rows)


def test_walks_stop_early_and_lose_nothing():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    members = np.floor(256 * (centre + 0.05 * rng.normal(size=(20, 16))))
    rows = np.floor(256 * rng.normal(size=(5000, 16)) * rng.lognormal(0, 1.5, size=(5000, 1)))
    shared = N.SharedList(members, rows)
    met = []
    score = shared.scores
    shared.scores = lambda who, a, b: met.append((b - a) * len(who)) or score(who, a, b)
    best = shared.walk(5, lambda who, at, s: np.ones(s.shape, bool), [None] * 20, np.arange(5000))
    exact = (members @ rows.T).astype(np.int64)
    for k, found in enumerate(best):
        assert found == [(int(exact[k, r]), int(r)) for r in np.lexsort((np.arange(5000), -exact[k]))[:5]]
    assert sum(met) < 0.25 * 20 * 5000


def test_given_vectors_equal_the_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    duckdb.sql(f"create or replace temp view embeddings as select * from '{path}'")
    want = keyed(duckdb.sql(N.SQL).fetchall())
    assert keyed(N.hard_negatives(spark.read.parquet(path)).collect()) == want and len(want) > 100
