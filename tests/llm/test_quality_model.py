import numpy as np
import pytest
from helpers import TEXTS, frame, real

from motes.llm import quality_model as Q


def labels(spark, n):
    return spark.read.parquet(f"/root/testdata/sf{n}/labels.parquet")


def test_held_out_accuracy(spark):
    own = labels(spark, "0.1")
    rows = Q.quality(real(spark, "0.1"), own).join(own, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 800
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_are_not_learnt(spark):
    import zlib

    own = labels(spark, "0.001")
    got = {r.doc_id: r.held_out for r in Q.quality(real(spark), own).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in got.items())
    turned = own.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality")
    a, b = ({r.doc_id: r.score for r in Q.quality(real(spark), x).collect()} for x in (own, turned))
    assert a == b


def test_awkward_rows(spark):
    own = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 0, 0), (7, None, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality(frame(spark), own).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[2] == by[3] and by[1] == by[9] and by[5] == by[6]
    assert len({r.score for r in Q.quality(frame(spark), own.limit(0)).collect()}) == 1
    assert Q.quality(frame(spark).limit(0), own).count() == 0
    assert Q.good_documents(frame(spark), own).columns == frame(spark).columns


def test_dual_coordinate_descent_solves_the_hinge_problem():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    y = np.array([int(r.sum() % 3 > 0) for r in rows])
    scale = rng.normal(size=12)
    w = Q.dual_coordinate_descent(rows, y, scale, np.full(60, 0.5), 4000)
    x = np.zeros((60, 13))
    for k, r in enumerate(rows):
        x[k, r], x[k, 12] = scale[r], 1
    sign = np.where(y > 0, 1, -1)
    primal = 0.5 * w @ w + 0.5 * np.maximum(0, 1 - sign * (x @ w)).sum()
    for _ in range(200):
        other = w + rng.normal(size=13) * 0.02
        assert 0.5 * other @ other + 0.5 * np.maximum(0, 1 - sign * (x @ other)).sum() > primal - 1e-4


@pytest.mark.parametrize("shift", [0.0, 1.5])
def test_calibration(shift):
    rng = np.random.default_rng(2)
    margin = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margin + shift)))).astype(int)
    a, b = Q.calibrate(margin, y)
    assert abs(a - 2) < 0.3 and abs(b - shift) < 0.3
