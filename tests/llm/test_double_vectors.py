"""Neighbours of vectors in double precision."""

import numpy as np
from pyspark.sql import functions as F

from skyqa.llm import neighbours


def test_doubles_are_compared_as_they_are(spark):
    draw = np.random.default_rng(9)
    v = draw.standard_normal((160, 32))
    v[5] = v[0] * 1e200
    v[6] = v[0] * (1 + 1e-9 * draw.standard_normal(32))  # apart from v[0] in double precision only
    v[7] = v[50] * 1e-200
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    for q in range(0, 160, 50):
        score = (unit * unit[q]).sum(axis=1)
        score[q] = -2
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in own], np.sort(score)[::-1][:5], rtol=0, atol=1e-15)
        assert np.allclose([score[i] for _, i, _ in own], [s for _, _, s in own], rtol=0, atol=1e-15)
    assert {r.vec_id for r in got if r.query_id == 0} >= {5, 6}
    assert next(r.vec_id for r in got if r.query_id == 50 and r.rank == 1) == 7
