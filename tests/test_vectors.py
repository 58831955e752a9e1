"""The vector index: recall against an exact scan, all cells give exact results, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from statuta.operators import search as S
from statuta.operators import vectors as VI


def test_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=16)).tolist(), i % 12) for i in range(1_500)] + [(9_000, None, 0), (9_001, [0.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cell_label int")
    index = VI.build(df, str(tmp_path / "v"), cells=12, sample=400)
    assert index.rows.count() == 1_500 and len(index.centres) == 12
    n, share = VI.recall(index, index.rows.where("vec_id % 20 = 0"), probes=4)
    assert n == 75 and share >= 0.9
    q = rows[40][1]
    want = [r["vec_id"] for r in S.vector_search(df, spark.createDataFrame([(q,)], "q array<double>"), limit=10).collect()]
    assert [r["vec_id"] for r in index.search(q, 10, probes=12).collect()] == want
    near = [r["vec_id"] for r in index.search(q, 10, probes=4).collect()]
    assert len(set(near) & set(want)) >= 8
    empty = VI.build(df.where("false"), str(tmp_path / "e"))
    assert len(empty.centres) == 0 and df.where(F.col("vec_id") < 0).count() == 0
