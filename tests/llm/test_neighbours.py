"""Recall of the Spark job on clusters of near-copies, well above the size of a start part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingrisk.llm import neighbours


@pytest.mark.parametrize("size", [2048, 4096])
def test_recall_on_near_copies(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((size // 128, 16))
    made = centres[np.arange(size) % len(centres)] + 1e-3 * rng.standard_normal((size, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 101 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    asked = range(0, size, 101)
    hits = 0
    for q in asked:
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(got[q] & set(np.argsort(-scores)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(asked)


def _recall(df, made, step, **options):
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % step == 0, k=5, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(made), step):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(got[q] & set(np.argsort(-scores)[:5].tolist()))
    return hits / (5 * len(range(0, len(made), step)))


def test_rows_written_do_not_grow_with_edges_or_candidates(spark, monkeypatch):
    """Lists of a part and candidates of a query travel packed: a few rows for each vector, not one for each edge and round."""
    made = np.random.default_rng(1).standard_normal((2048, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    store, written = neighbours.materialise, []

    def counted(table):
        stored = store(table)
        written.append(stored.count())
        return stored

    monkeypatch.setattr(neighbours, "materialise", counted)
    assert _recall(df, made, 64) >= 0.9
    assert sum(written) <= 10 * len(made)


def test_hubs_and_crowded_parts(spark, monkeypatch):
    """Vectors that fall into one part are dealt by hash; edges that lead to one part are spread."""
    rng = np.random.default_rng(2)
    made = np.eye(16)[0] + 0.05 * rng.standard_normal((5000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    parts = {(code << neighbours.CHUNK_BITS) + chunk: 3 for code in range(8) for chunk in range(8)}
    monkeypatch.setattr(neighbours, "_hot", lambda graph, degree: parts)
    assert _recall(df, made, 101) >= 0.9
