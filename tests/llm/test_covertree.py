"""Cover trees and exact top products against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingrisk.llm import covertree


def points(rng, n, d, high):
    return np.unique(rng.integers(-high, high + 1, (n, d)).astype(float), axis=0)


@pytest.mark.parametrize("n,d,high,leaf", [(1, 3, 5, 16), (60, 2, 4, 1), (900, 4, 9, 3), (2500, 1, 2000, 16), (1200, 32, 60, 8)])
def test_tree(n, d, high, leaf):
    given = points(np.random.default_rng(n), n, d, high)
    tree = covertree.build_tree(given, leaf)
    assert sorted(tree.order.tolist()) == list(range(len(given))) and (tree.points == given[tree.order]).all()
    assert tree.table[0, 1:3].tolist() == [0, len(given)]
    for i, (c, a, b, first, last) in enumerate(tree.table.tolist()):
        away = np.linalg.norm(tree.points[a:b] - tree.points[c], axis=1)
        assert a <= c < b and np.isclose(away.max(), tree.radius[i])
        if first < last:
            own = tree.table[first:last]
            assert first > i and own[0, 0] == c and own[0, 1] == a and own[-1, 2] == b and (own[1:, 1] == own[:-1, 2]).all()
            # Children lie apart by their scale, and within twice that of the parent.
            gaps = np.linalg.norm(tree.points[own[:, 0]][:, None] - tree.points[own[:, 0]], axis=2)
            scale = 2.0 ** np.floor(np.log2(gaps[0, 1:].max()))
            assert gaps[np.triu_indices(len(own), 1)].min() >= scale / 2 and gaps[0].max() <= 2 * scale


@pytest.mark.parametrize("n,m,d,high", [(1, 1, 3, 5), (10, 60, 2, 3), (100, 1500, 4, 10), (200, 2000, 1, 900), (300, 1500, 24, 60)])
@pytest.mark.parametrize("known", [False, True])
def test_search(n, m, d, high, known):
    rng = np.random.default_rng(m)
    asked, given = points(rng, n, d, high), points(rng, m, d, high)
    queries, data = covertree.build_tree(asked, 4), covertree.build_tree(given, 4)
    products = asked @ given.T
    bar = np.sort(products, axis=1)[:, -min(3, len(given))] if known else np.full(len(asked), -np.inf)
    at, ids, scores = covertree.search(queries, data, data.order * 2 + 1, 6, bar[queries.order])
    got = {}
    for q, i, s in zip(queries.order[at].tolist(), ids.tolist(), scores.tolist(), strict=True):
        got.setdefault(q, set()).add((-s, i))
    for q in range(len(asked)):
        best = sorted((-int(s), 2 * i + 1) for i, s in enumerate(products[q]))[:6]
        assert {x for x in got.get(q, set()) if -x[0] >= bar[q]} == {x for x in best if -x[0] >= bar[q]}


def plain(rows, k, divisor):
    x = {i: [int(np.floor(256 * v)) for v in e] for i, e in rows}
    out = []
    for q in (i for i in x if i % divisor == 0):
        scores = sorted((-sum(a * b for a, b in zip(x[q], y, strict=False)), i) for i, y in x.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("spread,block", [(1.0, 64), (0.02, 200)])
def test_many_trees(spark, monkeypatch, spread, block):
    """Several cells, blocks and pages, clusters that can be pruned, and many copies of one vector."""
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 8)
    monkeypatch.setattr(covertree, "PAGE", 5)
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((12, 8))
    made = centres[rng.integers(0, 12, 900)] + spread * rng.standard_normal((900, 8))
    made[100:400] = made[100]
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in covertree.top_products(table, F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == plain(rows, 5, 20)


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, x string, node int, score double"
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (50, [0.25, 2.0])]
    bad = [(4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 0.0]), (None, [1.0, 1.0])]
    again = [(0, [1.0, 0.5]), (2, [5.0, 5.0])]  # of two rows with one id the smaller vector stands
    short = [(8, [0.5]), (100, [])]
    table = spark.createDataFrame([(i, e, "clash", 1, 0.5) for i, e in good + bad + again + short], schema)
    got = sorted(tuple(r) for r in covertree.top_products(table, F.col("vec_id") % 50 == 0).collect())
    assert got == plain([(i, e + [0.0] * (2 - len(e))) for i, e in good + short], 5, 50)
    few = table.where("vec_id in (0, 2)")
    assert sorted(tuple(r) for r in covertree.top_products(few.where("embedding[0] < 2"), F.col("vec_id") == 0).collect()) == [(0, 1, 2, -65536)]
    for none in (table.where("false"), table.where("vec_id in (4, 5)"), table.where("vec_id in (1, 2)")):
        assert covertree.top_products(none, F.col("vec_id") % 50 == 0).count() == 0
    alone = covertree.top_products(table.where("vec_id = 50"), F.col("vec_id") % 50 == 0)
    assert alone.columns == ["query_id", "rank", "vec_id", "score"] and alone.count() == 0
    with pytest.raises(Exception, match="inner products beyond"):
        covertree.top_products(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), F.lit(True)).count()
