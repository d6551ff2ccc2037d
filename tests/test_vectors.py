"""Exact cosine search against brute force, and how much it compares."""

import numpy as np
import pytest

from equity_jobs.operators import vectors

KIND = "id bigint, vector array<double>, place string"


def brute(asked, held, k):
    out = {}
    unit = lambda v: np.array(v) / np.linalg.norm(v) if np.any(v) else np.zeros(len(v))
    units = [(i, unit(v)) for i, v in held if i is not None and v is not None]
    for q, v in asked:
        if q is None or v is None:
            continue
        scored = sorted(((-round(float(unit(v) @ u), 12), i) for i, u in units if i != q))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def rows_of(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append((r.passage_id, round(r.semantic, 12)))
    return got


@pytest.mark.parametrize("clustered", [True, False])
def test_search_equals_brute_force(spark, clustered):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(30, 16)) * 6
    points = [(i, [float(x) for x in (centres[i % 30] if clustered else 0) + draw.normal(size=16) * 0.4]) for i in range(2400)]
    points += [(3000 + i, points[5][1]) for i in range(300)] + [(4000, [0.0] * 16), (4001, [0.0] * 16), (4002, None), (None, points[0][1]), (4003, [1e300] * 16)]
    asked = [p for p in points if p[0] is None or p[0] % 40 == 0] + [(-1, [0.0] * 16), (-2, [-x for x in points[3][1]])]
    table, ask = (spark.createDataFrame([(*p, "x") for p in own], KIND).repartition(4) for own in (points, asked))
    found, share = vectors.cosine_search(ask, table, 6, block=4, sample=600, cells=40)
    want = brute(asked, points, 6)
    got = rows_of(found)
    assert got.keys() == want.keys()
    for q, own in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in own] and np.allclose([s for _, s in got[q]], [s for _, s in own], atol=2e-12)
    assert share <= (0.35 if clustered else 1.0)


def test_search_edges(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "x")], KIND)
    assert rows_of(vectors.cosine_top_k(table, table, 5)) == {1: [(2, 0.0)], 2: [(1, 0.0)]}
    assert vectors.cosine_top_k(table.limit(0), table, 5).count() == 0
    assert vectors.cosine_top_k(table, table.limit(0), 5).count() == 0
    assert vectors.cosine_top_k(table.where("id = 1"), table.where("id = 1"), 5).count() == 0
