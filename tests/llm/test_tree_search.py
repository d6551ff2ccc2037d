"""The k-means tree's search in packed rows: nothing grows with queries times leaves, and what is visited is searched exactly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equity_jobs.llm import kmeans_tree
from equity_jobs.llm.kmeans_tree import Block, Points


def scores(a, points):
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.cumsum(a.astype(float) * points.astype(float), axis=1)[:, -1]
    return np.where(np.isnan(out), -np.inf, out)


def brute(ids, points, asked, k):
    out = {}
    for i in asked:
        score = scores(points[i], points)
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score)) if j != i][:k]
    return out


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append((r[2], r[3]))
    return out


def test_no_table_has_a_row_for_each_visit(spark, monkeypatch):
    """As it did before: queries times leaves, each with the query's vector, and one batch of a task held all visits of its queries."""
    tables = {}

    def kept(df, name, *args, **options):
        tables[name] = real(df, name, *args, **options)
        return tables[name]

    real = kmeans_tree.written
    monkeypatch.setattr(kmeans_tree, "written", kept)
    points = np.random.default_rng(3).normal(size=(2000, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>")
    found = kmeans_tree.nearest(table, k=3, every=4, leaf_rows=20).count()
    assert found == 3 * 500
    assert max(t.count() for t in tables.values()) <= 2000
    held = {n: sum(r.n for r in t.select(sum(F.octet_length(c) for c, kind in t.dtypes if kind == "binary").alias("n")).collect()) for n, t in tables.items() if "binary" in dict(t.dtypes).values()}
    assert sum(held.values()) <= 3 * 2000 * (16 * 4 + 8)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_leaves_give_the_exact_best(spark, kind):
    draw = np.random.default_rng(6)
    points = draw.normal(size=(1500, 8)).astype(np.float32)
    points[200:500] = points[7]  # copies fill several packed rows and tie
    points[600:640] = points[600:640].round()
    points[900], points[901] = 3e4 * points[7], -3e4 * points[7]
    if kind == "double":
        points = points.astype(float)
        points[1000, 0], points[1001, 0], points[1002] = 1e300, 1e300, 1e-200
        points[1020] = [1e300, 1e300, *[0.0] * 6]
    ids = draw.permutation(3000)[:1500] - 500
    table = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points, strict=True)], f"id bigint, v array<{kind}>").repartition(3)
    index = kmeans_tree.build(table, F.col("id") % 7 == 0, sample=400, leaf_rows=50)
    assert index.asking == (ids % 7 == 0).sum() and index.tree.leaves > 8
    width = 8 * (4 if kind == "float" else 8)
    for packed in (0, 200 * width):  # rows of 32, and of 200 at most
        got = kmeans_tree.search(index, 20, index.tree.leaves, packed=packed)
        assert ranked(got.collect()) == brute(ids, points, np.flatnonzero(ids % 7 == 0), 20)


def test_order_and_visits_are_those_of_the_walk():
    draw = np.random.default_rng(8)
    points = np.vstack([draw.normal(size=(900, 5)), draw.normal(size=(100, 5)) * 0.01 + 3])
    tree = kmeans_tree.grow(points, 100_000, 900, branching=3)
    assert tree.leaves > 30 and tree.paths.shape[1] > 4
    queries = draw.normal(size=(70, 5))
    assert tree.order(queries).tolist() == [list(tree.walk(q)) for q in queries]
    rows = draw.integers(0, 3, tree.leaves)
    for visits, k in ((1, 0), (3, 9), (9, 2), (2, 10**6)):
        want = np.zeros((70, tree.leaves), bool)
        for i, q in enumerate(queries):
            held = 0
            for seen, leaf in enumerate(tree.walk(q)):
                if seen >= visits and held > k:
                    break
                want[i, leaf], held = rows[leaf] > 0, held + rows[leaf]
        assert (tree.visited(queries, visits, rows, k) == want).all()


def test_a_block_keeps_the_best_of_what_it_meets():
    draw = np.random.default_rng(9)
    points = draw.normal(size=(700, 4)).round(1)
    points[3, 0] = 1e9
    ids = draw.permutation(700)
    asked = np.arange(0, 60)
    block = Block(Points.of(ids[asked], points[asked]), np.full((60, 2), 255, np.uint8), 10)
    for i, start in enumerate(range(0, 700, 50)):
        block.meet(i, Points.of(ids[start : start + 50], points[start : start + 50]))
        assert block.new <= 60 * 10
    got = [(q, rank, i, s) for rank, (q, i, s) in enumerate(zip(*block.settle(), strict=True))]
    assert ranked(got) == brute(ids, points, asked, 10)
    none = Block(Points.of(ids[asked], points[asked]), np.zeros((60, 2), np.uint8), 10)
    none.meet(1, Points.of(ids, points))
    assert [len(c) for c in none.settle()] == [0, 0, 0]


def test_small_batches_end_with_the_search(spark):
    name = kmeans_tree.SENT[0]
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError), kmeans_tree.sent(spark):
        assert int(spark.conf.get(name)) == kmeans_tree.SENT[1]
        raise KeyError
    assert spark.conf.get(name, None) == before
    spark.conf.set(name, "1234567")
    with kmeans_tree.sent(spark):
        pass
    assert spark.conf.get(name) == "1234567"
    spark.conf.unset(name)
