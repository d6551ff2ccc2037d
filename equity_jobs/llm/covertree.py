"""Exact top-k search by inner product with dual cover trees.

The upper level of the trees is a net of pivots: every vector belongs to the cell of its
nearest pivot, and cells are dealt out as blocks of bounded size. A block of queries meets
a block of data only if the pivots and covering radii allow a score as good as the block's
worst bound so far. Where they meet, a cover tree is built over either side, and node
pairs are visited best first and pruned by their radii against the worst k-th score of
the queries below the node.

A tree's level i is a net of the points: each level holds the one above (nesting), its
points are over radius(i) apart (separation), and every point lies within radius(i) of its
parent in level i (covering), radii being halves of each other.

Scores are integers of any size. They are summed in double precision where that is exact;
otherwise a double with an error bound, which goes with the lengths of the two vectors, finds
the candidates and Python's integers rank them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.llm.common import written

LEAF = 128  # points that are compared at once
EXACT = float(1 << 53)  # integers up to here are exact in double precision
WHOLE = float(1 << 46)  # from here on every double times 64 is an integer
LONGEST = (1 << 63) - 1
TINY = 2.0**-1074  # what a product that is too small for full precision may be off by
FINITE = 500  # components up to this power of two have finite products
THIN = 8  # a level whose balls would hold fewer points than this on average prunes nothing


def quantised(vector: Column) -> Column:
    """Components as floor(64 * x) / 64 in double precision, which is exact and never overflows;
    null where the vector is null or holds a null or non-finite component."""

    def part(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < WHOLE, F.floor(x * 64).cast("double") / 64).otherwise(x)

    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.when(sound, F.transform(vector, part))


def whole(vector: np.ndarray) -> list[int]:
    """The integers 64 * x of a vector of quantised()."""
    return [int(x * 64) if abs(x) < WHOLE else int(x) * 64 for x in vector.tolist()]


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (abs(score).bit_length() + 7) // 8
    body = (1 << 31) + (size if score >= 0 else -size)
    return body.to_bytes(4, "big") + (abs(score) if score >= 0 else (1 << 8 * size) - 1 - abs(score)).to_bytes(size, "big")


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Lengths along the last axis, and no less than they are where squares are too small for full precision."""
    return np.sqrt((vectors**2).sum(-1) + vectors.shape[-1] * TINY)


def net_levels(points: np.ndarray, fewest: int = 1) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float, np.ndarray]]]:
    """order: points, each the farthest from those before it. gap: how far that is.
    levels: from the top, how many points of the order form the level, its radius, and the
    place in the order of each point's nearest of them.

    The levels end where every distinct point is in the net, or before the first whose balls
    would hold fewer than `fewest` points on average. Repeated points have gap 0.
    """
    n = len(points)
    first = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    order, gap = [first], [np.inf]
    near = np.sqrt(((points - points[first]) ** 2).sum(1))
    of = np.zeros(n, np.int64)
    radius = float(near.max())
    levels = [(1, radius, of.copy())]
    while near.max() > 0:
        radius /= 2
        while near.max() > radius:
            nxt = int(np.argmax(near))
            if (len(order) + 1) * fewest > max(n, 1) and fewest > 1:
                return np.array(order), np.array(gap), levels
            far = np.sqrt(((points - points[nxt]) ** 2).sum(1))
            closer = far < near
            order.append(nxt)
            gap.append(float(near[nxt]))
            near, of = np.where(closer, far, near), np.where(closer, len(order) - 1, of)
            if len(order) == n:
                near[:] = 0
        if len(order) > levels[-1][0]:
            levels.append((len(order), radius, of.copy()))
    return np.array(order), np.array(gap), levels


@dataclass
class Node:
    """A ball: its centre, the covering radius of all points below, and either children or points."""

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray) -> Node:
    """The cover tree of net_levels(). A node of LEAF points or fewer is not split; children of
    one point each, and the points of a node below which a level would take in nearly all at
    once, are compared LEAF at a time under the covering radius of their bundle."""
    order, _, levels = net_levels(points, THIN)

    def node(level: int, centre: int, index: np.ndarray) -> Node:
        own = points[index]
        made = Node(points[centre], float(lengths(own - points[centre]).max()), index)
        if len(index) <= LEAF or level + 1 == len(levels) or made.radius == 0:
            return made if len(index) <= LEAF else bundled(made)
        of = levels[level + 1][2][index]
        places, of = np.unique(of, return_inverse=True)
        sizes = np.bincount(of)
        single = sizes[of] == 1
        made.children = [node(level + 1, order[places[c]], index[of == c]) for c in np.flatnonzero(sizes > 1)]
        if single.any():
            rest = bundled(Node(made.centre, made.radius, index[single]))
            made.children += rest.children or [rest]
        return made

    def bundled(whole_: Node) -> Node:
        away = ((points[whole_.points] - whole_.centre) ** 2).sum(1)
        parts = np.array_split(whole_.points[np.argsort(away, kind="stable")], -(-len(away) // LEAF))
        if len(parts) > 1:
            whole_.children = [Node(whole_.centre, float(lengths(points[p] - whole_.centre).max()), p) for p in parts]
        return whole_

    return node(0, order[0], np.arange(len(points)))


def error(a: np.ndarray, b: np.ndarray, slack: float, dim: int) -> np.ndarray:
    """How far the scores of vectors of lengths a and b may be from the true ones."""
    return slack * np.outer(a, b) + 2 * dim * TINY if slack else np.zeros((len(a), len(b)))


class Search:
    """The k best data points of each query, by integer score, then by smaller id.

    slack: how far a score in double precision may be from the true one, as a share of the two
    lengths' product. Where it is above 0, all that may be among the k best are kept, for
    exact ranking; scores are then the least that they may be.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0) -> None:
        self.queries, self.query_ids, self.data, self.ids, self.k, self.slack = queries, query_ids, data, ids, k, slack
        self.worst = bounds.astype(np.float64)  # a score that the k-th best reaches at least
        self.scores = np.full((len(queries), k), -np.inf)
        self.best = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # with slack: query, data point, the most that the score may be
        self.held, self.room = 0, 1 << 20  # rows of near, and at how many those that fell behind go
        self.pairs = 0  # compared
        self.total = len(queries) * len(data)
        self.sizes = lengths(queries), lengths(data)

    def bound(self, q: Node, d: Node) -> float:
        a, b = float(lengths(q.centre)), float(lengths(d.centre))
        most = float(q.centre @ d.centre) + q.radius * b + d.radius * a + q.radius * d.radius
        return most + (1e-9 + 2 * self.slack) * (a + q.radius) * (b + d.radius) + 4 * len(q.centre) * TINY

    def visit(self, q: Node, d: Node) -> None:
        todo = [(q, d, self.bound(q, d))]
        while todo:
            q, d, most = todo.pop()
            if most < self.worst[q.points].min():
                continue
            if not q.children and not d.children:
                self.compare(q.points, d.points)
                continue
            split_query = q.children and (not d.children or q.radius >= d.radius)
            pairs = [(c, d) for c in q.children] if split_query else [(q, c) for c in d.children]
            todo += sorted(((a, b, self.bound(a, b)) for a, b in pairs), key=lambda x: x[2])  # the best is popped first

    def compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        self.pairs += len(rows) * len(columns)
        scores = self.queries[rows] @ self.data[columns].T
        ids = self.ids[columns]
        scores[self.query_ids[rows][:, None] == ids[None, :]] = -np.inf
        most = scores
        if self.slack:
            off = error(self.sizes[0][rows], self.sizes[1][columns], self.slack, self.data.shape[1])
            scores, most = scores - off, scores + off
        reach = most >= self.worst[rows][:, None]
        hit = np.flatnonzero(reach.any(1))
        if not len(hit):
            return
        if self.slack:
            at, column = np.nonzero(reach & np.isfinite(most))
            self.near.append((rows[at], columns[column], most[at, column]))
            self.held += len(at)
        rows, scores = rows[hit], scores[hit]
        merged = np.concatenate([self.scores[rows], scores], 1)
        names = np.concatenate([self.best[rows], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((names, -merged), axis=1)[:, : self.k]
        self.scores[rows], self.best[rows] = np.take_along_axis(merged, order, 1), np.take_along_axis(names, order, 1)
        self.worst[rows] = np.maximum(self.worst[rows], self.scores[rows, -1])
        if self.held > self.room:
            self.near = [self.abreast()]
            self.held = len(self.near[0][0])
            self.room = max(2 * self.held, 1 << 20)

    def abreast(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of near that may still be among their query's k best."""
        row, column, most = (np.concatenate(c) for c in zip(*self.near, strict=True))
        kept = most >= self.worst[row]
        return row[kept], column[kept], most[kept]

    def ranked(self, unit: float) -> tuple[list[int], list[int], list[int]]:
        """query id, data id and exact score of the k best. Scores in double precision are in units of `unit`."""
        if not self.slack:
            found = np.isfinite(self.scores)
            exact = np.rint(self.scores[found] * unit).astype(np.int64).tolist()
            return np.broadcast_to(self.query_ids[:, None], found.shape)[found].tolist(), self.best[found].tolist(), exact
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        if not self.near:
            return out
        row, column, _ = self.abreast()
        for r in np.unique(row).tolist():
            query = self.exact_queries(r)
            scored = sorted((-sum(x * y for x, y in zip(query, self.exact_data(c), strict=True)), int(self.ids[c])) for c in column[row == r].tolist())
            for negated, name in scored[: self.k]:
                out[0].append(int(self.query_ids[r]))
                out[1].append(name)
                out[2].append(-negated)
        return out


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to count vectors of the sample, each the farthest from those before it."""
    chosen, near = [0], np.sqrt(((sample - sample[0]) ** 2).sum(1))
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(1)))
    return sample[chosen]


def _stack(cells: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), "<f8").reshape(-1, dim)


def _padded(vectors: list[list[float]], dim: int) -> np.ndarray:
    return np.array([[*v, *[0.0] * (dim - len(v))] for v in vectors], np.float64).reshape(-1, dim)


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, block: int = 4096, query_block: int = 2048, sample: int = 2048, cells: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of all other vectors, for each id that `every` divides.

    Scores are inner products of the components floor(64 * x), x any finite double; ties go
    to the smaller id; a query with fewer than k others has them all. Ranks follow the exact
    integers; a score that no long holds is given as the nearest long. Null ids, null
    vectors and vectors with null or non-finite components take no part. Shorter vectors
    count as padded with zeros. An id that repeats is taken once, with the vector that
    sorts first. Other columns are not read; no rows: no rows. sample and cells bound what
    the driver sees: the vectors whose ids hash lowest, which give the pivots and each
    query's first bound, one row a cell, and the pairs of cells. block and query_block
    bound what meets in a task.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    valid = vectors.select(vectors[id_col].cast("bigint").alias("id"), quantised(vectors[vector_col]).alias("v")).where("id is not null and v is not null")
    valid = valid.groupBy("id").agg(F.min("v").alias("v"))
    size = valid.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    count, dim, largest = size[0], max(size[1] or 1, 1), float(size[2] or 0)
    wide = largest >= WHOLE or (64 * largest) ** 2 * dim >= EXACT
    # powers of two by which components go down: they stay exact, and their products finite
    down = max(int(np.frexp(largest)[1]) - FINITE, 0)
    slack = 2.0 * dim * 2.0**-52 if wide else 0.0
    unit = 4096.0  # (64 x) (64 y)
    scaled = lambda points: np.ldexp(points, -down) if down else points
    known = valid.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    sampled = scaled(_padded([r.v for r in known], dim))
    sampled_ids = np.array([r.id for r in known], np.int64)
    pivots = _pivots(sampled, min(cells, -(-count // block))) if count else sampled
    pivot_squares, pivot_lengths = (pivots**2).sum(1), lengths(pivots)

    def assign(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            ids = batch.column("id").to_numpy()
            vecs = _padded(batch.column("v").to_pylist(), dim)
            own = scaled(vecs)
            cell = np.argmin(pivot_squares - 2 * own @ pivots.T, axis=1)
            away = lengths(own - pivots[cell])
            bound = np.full(len(ids), -np.inf)
            asks = np.flatnonzero(ids % every == 0)
            if len(asks) and len(sampled) > k:
                scores = own[asks] @ sampled.T - error(lengths(own[asks]), lengths(sampled), slack, dim)
                scores[ids[asks][:, None] == sampled_ids] = -np.inf
                bound[asks] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.astype("<f8").tobytes() for v in vecs], pa.binary()), pa.array(cell), pa.array(away), pa.array(ids % every == 0), pa.array(bound)], names=["id", "v", "cell", "away", "asks", "bound"])

    placed = written(valid.mapInArrow(assign, "id bigint, v binary, cell bigint, away double, asks boolean, bound double"), "vectors")
    stats = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.sum(F.col("asks").cast("bigint")).alias("asking"), F.max(F.when(F.col("asks"), F.col("away"))).alias("q_radius"), F.min(F.when(F.col("asks"), F.col("bound"))).alias("q_bound")).collect()}  # one row a cell

    # query blocks are made of neighbouring cells; a cell with many queries is several blocks
    blocks: dict[int, tuple[int, int]] = {}  # cell -> first block, blocks
    last, room = -1, 0
    for cell in sorted(c for c, r in stats.items() if r.asking):
        need = stats[cell].asking
        if need <= room:
            blocks[cell], room = (last, 1), room - need
        else:
            blocks[cell] = (last + 1, -(-need // query_block))
            last += blocks[cell][1]
            room = query_block - need if blocks[cell][1] == 1 else 0

    def reach(q: int, d: int) -> bool:
        a, b, r, s = pivot_lengths[q], pivot_lengths[d], stats[q].q_radius, stats[d].radius
        most = float(pivots[q] @ pivots[d]) + r * b + s * a + r * s
        return most + (1e-9 + 2 * slack) * (a + r) * (b + s) + 4 * dim * TINY >= stats[q].q_bound

    meets = [(q, d) for q in blocks for d in stats if reach(q, d)]  # at most cells x cells
    chunks = {d: -(-r.n // block) for d, r in stats.items()}
    spark = vectors.sparkSession
    deal = spark.createDataFrame([(c, chunks[c], *blocks.get(c, (0, 1))) for c in stats], "cell bigint, chunks bigint, first bigint, q_blocks bigint")
    asking = deal.select(F.col("cell").alias("q_cell"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("q_blocks") - 1)).alias("q_block"))
    pairs = spark.createDataFrame(meets, "q_cell bigint, cell bigint").join(asking, "q_cell").select("cell", "q_block").distinct()
    dealt = placed.join(F.broadcast(deal), "cell")  # one row a cell
    data = dealt.join(pairs, "cell").select("q_block", F.col("cell").alias("d_cell"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), F.lit(False).alias("query"), "id", "v", "bound")
    homes = deal.select(F.col("cell").alias("d_cell"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    visits = pairs.select(F.col("cell").alias("d_cell"), "q_block").join(homes, "d_cell")
    asked = dealt.where("asks").withColumn("q_block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("q_blocks")))
    asked = asked.select("q_block", "id", "v", "bound").join(visits, "q_block").select("q_block", "d_cell", "chunk", F.lit(True).alias("query"), "id", "v", "bound")

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("query").to_numpy()
        ids, vecs = table.column("id").to_numpy(), _stack(table.column("v"), dim)
        out: tuple[list, list, list] = ([], [], [])
        if is_query.any() and not is_query.all():
            run = Search(scaled(vecs[is_query]), ids[is_query], table.column("bound").to_numpy()[is_query], scaled(vecs[~is_query]), ids[~is_query], k, slack)
            run.exact_queries, run.exact_data = lambda r: whole(vecs[is_query][r]), lambda c: whole(vecs[~is_query][c])
            run.visit(cover_tree(run.queries), cover_tree(run.data))
            out = run.ranked(unit)
        key = [sortable(s) if wide else None for s in out[2]]
        held = [max(-LONGEST - 1, min(LONGEST, s)) for s in out[2]]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(held, pa.int64()), "key": pa.array(key, pa.binary())})

    near = data.unionByName(asked).groupBy("q_block", "d_cell", "chunk").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint, key binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(kind), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast(kind), "score")
