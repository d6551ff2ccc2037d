"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then placed in one of its leaves.
A query walks the tree best bin first: a priority queue holds open nodes by the score that
their centre and spread promise, the best is taken, an inner node gives way to its
children, a leaf is visited. How many leaves a query visits is calibrated: for some queries
the true neighbours are found by comparing them with all vectors, and visits are widened
until the walks reach the wanted share of them. Queries and neighbouring leaves are packed
into rows of bounded size, and every pair of them that has a visit meets in a task, which
keeps each query's best: no row is written for a visit, and vectors are not copied for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equity_jobs.llm.common import relieve, written

SPREAD = 0.3  # of |query| x a node's spread, added to what its centre promises
PACKED = 1 << 20  # bytes of vectors that a packed row holds at most
FILED = 8  # packed rows a file, which bounds what its writer and readers hold
SENT = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)  # of pairs of packed rows; Spark's own 64 MB are held several times over in each task
CELLS = 1 << 21  # of a matrix of scores or promises that is held at once


def sound(vector: Column, kind: str = "double") -> Column:
    """The vector as array<kind>; null where it is null, zero or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.when(finite & F.exists(vector, lambda x: x != 0), F.transform(vector, lambda x: x.cast(kind)))


@dataclass
class Tree:
    """Nodes in one table: centres, spreads (root mean square distance), children (none: a leaf) and, of leaves, their number."""

    centres: np.ndarray
    spreads: np.ndarray
    children: list[list[int]]
    leaf_of: list[int]

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest child at every node."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, index = todo.pop()
            if not self.children[node]:
                out[index] = self.leaf_of[node]
                continue
            centres = self.centres[self.children[node]]
            nearest = _nearest(points[index], centres)
            todo += [(child, index[nearest == i]) for i, child in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        promise = self.centres @ query + SPREAD * np.linalg.norm(query) * self.spreads
        heap = [(-promise[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                yield self.leaf_of[node]
            for child in self.children[node]:
                heapq.heappush(heap, (-promise[child], child))

    @cached_property
    def paths(self) -> np.ndarray:
        """The nodes from each leaf up to the root; shorter paths begin with the leaf again."""
        found: list[list[int]] = [[] for _ in range(self.leaves)]
        todo = [(0, [0])]
        while todo:
            node, path = todo.pop()
            if not self.children[node]:
                found[self.leaf_of[node]] = path
            todo += [(child, [child, *path]) for child in self.children[node]]
        depth = max(map(len, found))
        return np.array([[path[0]] * (depth - len(path)) + path for path in found])

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Each query's leaves as walk() yields them.

        A node waits for the least promise above it, so leaves come by the least promise on their
        paths; those that share the node of that promise, by the least one below it, and so on.
        """
        promise = queries @ self.centres.T + SPREAD * np.linalg.norm(queries, axis=1)[:, None] * self.spreads
        least = np.minimum.accumulate(promise.T[self.paths.T], axis=0)  # level, leaf, query
        return np.lexsort(-least.transpose(0, 2, 1))  # the whole path's decides first

    def visited(self, queries: np.ndarray, visits: int, rows: np.ndarray, k: int) -> np.ndarray:
        """Whether each query visits each leaf: `visits` of them, and on until they hold it and k others, or all. rows: of each leaf."""
        out = np.zeros((len(queries), self.leaves), bool)
        step = max(1, CELLS // self.paths.size)
        for start in range(0, len(queries), step):
            order = self.order(queries[start : start + step])
            held = np.cumsum(rows[order], axis=1)
            taken = np.arange(self.leaves) < np.maximum(visits, (held <= k).sum(1) + 1)[:, None]
            np.put_along_axis(out[start : start + step], order, taken, axis=1)
        return out & (rows > 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)


def _split(points: np.ndarray, count: int, draw: np.random.Generator, turns: int = 8) -> np.ndarray:
    """Lloyd's k-means: each point's cluster of at most count, none empty, numbered from 0."""
    centres = points[draw.choice(len(points), count, replace=False)]
    for _ in range(turns):
        nearest = _nearest(points, centres)
        held = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return np.unique(_nearest(points, centres), return_inverse=True)[1]


def grow(sample: np.ndarray, rows: int, leaf_rows: int, branching: int = 8, seed: int = 7) -> Tree:
    """A tree whose leaves hold leaf_rows of `rows` rows, as far as the sample goes: a node is
    split while it stands for more and has over 2 x branching points that differ."""
    draw = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, sample.shape[1])), np.zeros(0), [], [])
    centres, spreads, leaf = [], [], 0
    todo: list[tuple[int | None, np.ndarray]] = [(None, np.arange(len(sample)))]
    while todo:
        parent, index = todo.pop()
        own, node = sample[index], len(centres)
        centre = own.mean(0) if len(own) else np.zeros(sample.shape[1])
        spread = float(np.sqrt(((own - centre) ** 2).sum(1).mean())) if len(own) else 0.0
        centres.append(centre)
        spreads.append(spread)
        tree.children.append([])
        tree.leaf_of.append(-1)
        if parent is not None:
            tree.children[parent].append(node)
        share = len(own) * rows / max(len(sample), 1)
        if share > leaf_rows and len(own) > 2 * branching and spread > 0:
            # no more children than leaves are wanted below
            of = _split(own, min(branching, max(2, round(share / leaf_rows))), draw)
            if of.max() > 0:
                todo += [(node, index[of == c]) for c in range(of.max() + 1)]
                continue
        tree.leaf_of[node], leaf = leaf, leaf + 1
    tree.centres, tree.spreads = np.array(centres), np.array(spreads)
    return tree


@dataclass
class Points:
    """Vectors as they are stored, and over scale in single precision with their lengths."""

    ids: np.ndarray
    exact: np.ndarray
    rough: np.ndarray
    lengths: np.ndarray
    scale: float

    @classmethod
    def of(cls, ids: np.ndarray, exact: np.ndarray) -> Points:
        scale = max(float(np.abs(exact).max(initial=0)), 1e-300)
        scaled = exact / np.float64(scale)  # products stay finite
        return cls(ids, exact, scaled.astype(np.float32), np.linalg.norm(scaled, axis=1), scale)

    def part(self, where: np.ndarray | slice) -> Points:
        return Points(self.ids[where], self.exact[where], self.rough[where], self.lengths[where], self.scale)


def _in_order(a: np.ndarray, q: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of rows q of a and d of b, summed component by component: equal vectors have equal scores wherever they are."""
    total = np.zeros(len(q))
    step = max(1, CELLS // a.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, len(q), step):
            for cells in (a[q[i : i + step]].astype(np.float64) * b[d[i : i + step]]).T:
                total[i : i + step] += cells
    return np.where(np.isnan(total), -np.inf, total)


def best(queries: Points, bounds: np.ndarray, data: Points, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, data point and score of other data points that reach a query's bound, its k best at least if so many do.

    A matrix product in single precision finds what may be among them; each pair's own
    rounding error is allowed for.
    """
    step = max(1, CELLS // max(len(data.ids), 1))
    found = [_best(queries.part(slice(i, i + step)), bounds[i : i + step], data, k) for i in range(0, len(queries.ids), step)]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    parts = zip(*((q + i * step, d, score) for i, (q, d, score) in enumerate(found)), strict=True)
    return tuple(np.concatenate(p) for p in parts) if found else none


def _best(queries: Points, bounds: np.ndarray, data: Points, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    share, tiny = (queries.exact.shape[1] + 8) * 2.0**-23, 1e-30  # the error of a rough score, of the product of both lengths
    rough = queries.rough @ data.rough.T
    with np.errstate(over="ignore"):
        # a bound that is infinite is reached by scores that overflow
        reach = np.minimum(bounds, np.finfo(float).max) / queries.scale / data.scale
        cut = reach - queries.lengths * data.lengths.max(initial=0) * share * 2 - tiny
        able = rough >= cut.astype(np.float32)[:, None]
    if (queries.ids.min(initial=0) <= data.ids.max(initial=0)) and (data.ids.min(initial=0) <= queries.ids.max(initial=0)):
        own = queries.ids[:, None] == data.ids[None, :]
        able &= ~own
        rough[own] = -np.inf
    free = np.flatnonzero(bounds == -np.inf)
    if len(free) and len(data.ids) > k:
        slack = queries.lengths[free, None] * data.lengths * share + tiny
        least = np.partition(rough[free] - slack, -k, axis=1)[:, -k]
        able[free] &= rough[free] + slack >= least[:, None]
    q, d = np.divmod(np.flatnonzero(able), len(data.ids))
    near = rough[q, d] + queries.lengths[q] * data.lengths[d] * share + tiny >= reach[q]
    q, d = q[near], d[near]
    score = _in_order(queries.exact, q, data.exact, d)
    reached = score >= bounds[q]
    return q[reached], d[reached], score[reached]


def _first(q: np.ndarray, d: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, d and score of each q's k best, in order."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], d[order][kept], score[order][kept]


@dataclass
class Block:
    """Queries that were packed together, the leaves each visits (a bit each), and what is best for them so far."""

    queries: Points
    visits: np.ndarray
    k: int
    bounds: np.ndarray = field(init=False)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(init=False, default_factory=list)
    new: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        self.bounds = np.full(len(self.queries.ids), -np.inf)

    def meet(self, leaf: int, data: Points) -> None:
        """Takes in (a part of) a leaf."""
        asking = np.flatnonzero(self.visits[:, leaf >> 3] & (128 >> (leaf & 7)))
        if len(asking):
            q, d, score = best(self.queries.part(asking), self.bounds[asking], data, self.k)
            self.found.append((asking[q], data.ids[d], score))
            self.new += len(q)
            if self.new > len(self.queries.ids) * self.k:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query id, id and score of the k best; what comes later must reach the last of them."""
        if not self.found:
            return self.queries.ids[:0], self.queries.ids[:0], np.zeros(0)
        q, ids, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
        q, ids, score = _first(q, ids, ids, score, self.k)
        last = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
        self.bounds[q[last]] = score[last]
        self.found, self.new = [(q, ids, score)], 0
        return self.queries.ids[q], ids, score


def _matrix(cells: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows, shorter ones padded with zeros."""
    size = np.diff(cells.offsets.to_numpy())
    out = np.zeros((len(cells), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = cells.flatten().to_numpy()
    return out


def _packed(points: np.ndarray, kind: str) -> pa.Array:
    return pa.array([p.tobytes() for p in points.astype(kind)], pa.binary())


def _unpacked(cells: pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), kind).reshape(-1, dim)


@dataclass
class Index:
    """placed: id, v (bytes of numbers of that kind), leaf and asks (whether it is a query), as a written table; the tree of the vectors over scale; rows by leaf; how many ask."""

    placed: DataFrame
    tree: Tree
    scale: float
    rows: dict[int, int]
    asking: int
    dim: int
    kind: str


def build(vectors: DataFrame, asks: Column, sample: int = 16_384, leaf_rows: int = 200, branching: int = 8) -> Index:
    """Places every id of vectors (id, v), with the vector that sorts first, in the leaves of a tree fitted on the `sample` ids that hash lowest."""
    kind = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    named = written(vectors.groupBy("id").agg(F.max(F.size("v")).alias("size")), "ids")
    size = named.agg(F.count("*"), F.max("size")).first()
    count, dim = size[0], max(size[1] or 1, 1)
    drawn = F.broadcast(named.select("id").orderBy(F.xxhash64("id"), "id").limit(sample))
    known = vectors.join(drawn, "id").groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id"), "id").toArrow()
    points = _matrix(known.column("v").combine_chunks(), dim)
    scale = 2.0 ** (np.frexp(np.abs(points).max(initial=1.0))[1] - 1)  # squares stay finite
    tree = grow(points / scale, count, leaf_rows, branching)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(points, kind), pa.array(tree.place(points / scale)), batch.column("asks")], names=["id", "v", "leaf", "asks"])

    vectors = vectors.groupBy("id").agg(F.min("v").alias("v"))
    placed = written(vectors.select("id", "v", asks.alias("asks")).mapInArrow(place, "id bigint, v binary, leaf bigint, asks boolean"), "leaves")
    held = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).collect()  # one row a leaf
    return Index(placed, tree, scale, {r.leaf: r.n for r in held}, sum(r.asking for r in held), dim, kind)


def true_neighbours(index: Index, queries: pa.Table, k: int) -> pa.Table:
    """query_id, id, score and leaf of the k best of all other vectors: each task compares its rows with the few queries."""
    dim, kind = index.dim, index.kind
    names = queries.column("id").to_numpy()
    asked = Points.of(names, _unpacked(queries.column("v"), dim, kind))
    bounds = np.full(len(names), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            q, d, score = best(asked, bounds, Points.of(ids, _unpacked(batch.column("v"), dim, kind)), k)
            q, d, score = _first(q, d, ids[d], score, k)
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[d]), pa.array(score), batch.column("leaf").take(pa.array(d))], names=["query_id", "id", "score", "leaf"])

    found = index.placed.select("id", "v", "leaf").mapInArrow(run, "query_id bigint, id bigint, score double, leaf bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).toArrow()


def calibrate(index: Index, k: int, recall: float = 0.93, probes: int = 256) -> tuple[int, float]:
    """The fewest leaf visits with which the probes' mean recall, less two standard errors, is `recall`; and their recall.

    probes: the queries whose ids hash lowest, at most that many. Where no number of visits
    below all leaves reaches it, all leaves are visited, which is exact.
    """
    queries = index.placed.where("asks").orderBy(F.xxhash64("id"), "id").limit(probes).toArrow()
    if not queries.num_rows:
        return 1, 1.0
    truth = true_neighbours(index, queries, k)
    names = queries.column("id").to_numpy()
    order = np.argsort(names)
    leaves = index.tree.leaves
    places = np.zeros((len(names), leaves), np.int64)
    for i, q in enumerate(_unpacked(queries.column("v"), index.dim, index.kind) / np.float64(index.scale)):
        places[i, list(index.tree.walk(q))] = np.arange(leaves)
    of = order[np.searchsorted(names[order], truth.column("query_id").to_numpy())]
    visit = places[of, truth.column("leaf").to_numpy()]
    total = np.maximum(np.bincount(of, minlength=len(names)), 1)
    share = np.cumsum([np.bincount(of[visit == m], minlength=len(names)) for m in range(leaves)], axis=0) / total
    share[:, np.bincount(of, minlength=len(names)) == 0] = 1.0
    low = share.mean(1) - 2 * share.std(1) / np.sqrt(len(names))
    enough = np.flatnonzero(low >= recall)
    visits = int(enough[0]) + 1 if len(enough) else leaves
    return visits, float(share[visits - 1].mean())


@contextmanager
def sent(spark: SparkSession) -> Iterator[None]:
    """Batches for Python are small while the body runs."""
    before = spark.conf.get(SENT[0], None)
    spark.conf.set(*SENT)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SENT[0])
        else:
            spark.conf.set(SENT[0], before)


def search(index: Index, k: int, visits: int, packed: int = PACKED, parts: int = 4) -> DataFrame:
    """query_id, rank, vec_id and score of the k best in the leaves that each query visits.

    A query goes on past `visits` until its leaves hold k other vectors, or all. A row holds at most
    `packed` bytes of vectors, or half that of queries; few vectors make smaller rows. The leaves are
    dealt to `parts` tasks for each partition of queries, so a query's best come from at most that many.
    """
    dim, kind = index.dim, index.kind
    most = max(32, packed // (dim * np.dtype(kind).itemsize))
    few = lambda n, of: min(most // of, max(256 // of, n * of // 64))
    blocks, bundles = _blocks(index, k, visits, few(index.asking, 2)), _bundles(index, few(sum(index.rows.values()), 1))
    relieve(index.placed.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}
        last, leaves, data = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                names = np.frombuffer(row["q_ids"].as_buffer(), "<i8")
                if names[0] not in held:  # an id is in one block
                    bits = np.frombuffer(row["visits"].as_py(), np.uint8).reshape(len(names), -1)
                    asked = np.frombuffer(row["q_v"].as_py(), kind).reshape(-1, dim)
                    held[names[0]] = Block(Points.of(names.copy(), asked), bits, k)
                if row["bundle"].as_py() != last:
                    last = row["bundle"].as_py()
                    ends = np.cumsum(row["counts"].as_py())
                    leaves = list(zip(row["leaves"].as_py(), [0, *ends[:-1]], ends, strict=True))
                    data = Points.of(np.frombuffer(row["ids"].as_py(), "<i8"), np.frombuffer(row["v"].as_py(), kind).reshape(-1, dim))
                for leaf, start, end in leaves:
                    held[names[0]].meet(leaf, data.part(slice(start, end)))
        for own in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in own.settle()], names=["query_id", "vec_id", "score"])

    # each pair of packed rows meets in a task that reads both: nothing is shuffled for it
    pairs = bundles.coalesce(parts).join(blocks.hint("shuffle_replicate_nl"), F.arrays_overlap("leaves", "q_leaves")).drop("q_leaves")
    found = pairs.mapInArrow(compare, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    with sent(index.placed.sparkSession):
        return written(ranked, "nearest")


def _blocks(index: Index, k: int, visits: int, block: int) -> DataFrame:
    """The queries in rows of at most `block`, those of near leaves together: q_ids, q_v, visits (a bit a leaf and query) and q_leaves, those that any visits."""
    tree, scale, dim, kind = index.tree, index.scale, index.dim, index.kind
    rows = np.array([index.rows.get(leaf, 0) for leaf in range(tree.leaves)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                own = batch.slice(start, block)
                points = _unpacked(own.column("v"), dim, kind)
                visited = tree.visited(points / np.float64(scale), visits, rows, k)
                cells = [own.column("id").to_numpy().astype("<i8").tobytes(), points.tobytes(), np.packbits(visited, axis=1).tobytes()]
                yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in cells), pa.array([np.flatnonzero(visited.any(0))], pa.list_(pa.int64()))], names=["q_ids", "q_v", "visits", "q_leaves"])

    asked = index.placed.where("asks").repartitionByRange(max(1, -(-index.asking // block)), "leaf", "id").sortWithinPartitions("leaf", "id")
    return written(asked.select("id", "v").mapInArrow(pack, "q_ids binary, q_v binary, visits binary, q_leaves array<bigint>"), "queries", maxRecordsPerFile=FILED)


def _bundles(index: Index, block: int) -> DataFrame:
    """The vectors in rows of about `block` at most, of neighbouring leaves or of a part of one: bundle, its leaves and their counts, ids and v one after the other."""
    sizes, last, room = [], -1, 0
    for leaf in sorted(index.rows):
        count = index.rows[leaf]
        chunks = -(-count // block)
        if count > room:
            first, last, room = last + 1, last + chunks, max(0, block - count)
        else:
            first, room = last, room - count
        sizes.append((leaf, first, chunks))
    deal = F.broadcast(index.placed.sparkSession.createDataFrame(sizes, "leaf bigint, first bigint, chunks bigint"))  # one row a leaf

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("id", "ascending")])
        leaves, counts = np.unique(table.column("leaf").to_numpy(), return_counts=True)
        cells = [pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(table.column("v").to_pylist())], pa.binary())]
        lists = [pa.array([c], pa.list_(pa.int64())) for c in (leaves, counts)]
        return pa.Table.from_arrays([table.column("bundle").slice(0, 1).combine_chunks(), *lists, *cells], names=["bundle", "leaves", "counts", "ids", "v"])

    dealt = index.placed.join(deal, "leaf").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("chunks"))).alias("bundle"), "leaf", "id", "v")
    packed = dealt.groupBy("bundle").applyInArrow(pack, "bundle bigint, leaves array<bigint>, counts array<bigint>, ids binary, v binary")
    return written(packed, "bundles", maxRecordsPerFile=FILED)


def nearest(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, recall: float = 0.93, **fit: int) -> DataFrame:
    """query_id, rank, vec_id and score (inner product in double precision) of about the k best other vectors, for each id that `every` divides.

    Ties go to the smaller id; with k others or fewer a query gets them all. Null ids and
    null, zero or non-finite vectors take no part. Shorter vectors count as padded with
    zeros. An id that repeats is taken once, with the vector that sorts first. A score that
    overflows is infinite, one that is no number ranks last. Other columns are not read; no
    rows: no rows. fit: sample (rows on which the tree is fitted), leaf_rows and branching,
    as in build().
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    valid = vectors.select(vectors[id_col].cast("bigint").alias("id"), sound(vectors[vector_col], kind).alias("v")).where("id is not null and v is not null")
    index = build(valid, F.col("id") % every == 0, **fit)
    visits, _ = calibrate(index, k, recall)
    relieve(vectors.sparkSession)
    return search(index, k, visits)
