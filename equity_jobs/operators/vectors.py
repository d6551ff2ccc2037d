"""Exact cosine search that leaves out what no bound allows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.sources.shared import written

CLOSE = 1e-9  # more than what rounding can change of a cosine


def _units(cells: pa.Array) -> np.ndarray:
    """Rows of equal length over their norm, taken of components over the largest: no square overflows; zero vectors stay zero."""
    rows = np.array(cells.to_pylist(), np.float64)
    if rows.ndim < 2 or not rows.size:
        return rows.reshape(len(rows), -1)
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = np.divide(rows, top, out=np.zeros_like(rows), where=top > 0)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to count unit vectors of the sample, each the farthest from those before it."""
    sample = sample[np.abs(sample).sum(1) > 0]
    if not len(sample):
        return sample
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < count and near.min() < 1 - CLOSE:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def cosine_search(queries: DataFrame, passages: DataFrame, k: int, block: int = 1024, sample: int = 4096, cells: int = 256, waves: int = 3) -> tuple[DataFrame, float]:
    """TX5: query_id, passage_id, semantic (cosine; 0 for a zero vector) and place of each query's k
    best passages, ties to the smaller id; and the share of all pairs that was compared.

    queries and passages: id and vector, all of one length. A query is not its own passage.
    Null ids and vectors take no part; no rows on a side: no rows.

    Vectors go to the cell of the nearest of `cells` pivots from a sample. Two cells cannot hold a
    better pair than their pivots' angle, less both cells' widest angles, allows. Each cell of
    queries meets its most promising cells of passages first; the worst k-th score that its
    queries have by then rules out cells in the next waves, and what leaves a task reaches
    its query's own. A task compares a block of queries with 16 blocks' worth of passages.
    """
    left, right = (side.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null") for side in (queries, passages))
    known = right.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    count = right.count()
    pivots = _pivots(_units(known.column("vector")), max(1, min(cells, -(-count // (16 * block))))) if count else np.zeros((0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column("vector"))
            zero = np.abs(units).sum(1) == 0
            near = units @ pivots.T if len(pivots) else np.zeros((len(units), 1))
            cell, angle = np.where(zero, -1, near.argmax(1)), np.where(zero, 0.0, _angles(near.max(1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(cell), pa.array(angle), batch.column("asks")], names=["id", "v", "cell", "angle", "asks"])

    both = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False)))
    placed = written(both.mapInArrow(place, "id bigint, v binary, cell bigint, angle double, asks boolean"), "cosine-cells")
    # two rows a cell
    stats = {(r.asks, r.cell): (r.n, r.wide) for r in placed.groupBy("asks", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("wide")).collect()}
    asking, holding = ({c: x for (a, c), x in stats.items() if a == side} for side in (True, False))
    between = _angles(pivots @ pivots.T)

    def bound(q: int, d: int) -> float:
        if q < 0 or d < 0:
            return 0.0
        return float(np.cos(max(0.0, between[q, d] - asking[q][1] - holding[d][1]))) + CLOSE

    todo = {q: sorted(holding, key=lambda d, q=q: (-bound(q, d), d)) for q in asking}
    worst, compared = dict.fromkeys(asking, -np.inf), 0
    found: DataFrame | None = None
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("semantic", 12).desc(), "passage_id"))
    for wave in range(waves):
        pairs = []
        for q, cells_left in todo.items():
            cells_left[:] = [d for d in cells_left if bound(q, d) >= worst[q]]
            take, held = 0, 0
            # the first wave ends once there are k passages besides the query itself
            while take < len(cells_left) and (wave == waves - 1 or (held <= k if wave == 0 else take < -(-len(cells_left) // 2))):
                held += holding[cells_left[take]][0]
                take += 1
            pairs += [(q, d) for d in cells_left[:take]]
            compared += asking[q][0] * held
            del cells_left[:take]
        if not pairs:
            break
        own = _meet(placed, pairs, asking, holding, found, k, block)
        found = own if found is None else found.drop("place").unionByName(own)
        found = written(found.withColumn("place", order).where(F.col("place") <= k), "cosine-best")
        if any(todo.values()):
            ends = found.where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("semantic").alias("last"))
            lows = placed.where("asks").select("id", "cell").join(ends, "id", "left").groupBy("cell").agg(F.min(F.coalesce("last", F.lit(-2.0))).alias("low"))
            worst |= {r.cell: r.low - CLOSE for r in lows.collect()}  # one row a cell
    total = sum(n for n, _ in asking.values()) * sum(n for n, _ in holding.values())
    if found is None:
        empty = placed.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("passage_id"), F.col("angle").alias("semantic"), F.lit(1).alias("place"))
        return empty, 0.0
    return found, compared / total


def _meet(placed: DataFrame, pairs: list[tuple[int, int]], asking: dict, holding: dict, found: DataFrame | None, k: int, block: int) -> DataFrame:
    """query_id, passage_id and semantic of what may be among the k best, for these pairs of cells (at most cells x cells)."""
    spark = placed.sparkSession
    meets = spark.createDataFrame([(q, d, -(-asking[q][0] // block), -(-holding[d][0] // (16 * block))) for q, d in pairs], "q_cell bigint, d_cell bigint, q_blocks bigint, chunks bigint")
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asked = placed.where("asks").select("id", "v", F.col("cell").alias("q_cell"))
    if found is not None:
        asked = asked.join(found.where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("semantic").alias("bound")), "id", "left")
    else:
        asked = asked.withColumn("bound", F.lit(None).cast("double"))
    columns = ["q_cell", "d_cell", "q_block", "chunk", "asks", "id", "v", "bound"]
    own = asked.join(meets, "q_cell").withColumn("q_block", one("q_blocks")).select("*", every("chunks").alias("chunk"), F.lit(True).alias("asks"))
    data = placed.where("not asks").select("id", "v", F.col("cell").alias("d_cell"), F.lit(None).cast("double").alias("bound")).join(meets, "d_cell").withColumn("chunk", one("chunks")).select("*", every("q_blocks").alias("q_block"), F.lit(False).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        a, b = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out = [[], [], []]
        if a.num_rows and b.num_rows:
            unit = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(t.num_rows, -1)
            scores, ids, names = unit(a) @ unit(b).T, b.column("id").to_numpy(), a.column("id").to_numpy()
            scores[names[:, None] == ids[None, :]] = -np.inf
            least = np.nan_to_num(a.column("bound").to_numpy().astype(np.float64), nan=-np.inf)
            rank = np.lexsort((np.broadcast_to(ids, scores.shape), -np.round(scores, 12)), axis=1)[:, :k]
            best = np.take_along_axis(scores, rank, 1)
            good = np.isfinite(best) & (best >= least[:, None] - CLOSE)
            out = [np.broadcast_to(names[:, None], best.shape)[good], ids[rank][good], best[good]]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "passage_id": pa.array(out[1], pa.int64()), "semantic": pa.array(out[2], pa.float64())})

    return own.select(columns).unionByName(data.select(columns)).groupBy("q_cell", "d_cell", "q_block", "chunk").applyInArrow(search, "query_id bigint, passage_id bigint, semantic double")


def cosine_top_k(queries: DataFrame, passages: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """TX5: the rows of cosine_search()."""
    return cosine_search(queries, passages, k, block)[0]
