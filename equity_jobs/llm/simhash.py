"""SimHash near-duplicates by a Gray-order hierarchical index.

Equal fingerprints are one representative. The bits are dealt into blocks; `limit`
differences touch at most `limit` blocks, so two near fingerprints agree on all others.
The upper nodes of the index are masked bit patterns: for every choice of the blocks that
may differ, the pattern of the rest, 20 bits or more, so that few fingerprints share one
by chance however many there are. Below a pattern, fingerprints are sorted by Gray rank
and runs of them are factored, level by level, into nodes that hold the bits all of the
run share. Node pairs are compared from the top; a pair whose shared bits already differ
in more than `limit` places is pruned with all that lies below.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equity_jobs.llm.common import written
from equity_jobs.llm.components import components

BITS = 64
FAN = 8  # children of a node
PAIRS = 1 << 20  # node pairs compared at once


def fingerprint(text: str | None, size: int = 4) -> int:
    """A bit is 1 if it is set in over half of the hashes of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n = max(1, len(words) - size + 1)
    ends = (begins + lengths)[-n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):  # a bounded matrix of bits
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """id and fp (64 bits as a signed long) of every row; null and empty texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of 64-bit codes in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def near_pairs(group: np.ndarray, codes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within a group at most limit bits apart; group and codes sorted by (group, Gray rank)."""
    levels = [(group, codes, codes)]  # group, bits set in all, bits set in any
    while len(levels[-1][0]) and np.any(levels[-1][0][1:] == levels[-1][0][:-1]):
        groups, every, some = levels[-1]
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        place = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
        heads = np.flatnonzero(place % FAN == 0)
        levels.append((groups[heads], np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)))
        levels[-2] = (*levels[-2], np.append(heads, len(groups)))  # children of the nodes above
    top = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, top[i : i + PAIRS], top[i : i + PAIRS]) for i in range(0, len(top), PAIRS)]
    while todo:
        level, a, b = todo.pop()
        every, some = levels[level][1:3]
        if level == 0:
            near = (a < b) & (np.bitwise_count(codes[a] ^ codes[b]) <= limit)
            yield a[near], b[near]
            continue
        # bits that all of one node have and none of the other has
        apart = np.bitwise_count((every[a] & ~some[b]) | (every[b] & ~some[a]))
        a, b = a[apart <= limit], b[apart <= limit]
        heads = levels[level - 1][3]
        for at in range(0, len(a), PAIRS // (FAN * FAN)):
            pa_, pb = a[at : at + PAIRS // (FAN * FAN)], b[at : at + PAIRS // (FAN * FAN)]
            wide_a, wide_b = heads[pa_ + 1] - heads[pa_], heads[pb + 1] - heads[pb]
            many = wide_a * wide_b
            of = np.repeat(np.arange(len(pa_)), many)
            k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            left, right = heads[pa_[of]] + k // wide_b[of], heads[pb[of]] + k % wide_b[of]
            kept = left <= right
            todo.append((level - 1, left[kept], right[kept]))


def spanning(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """root, the least index reachable of each of n points, given links and the roots so far."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def patterns(blocks: int, limit: int) -> list[int]:
    """Masks of the bits that may not differ: all but `limit` of the blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(kept) for kept in combinations(masks, blocks - limit)]


def links(reps: DataFrame, limit: int = 4, cap: int = 1024, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most limit bits apart, of distinct rows (fp, node).

    blocks: into how many the bits are dealt, by default limit + 2. With 6 blocks and 4
    bits a pattern holds 20 bits or more and there are 15; with 8 blocks 32 bits and 70.
    Not every near pair is given: below a pattern, each fingerprint is linked to the first
    of its component there, so m of them give under m links. More than cap fingerprints
    below one pattern are dealt out as pairs of chunks of cap, each to a task of its own;
    nothing is dropped.
    """
    masks = patterns(blocks or limit + 2, limit)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for i, m in enumerate(signed)))
    keyed = reps.select("fp", "node", F.inline(bands))
    large = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > cap)
    chunks = F.coalesce(F.ceil(F.col("n") / cap), F.lit(1))
    dealt = keyed.join(large, ["band", "key"], "left").select("fp", "node", "band", "key", chunks.cast("int").alias("chunks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.select("fp", "node", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("fp", "node", "band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    sent = dealt.repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def found(table: pa.Table) -> pa.RecordBatch:
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "low", "high")])
            codes, nodes = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
            group = np.concatenate([[0], np.cumsum(np.any(keys[:, 1:] != keys[:, :-1], axis=0))])
            order = np.lexsort((gray_rank(codes), group))
            group, codes, nodes = group[order], codes[order], nodes[order]
            root = np.arange(len(nodes))
            for a, b in near_pairs(group, codes, limit):
                root = spanning(len(nodes), a, b, root)
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[root[linked]]), pa.array(nodes[linked])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = [table.column(c)[-1].as_py() for c in ("band", "key", "low", "high")]
            same = np.all([table.column(c).to_numpy() == v for c, v in zip(("band", "key", "low", "high"), last, strict=True)], axis=0)
            cut = len(same) - int(same.sum())  # sorted: the last group may go on in the next batch
            if cut:
                yield found(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield found(rest)

    return sent.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, limit: int = 4) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links of at most limit bits.

    One row for each row in, repeats too. Null and empty texts have fingerprint zero and
    link like any other. A null id keeps its row: it shares the component of its
    fingerprint, which is null if no row of the component has an id. Other columns are not
    read. Ids are integers.
    """
    marked = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    reps = marked.where("id is not null").groupBy("fp").agg(F.min("id").cast("bigint").alias("node"))
    # a row without an id can still connect others, so its fingerprint takes part under a node of its own
    lone = marked.where("id is null").select("fp").distinct().join(reps, "fp", "left_anti").select("fp", F.lit(None).cast("bigint").alias("node"))
    reps = written(reps.unionByName(lone).select("fp", "node"), "representatives")
    roots = components(links(reps.select("fp", F.col("fp").alias("node")), limit))
    least = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = least.join(least.groupBy("root").agg(F.min("node").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(least, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
