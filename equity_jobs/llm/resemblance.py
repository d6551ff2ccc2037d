"""Links between documents whose word shingles have a Jaccard similarity of at least 0.8.

Exact: in any one order of all shingles, two such documents share one of their first
n - ceil(0.8 n) + 1, so all candidates meet there. Shingles that many documents hold come last
in the order, which changes the work and never the result: documents that share a passage, and
otherwise differ, then do not meet. Which are frequent is told by counts over a fixed share of all
documents, kept as one bit a hash bucket, so that it takes 2 MB at every size. Candidates are first the pairs
of each shingle's leader, which is one of a few for the shingles of like documents, then all pairs that the links found so far leave apart.
A sketch of each set, its shingles counted by their lowest bits, rules out most candidates: two
sets differ in at least as many shingles as their counts do. The others are verified on the
whole sets. Shingles are 32-bit hashes, which halves what is shuffled; two shingles of a
pair of texts of 1,000 words each are confused in one pair of some 4,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equity_jobs.llm.common import written
from equity_jobs.llm.components import components

SHARE, OFTEN = 4, 3  # one in SHARE documents is counted; those beyond the expected that make a shingle frequent
BUCKETS = 24  # bits of a shingle that tell its bucket, one mark each
LEADERS = 8  # orders of the documents by which shingles choose their leader
COUNTS = 64  # of a sketch, at least; a power of 2


def grams(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int32)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique((out >> np.uint64(32)).astype(np.uint32).view(np.int32))


def gram_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """id, node (a hash of the set) and grams of every row with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t, size) for t in batch.column("text").to_pylist()]
            some = np.array([len(s) > 0 for s in sets], bool)
            sets = [s for s in sets if len(s)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(some)), pa.array(nodes), lists], names=["id", "node", "grams"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return rows.mapInArrow(run, "id bigint, node bigint, grams array<int>")


def sketch(own: np.ndarray) -> bytes:
    """How many grams end in each of 64 or more bit patterns, one for four to eight of many grams; 255 at most."""
    counts = max(COUNTS, 1 << (len(own) >> 3).bit_length())
    return np.minimum(np.bincount(own & (counts - 1), minlength=counts), 255).astype(np.uint8).tobytes()


def gram_sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """id, node, n (the size of its set) and sketch of every row with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = batch.column("grams").offsets.to_numpy(), batch.column("grams").values.to_numpy()
            sketches = [sketch(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            sizes = pa.array(np.diff(ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), sizes, pa.array(sketches, pa.binary())], names=["id", "node", "n", "sketch"])

    return gram_sets(docs, size).mapInArrow(run, "id bigint, node bigint, n int, sketch binary")


def differ(a: bytes, b: bytes) -> int:
    """In how many grams at least the sets of two sketches differ; the longer sketch is folded to the shorter."""
    width = min(len(a), len(b))
    x, y = (np.minimum(np.frombuffer(s, np.uint8).reshape(-1, width).sum(0, dtype=np.int32), 255) for s in (a, b))
    return int(np.abs(x - y).sum())


def plausible(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sketches (owners: node, n, sketch) leave a similarity of 0.8 or more possible.

    Sets of x and y shingles are as similar as that if they differ in at most (x + y) / 9.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([differ(a, b) for a, b in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)], np.int64)
            sizes = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(9 * least <= sizes))

    left, right = (owners.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def frequent_marks(docs: DataFrame, nodes: DataFrame, size: int = 5) -> np.ndarray:
    """A mark for each bucket of shingles, as packed bits: set where many documents hold one of the bucket.

    nodes: id and n of all sets. A bucket is frequent if it has OFTEN more shingles than three
    deviations above the mean, so few are marked by chance however many documents there are.
    """
    counted = lambda key: F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(SHARE)) == 0
    mean = (nodes.where(counted("id")).agg(F.sum("n")).first()[0] or 0) / (1 << BUCKETS)
    bucket = F.col("gram").bitwiseAND(F.lit((1 << BUCKETS) - 1))
    held = gram_sets(docs.where(counted("doc_id")), size).select(F.explode("grams").alias("gram")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    many = held.where(F.col("n") >= F.lit(OFTEN + mean + 3 * mean**0.5)).withColumn("bit", F.expr("shiftleft(1L, cast(bucket & 63 as int))"))
    words = many.groupBy(F.shiftright("bucket", 6).alias("word")).agg(F.bit_or("bit").alias("bits")).toPandas()
    marks = np.zeros(1 << (BUCKETS - 6), np.int64)
    marks[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return marks


def first_grams(sets: DataFrame, marks: np.ndarray) -> DataFrame:
    """gram, node, n (the size of its set) and place (in the order) of the grams by which a set meets all sets like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("grams").offsets.to_numpy()
            values = batch.column("grams").values.to_numpy()
            taken, counts, sizes = [], [], np.diff(ends)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = values[a:b]
                bucket = own & ((1 << BUCKETS) - 1)
                rare = (marks[bucket >> 6] >> (bucket & 63).astype(np.int64)) & 1 == 0
                first = np.concatenate([own[rare], own[~rare]])[: (b - a) - -(-4 * (b - a) // 5) + 1]
                taken.append(first)
                counts.append(len(first))
            flat = np.concatenate(taken) if taken else np.empty(0, np.int32)
            nodes = np.repeat(batch.column("node").to_numpy(), counts)
            places = np.concatenate([np.empty(0, np.int32), *(np.arange(c, dtype=np.int32) for c in counts)])
            columns = [flat, nodes, np.repeat(sizes, counts).astype(np.int32), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "node", "n", "place"])

    return sets.select("node", "grams").mapInArrow(run, "gram int, node bigint, n int, place int")


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, size: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those with a similarity of 0.8 or more, by the ids that own them."""
    pairs = written(plausible(pairs, owners), "plausible-pairs")
    # written, so that its size is known and texts are dealt out by a join only where it is large
    asked = written(owners.select("id", "node").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "candidate-nodes")
    texts = docs.select("doc_id", "text").join(asked.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    whole = written(gram_sets(texts, size), "candidate-sets").join(asked, ["id", "node"], "left_semi")
    left, right = (whole.select(F.col("node").alias(n), F.col("id").alias(f"id_{n}"), F.col("grams").alias(f"grams_{n}")) for n in "ab")
    rows = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return rows.where(both * 5 >= (F.size("grams_a") + F.size("grams_b") - both) * 4).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def similar_links(docs: DataFrame, size: int = 5) -> DataFrame:
    """Links (a, b) of doc_ids that connect all documents with a similarity of 0.8 or more.

    docs: doc_id, text. Not every similar pair is given: pairs that other links already
    connect are not compared. Rows without an id or without words link nothing.
    """
    # sets are made again from the texts where they are needed: stored, they take more than the input
    sets = gram_sets(docs, size)
    nodes = written(gram_sketches(docs, size), "gram-nodes")
    # rows of one node have one set, so n and sketch are the same in all of them
    owners = written(nodes.groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "gram-owners")
    copies = nodes.select("id", "node").join(owners.select("node", F.col("id").alias("a")), "node").where("id <> a").select("a", F.col("id").alias("b"))
    firsts = first_grams(sets, frequent_marks(docs, nodes, size))
    # several orders: a document that is not similar to one leader of its group may be so to another
    leader = F.min_by("node", F.xxhash64("node", F.pmod("gram", F.lit(LEADERS))))
    led = firsts.groupBy("gram").agg(leader.alias("leader"), F.min("node").alias("low"), F.max("node").alias("high"))
    leaders = written(led.where("low <> high").select("gram", "leader"), "leaders")
    shared = written(firsts.join(leaders, "gram").distinct(), "shared-grams")
    heads = shared.where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    links = written(verified(written(heads, "first-pairs"), docs, owners, size), "first-links")
    # what the first links leave apart meets in full: a gram whose sets are all in one component needs no pair
    roots = components(links).withColumnRenamed("node", "id").join(owners.select("id", "node"), "id").select("node", "root")
    placed = shared.join(roots, "node", "left").select("gram", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
    open_ = written(placed.join(apart, "gram", "left_semi"), "open-grams")
    left, right = (open_.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "place", "root"))) for s in "ab")
    # sets share no more than what follows the first shingle they share, and must share 4/9 of both sizes
    enough = "9 * least(n_a - place_a, n_b - place_b) >= 4 * (n_a + n_b)"
    rest = left.join(right, "gram").where(f"node_a < node_b and root_a <> root_b and {enough}")
    rest = rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(heads, ["a", "b"], "left_anti")
    return links.unionByName(verified(written(rest, "other-pairs"), docs, owners, size)).unionByName(copies)
