"""Importance resampling towards a target distribution over hashed word runs.

Every document's weight is the sum, over its runs of one to three words, of the log ratio
of target to corpus counts in the run's bucket; with Gumbel noise on top, the highest
scores are a sample without replacement in proportion to the weights' exponentials.

The cutoff among all scores is found by weighted median of medians: in each round, tasks
give the median of what is left on either side of the last pivot, the driver takes the
median of these medians weighted by how many keys each stands for, and at least a quarter
of what is left is discarded, until the pivot is the cutoff itself. Only keys at or before
the cutoff are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equity_jobs.llm.common import written
from equity_jobs.operators.ranking import ranked

WINDOW = 1 << 20  # bytes of text looked at together
SHORT = 48  # longer words are hashed one by one
GROUP = 1 << 20  # keys of which one median is taken at most

# a-z, 0-9 and all bytes of characters beyond ASCII; A-Z are lower-cased before
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    """What a byte does to the register of CRC-32 (reversed polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    return table


CRC = _crc_table()
START = np.uint32(0xFFFFFFFF)


def _over(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the words data[begin : begin + size]."""
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    state, begin, size = state[order], begin[order], size[order]
    long = int((size > SHORT).sum())
    for i in range(long):
        word = data[begin[i] : begin[i] + size[i]].tobytes()
        state[i] = zlib.crc32(word, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for at in range(int(size[long]) if long < len(size) else 0):
        upto = np.searchsorted(-size[long:], -at) + long  # words of over `at` bytes
        own = state[long:upto]
        state[long:upto] = CRC[(own ^ data[begin[long:upto] + at]) & 255] ^ (own >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def _space(state: np.ndarray) -> np.ndarray:
    return CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8)


def word_runs(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """The words' rows, and for runs of 1, 2 and 3 words the rows and buckets, window by window.

    Windows end between words, so a very long text takes bounded memory; runs that cross
    from one window to the next are counted in the latter. Nulls count as empty.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, where, raw = texts.buffers()
    edges = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(edges[0]), int(edges[-1])
    data = np.frombuffer(raw, np.uint8)[first:last] if raw is not None and last > first else np.zeros(0, np.uint8)
    edges = edges - first
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[edges] = True
    at, before = 0, (-1, START, START, False)  # of the last word: row, register, register of its pair, whether it has one
    while at < len(data):
        end = _between(data, starts_row, at)
        own = LOWER[data[at:end]]
        inside = IN_WORD[own]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | starts_row[at + 1 : end]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | starts_row[at + 1 : end]
        begin = np.flatnonzero(opens)
        size = np.flatnonzero(closes) + 1 - begin
        if len(begin):
            row = np.searchsorted(edges, begin + at, "right") - 1
            one = _over(np.full(len(begin), START), own, begin, size)
            paired = np.concatenate([[before[0] == row[0]], row[1:] == row[:-1]])
            tripled = paired & np.concatenate([[before[3]], paired[:-1]])
            two = np.full(len(begin), START)
            two[paired] = _over(_space(np.concatenate([[before[1]], one[:-1]])[paired]), own, begin[paired], size[paired])
            three = _over(_space(np.concatenate([[before[2]], two[:-1]])[tripled]), own, begin[tripled], size[tripled])
            runs = [(row, one), (row[paired], two[paired]), (row[tripled], three)]
            yield row, [(r, (~s % np.uint32(buckets)).astype(np.int64)) for r, s in runs]
            before = (int(row[-1]), one[-1], two[-1], bool(paired[-1]))
        at = end


def _between(data: np.ndarray, starts_row: np.ndarray, at: int) -> int:
    """A place between words about WINDOW bytes on; further on where one word is longer."""
    end = at + WINDOW
    while end < len(data):
        gaps = np.flatnonzero(~IN_WORD[LOWER[data[end - WINDOW : end]]] | starts_row[end - WINDOW + 1 : end + 1])
        if len(gaps):
            return end - WINDOW + int(gaps[-1]) + 1
        end += WINDOW
    return len(data)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """How many runs of all texts fall in each bucket; one row a bucket and task is shuffled, one a bucket collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, runs in word_runs(batch.column("text"), buckets):
                for _, bucket in runs:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = texts.select(texts[text_col].alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most `buckets` rows
        total[row.bucket] = row.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 x log ratio) of each bucket, one added to each count."""
    all_corpus, all_target, n = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = lambda s, t: (t + 1.0) * (all_corpus + n) / ((s + 1.0) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 x standard Gumbel noise), fixed by seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight and score of every row, as a written table, sorted by score in each partition; _row numbers the rows.

    Repeated rows each count; null and empty texts have no features and weight 0.
    """
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for row, runs in word_runs(batch.column("text"), buckets):
                words += np.bincount(row, minlength=n)
                for r, bucket in runs:
                    features += np.bincount(r, minlength=n)
                    weight += np.bincount(r, gain[bucket], n).astype(np.int64)  # sums below 2^53
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (words, features, weight))], names=["id", "n_words", "n_features", "weight"])

    own = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint")
    own = own.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).sortWithinPartitions(*_order()).withColumn("_row", F.monotonically_increasing_id())
    return written(own, "resample-scores")


def _order() -> list[Column]:
    """Highest score first, then smaller id, ids before null; no two rows are equal once _row has been added."""
    return [F.desc("score"), F.asc_nulls_last("id")]


@dataclass(frozen=True, order=True)
class Key:
    """A row's place in the order: smaller comes first."""

    negated: int
    unnamed: bool
    id: int
    row: int

    def first(self) -> Column:
        """Whether a row is at or before this one."""
        tied = F.col("id").isNotNull() if self.unnamed else (F.col("id") < self.id)
        same = (F.col("id").isNull() if self.unnamed else (F.col("id") == self.id)) & (F.col("_row") <= self.row)
        return (F.col("score") > -self.negated) | ((F.col("score") == -self.negated) & F.coalesce(tied | same, F.lit(False)))


def _medians(keys: DataFrame, pivot: Key | None) -> tuple[int, list[tuple[Key, int]], list[tuple[Key, int]]]:
    """How many keys come before the pivot, and medians of those before and after it with the keys each stands for.

    A task gives a row a side for GROUP keys or fewer. No pivot: all keys come after it.
    """
    at = (pivot.negated, pivot.unnamed, pivot.id, pivot.row) if pivot else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def medians() -> pa.RecordBatch:
            own = np.concatenate(held, axis=1)
            own = own[:, np.lexsort(own[::-1])]
            split = 0 if at is None else _before(own, at)
            after = split + (at is not None and split < own.shape[1] and tuple(own[:, split].tolist()) == tuple(map(int, at)))
            rows = [(side, *own[:, lo + (hi - lo) // 2].tolist(), hi - lo) for side, lo, hi in ((False, 0, split), (True, after, own.shape[1])) if hi > lo]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, MEDIAN, strict=True)], names=["after", "negated", "unnamed", "id", "row", "n"])

        for batch in batches:
            unnamed = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            held.append(np.stack([-batch.column("score").to_numpy(), unnamed.astype(np.int64), batch.column("id").fill_null(0).to_numpy(), batch.column("_row").to_numpy()]))
            if sum(h.shape[1] for h in held) >= GROUP:
                yield medians()
                held.clear()
        if held:
            yield medians()

    found = keys.select("score", "id", "_row").mapInArrow(run, "after boolean, negated bigint, unnamed bigint, id bigint, row bigint, n bigint").collect()
    sides = [[(Key(r.negated, bool(r.unnamed), r.id, r.row), r.n) for r in found if r.after == after] for after in (False, True)]
    return sum(n for _, n in sides[0]), *sides


MEDIAN = [pa.bool_(), *[pa.int64()] * 5]


def _before(keys: np.ndarray, at: tuple[int, bool, int, int]) -> int:
    """How many of the sorted keys come before at."""
    lo, hi = 0, keys.shape[1]
    for column, value in zip(keys, at, strict=True):
        lo, hi = lo + int(np.searchsorted(column[lo:hi], value)), lo + int(np.searchsorted(column[lo:hi], value, "right"))
    return lo


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no medians")


def cutoff(scored: DataFrame, wanted: int) -> tuple[Key | None, int]:
    """The key of place `wanted` (from 1) in the order of scores(), and in how many rounds it was found; None for no or too few rows.

    A round reads the keys whose score lies between the bounds so far, one job a round; the
    bounds reach the Parquet scan. Rounds grow with the logarithm of the rows.
    """
    _, _, medians = _medians(scored, None)
    if not 0 < wanted <= sum(n for _, n in medians):
        return None, 0
    least = most = None  # exclusive bounds
    rounds = 0
    while True:
        rounds += 1
        pivot = _weighted_median(medians)
        left = scored
        if least is not None:
            left = left.where((F.col("score") <= -least.negated) & ~least.first())
        if most is not None:
            left = left.where((F.col("score") >= -most.negated) & most.first() & ~((F.col("_row") == most.row)))
        before, earlier, later = _medians(left, pivot)
        if before + 1 == wanted:
            return pivot, rounds
        if wanted <= before:
            most, medians = pivot, earlier
        else:
            least, medians, wanted = pivot, later, wanted - before - 1


def draw(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """The rows of scores() with rank: of the N rows with least_words words or more, the
    floor(percent x N / 100) highest scores are ranked from 1, ties to the smaller id, null
    ids last, repeated rows in either order; all others have a null rank."""
    able = scored.where(F.col("n_words") >= least_words)
    last, _ = cutoff(able, percent * able.count() // 100)
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint")).drop("_row")
    winner = (F.col("n_words") >= least_words) & last.first()
    winners = ranked(scored.where(winner), [*_order(), F.asc("_row")], "rank")
    rest = scored.where(~winner).withColumn("rank", F.lit(None).cast("bigint"))
    return winners.unionByName(rest).drop("_row")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every document, drawn towards the texts of target.

    The texts are read twice: for the corpus counts, and for the weights once the gains
    (`buckets` longs) are known. Null and empty texts have no features; empty tables give
    no rows, or gains from the other table alone. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, "text", buckets))
    return draw(scores(docs, gain, seed, id_col, text_col), percent, least_words).withColumnRenamed("id", id_col)
