"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table predicts every document's domain posteriors, by one
two-way model a domain: this domain or one of those after it. A
projected gradient then fits nonnegative document rates so that the expected tokens of
each domain, sum(rate x tokens x posterior), meet the targets in the least squares sense,
at rates as near 1 as that allows, and none above a bound. At the optimum a rate is 1 less a
combination of the document's posteriors, projected on 0 to the bound, so one number a domain
describes all rates. Each step is one aggregate: the gradient (a sum a domain) and the curvature
of the documents with a rate between 0 and the bound (domains x domains), which sets the step's
length and direction; the rates themselves are an expression and are never gathered. What
no rates within the bound can meet is given as the residual of each domain.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equity_jobs.llm.common import relieve, relieved, written
from equity_jobs.llm.form import shape


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain (toxic, high or low) of the labels table.

    Rows without a verdict or an id are left out; of an id's several verdicts toxic goes first, then low.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    model: PipelineModel | None  # None where labels are of one domain or none

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """doc_id, tokens and p, an array of the posteriors in the order of domains, of every row of docs (doc_id, text).

        The same as the pipeline model's own transform gives, from one pass over a text's bytes: spark.ml's takes
        strings, counts and vectors from one column to the next.
        """
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        even = np.full(len(self.domains), 1.0 / len(self.domains))
        # at most `features` words
        learned = docs.sparkSession.sparkContext.broadcast(self._weights()) if self.model else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, weights, shift = learned.value if learned else ({}, np.zeros((2, 0)), np.zeros(0))
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    tokens, held, counts, form = [], [], [], []
                    for raw in part.column("text").to_pylist():
                        tokens.append(float(len(raw.split())))
                        if learned:
                            own, marks, repeats = shape(raw)
                            known = [n for n in map(words.get, own) if n is not None]
                            held += known
                            counts.append(len(known))
                            form.append((marks, repeats))
                    if learned:
                        owner, held = np.repeat(np.arange(len(counts)), counts), np.array(held, np.int64)
                        margin = np.array(form) @ weights[-2:] + shift
                        margin += np.stack([np.bincount(owner, w[held], len(counts)) for w in weights.T], 1)
                        with np.errstate(over="ignore"):
                            taken = 1.0 / (1.0 + np.exp(-margin))
                        rest = np.cumprod(1.0 - taken, 1)
                        p = np.hstack([taken, np.ones((len(taken), 1))])
                        p[:, 1:] *= rest
                    else:
                        p = np.tile(even, (len(tokens), 1))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.float64()), lists], names=["doc_id", "tokens", "p"])

        return rows.mapInArrow(run, f"doc_id {kind}, tokens double, p array<double>")

    def _weights(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """The words' numbers, a row of weights a word and, at the end, for marks and repetition (a column a model), and the intercepts."""
        words, _, *models = self.model.stages
        weights = np.stack([m.coefficients.toArray() for m in models], 1)
        return {w.encode(): n for n, w in enumerate(words.vocabulary)}, weights, np.array([m.intercept for m in models])


def repetition(text: Column, width: int = 100) -> Column:
    """The share of words that their own window has had before, over all consecutive windows of `width` words."""

    def share(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words), F.lit(width))
        distinct = F.aggregate(starts, F.lit(0), lambda n, at: n + F.size(F.array_distinct(F.slice(words, at, F.lit(width)))))
        return F.lit(1.0) - distinct / F.size(words)

    # as a lambda's variable the words are split once, not once a window
    return F.get(F.transform(F.array(F.split(text, " ")), share), 0)


def _shaped(docs: DataFrame) -> DataFrame:
    """docs with its words, an empty one first, and shares that describe its form; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.concat(F.array(F.lit("")), F.split(F.lower(text), r"[\s\p{Punct}]+"))
    size = F.greatest(F.char_length(text), F.lit(1))
    marks = F.char_length(F.regexp_replace(text, r"[^#$%&*|]+", "")) / size
    return docs.withColumns({"_words": words, "_marks": F.least(marks * 10, F.lit(2.0)), "_repeats": repetition(text) * 2})


def train(docs: DataFrame, domains: DataFrame, sample: int = 8000, features: int = 1 << 17, seen: int = 5, rounds: int = 25, ridge: float = 0.0005) -> Classifier:
    """A classifier of domains from at most `sample` labelled documents, those whose ids hash lowest.

    docs: doc_id, text. domains: doc_id, domain. Its features are the words that at least
    `seen` of the documents hold (all of them, where there are fewer), at most `features` and
    the most frequent ones. Without two domains the posteriors are even; without any label
    there is one domain, "all".
    """
    chosen = F.broadcast(domains.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` rows
    # of an id's several texts the one that sorts first
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    rows = written(_shaped(texts).select("domain", "_words", "_marks", "_repeats"), "mixing-sample")
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    names = sorted(sizes, reverse=True)
    if len(names) < 2:
        return Classifier(names or ["all"], None)
    words = [
        # the empty word is in all texts, so there is always a feature
        CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=features, minDF=min(seen, sum(sizes.values())), binary=True),
        VectorAssembler(inputCols=["_tf", "_marks", "_repeats"], outputCol="_features"),
    ]
    # at most `sample` rows: each partition ships a gradient of all features in every round, and more than
    # five ship it by a second stage
    with relieved(docs.sparkSession):
        shaper = Pipeline(stages=words).fit(rows.coalesce(3))
    shaped = shaper.transform(rows.coalesce(3)).select("domain", "_features")
    models = []
    for i, name in enumerate(names[:-1]):
        two_way = LogisticRegression(
            featuresCol="_features", labelCol="_label", predictionCol=f"_d{i}", probabilityCol=f"_q{i}", rawPredictionCol=f"_r{i}",
            family="binomial", regParam=ridge, maxIter=rounds, standardization=False,
        )
        relieve(docs.sparkSession)
        with relieved(docs.sparkSession):
            models.append(two_way.fit(shaped.where(F.col("domain").isin(names[i:])).withColumn("_label", (F.col("domain") == name).cast("double"))))
    return Classifier(names, PipelineModel([*shaper.stages, *models]))


MOST = 16.0  # the rate that no document exceeds, unless a caller says otherwise


def _free(posteriors: Column, prices: list[float]) -> Column:
    """1 less the posteriors' prices: the rate before it is projected."""
    return F.lit(1.0) - sum((F.get(posteriors, i) * float(y) for i, y in enumerate(prices)), F.lit(0.0))


def rate(posteriors: Column, prices: list[float], most: float = MOST) -> Column:
    """The rate of a document: 1 less its posteriors' prices, projected on 0 to `most`."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), _free(posteriors, prices)))


def fit_rates(members: DataFrame, targets: list[float], kept: list[bool] | None = None, pull: float = 1e-2, tolerance: float = 1e-7, rounds: int = 100, most: float = MOST) -> tuple[list[float], list[float]]:
    """The prices that give the rates, and how far each domain's tokens are from their target.

    members: tokens and p. targets: the share of each domain. kept: domains that must not
    shrink; the total is then so large that their natural tokens fit into their targets.
    The rates r, from 0 to `most` (1 at least), minimise sum((S_d - aim_d)^2 / share_d) + pull x
    sum(tokens x (r - 1)^2), tokens and sums being shares of all there are. Steps end when the
    gradient of every price is below the tolerance, or after `rounds` aggregates; a step that
    does not lower the objective is halved, so the prices are always the best so far. No
    tokens: no prices.
    """
    size = len(targets)
    rows, names = members.select("tokens", "p"), [f"s{n}" for n in range(size + size * (size + 1) // 2 + 1)]
    upper = np.triu_indices(size)

    def sums(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        # by numpy: prices in an expression are constants of its code, which each step would compile anew
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(len(names))
            for batch in batches:
                tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                z = 1.0 - p @ prices
                r = np.clip(z, 0.0, most)
                between = np.where((r > 0) & (r < most), tokens, 0.0)
                own[:size] += (tokens * r) @ p
                own[size:-1] += ((p * between[:, None]).T @ p)[upper]
                # r (2 z - r) is twice the integral of the projection, r^2 within the bounds
                own[-1] += tokens @ (r * (2 * z - r))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in own], names=names)

        row = rows.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names)).first()
        curve = np.zeros((size, size))
        curve[upper] = row[size:-1]
        return np.array(row[:size]), np.maximum(curve, curve.T), row[-1]

    prices = np.zeros(size)
    had, curve, square = sums(prices)
    total = had.sum()
    if not total:
        return [], []
    share = np.maximum(had / total, 1e-6)
    scale = max((share[i] / targets[i] for i in range(size) if kept and kept[i] and targets[i] > 0), default=1.0)
    aim = scale * np.array(targets)
    value = lambda y, sq: float(pull / 2 * (share * y * y).sum() + sq / total / 2 + aim @ y)
    now, step = value(prices, square), None
    for _ in range(rounds):
        off = had / total - aim
        slope = pull * share * prices - off
        if np.abs(slope).max() < tolerance:
            return prices.tolist(), off.tolist()
        step = np.linalg.solve(pull * np.diag(share) + curve / total, slope) if step is None else step / 2
        tried = prices - step
        after = sums(tried)
        if value(tried, after[2]) <= now - 1e-4 * float(slope @ step) or np.abs(step).max() < 1e-12:
            prices, (had, curve, square), step = tried, after, None
            now = value(prices, square)
    return prices.tolist(), (had / total - aim).tolist()


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], kept: list[str] | None = None, sample: int = 8000, most: float = MOST) -> tuple[DataFrame, list[str]]:
    """doc_id, tokens, p and rate (0 to `most`) of every document, and the names of the domains in p.

    docs: doc_id, text. tokens are runs of non-space characters. Null and empty texts have no tokens, and a rate like
    any other. Domains that targets do not name aim at nothing; with no label at all every
    rate is 1. Repeated rows have equal rates; other columns are not read.
    """
    classifier = train(docs, domains, sample)
    relieve(docs.sparkSession)
    members = written(classifier.posteriors(docs.select("doc_id", "text")), "mixing-posteriors")
    relieve(docs.sparkSession)
    if classifier.model is None:
        return members.withColumn("rate", F.lit(1.0)), classifier.domains
    aim = [targets.get(d, 0.0) for d in classifier.domains]
    with relieved(docs.sparkSession):
        prices, off = fit_rates(members, aim, [d in (kept or []) for d in classifier.domains], most=most)
    logging.getLogger(__name__).info("tokens above target, as shares of all: %s", dict(zip(classifier.domains, off, strict=False)))
    return members.withColumn("rate", rate(F.col("p"), prices, most)), classifier.domains


def copies(mixed: DataFrame, domains: list[str], kept: list[str]) -> DataFrame:
    """doc_id and how often the document goes into the mix: its rate, rounded up or down at
    random by its id so that the expectation stays. Documents most likely of a kept domain
    stay at least once. Of an id's several rows each has its own number; a null id is like any other."""
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    often = F.floor(F.col("rate") + draw).cast("int")
    best = F.array_position("p", F.array_max("p"))
    stays = best.isin([i + 1 for i, d in enumerate(domains) if d in kept])
    return mixed.select("doc_id", F.when(stays, F.greatest(often, F.lit(1))).otherwise(often).alias("copies"))
