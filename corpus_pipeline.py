"""The corpus pipeline: documents that pass each stage go on to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equity_jobs.llm import langid, mixing, pieces, queries, resemblance, secret_scan, simhash
from equity_jobs.llm.common import relieve, table, written
from equity_jobs.llm.components import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language was found (operator 7); rejects those without letters
    and long ones that no language explains better than symbols drawn at random."""
    return langid.identify(docs.select(COLUMNS), langid.learn(docs), keep=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id; of an id's several
    rows the one that sorts first stays, documents without an id stay. Links are those of operator 8 and all pairs whose sets of
    five-word shingles have a similarity of 0.8 or more, most of which are over 4 bits apart."""
    relieve(spark)
    docs = docs.select(COLUMNS)
    near = simhash.near_duplicates(docs).select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    links = near.unionByName(resemblance.similar_links(docs))
    relieve(spark)
    later = components(links).where("node <> root").select(F.col("node").alias("doc_id"))
    first = docs.where("doc_id is not null").join(later, "doc_id", "left_anti").groupBy("doc_id").agg(F.min(F.struct(COLUMNS[1:])).alias("row"))
    return first.select("doc_id", "row.*").unionByName(docs.where("doc_id is null"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in every text (operator 10); n_chars follows the text. Null texts and
    repeated rows stay as they are; no rows: no rows."""
    relieve(spark)
    docs = docs.select(COLUMNS)
    return secret_scan.redact(docs, secret_scan.learn(written(secret_scan.scan(docs), "secret-candidates")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or removes documents so that the domains' tokens meet their targets (operator 5).

    Documents most likely of a clean domain stay at least once; those of the toxic domain,
    whose target is nothing, go as their rate falls to nothing. Documents without an id stay.
    """
    relieve(spark)
    docs = docs.select(COLUMNS)
    mixed, domains = mixing.mix(docs, mixing.domain_of(table(spark, sf_dir, "labels")), queries.MIX_TARGETS, queries.MIX_KEPT)
    often = mixing.copies(mixed, domains, queries.MIX_KEPT).groupBy("doc_id").agg(F.max("copies").alias("copies"))
    taken = docs.join(often, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document that is left (operator 2), one row a row: a null text is
    empty, repeats and null ids stay; no rows: no rows."""
    relieve(spark)
    return pieces.round_trip(docs, queries.model_path())


STAGES = [("language ID", language_stage), ("SimHash near-dedup", near_duplicate_stage), ("secret scans", secrets_stage), ("mixing to target weights", mixing_stage), ("SentencePiece", encoding_stage)]

#: DuckDB cannot express the stages' models; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
