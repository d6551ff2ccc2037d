"""Document fingerprints by I-Match, in DataFrame operations only.

Terms whose inverse document frequency lies in a band form the lexicon. A document's
distinct lexicon terms, sorted, are hashed once for each of several randomised subsets of
the lexicon; documents that differ in no term of a subset share its hash. The subsets are
of falling density, so that some tolerate few and others many changed terms. Several draws
are made; within a draw each subset is a random half of the one before.

Terms travel as 64-bit hashes. A term in the band occurs in at least `low` of all
documents, so the lexicon holds at most (mean distinct terms of a document) / low terms,
however many documents there are; that is why it may be part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.llm.common import written

DENSITIES = (8, 16, 32, 64, 128, 256, 512)  # a subset keeps one term in so many
DRAWS = 4  # subsets of each density
NONE = "-"  # stands for a subset without terms of the document
NULL_RANGES = 1 << 16  # ranges, by text, of rows without an id


def term_hashes(text: Column) -> Column:
    """The distinct terms (runs of letters and digits, in lower case) of a text, as hashes."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = 0.005, high: float = 0.2) -> list[int]:
    """Hashes of the terms in at least low and at most high of all documents."""
    counted = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.count()
    band = counted.where((F.col("df") >= max(low * total, 1)) & (F.col("df") <= high * total))
    return [r.term for r in band.select("term").collect()]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fingerprint(text: Column, terms: list[int]) -> Column:
    """28 hashes of lexicon subsets and one of all terms, joined by dots; equal texts have equal fingerprints.

    Draw by draw, densest subset first. A term is in the subset of density 1/d if the
    last log2(d) bits of its hash for the draw are 0.
    """

    def subsets(found: Column, draw: int, densities: tuple[int, ...]) -> Column:
        if not densities:
            return F.array().cast("array<string>")
        one_in, *rest = densities
        held = F.filter(found, lambda t: F.xxhash64(t, F.lit(draw)).bitwiseAND(one_in - 1) == 0)
        return _let(held, lambda h: F.concat(F.array(F.when(F.size(h) > 0, _short(h)).otherwise(NONE)), subsets(h, draw, tuple(rest))))

    def parts(own: Column) -> Column:
        kept = F.filter(own, lambda t: t.isin(terms)) if terms else F.filter(own, lambda t: F.lit(False))
        drawn = _let(kept, lambda found: F.concat(*(subsets(found, i, DENSITIES) for i in range(DRAWS))))
        return F.array_join(F.array_append(drawn, _short(own)), ".")

    return _let(F.array_sort(term_hashes(text)), parts)


def _short(hashes: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(hashes).bitwiseAND(0xFFFFFFFF))), 8, "0")


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets of which either document has terms, the share with equal hashes; without any, whether all terms are equal."""
    left, right = F.split(a, r"\."), F.split(b, r"\.")
    size = len(DENSITIES) * DRAWS
    pairs = F.filter(F.arrays_zip(F.slice(left, 1, size).alias("l"), F.slice(right, 1, size).alias("r")), lambda p: (p["l"] != NONE) | (p["r"] != NONE))
    same = F.filter(pairs, lambda p: p["l"] == p["r"])
    whole = (F.get(left, size) == F.get(right, size)).cast("double")
    return F.when(F.size(pairs) > 0, F.size(same) / F.size(pairs)).otherwise(whole)


def with_heads(docs: DataFrame, id_col: str, width: int = 1024) -> DataFrame:
    """docs in ranges of width ids (_range), with a copy (_copy) of the first row of each range at
    the end of the range before it, so that every row meets its follower in its own range.

    The first range is copied to the end of the last. Rows without an id come before all
    others, in the order of a hash of their other columns, in NULL_RANGES ranges.
    """
    rest = [c for c in docs.columns if c != id_col]
    without = F.pmod(F.xxhash64(*rest), F.lit(NULL_RANGES)) - (1 << 62)
    ranged = docs.withColumn("_range", F.coalesce(F.floor(F.col(id_col) / width), without))
    firsts = ranged.groupBy("_range").agg(F.min(id_col).alias("_id"))
    # ranges are as many as rows / width; they too are numbered range by range
    outer = written(firsts.withColumn("_outer", F.floor(F.col("_range") / 4096)), "ranges")
    inside = outer.withColumn("_before", F.lag("_range").over(Window.partitionBy("_outer").orderBy("_range")))
    ends = outer.groupBy("_outer").agg(F.max("_range").alias("_last"))
    everything = Window.orderBy("_outer")  # rows / (width x 4096)
    ends = ends.select("_outer", F.lag("_last").over(everything).alias("_previous"), F.max("_last").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_top"))
    targets = inside.join(ends, "_outer").select(F.col("_range").alias("_from"), F.coalesce("_before", "_previous", "_top").alias("_target"), "_id")
    targets = written(targets, "range-targets")  # of known size: broadcast or not by the session's threshold
    heads = ranged.join(targets, (F.col("_range") == F.col("_from")) & F.col(id_col).eqNullSafe(F.col("_id")))
    heads = heads.withColumn("_n", F.row_number().over(Window.partitionBy("_from").orderBy(*rest))).where("_n = 1")
    return ranged.withColumn("_copy", F.lit(False)).unionByName(heads.select(*docs.columns, F.col("_target").alias("_range"), F.lit(True).alias("_copy")))


def with_next(rows: DataFrame, id_col: str, columns: list[str], ties: list[str]) -> DataFrame:
    """rows of with_heads() with next_<column> of the follower; rows of equal id follow each other by ties."""
    follow = Window.partitionBy("_range").orderBy("_copy", F.col(id_col), *ties)
    return rows.withColumns({f"next_{c}": F.lead(c).over(follow) for c in columns}).where(~F.col("_copy")).drop("_range", "_copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.005, high: float = 0.2) -> DataFrame:
    """id, text and fingerprint of every row. Null texts count as empty; repeats and null ids stay; no rows: no rows."""
    terms = lexicon(docs, text_col, low, high)
    return docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("fingerprint", fingerprint(F.col("text"), terms))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.005, high: float = 0.2) -> DataFrame:
    """Each document's fingerprint held against that of an edited text and of the next document.

    The edited text has its last quarter of code points replaced by as many from the
    start of the next document, by id; the first follows the last. See with_heads() and
    with_next() for null ids and repeats. No rows: no rows.
    """
    terms = lexicon(docs, text_col, low, high)
    texts = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    marked = with_heads(texts, id_col).withColumn("fingerprint", fingerprint(F.col("text"), terms))
    rows = with_next(marked, id_col, ["text", "fingerprint"], ["text"])
    size = F.char_length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select(id_col, size.cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), terms).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
