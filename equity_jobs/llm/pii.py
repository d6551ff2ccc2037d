"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the base matches and looser forms of the same kinds. Three labelers vote
for a candidate, against it, or not at all: a regex on its form, a gazetteer of listed
parts (domain endings, address blocks, issuer and calling codes), and the words on both
sides of it. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is for each kind; the posteriors weigh the examples of a logistic
span classifier, which also sees features of the span itself and decides on the looser
candidates. Base matches stay whatever it says.

What is stored between the steps are places, votes and features, never the data found.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.llm.common import written

KINDS = ["email", "ip", "card", "phone"]  # in the order in which spans are listed

# Runs and repeated groups are taken whole by possessive quantifiers: the same matches as
# with plain ones, without backtracking and without a stack that grows with the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that a text without any match fails; null: none.
HINT = {"email": "@", "ip": None, "card": None, "phone": "+"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]++"
    r"(?:\.[A-Za-z0-9-]++| ?[(\[] ?(?:dot|DOT) ?[)\]] ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Fa-f:])"
    r"|(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ ./_-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9(+])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}|00[1-9][0-9]{0,2}[ ./-][0-9](?:[ ./()-]?[0-9]){6,11})(?![0-9])",
}
LOOSE_HINT = {
    "email": r"[(\[] ?(?:at|AT) ?[)\]]",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]{2}|[0-9]\[\.\]",
    "card": r"[0-9]{13}|[0-9]{4}[ ./_-][0-9]{4}",
    "phone": r"[0-9]{3}[-. ][0-9]{4}|00[1-9][0-9]{0,2}[ ./-]",
}
# The form labeler: the first pattern that fits gives the vote; none: no vote.
FORM = {
    "email": [(r"\.\.|[0-9]$|^[.%+-]", -1), (r"^.{1,64}(?:@| ?[(\[] ?(?:at|AT) ?[)\]]).*[A-Za-z]{2}$", 1)],
    "ip": [(r"(?:^|[.\]])0[0-9]", -1), (r"^[0-9](?:\.|\[)", 0), (r"[0-9]", 1)],
    "card": [(r"^([0-9])\1{12}|^[0-9]{13,14}$", -1), (r"^[0-9]{15,16}$|^[0-9]{4}([^0-9])[0-9]{4}\2[0-9]{4}\2[0-9]{4}$|^[0-9]{4}([^0-9])[0-9]{6}\3[0-9]{5}$", 1)],
    "phone": [(r"^\+0|^\(?[01][0-9]{2}[-. )]", -1), (r"^\+[1-9]|^00[1-9]|^\(?[2-9]", 1)],
}
# What the gazetteer lists. By kind, the part of the span that is looked up.
ENDINGS = "com org net edu gov mil int info biz io ai app dev me tv eu de fr es uk us ca au at ch it nl be lu pl cz se no dk fi pt ie mx ar br cl co pe ru ua in cn jp kr tw za".split()
FILE_ENDINGS = "png jpg jpeg gif svg webp css js json html htm xml py txt pdf md yml yaml".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38|30[0-5])"
CALLING = r"^(?:\+|00)(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[0-3])|^\(?[2-9][0-9]{2}[-. )]"
# The context labeler: words on either side that announce the kind, or something else.
ANNOUNCES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|courriel|correo|schreiben)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|address|server|client|login|adresse|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cvv|karte|kreditkarte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:call|phone|tel|fax|mobile|cell|whatsapp|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
}
DENIES = {
    "email": r"(?i)\b(?:file|image|src|href|path)\b",
    "ip": r"(?i)\b(?:version|release|build|section|chapter|firmware|v)\b",
    "card": r"(?i)\b(?:isbn|order|invoice|tracking|serial|sku|ticket|timestamp|barcode)\b",
    "phone": r"(?i)\b(?:isbn|order|invoice|tracking|serial|sku|ticket|part|item)\b",
}
NEAR = 40  # code points on either side that the context labeler reads, up to the next match of the same kind
LABELERS = ("form", "listed", "announced")
#: Features of the span itself; with the votes at most 1,296 patterns a kind, whatever the data.
FEATURES = (*LABELERS, "glued", "parts", "sized", "checked")
BLOCK = 256  # lengths that are added up at once


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    right = F.reverse(_digits(value))

    def part(i: Column) -> Column:
        digit = F.substring(right, i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    places = F.sequence(F.lit(1), F.char_length(right))
    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a base match is one."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.lpad(p, 3, "0").cast("int") <= 255))
    size = F.char_length(_digits(value))
    if kind == "card":
        return F.when(size.between(16, 19), _luhn(value)).otherwise(False)
    return size.between(8, 15) if kind == "phone" else F.lit(True)


def _sums_before(sizes: Column) -> Column:
    """For each of an array of lengths the sum of those before it, added up in blocks."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    last = F.floor((F.greatest(F.size(sizes), F.lit(1)) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))

    def placed(own: Column, before: Column) -> Column:
        return F.transform(own, lambda _, j: before + total(F.slice(own, F.lit(1), j)))

    return _let(blocks, lambda bs: _let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda own, b: _let(total(F.slice(sums, F.lit(1), b)), lambda before: placed(own, before))))))


def _matches(text: Column, pattern: str, hint: Column | None) -> Column:
    """The leftmost non-overlapping matches: start (in code points), value, and the text before and after each.

    before and after end at the neighbouring matches: they are the pieces of split().
    """

    def found(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        zipped = F.arrays_zip(F.slice(pieces, F.lit(1), n).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.slice(pieces, F.lit(2), n).alias("after"))
        sizes = lambda z: F.transform(z, lambda m: F.char_length(m["before"]) + F.char_length(m["value"]))
        starts = lambda z, s: F.transform(s, lambda at, i: F.struct((at + F.char_length(F.get(z, i)["before"])).alias("start"), F.get(z, i).alias("m")))
        return F.when(n > 0, _let(zipped, lambda z: starts(z, _sums_before(sizes(z)))))

    matched = _let(F.split(text, pattern, -1), found)
    return matched if hint is None else F.when(hint, matched)


def _first(value: Column, rules: list[tuple[str, int]]) -> Column:
    vote = F.lit(0)
    for pattern, is_ in reversed(rules):
        vote = F.when(value.rlike(pattern), is_).otherwise(vote)
    return vote


def _listed(kind: str, value: Column) -> Column:
    """The gazetteer's vote: listed, listed as something else, or nothing known."""
    if kind == "email":
        ending = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        return F.when(ending.isin(ENDINGS), 1).when(ending.isin(FILE_ENDINGS), -1).otherwise(0)
    if kind == "ip":
        block = F.regexp_extract(value, r"^0*([0-9]{1,3})(?:\.|\[)", 1)
        octet = F.when(block != "", block.cast("int"))
        return F.when(octet.between(1, 223), 1).when(octet.isNotNull(), -1).when(value.rlike(r"^(?:[23][0-9A-Fa-f]{3}|(?i)fe80|f[cd][0-9a-f]{2}):"), 1).otherwise(0)
    return F.when(value.rlike(ISSUERS if kind == "card" else CALLING), 1).otherwise(0)


def _judged(kind: str, base: bool, matches: Column) -> Column:
    """Spans with the labelers' votes (1 for, -1 against, 0 none) and features; of base matches those that hold."""

    def span(s: Column) -> Column:
        value, before, after = s["m"]["value"], F.right(s["m"]["before"], F.lit(NEAR)), F.left(s["m"]["after"], F.lit(NEAR))
        near = F.concat(before, F.lit(" "), after)
        separators = F.char_length(F.regexp_replace(value, "[A-Za-z0-9]", ""))
        size = F.char_length(value)
        votes = {
            "form": _first(value, FORM[kind]),
            "listed": _listed(kind, value),
            "announced": F.when(near.rlike(ANNOUNCES[kind]), 1).when(near.rlike(DENIES[kind]), -1).otherwise(0),
            "glued": (before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")).cast("int"),
            "parts": F.when(separators == 0, 0).when(separators <= 3, 1).otherwise(2),
            "sized": F.when(size < 8, 0).when(size < 16, 1).when(size < 32, 2).otherwise(3),
            "checked": (F.lit(base) if kind == "card" else F.lit(False)).cast("int"),
        }
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + size).alias("end"), F.lit(base).alias("base"), *(v.cast("int").alias(n) for n, v in votes.items()))

    kept = F.filter(matches, lambda s: _holds(kind, s["m"]["value"])) if base else matches
    empty = F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(base).alias("base"), *(F.lit(0).alias(n) for n in FEATURES))), lambda s: F.lit(False))
    return F.coalesce(F.transform(kept, span), empty)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a number of its own for every row) and spans: base matches and all looser ones."""
    texts = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    text, parts = F.col("text"), []
    for kind in KINDS:
        hint = None if HINT[kind] is None else F.contains(text, F.lit(HINT[kind]))
        parts += [_judged(kind, True, _matches(text, BASE[kind], hint)), _judged(kind, False, _matches(text, LOOSE[kind], text.rlike(LOOSE_HINT[kind])))]
    return texts.select("id", "row", F.concat(*parts).alias("spans"))


def open_spans(marked: DataFrame) -> DataFrame:
    """The spans of candidates() as rows, without looser ones that overlap a base match of their text."""
    rows = marked.where(F.size("spans") > 0).select("row", F.inline("spans"))
    upward = Window.partitionBy("row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"_end": F.max(F.when(F.col("base"), F.col("end"))).over(upward), "_start": F.min(F.when(F.col("base"), F.col("start"))).over(downward)})
    overlaps = F.coalesce(F.col("_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_start") < F.col("end"), F.lit(False))
    return seen.where(F.col("base") | ~overlaps).drop("_end", "_start")


@dataclass(frozen=True)
class Reliability:
    """Of a kind: the share of true spans, and by labeler the chance that its vote is for a true and against a false one."""

    prior: float
    right: dict[str, tuple[float, float]]

    def posterior(self, pattern: dict[str, int]) -> float:
        true, false = math.log(self.prior), math.log(1 - self.prior)
        for labeler, vote in pattern.items():
            for_true, against_false = self.right[labeler]
            if vote > 0:
                true, false = true + math.log(for_true), false + math.log(1 - against_false)
            elif vote < 0:
                true, false = true + math.log(1 - for_true), false + math.log(against_false)
        return 1 / (1 + math.exp(max(-50.0, min(50.0, false - true))))


def estimate(patterns: list[tuple[dict[str, int], int]], rounds: int = 50) -> Reliability:
    """Expectation-maximisation over vote patterns and their counts (at most 27).

    It begins with the votes at face value. Votes of 0 say nothing. Each labeler is taken
    to have been right in four earlier cases of five.
    """
    weights = [min(0.95, max(0.05, 0.5 + 0.2 * sum(p.values()))) for p, _ in patterns]
    now = None
    for _ in range(rounds):
        rows = [(p, n * w, n * (1 - w)) for w, (p, n) in zip(weights, patterns, strict=True)]
        right = {
            name: (
                (4 + sum(t for p, t, _ in rows if p[name] > 0)) / (5 + sum(t for p, t, _ in rows if p[name])),
                (4 + sum(f for p, _, f in rows if p[name] < 0)) / (5 + sum(f for p, _, f in rows if p[name])),
            )
            for name in LABELERS
        }
        share = sum(t for _, t, _ in rows) / sum(t + f for _, t, f in rows)
        now = Reliability(min(0.95, max(0.05, share)), right)
        weights = [now.posterior(p) for p, _ in patterns]
    return now


def span_weights(spans: DataFrame) -> dict[str, list[float]]:
    """By kind the weights and the intercept of the span classifier, learned from all candidates."""
    counted = spans.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).orderBy("kind", *FEATURES).collect()  # at most 4 x 1,296 patterns
    learned = {}
    for kind in KINDS:
        mine = [r for r in counted if r["kind"] == kind]
        if not mine:
            continue
        votes: dict[tuple[int, ...], int] = {}
        for r in mine:
            key = tuple(r[name] for name in LABELERS)
            votes[key] = votes.get(key, 0) + r["n"]
        reliability = estimate([(dict(zip(LABELERS, key, strict=True)), n) for key, n in votes.items()])
        rows = []
        for r in mine:
            share = reliability.posterior({name: r[name] for name in LABELERS})
            rows += [(*(float(r[f]) for f in FEATURES), label, r["n"] * w) for label, w in ((1.0, share), (0.0, 1 - share))]
        listed = ", ".join(f"({', '.join(f'{x!r}D' for x in row)})" for row in rows)
        frame = spans.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(FEATURES)}, label, weight)")
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame))
        learned[kind] = [*map(float, model.coefficients), float(model.intercept)]
    return learned


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id and spans (kind, start, end, base; code points, end exclusive; by kind, then start) of every row.

    Null and empty texts have no spans; no rows: no rows. Repeats and null ids stay, each
    with its own spans; other columns are not read. threshold: the classifier's
    probability from which a looser candidate counts.
    """
    marked = written(candidates(docs, id_col, text_col), "personal-data")
    spans = written(open_spans(marked), "personal-spans")
    said = F.lit(False)
    for kind, (*weights, intercept) in span_weights(spans).items():
        score = sum((F.col(name) * w for name, w in zip(FEATURES, weights, strict=True)), F.lit(intercept))
        said = F.when(F.col("kind") == kind, score >= math.log(threshold / (1 - threshold))).otherwise(said)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    own = spans.where(F.col("base") | said).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("own"))
    listed = F.transform("own", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,base:boolean>>")
    return marked.select("id", "row").join(own, "row", "left").select(F.col("id").alias(id_col), F.coalesce(listed, none).alias("spans"))
