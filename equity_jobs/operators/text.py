"""Report text: chunks, retrieval, routing, grounded evidence, counter-evidence and verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.operators import lexical

WORD = "[a-z0-9]+"


def pack_lines(text: str, most: int, overlap: int) -> list[str]:
    """Lines packed into chunks of at most `most` characters; a longer line stands alone; a chunk repeats the last lines of the one before."""
    lines = [line for raw in text.split("\n") if (line := re.sub(r"[\s\xa0]+", " ", raw).strip())]
    chunks, at = [], 0
    while at < len(lines):
        end, size = at + 1, len(lines[at])
        while end < len(lines) and size + 1 + len(lines[end]) <= most:
            size, end = size + 1 + len(lines[end]), end + 1
        chunks.append("\n".join(lines[at:end]))
        if end >= len(lines):
            break
        at = max(at + 1, end - overlap)
    return chunks


def chunk_pages(pages: DataFrame, most: int = 1200, overlap: int = 2, held: int = 1 << 20) -> DataFrame:
    """TX1: doc_id, page_number, chunk_index (from 1) and text of every page; null and blank pages have no chunk."""

    def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        doc, page, index, text = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(doc, schema.field("doc_id").type), pa.array(page, schema.field("page_number").type), pa.array(index, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "page_number", "chunk_index", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one page at a time; chunks go as soon as they hold `held` characters
        for batch in batches:
            rows, size = [], 0
            docs, numbers, texts = (batch.column(n) for n in ("doc_id", "page_number", "text"))
            for at in range(batch.num_rows):
                for i, chunk in enumerate(pack_lines(texts[at].as_py() or "", most, overlap), 1):
                    rows.append((docs[at].as_py(), numbers[at].as_py(), i, chunk))
                    size += len(chunk)
                    if size >= held:
                        yield packed(rows, batch.schema)
                        rows, size = [], 0
            if rows:
                yield packed(rows, batch.schema)

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("doc_id", "page_number", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, chunk_index bigint, text string")


# Words that are no terms, Chinese phrases with the terms they stand for, and
# concepts with the phrases that ask for them and their terms.
STOP_WORDS = ["a", "an", "and", "are", "by", "can", "company", "did", "do", "does", "for", "from", "how", "in", "it", "its", "is", "of", "on", "the", "to", "was", "were", "what", "why", "with", "year"]
FINANCE_TERMS = {
    "营业收入": ["营业收入", "营业总收入", "revenue", "sales"],
    "收入": ["营业收入", "营业总收入", "revenue", "sales"],
    "营收": ["营业收入", "营业总收入", "revenue", "sales"],
    "净利润率": ["净利润", "归属于母公司股东的净利润", "营业收入", "net", "profit", "margin", "revenue"],
    "净利率": ["净利润", "归属于母公司股东的净利润", "营业收入", "net", "profit", "margin", "revenue"],
    "净利润": ["净利润", "归属于母公司股东的净利润", "net", "profit"],
    "利润": ["利润总额", "净利润", "profit"],
    "盈利": ["利润总额", "净利润", "profit"],
    "经营现金流": ["经营活动产生的现金流量净额", "经营活动现金流量净额", "operating", "cash", "flow"],
    "投资现金流": ["投资活动产生的现金流量净额", "investing", "cash", "flow"],
    "融资现金流": ["筹资活动产生的现金流量净额", "financing", "cash", "flow"],
    "现金流": ["现金流量净额", "cash", "flow"],
    "现金": ["现金及现金等价物", "cash"],
    "流动比率": ["流动资产合计", "流动负债合计", "current", "assets", "liabilities", "ratio"],
    "流动资产": ["流动资产合计", "current", "assets"],
    "总资产": ["资产总计", "资产合计", "total", "assets"],
    "资产": ["资产总计", "assets"],
    "流动负债": ["流动负债合计", "current", "liabilities"],
    "总负债": ["负债合计", "负债总计", "total", "liabilities"],
    "负债": ["负债合计", "liabilities"],
    "借款": ["借款", "borrowings"],
    "债务": ["债务", "借款", "debt", "borrowings"],
    "增长": ["增加", "增长", "growth", "increase"],
    "下降": ["减少", "下降", "decrease", "decline"],
    "风险": ["风险", "risk"],
}
FINANCE_CONCEPTS = {
    "revenue and sales": (["revenue", "sales", "turnover", "top line", "收入", "营收"], ["revenue", "sales", "growth", "营业收入", "营业总收入"]),
    "profitability": (
        ["profitability", "earnings", "bottom line", "net margin", "盈利能力", "利润率", "净利率", "净利润"],
        ["profit", "earnings", "margin", "revenue", "净利润", "归属于母公司股东的净利润", "营业收入"],
    ),
    "operating cash flow": (
        ["operating cash flow", "cash generation", "cash generated", "core operations", "day-to-day operations", "day to day operations", "经营现金流", "经营活动现金"],
        ["operating", "cash", "flow", "generated", "working", "capital", "经营活动产生的现金流量净额", "经营活动现金流量净额"],
    ),
    "liquidity": (
        ["liquidity", "current ratio", "short-term obligations", "short term obligations", "cover its bills", "meet near-term payments", "流动比率", "流动性", "短期偿债"],
        ["current", "assets", "liabilities", "working", "capital", "liquidity", "流动资产合计", "流动负债合计"],
    ),
    "leverage": (
        ["leverage", "total liabilities", "capital structure", "debt burden", "asset base", "funded by obligations", "资产负债率", "负债资产比", "资本结构", "偿债压力"],
        ["total", "assets", "liabilities", "borrowings", "debt", "资产总计", "负债合计", "所有者权益合计"],
    ),
    "capital expenditure": (
        ["capital expenditure", "capex", "investment in stores", "property plant and equipment", "资本开支", "扩张投资"],
        ["capital", "expenditure", "purchase", "property", "plant", "equipment", "购建固定资产"],
    ),
}
# Who asks for total liabilities, and what a full balance sheet says.
ASKS_LIABILITIES = ["total liabilities", "总负债", "资产负债率"]
BALANCE_SCOPES = [["non-current liabilities", "net assets", "group balance sheet"], ["非流动负债合计", "负债合计", "所有者权益合计"]]

HAN = "\u3400-\u4dbf\u4e00-\u9fff"  # characters that words are not split by


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def stem(word: Column) -> Column:
    """Words of over 4 letters that end in "ed" without their last letter."""
    return F.when(word.endswith("ed") & (F.char_length(word) > 4), F.left(word, F.char_length(word) - 1)).otherwise(word)


def flat(text: Column) -> Column:
    """Lower case, white space joined."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00a0]+", " ")))


def trie_pattern(phrases: list[str]) -> str:
    """A regular expression for the longest of the phrases at a place: common beginnings are tried once, as in a trie."""
    trie: dict = {}
    for phrase in phrases:
        node = trie
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(c) + pattern(n) for c, n in node.items() if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + ("?" if "" in node else "")

    return pattern(trie)


def phrases_in(rows: DataFrame, text: Column, phrases: list[str], keys: list[str]) -> DataFrame:
    """keys and phrase, once each, for all phrases that a row's text holds anywhere, overlapping ones too.

    The text is read once: at each place a trie finds the longest phrase that begins there,
    and an equi-join adds those that are its beginnings. phrases: a parameter, on the driver.
    """
    if not phrases:
        return rows.select(*keys, F.lit("").alias("phrase")).limit(0)
    found = rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({trie_pattern(phrases)}))"), F.lit(1)))).alias("_longest"))
    begins = [(long, short) for long in set(phrases) for short in set(phrases) if long.startswith(short)]
    table = rows.sparkSession.createDataFrame(begins, "_longest string, phrase string")
    return found.join(table, "_longest").select(*keys, "phrase").distinct()


def query_terms(questions: DataFrame, stop: list[str] | None = None, lexicon: dict[str, list[str]] | None = None, concepts: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """TX2: query_id, term and weight: 2 for stemmed words of the question, 1.5 for the terms of phrases
    in it, 1 for those of its concepts; of equal terms the largest weight counts.

    lexicon: phrase to terms. concepts: name to (phrases that ask for it, terms). Phrases are
    found anywhere in the question's flat text, in Chinese as in English; all terms are stemmed.
    Words of one character and stop words are no terms; null questions have none.
    """
    lexicon, concepts = FINANCE_TERMS if lexicon is None else lexicon, FINANCE_CONCEPTS if concepts is None else concepts
    kept = F.filter(words(F.col("text")), lambda w: (F.char_length(w) > 1) & ~w.isin(STOP_WORDS if stop is None else stop))
    found = questions.select("query_id", F.explode(F.transform(kept, stem)).alias("term"), F.lit(2.0).alias("weight"))
    meant = [(p, t, 1.5) for p, terms in lexicon.items() for t in terms] + [(p, t, 1.0) for triggers, terms in concepts.values() for p in triggers for t in terms]
    if meant:
        held = phrases_in(questions, flat(F.col("text")), list(dict.fromkeys(p for p, *_ in meant)), ["query_id"])
        table = questions.sparkSession.createDataFrame(meant, "phrase string, term string, weight double")
        found = found.unionByName(held.join(table, "phrase").select("query_id", stem(F.col("term")).alias("term"), "weight"))
    return found.groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def query_concepts(questions: DataFrame, concepts: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """TX2: query_id and concepts, the names of those that a phrase of the question asks for, in the table's order; none: an empty list."""
    concepts = FINANCE_CONCEPTS if concepts is None else concepts
    asks = [(p, i, name) for i, (name, (triggers, _)) in enumerate(concepts.items()) for p in triggers]
    table = questions.sparkSession.createDataFrame(asks, "phrase string, place int, concept string")
    named = phrases_in(questions, flat(F.col("text")), [p for p, *_ in asks], ["query_id"]).join(table, "phrase")
    listed = named.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("place", "concept"))).getField("concept").alias("concepts"))
    return questions.select("query_id").join(listed, "query_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def substring_counts(passages: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term and tf: how often a passage's flat text holds each Chinese term, occurrences that overlap counted once.

    A positional index of two-character grams: every Chinese character of a text gives the
    gram that begins there and the characters around it; an equi-join with the gram of each
    term's first Chinese character finds its places, and the surroundings tell whether the
    whole term stands there. Texts never meet all terms. Terms that can overlap themselves
    are counted again in the texts that hold them.
    """
    asked = terms.select("term").distinct().where(F.col("term").rlike(f"[{HAN}]"))
    asked = asked.withColumn("_back", F.char_length(F.regexp_extract("term", f"^[^{HAN}]*", 0))).withColumn("_gram", F.expr("substring(term, _back + 1, 2)"))
    border = F.exists(F.sequence(F.lit(1), F.char_length("term") - 1), lambda n: F.left("term", n) == F.right("term", n))
    asked = asked.withColumn("_overlaps", F.when(F.char_length("term") > 1, border).otherwise(F.lit(False)))
    size = asked.agg(F.max("_back"), F.max(F.char_length("term")), F.coalesce(F.max(F.char_length("_gram") == 1), F.lit(False)), F.coalesce(F.max("_overlaps"), F.lit(False))).first()
    if size[1] is None:
        return passages.select(*keys, F.lit("").alias("term"), F.lit(0).cast("bigint").alias("tf")).limit(0)
    back, longest, single, overlaps = size
    # lines cannot be in flat text, so they pad its beginning
    padded = F.concat(F.lit("\n" * back), flat(F.col("text")))
    around = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{back}}}[{HAN}].{{0,{longest - 1}}}))"), F.lit(1))
    places = passages.where(F.col("text").rlike(f"[{HAN}]")).select(*keys, F.explode(around).alias("_around"))
    grams = F.array(*(F.substring("_around", back + 1, n) for n in ([2, 1] if single else [2])))
    # a last character's gram is its only one
    places = places.withColumn("_gram", F.explode(F.array_distinct(grams)))
    stands = F.expr(f"substring(_around, {back + 1} - _back, char_length(term))") == F.col("term")
    hits = places.join(asked, "_gram").where(stands)
    counts = hits.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("_overlaps").alias("_overlaps"))
    if not overlaps:
        return counts.drop("_overlaps")
    again = counts.where("_overlaps").select(*keys, "term").join(passages.select(*keys, flat(F.col("text")).alias("_flat")), keys)
    again = again.select(*keys, "term", ((F.char_length("_flat") - F.char_length(F.replace("_flat", "term", F.lit("")))) / F.char_length("term")).cast("bigint").alias("tf"))
    return counts.where("not _overlaps").drop("_overlaps").unionByName(again)


def asked_classes(terms: DataFrame, questions: DataFrame) -> DataFrame:
    """What lexical.score() takes for questions: those that have equal words and terms are one class."""
    asked_words = words(F.col("text"))
    inner = F.transform(F.slice(asked_words, 2, F.greatest(F.size(asked_words) - 2, F.lit(0))), stem)
    return lexical.classes(questions, terms, F.array_join(asked_words, " "), inner)


def lexical_scores(passages: DataFrame, terms: DataFrame, questions: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """TX3: score and matched terms of each (query, passage) with any match, by inverted indexes of blocks of questions.

    10 x matched weight / total weight, plus the weight of each term for up to three
    occurrences, plus 5 if the passage's flat text holds the question's English words in a
    row. Terms with Chinese characters count as substrings, others as stemmed words. keys name
    one passage. k: only passages that may be among a query's k best, ties to the smaller keys.
    """
    return lexical.score(passages.select(*keys, flat(F.col("text")).alias("_flat"), F.lit(False).alias("_split")), asked_classes(terms, questions), keys, HAN, k)


def hybrid_candidates(passages: DataFrame, terms: DataFrame, questions: DataFrame, keys: list[str], semantic: DataFrame, most: int, holds: Column, k: int) -> DataFrame:
    """TX3 for TX4's k best: the lexical scores of all pairs of semantic (at most `most` a query) and of those other
    passages that may be among a query's k best, apart by whether the passage gives the bonus (holds)."""
    asked = asked_classes(terms, questions)
    plain = passages.select(*keys, flat(F.col("text")).alias("_flat"), holds.alias("_split"))
    near = lexical.score_pairs(semantic, plain, asked, keys, HAN)
    return lexical.score(plain, asked, keys, HAN, k + most).join(semantic.select("query_id", *keys), ["query_id", *keys], "left_anti").unionByName(near)


def hybrid_scores(lexical: DataFrame, semantic: DataFrame | None, keys: list[str], bonus: tuple[DataFrame, DataFrame, float] | None = None, recall: float = 0.60) -> DataFrame:
    """TX4: lexical over the query's best, mixed 0.55 to 0.45 with the semantic score where there is one; rows found by meaning alone need `recall`."""
    best = F.max("lexical").over(Window.partitionBy("query_id"))
    rows = lexical.withColumn("_norm", F.col("lexical") / best)
    rows = rows.join(semantic, ["query_id", *keys], "full_outer") if semantic is not None else rows.withColumn("semantic", F.lit(None).cast("double"))
    extra = F.lit(0.0)
    if bonus is not None:  # for rows that were found anyway: the bonus alone finds none
        wanted, holds, size = bonus
        rows = rows.join(wanted.withColumn("_asks", F.lit(True)), "query_id", "left").join(holds.withColumn("_holds", F.lit(True)), keys, "left")
        extra = F.when(F.col("_asks") & F.col("_holds"), F.lit(size)).otherwise(F.lit(0.0))
    norm, positive = F.coalesce("_norm", F.lit(0.0)), F.greatest("semantic", F.lit(0.0))
    score = F.when(F.col("semantic").isNull(), norm).otherwise(0.55 * norm + 0.45 * positive) + extra
    method = F.when(F.col("semantic").isNull(), "lexical").when(F.col("_norm").isNull(), "semantic").otherwise("hybrid")
    return rows.where(F.col("_norm").isNotNull() | (F.col("semantic") >= recall)).withColumns({"score": score, "method": method, "matched": F.coalesce("matched", F.array().cast("array<string>"))}).drop("_norm", "_asks", "_holds")


def statement_bonus(questions: DataFrame, passages: DataFrame, keys: list[str], asks: list[str] | None = None, scopes: list[list[str]] | None = None, size: float = 0.25) -> tuple[DataFrame, DataFrame, float]:
    """TX4's bonus: the questions that ask for the metric, the passages with all phrases of a scope, and what a row of both gains; they are never paired with each other."""
    wanted = questions.where(_any_of([F.contains(flat(F.col("text")), F.lit(a)) for a in asks or ASKS_LIABILITIES])).select("query_id")
    return wanted, passages.where(holds_scope(scopes)).select(*keys), size


def _any_of(tests: list[Column]) -> Column:
    return F.greatest(*tests, F.lit(False))


def holds_scope(scopes: list[list[str]] | None = None) -> Column:
    """Whether a passage has all phrases of a scope."""
    holds = lambda phrases: F.least(*(F.contains(flat(F.col("text")), F.lit(p)) for p in phrases), F.lit(True))
    return _any_of([holds(s) for s in scopes or BALANCE_SCOPES])


def top_results(scored: DataFrame, order: list[Column], k: int) -> DataFrame:
    """TK8: place of the k best of each query, by score and then the given order."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))).where(F.col("place") <= k)


# The router's trigger phrases in the order in which they are tried.
DEEP = ["management promise", "management said", "guidance", "delivered on", "compare years", "across years", "contradiction", "contradict", "承诺", "兑现", "管理层", "指引", "跨年度", "多年", "矛盾", "去年说"]
SCEPTICAL = ["what drove", "driver", "why", "risk", "quality", "cover its", "为什么", "原因", "风险", "质量", "偿债", "驱动"]
METRICS = {
    "net_profit_margin": ["net profit margin", "net margin", "profit margin", "净利润率", "净利率"], "revenue_growth": ["revenue growth", "sales growth", "收入增长率", "营收增长率"], "current_ratio": ["current ratio", "流动比率"],
    "liabilities_to_assets": ["liabilities-to-assets", "liabilities to assets", "debt ratio", "资产负债率", "负债资产比", "负债占资产"], "total_liabilities": ["total liabilities", "总负债"],
}
CHANGE = ["increase", "decrease", "增长", "下降", "变化"]
MARKERS = {"partly offset by": 5, "offset by": 5, "however": 4, "although": 4, "despite": 4, "could adversely": 4, "headwind": 3, "uncertain": 2}
# mode -> top_k, evidence and challenge limits
LIMITS = {"deep_investigation": (10, 5, 3), "skeptical_analysis": (6, 3, 2), "deterministic_metric": (6, 3, 2), "change_analysis": (6, 3, 2), "quick_evidence": (3, 2, 1)}


def route(text: Column, deep: list[str] | None = None, sceptical: list[str] | None = None, metrics: dict[str, list[str]] | None = None, change: list[str] | None = None) -> dict[str, Column]:
    """TX6: mode, trigger, tool and limits of a question: the first trigger of the first list that has one."""
    tools = {t: name for name, ts in (metrics or METRICS).items() for t in ts}
    lists = [("deep_investigation", deep or DEEP), ("skeptical_analysis", sceptical or SCEPTICAL), ("deterministic_metric", list(tools)), ("change_analysis", change or CHANGE)]
    names = ("mode", "trigger", "tool", "top_k", "max_evidence", "max_challenges")
    null = F.lit(None).cast("string")

    def entry(mode: str, phrase: str | None) -> Column:
        tool = tools.get(phrase) if mode == "deterministic_metric" else None
        values = [F.lit(mode), null if phrase is None else F.lit(phrase), null if tool is None else F.lit(tool), *map(F.lit, LIMITS[mode])]
        return F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))

    listed = F.array(*(entry(mode, phrase) for mode, phrases in lists for phrase in phrases))
    # an array of one, so that the question is made plain once and not for each phrase
    plain = F.array(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))
    found = F.get(F.transform(plain, lambda p: F.coalesce(F.get(F.filter(listed, lambda t: F.contains(p, t["trigger"])), 0), entry("quick_evidence", None))), 0)
    return {n: found[n] for n in names}


def sentences(text: Column) -> Column:
    """Sentences with white space joined, in order."""
    parts = F.split(F.regexp_replace(text, "\u00a0", " "), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def held(text: Column, terms: Column) -> Column:
    """How many of the terms the text holds anywhere, whatever its case."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))


def grounded(results: DataFrame, max_evidence: int = 3, short: int = 220, cut: int = 280, recall: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """TX7: of each query the best result of a page, its best passage, and whether the answer is supported.

    results: query_id, page_number, text, matched, score, semantic, place. The best passage
    matches most terms, then is longest up to `short`, then comes first.
    """
    page = F.row_number().over(Window.partitionBy("query_id", "page_number").orderBy("place"))
    rows = results.withColumn("_p", page).where("_p = 1").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= max_evidence)
    scored = F.transform(sentences(F.col("text")), lambda s, i: F.struct(held(s, F.col("matched")).alias("hits"), F.least(F.char_length(s), F.lit(short)).alias("size"), (-i).alias("place"), s.alias("text")))
    best = F.array_max(scored)
    excerpt = F.when(F.char_length(best["text"]) > cut, F.concat(F.rtrim(F.substring(best["text"], 1, cut)), F.lit("…"))).otherwise(best["text"])
    evidence = rows.select("query_id", "page_number", "rank", excerpt.alias("excerpt"), best["hits"].alias("hits"), "semantic").where("excerpt is not null")
    answer = evidence.groupBy("query_id").agg(F.count("*").alias("evidence"), (F.max(F.col("hits") >= 2) | F.coalesce(F.max(F.col("semantic") >= recall), F.lit(False))).alias("is_supported"))
    return evidence, answer


def challenges(results: DataFrame, markers: dict[str, int] | None = None, least: int = 40, top: int = 2) -> DataFrame:
    """TX8: sentences of at least `least` characters with a marker and a matched term, once for each page and text, in order.

    The marker is the heaviest in the sentence, the first listed at equal weight.
    """
    table = markers or MARKERS
    rows = results.select("query_id", "page_number", "matched", F.explode(sentences(F.col("text"))).alias("excerpt")).where(F.char_length("excerpt") >= least)
    marker, weight = F.lit(None).cast("string"), F.lit(None).cast("int")
    for word, value in sorted(reversed(list(table.items())), key=lambda x: x[1]):
        hit = F.lower("excerpt").rlike(rf"\b{word}\b")
        marker, weight = F.when(hit, word).otherwise(marker), F.when(hit, value).otherwise(weight)
    found = rows.withColumns({"marker": marker, "weight": weight, "terms": held(F.col("excerpt"), F.col("matched"))}).where("marker is not null and terms >= 1")
    once = found.dropDuplicates(["query_id", "page_number", "excerpt"])
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), F.desc("terms"), "page_number", "excerpt")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("matched")


def plain(text: Column) -> Column:
    """For comparing quotations: lower case, white space joined, a last ellipsis ignored."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "…$", ""), r"\s+", " ")))


def contained(quotes: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes with `traceable`: whether a source with equal keys (query or document, and page) holds the quoted text."""
    texts = sources.select(*keys, plain(F.col("text")).alias("_source"))
    rows = quotes.join(texts, keys, "left").withColumn("_hit", F.coalesce(F.contains("_source", plain(F.col("excerpt"))), F.lit(False)))
    return rows.groupBy(*quotes.columns).agg(F.max("_hit").alias("traceable"))


def verify(answers: DataFrame, evidence: DataFrame, challenged: DataFrame, results: DataFrame) -> DataFrame:
    """TX9: the five checks of each answer, and approved, approved_with_caveats or rejected."""
    own = contained(evidence.select("query_id", "page_number", "excerpt"), results, ["query_id", "page_number"]).groupBy("query_id").agg(F.every("traceable").alias("points_ok"), F.every(F.col("page_number") >= 0).alias("pages_ok"))
    theirs = contained(challenged.select("query_id", "page_number", "excerpt"), results, ["query_id", "page_number"]).groupBy("query_id").agg(F.every("traceable").alias("challenges_ok"), F.count("*").alias("challenges"), F.every(F.col("page_number") >= 0).alias("cited_ok"))
    rows = answers.join(own, "query_id", "left").join(theirs, "query_id", "left").withColumn("challenges", F.coalesce("challenges", F.lit(0)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns(
        {
            "evidence_check": yes(F.col("is_supported") & (F.col("evidence") > 0)), "trace_check": yes(F.col("is_supported") & F.col("points_ok")), "page_check": yes(F.col("pages_ok")) & F.coalesce("cited_ok", F.lit(True)),
            "status_check": yes(F.col("is_supported")) | (F.col("challenges") == 0), "challenge_check": F.coalesce("challenges_ok", F.lit(True)),
        }
    )
    good = F.col("evidence_check") & F.col("trace_check") & F.col("page_check") & F.col("status_check") & F.col("challenge_check")
    return rows.withColumn("verdict", F.when(~good, "rejected").when(F.col("challenges") > 0, "approved_with_caveats").otherwise("approved"))


def escalate(routes: DataFrame, verified: DataFrame, metric_missing: Column, weeks_differ: Column) -> DataFrame:
    """TX10: the signals of each query, and its route one level up where there is any and there is one."""
    rows = routes.join(verified, "query_id", "left")
    relevant = (F.col("tool") == "revenue_growth") | F.col("mode").isin("skeptical_analysis", "deep_investigation")
    signals = F.array_compact(
        F.array(
            F.when(F.coalesce("evidence", F.lit(0)) == 0, "no_evidence").when(~F.col("is_supported"), "weak_evidence"), F.when(metric_missing, "metric_missing"), F.when(F.col("challenges") > 0, "material_challenge"),
            F.when(F.coalesce(relevant, F.lit(False)) & weeks_differ, "period_mismatch"), F.when(F.col("verdict") == "rejected", "rejected"),
        )
    )
    top = F.col("mode") == "deep_investigation"
    up = F.when(F.col("mode").isin("quick_evidence", "deterministic_metric"), "skeptical_analysis").otherwise("deep_investigation")
    rows = rows.withColumn("signals", signals).withColumn("escalated", (F.size("signals") > 0) & ~top)
    mode = F.when(F.col("escalated"), up).otherwise(F.col("mode"))
    return rows.withColumn("final_mode", mode).withColumn("final_top_k", F.coalesce(*(F.when(mode == m, v[0]) for m, v in LIMITS.items())))


def guardrail(claims: DataFrame, sources: DataFrame, advice: str = r"(?i)\b(?:buy|sell|hold)\b|买入|卖出|持有") -> DataFrame:
    """TX11: why a generated claim must not be shown: an unknown page, an excerpt that is not verbatim, numbers that no source has, advice.

    claims: claim_id, query_id, page_number, excerpt, statement. sources: query_id, page_number, text.
    """
    number = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "")))
    pages = sources.groupBy("query_id", "page_number").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"))
    rows = claims.join(pages, ["query_id", "page_number"], "left")
    missing = F.size(F.array_except(number(F.col("statement")), number(F.coalesce("text", F.lit(""))))) > 0
    found = F.array_compact(
        F.array(F.when(F.col("text").isNull(), "page"), F.when(F.col("text").isNotNull() & ~F.contains(plain(F.col("text")), plain(F.col("excerpt"))), "excerpt"), F.when(missing, "numbers"), F.when(F.col("statement").rlike(advice), "advice"))
    )
    return rows.select("claim_id", "query_id", "page_number", found.alias("reasons"), (F.size(found) == 0).alias("shown"))
