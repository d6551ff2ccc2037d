"""Terms and scores of Chinese, English and mixed questions against a brute-force version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from equity_jobs.operators import text

HAN = re.compile(r"[㐀-䶿一-鿿]")
stem = lambda w: w[:-1] if w.endswith("ed") and len(w) > 4 else w
flat = lambda t: re.sub(r"[\s\xa0]+", " ", t or "").strip().lower()


def features(question, stop, lexicon, concepts):
    weights = {stem(w): 2.0 for w in re.findall("[a-z0-9]+", flat(question)) if w not in stop and len(w) > 1}
    named = []
    for phrase, terms in lexicon.items():
        for t in terms if phrase in flat(question) else []:
            weights[stem(t)] = max(weights.get(stem(t), 0), 1.5)
    for name, (triggers, terms) in concepts.items():
        if any(t in flat(question) for t in triggers):
            named.append(name)
            for t in terms:
                weights[stem(t)] = max(weights.get(stem(t), 0), 1.0)
    return weights, named


def score(page, question, weights):
    body = flat(page)
    tokens = [stem(w) for w in re.findall("[a-z0-9]+", body)]
    counts = {t: body.count(t) if HAN.search(t) else tokens.count(t) for t in weights}
    matched = sorted(t for t, n in counts.items() if n)
    if not matched:
        return None
    total = 10 * sum(weights[t] for t in matched) / sum(weights.values()) + sum(min(counts[t], 3) * weights[t] for t in matched)
    phrase = " ".join(re.findall("[a-z0-9]+", question.lower()))
    return round(total + (5 if phrase and phrase in body else 0), 9), matched


QUESTIONS = [
    "净利润率是多少？", "What drove the increased Revenue", "公司的总负债 and cash flow 风险", "What is the current ratio", "cover its bills with\xa0cash   generated", "现金", "", None, "the of and", "short-term obligations 借款", "cash", "A股 中中 risk", "total liabilities",
]
PAGES = [
    "净利润为100，净利润率上升；营业收入与营业总收入。归属于母公司股东的净利润", "Revenue increased as sales increase. revenue REVENUE revenue", "负债合计 1,000\n流动负债合计 资产总计", "the current\nratio of current assets to liabilities", "中中中中中 A股票 a股 股",
    "Total liabilities, net", "cash flows and cash, cashed", None, "", "借", "借款借款", "what drove the increased revenue? What drove the increased revenues", "no match here 人",
]


@pytest.mark.parametrize("lexicon", [text.FINANCE_TERMS, text.FINANCE_TERMS | {"a股": ["a股", "股"], "中中": ["中中", "股", "中中中"], "risk": ["人"]}])
def test_scores_equal_brute_force(spark, lexicon):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id bigint, text string").repartition(3)
    pages = spark.createDataFrame([(i, p, "term", 7) for i, p in enumerate(PAGES)], "doc_id bigint, text string, term string, tf int").repartition(3)
    terms = text.query_terms(asked, lexicon=lexicon)
    want = {i: features(q, text.STOP_WORDS, lexicon, text.FINANCE_CONCEPTS) for i, q in enumerate(QUESTIONS)}
    assert {(r.query_id, r.term): r.weight for r in terms.collect()} == {(i, t): w for i, (ws, _) in want.items() for t, w in ws.items()}
    assert {r.query_id: r.concepts for r in text.query_concepts(asked).collect()} == {i: names for i, (_, names) in want.items()}
    scores = text.lexical_scores(pages, terms, asked, ["doc_id"])
    got = {(r.query_id, r.doc_id): (round(r.lexical, 9), r.matched) for r in scores.collect()}
    assert got == {(i, j): s for i, (ws, _) in want.items() for j, p in enumerate(PAGES) if ws and (s := score(p, QUESTIONS[i] or "", ws))}
    plan = scores._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scores_without_terms_or_pages(spark):
    asked = spark.createDataFrame([(1, "净利润 growth")], "query_id bigint, text string")
    pages = spark.createDataFrame([(1, "净利润")], "doc_id bigint, text string")
    terms = text.query_terms(asked)
    assert text.lexical_scores(pages.limit(0), terms, asked, ["doc_id"]).count() == 0
    assert text.lexical_scores(pages, terms.limit(0), asked.limit(0), ["doc_id"]).count() == 0
    assert text.query_terms(asked, lexicon={}, concepts={}).collect()[0].term == "growth"
    assert text.substring_counts(pages, terms.where("term = 'growth'"), ["doc_id"]).count() == 0


def test_a_trie_finds_overlapping_phrases(spark):
    phrases = ["ab", "abc", "bc", "b", "c d", "(x)", "a+"]
    rows = spark.createDataFrame([(1, "zabcz c d (x)"), (2, "ab a+ b"), (3, ""), (4, None)], "query_id int, text string")
    got = {(r.query_id, r.phrase) for r in text.phrases_in(rows, F.col("text"), phrases, ["query_id"]).collect()}
    assert got == {(i, p) for i, t in ((1, "zabcz c d (x)"), (2, "ab a+ b")) for p in phrases if p in t}
    assert text.phrases_in(rows, F.col("text"), [], ["query_id"]).count() == 0


def test_balance_sheet_scopes(spark):
    asked = spark.createDataFrame([(1, "TOTAL  liabilities?"), (2, "总负债"), (3, "cash"), (4, None)], "query_id bigint, text string")
    pages = spark.createDataFrame([(1, "Group balance sheet\nnon-current\nliabilities net assets"), (2, "非流动负债合计 负债合计 所有者权益合计"), (3, "负债合计"), (4, None)], "doc_id bigint, text string")
    wanted, holds, size = text.statement_bonus(asked, pages, ["doc_id"])
    assert {r[0] for r in wanted.collect()} == {1, 2} and {r[0] for r in holds.collect()} == {1, 2} and size == 0.25


def test_block_scores_keep_ties_and_copies(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 9))) for _ in range(40)]
    pages = spark.createDataFrame([(i, texts[i % 40]) for i in range(600)], "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame([(i, texts[i % 7]) for i in range(21)], "query_id bigint, text string")
    terms = text.query_terms(asked, [], {}, {})
    whole = text.lexical_scores(pages, terms, asked, ["doc_id"])
    assert "_word" not in whole._jdf.queryExecution().toString()  # no row a (question, passage, term)
    rows = {(r.query_id, r.doc_id): (round(r.lexical, 9), r.matched) for r in whole.collect()}
    wanted = {q: {(q, d) for _, d in sorted((-s, d) for (p, d), (s, _) in rows.items() if p == q)[:3]} for q in range(21)}
    found = {(r.query_id, r.doc_id): (round(r.lexical, 9), r.matched) for r in text.lexical_scores(pages, terms, asked, ["doc_id"], 3).collect()}
    assert found.items() <= rows.items() and all(w <= found.keys() for w in wanted.values())
    assert len(found) < len(rows) / 4


def test_chunks_leave_before_all_are_made(spark):
    pages = spark.createDataFrame([(1, i, f"{'a' * 50}\n{'b' * 50}") for i in range(40)], "doc_id bigint, page_number bigint, text string").coalesce(1)
    whole = text.chunk_pages(pages, 60, 0)
    assert sorted(whole.collect()) == sorted(text.chunk_pages(pages, 60, 0, held=120).collect()) and whole.count() == 80
