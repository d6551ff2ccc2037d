"""Queries of the report text, statement, evaluation, brief, source and stream jobs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from equity_jobs.operators import brief, evaluation, statements, text, vectors
from equity_jobs.plans.market import AS_OF, EVENTS, FEATURED, LIMITED, RADAR, radar_rows, six
from equity_jobs.plans.registry import Registry
from equity_jobs.plans.research import NORMAL, POINTS, WINDOWS, latest_points, windows
from equity_jobs.plans.views import duck, view
from equity_jobs.sources import landed, sinks
from equity_jobs.sources.shared import shared_dir, written
from equity_jobs.streaming import feed

R = Registry()
STOP = ["the", "of", "and", "to", "in", "la", "de", "der", "die", "das", "que", "les", "le", "el", "et", "un"]
LEXICON = {"that": ["this"], "for": ["with"], "une": ["des"]}
CONCEPTS = {"first": (["and the"], ["by"]), "second": (["is the"], ["was"])}
# What makes Chinese and mixed pages and questions of the given texts: words that become phrases.
CHINESE = [
    (" the ", "营业收入"), (" of ", " 净利润率 "), (" and ", "，经营现金流"), (" in ", "总负债 "), (" to ", "风险"), (" der ", "流动资产合计"), (" die ", "资产总计 "),
    (" de ", "借款借款"), (" la ", "负债合计"), (" le ", "现金及现金等价物"), (" el ", "利润总额"), (" en ", "中中中"), (" que ", "资本开支"),
]
CHINESE_CONCEPTS = text.FINANCE_CONCEPTS | {"repeated": (["总负债", "款借"], ["中中", "款 x"])}


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def terms(spark, sf):
    return text.query_terms(questions(spark, sf), STOP, LEXICON, CONCEPTS)


def in_chinese(column, phrases=None):
    body = F.concat(F.lit(" "), column, F.lit(" "))
    for word, phrase in phrases or CHINESE:
        body = F.replace(body, F.lit(word), F.lit(phrase))
    return body


def in_chinese_sql(column, phrases=None):
    body = f"' ' || {column} || ' '"
    for word, phrase in phrases or CHINESE:
        body = f"replace({body}, '{word}', '{phrase}')"
    return body


FLAT = lambda c: f"lower(trim(regexp_replace(coalesce({c}, ''), '[\\s\\xa0]+', ' ', 'g')))"
STEM = lambda c: f"CASE WHEN {c} LIKE '%ed' AND length({c}) > 4 THEN left({c}, length({c}) - 1) ELSE {c} END"
HAN = "[\u3400-\u4dbf\u4e00-\u9fff]"


def terms_sql(source, stop, lexicon, concepts):
    """terms: query_id, term and weight of the questions that source selects."""
    meant = [(p, t, 1.5) for p, ts in lexicon.items() for t in ts] + [(p, t, 1.0) for ps, ts in concepts.values() for p in ps for t in ts]
    values = ", ".join(f"('{p}', '{t}', {w}e0)" for p, t, w in meant)
    return f"""q AS ({source}), qw AS (SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws, {FLAT("text")} AS flat FROM q), kept AS (SELECT query_id, w FROM (SELECT query_id, unnest(ws) AS w FROM qw) WHERE length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in stop)})),
t0 AS (SELECT query_id, {STEM("w")} AS term, 2.0e0 AS weight FROM kept UNION ALL SELECT query_id, {STEM("m.term")}, m.weight FROM qw JOIN (VALUES {values}) AS m(phrase, term, weight) ON contains(flat, m.phrase)), terms AS (SELECT query_id, term, max(weight) AS weight FROM t0 GROUP BY query_id, term)"""


def scores_sql(found, source):
    """lex: query_id, doc_id, lexical score and matched terms; found: terms_sql()."""
    return f"""{found}, tw AS (SELECT *, sum(weight) OVER (PARTITION BY query_id) AS total FROM terms), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws, {FLAT("text")} AS flat FROM ({source})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {STEM("w")} AS term FROM (SELECT doc_id, unnest(ws) AS w FROM dw)) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term
  UNION ALL SELECT doc_id, term, ((length(flat) - length(replace(flat, term, ''))) // length(term))::BIGINT FROM dw JOIN (SELECT DISTINCT term FROM terms WHERE regexp_matches(term, '{HAN}')) ON contains(flat, term)),
hits AS (SELECT query_id, doc_id, 10 * sum(weight) / max(total) AS share, sum(least(tf, 3) * weight) AS often, list_sort(list(term)) AS matched FROM tf JOIN tw USING (term) GROUP BY query_id, doc_id),
lex AS (SELECT h.query_id, h.doc_id, share + often + CASE WHEN len(qw.ws) > 0 AND contains(dw.flat, array_to_string(qw.ws, ' ')) THEN 5 ELSE 0 END AS lexical, matched FROM hits h JOIN dw USING (doc_id) JOIN qw USING (query_id))"""


TERMS = terms_sql("SELECT item_id AS query_id, text FROM benchmark", STOP, LEXICON, CONCEPTS)
SCORES = scores_sql(TERMS, "SELECT doc_id, text FROM documents")
CHINESE_PAGES = f"SELECT doc_id, {in_chinese_sql('text')} AS text FROM documents"
CHINESE_QUESTIONS = f"SELECT item_id AS query_id, {in_chinese_sql('text')} AS text FROM benchmark"
COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12)"
HYBRID = f"""{SCORES}, c0 AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {COSINE} AS semantic FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, doc_id) AS n FROM c0) WHERE n <= 10), nl AS (SELECT *, lexical / max(lexical) OVER (PARTITION BY query_id) AS norm FROM lex),
bon AS (SELECT q.query_id, d.doc_id FROM q JOIN documents d ON contains(lower(q.text), 'that') AND (contains(lower(d.text), 'this') AND contains(lower(d.text), 'with') OR contains(lower(d.text), 'une') AND contains(lower(d.text), 'des'))),
hy AS (SELECT query_id, doc_id, coalesce(matched, []) AS matched, s.semantic, CASE WHEN s.semantic IS NULL THEN coalesce(norm, 0) ELSE 0.55e0 * coalesce(norm, 0) + 0.45e0 * greatest(s.semantic, 0) END + CASE WHEN bon.doc_id IS NULL THEN 0 ELSE 0.25e0 END AS score, CASE WHEN s.semantic IS NULL THEN 'lexical' WHEN norm IS NULL THEN 'semantic' ELSE 'hybrid' END AS method
  FROM nl FULL JOIN sem s USING (query_id, doc_id) LEFT JOIN bon USING (query_id, doc_id) WHERE norm IS NOT NULL OR s.semantic >= 0.6e0),
res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS place FROM hy) WHERE place <= 6)"""


@R.query("tx2_query_terms", f"WITH {TERMS} SELECT query_id, term, weight FROM terms")
def tx2(spark, sf):
    return terms(spark, sf)


def chinese_questions(spark, sf):
    return questions(spark, sf).withColumn("text", in_chinese(F.col("text")))


@R.query("tx2_chinese_terms", f"WITH {terms_sql(CHINESE_QUESTIONS, text.STOP_WORDS, text.FINANCE_TERMS, text.FINANCE_CONCEPTS)} SELECT query_id, term, weight FROM terms")
def tx2_chinese(spark, sf):
    return text.query_terms(chinese_questions(spark, sf))


CONCEPT_ROWS = ", ".join(f"('{p}', {i}, '{name}')" for i, (name, (ps, _)) in enumerate(text.FINANCE_CONCEPTS.items()) for p in ps)


@R.query("tx2_concepts", f"WITH q AS ({CHINESE_QUESTIONS}), c AS (SELECT DISTINCT query_id, place, concept FROM q JOIN (VALUES {CONCEPT_ROWS}) AS v(phrase, place, concept) ON contains({FLAT('text')}, phrase)) SELECT q.query_id, coalesce(string_agg(concept, ', ' ORDER BY place), '') AS concepts FROM q LEFT JOIN c USING (query_id) GROUP BY q.query_id")
def tx2_concepts(spark, sf):
    return text.query_concepts(chinese_questions(spark, sf)).select("query_id", F.concat_ws(", ", "concepts").alias("concepts"))


@R.query("tx3_chinese_scores", f"WITH {scores_sql(terms_sql(CHINESE_QUESTIONS, text.STOP_WORDS, text.FINANCE_TERMS, CHINESE_CONCEPTS), CHINESE_PAGES)} SELECT query_id, doc_id, round(lexical, 6) AS lexical, array_to_string(matched, ',') AS matched FROM lex")
def tx3_chinese(spark, sf):
    asked = chinese_questions(spark, sf)
    pages = table(spark, sf, "documents").select("doc_id", in_chinese(F.col("text")).alias("text"))
    found = text.lexical_scores(pages, text.query_terms(asked, concepts=CHINESE_CONCEPTS), asked, ["doc_id"])
    return found.select("query_id", "doc_id", *six("lexical"), F.concat_ws(",", "matched").alias("matched"))


def lexical(spark, sf, k=None):
    return text.lexical_scores(table(spark, sf, "documents").select("doc_id", "text"), terms(spark, sf), questions(spark, sf), ["doc_id"], k)


@R.query("tx3_lexical_scores", f"WITH {SCORES} SELECT query_id, doc_id, round(lexical, 6) AS lexical, array_to_string(matched, ',') AS matched FROM lex")
def tx3(spark, sf):
    return lexical(spark, sf).select("query_id", "doc_id", *six("lexical"), F.concat_ws(",", "matched").alias("matched"))


def hybrid(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    semantic = vectors.cosine_top_k(asked, rows, 10).select("query_id", F.col("passage_id").alias("doc_id"), F.round("semantic", 12).alias("semantic"))
    semantic, docs, scopes = written(semantic, "semantic"), table(spark, sf, "documents").select("doc_id", "text"), [["this", "with"], ["une", "des"]]
    bonus = text.statement_bonus(questions(spark, sf), docs, ["doc_id"], ["that"], scopes)
    found = text.hybrid_candidates(docs, terms(spark, sf), questions(spark, sf), ["doc_id"], semantic, 10, text.holds_scope(scopes), 6)
    return text.hybrid_scores(found, semantic, ["doc_id"], bonus)


def results(spark, sf):
    """The six best documents of each question, as pages with their text."""
    best = text.top_results(hybrid(spark, sf).withColumn("score", F.round("score", 9)), [F.asc("doc_id")], 6)
    found = best.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "page_number")
    return written(found, "results")  # six pages a question, read by every later step


@R.query("tx4_hybrid_top_k", f"WITH {HYBRID} SELECT query_id, doc_id, round(score, 9) AS score, method, place FROM res WHERE doc_id IN (SELECT doc_id FROM documents)")
def tx4(spark, sf):
    return results(spark, sf).select("query_id", F.col("page_number").alias("doc_id"), "score", "method", "place")


@R.query("tk8_retrieval_top_k", f"WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, doc_id)::INTEGER AS place FROM lex) SELECT query_id, doc_id, place FROM k WHERE place <= 3")
def tk8(spark, sf):
    return text.top_results(lexical(spark, sf, 3).withColumn("score", F.round("lexical", 9)), [F.asc("doc_id")], 3).select("query_id", "doc_id", "place")


@R.query("tx5_cosine_top_k", f"WITH c AS (SELECT a.vec_id AS query_id, b.vec_id AS passage_id, {COSINE} AS semantic FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, passage_id)::INTEGER AS place FROM c) SELECT query_id, passage_id, round(semantic, 6) AS semantic, place FROM k WHERE place <= 10")
def tx5(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.cosine_top_k(rows.where("id % 50 = 0"), rows, 10).select("query_id", "passage_id", *six("semantic"), "place")


def triggers():
    return {"deep": ["that is", "reth"], "sceptical": ["with", "oueau"], "metrics": {"net_profit_margin": ["this"], "revenue_growth": ["ación", "ungs"]}, "change": ["tion"]}


TRIGGERS = [("that is", "deep_investigation", None), ("reth", "deep_investigation", None), ("with", "skeptical_analysis", None), ("oueau", "skeptical_analysis", None), ("this", "deterministic_metric", "net_profit_margin"), ("ación", "deterministic_metric", "revenue_growth"), ("ungs", "deterministic_metric", "revenue_growth"), ("tion", "change_analysis", None)]
ROUTES = f"""r0 AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS p FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(p, '{t}') THEN '{m}'" for t, m, _ in TRIGGERS)} ELSE 'quick_evidence' END AS mode, CASE {" ".join(f"WHEN contains(p, '{t}') THEN '{t}'" for t, m, _ in TRIGGERS)} END AS trigger, CASE {" ".join(f"WHEN contains(p, '{t}') THEN {'NULL' if o is None else repr(o)}" for t, m, o in TRIGGERS)} END AS tool FROM r0)"""
LIMIT = lambda i: "CASE mode " + " ".join(f"WHEN '{m}' THEN {v[i]}" for m, v in text.LIMITS.items()) + " END"


@R.query("tx6_route_questions", f"WITH {ROUTES} SELECT conv_id, turn, mode, trigger, tool, {LIMIT(0)} AS top_k, {LIMIT(1)} AS max_evidence, {LIMIT(2)} AS max_challenges FROM r")
def tx6(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'")
    return asked.withColumns(text.route(F.col("text"), **triggers())).select("conv_id", "turn", "mode", "trigger", "tool", "top_k", "max_evidence", "max_challenges")


# What makes questions of user turns: words that become phrases of the router's own lists, and words that are none of them.
ASKED = [
    (" with ", " guidance "), (" mit ", "跨年度"), (" por ", " compare years "), (" that ", " what  drove "), (" für ", "为什么"), (" una ", " Quality "), (" are ", " net margin "), (" von ", "资产负债率"), (" los ", " revenue growth "), (" dans ", "流动比率"),
    (" this ", " increase "), (" sur ", "变化"), (" del ", " total liabilities "),
]
OWN = [(t, "deep_investigation", None) for t in text.DEEP] + [(t, "skeptical_analysis", None) for t in text.SCEPTICAL] + [(t, "deterministic_metric", m) for m, ts in text.METRICS.items() for t in ts] + [(t, "change_analysis", None) for t in text.CHANGE]
_case = lambda pick: "CASE " + " ".join(f"WHEN contains(p, '{t}') THEN {pick(t, m, o)}" for t, m, o in OWN)


@R.query(
    "tx6_own_triggers",
    f"""WITH q AS (SELECT conv_id, turn, trim(regexp_replace(lower({in_chinese_sql('text', ASKED)}), '\\s+', ' ', 'g')) AS p FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, {_case(lambda t, m, o: f"'{m}'")} ELSE 'quick_evidence' END AS mode, {_case(lambda t, m, o: f"'{t}'")} END AS trigger, {_case(lambda t, m, o: 'NULL' if o is None else f"'{o}'")} END AS tool FROM q)
    SELECT conv_id, turn, mode, trigger, tool, {LIMIT(0)} AS top_k, {LIMIT(1)} AS max_evidence, {LIMIT(2)} AS max_challenges FROM r""",
)
def tx6_own(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'").withColumn("text", in_chinese(F.col("text"), ASKED))
    return asked.withColumns(text.route(F.col("text"))).select("conv_id", "turn", "mode", "trigger", "tool", "top_k", "max_evidence", "max_challenges")


SENTENCES = """string_split_regex(regexp_replace(replace(text, chr(160), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')"""
EVIDENCE = f"""{HYBRID}, pg AS (SELECT r.*, d.text FROM res r JOIN documents d USING (doc_id)), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER AS rank FROM pg),
s0 AS (SELECT query_id, doc_id, place, rank, matched, semantic, unnest({SENTENCES}) AS raw, generate_subscripts({SENTENCES}, 1) AS i FROM ranked), s1 AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS s FROM s0), s2 AS (SELECT *, len(list_filter(matched, lambda t: contains(lower(s), t)))::INTEGER AS terms FROM s1 WHERE s <> ''),
ev AS (SELECT query_id, doc_id AS page_number, rank, terms AS hits, semantic, CASE WHEN length(s) > 280 THEN rtrim(s[1:280]) || '…' ELSE s END AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY terms DESC, least(length(s), 220) DESC, i) AS n FROM s2 WHERE rank <= 3) WHERE n = 1),
ans AS (SELECT query_id, count(*) AS evidence, bool_or(hits >= 2) OR coalesce(bool_or(semantic >= 0.6e0), false) AS is_supported FROM ev GROUP BY query_id),
mk AS (SELECT *, CASE WHEN regexp_matches(lower(s), '\\bthis\\b') THEN 'this' WHEN regexp_matches(lower(s), '\\bthat\\b') THEN 'that' WHEN regexp_matches(lower(s), '\\bwith\\b') THEN 'with' END AS marker, CASE WHEN regexp_matches(lower(s), '\\bthis\\b') THEN 5 WHEN regexp_matches(lower(s), '\\b(that|with)\\b') THEN 3 END AS weight FROM s2 WHERE length(s) >= 40),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, terms DESC, page_number, excerpt)::INTEGER AS place FROM (SELECT DISTINCT query_id, doc_id AS page_number, s AS excerpt, marker, weight, terms FROM mk WHERE marker IS NOT NULL AND terms >= 1)) WHERE place <= 2),
ver AS (SELECT a.query_id, evidence, is_supported, coalesce(c.n, 0) AS challenges, CASE WHEN NOT is_supported THEN 'rejected' WHEN coalesce(c.n, 0) > 0 THEN 'approved_with_caveats' ELSE 'approved' END AS verdict FROM ans a LEFT JOIN (SELECT query_id, count(*) AS n FROM ch GROUP BY query_id) c USING (query_id))"""
FOUND_MARKERS = {"this": 5, "that": 3, "with": 3}


@R.query("tx7_grounded_evidence", f"WITH {EVIDENCE} SELECT query_id, page_number, rank, hits, excerpt FROM ev")
def tx7(spark, sf):
    return text.grounded(results(spark, sf))[0].select("query_id", "page_number", "rank", "hits", "excerpt")


@R.query("tx8_counter_evidence", f"WITH {EVIDENCE} SELECT query_id, page_number, marker, weight, terms, place, excerpt FROM ch")
def tx8(spark, sf):
    return text.challenges(results(spark, sf), FOUND_MARKERS).select("query_id", "page_number", "marker", "weight", "terms", "place", "excerpt")


def verified(spark, sf):
    found = results(spark, sf)
    evidence, answer = text.grounded(found)
    return text.verify(answer, evidence, text.challenges(found, FOUND_MARKERS), found)


@R.query("tx9_verify_answers", f"WITH {EVIDENCE} SELECT query_id, evidence, is_supported, challenges, verdict FROM ver")
def tx9(spark, sf):
    return verified(spark, sf).select("query_id", "evidence", "is_supported", "challenges", "verdict")


@R.query(
    "tx10_escalate",
    f"""WITH {EVIDENCE}, rt AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'quick_evidence' WHEN 1 THEN 'skeptical_analysis' ELSE 'deep_investigation' END AS mode FROM q),
    sg AS (SELECT rt.*, concat_ws(',', CASE WHEN coalesce(evidence, 0) = 0 THEN 'no_evidence' WHEN NOT is_supported THEN 'weak_evidence' END, CASE WHEN challenges > 0 THEN 'material_challenge' END, CASE WHEN mode <> 'quick_evidence' AND query_id % 5 = 0 THEN 'period_mismatch' END, CASE WHEN verdict = 'rejected' THEN 'rejected' END) AS signals FROM rt LEFT JOIN ver USING (query_id)),
    e AS (SELECT *, signals <> '' AND mode <> 'deep_investigation' AS escalated FROM sg), f AS (SELECT query_id, signals, escalated, CASE WHEN escalated AND mode = 'quick_evidence' THEN 'skeptical_analysis' WHEN escalated THEN 'deep_investigation' ELSE mode END AS mode FROM e)
    SELECT query_id, signals, escalated, mode AS final_mode, {LIMIT(0)} AS final_top_k FROM f""",
)
def tx10(spark, sf):
    mode = F.when(F.col("query_id") % 3 == 0, "quick_evidence").when(F.col("query_id") % 3 == 1, "skeptical_analysis").otherwise("deep_investigation")
    routes = questions(spark, sf).select("query_id", mode.alias("mode"), F.lit(None).cast("string").alias("tool"))
    return text.escalate(routes, verified(spark, sf), F.lit(False), F.col("query_id") % 5 == 0).select("query_id", F.concat_ws(",", "signals").alias("signals"), "escalated", "final_mode", "final_top_k")


PLAIN = lambda c: f"lower(trim(regexp_replace(regexp_replace({c}, '…$', ''), '\\s+', ' ', 'g')))"


@R.query("j12_citation_containment", f"WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'zz ' ELSE '' END || substr(text, 20, 60) AS excerpt, text FROM documents) SELECT doc_id, contains({PLAIN('text')}, {PLAIN('excerpt')}) AS traceable FROM s")
def j12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    quotes = docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "zz ").otherwise(""), F.substring("text", 20, 60)).alias("excerpt"))
    return text.contained(quotes, docs, ["doc_id"]).select("doc_id", "traceable")


NUMBERS = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')))"


@R.query(
    "tx11_guardrail",
    f"""WITH c AS (SELECT doc_id AS claim_id, doc_id % 7 AS query_id, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id END AS page_number, CASE WHEN doc_id % 3 = 0 THEN 'zz ' ELSE '' END || substr(text, 1, 30) AS excerpt, substr(text, 1, 30) || CASE WHEN doc_id % 5 = 0 THEN ' 12,345.5' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' so buy' ELSE '' END AS statement FROM documents),
    j AS (SELECT c.*, d.text FROM c LEFT JOIN documents d ON c.page_number = d.doc_id)
    SELECT claim_id, concat_ws(',', CASE WHEN text IS NULL THEN 'page' END, CASE WHEN NOT contains({PLAIN('text')}, {PLAIN('excerpt')}) THEN 'excerpt' END, CASE WHEN len(list_filter({NUMBERS('statement')}, lambda x: NOT list_contains({NUMBERS("coalesce(text, '')")}, x))) > 0 THEN 'numbers' END,
      CASE WHEN regexp_matches(statement, '(?i)\\b(?:buy|sell|hold)\\b|买入|卖出|持有') THEN 'advice' END) AS reasons FROM j""",
)
def tx11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    i, head = F.col("doc_id"), F.substring("text", 1, 30)
    claims = docs.select(i.alias("claim_id"), (i % 7).alias("query_id"), F.when(i % 13 == 0, -1).otherwise(i).alias("page_number"), F.concat(F.when(i % 3 == 0, "zz ").otherwise(""), head).alias("excerpt"), F.concat(head, F.when(i % 5 == 0, " 12,345.5").otherwise(""), F.when(i % 11 == 0, " so buy").otherwise("")).alias("statement"))
    return text.guardrail(claims, docs.select((i % 7).alias("query_id"), i.alias("page_number"), "text")).select("claim_id", F.concat_ws(",", "reasons").alias("reasons"))


@R.query("tx1_page_chunks")
def tx1(spark, sf):
    return text.chunk_pages(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text"))


# ---- statements: pages rendered from the yearly figures


def amount(value: Column) -> Column:
    """A figure as reports print it."""
    shown = F.format_number(F.abs(F.round(value)), 0)
    return F.when(F.round(value) < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


YEARS = """y0 AS (SELECT company, period_year, company * 10000 + period_year AS doc_id, round(revenue) AS revenue, round(net_profit) AS net_profit, round(operating_cash_flow) AS ocf, round(total_assets) AS assets, round(total_liabilities) AS liabilities FROM {vintages} WHERE accounting_basis = 'original'),
y AS (SELECT a.*, p.revenue AS revenue_p, p.net_profit AS net_profit_p, p.ocf AS ocf_p, p.assets AS assets_p, p.liabilities AS liabilities_p FROM y0 a JOIN y0 p ON a.company = p.company AND a.period_year = p.period_year + 1)"""


def years(spark, sf):
    rows = view(spark, sf, "vintages").where("accounting_basis = 'original'")
    own = rows.select("company", "period_year", (F.col("company") * 10000 + F.col("period_year")).alias("doc_id"), F.round("revenue").alias("revenue"), F.round("net_profit").alias("net_profit"), F.round("operating_cash_flow").alias("ocf"), F.round("total_assets").alias("assets"), F.round("total_liabilities").alias("liabilities"))
    before = own.select("company", (F.col("period_year") + 1).alias("period_year"), *(F.col(c).alias(f"{c}_p") for c in ("revenue", "net_profit", "ocf", "assets", "liabilities")))
    return own.join(before, ["company", "period_year"])


def pages(spark, sf):
    """Five pages a report: a cover, income, balance (its last row broken over two pages for even companies) and cash flow.

    By company, statements have two columns, four in Chinese (the company's own beside the
    consolidated ones) or six (before adjustments, adjustments and total of each year, the
    header in one piece or broken).
    """
    line = lambda *parts: F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    company, year = F.col("company"), F.col("period_year")
    even, four, six_wide = company % 2 == 0, company % 3 == 1, company % 3 == 2
    says = lambda english, chinese: F.when(four, chinese).otherwise(english)
    spaced = lambda *parts: F.concat_ws(" ", *parts)
    header = F.when(six_wide & even, line(*["Before adjusting", "items", "Adjusting", "items", "Total"] * 2)).when(six_wide, line(*["Before adjusting items", "Adjusting items", "Total"] * 2))

    def rows(*labelled):
        """Each label and its two totals in the company's layout."""
        wide = lambda e: line(*(amount(x) for total, part in ((e["now"], 5), (e["before"], 7)) for x in (total - part, F.lit(part), total)))
        beside = lambda e: line(spaced(amount(e["now"]), amount(e["before"])), spaced(amount(e["now"] + 1), amount(e["before"] + 2)))
        own = F.array(*(F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), now.cast("double").alias("now"), before.cast("double").alias("before")) for label, now, before in labelled))
        return F.array_join(F.transform(own, lambda e: line(e["label"], F.when(four, beside(e)).when(six_wide, wide(e)).otherwise(line(amount(e["now"]), amount(e["before"]))))), "\n")

    pair = lambda label, c: (label, F.col(c), F.col(f"{c}_p"))
    part = lambda label, c, n: (label, F.floor(F.col(c) / n), F.floor(F.col(f"{c}_p") / n))
    fixed = lambda label, now, before: (label, F.lit(now), F.lit(before))
    # some companies' equity or closing cash does not add up
    equity = (F.col("assets") - F.col("liabilities") + F.when(company % 11 == 4, 9).otherwise(0), F.col("assets_p") - F.col("liabilities_p"))
    # even companies count the exchange effect in their net change
    net = (F.col("ocf") + F.when(even, -193).otherwise(-200), F.col("ocf_p") + F.when(even, -109).otherwise(-100))
    closing = (F.col("ocf") + F.when(company % 11 == 3, 812).otherwise(807), F.col("ocf_p") + 891)
    weeks = lambda y: F.concat(F.when(y % 4 == 0, 53).otherwise(52).cast("string"), F.lit(" weeks"))
    cash_unit = F.when(company % 8 == 5, "单位：千元").when(company % 7 != 3, "单位：元")
    cash = line(
        says("Cash flow statement", "合并及公司现金流量表"), cash_unit, header,
        rows(
            pair(says("Net cash from operating activities", "经营活动产生的现金流量净额"), "ocf"), fixed(says("Net cash from investing activities", "投资活动产生的现金流量净额"), -300, -200), fixed(says("Net cash from financing activities", "三、筹资活动产生的现金流量净额"), 100, 100),
            fixed(says("Effect of exchange rate changes", "汇率变动对现金及现金等价物的影响"), 7, -9), (says("Net change in cash", "现金及现金等价物净增加额"), *net), fixed(says("Opening cash", "期初现金余额"), 1000, 1000), (says("Closing cash", "期末现金余额"), *closing),
        ),
    )
    early = company % 26 == 6  # these begin their cash flow statement on the page where the balance sheet ends
    # even companies' last row is broken after its label
    last = rows((F.when(even, "3 / 5").otherwise(says("Total equity", "所有者权益合计")), *equity))
    balance = rows(part(says("Total current assets", "流动资产合计"), "assets", 2), pair(says("Total assets", "资产总计"), "assets"), part(says("Total current liabilities", "流动负债合计"), "liabilities", 4), pair(says("Total liabilities", "负债合计"), "liabilities"))
    income = rows(pair(line(says("1. Revenue", "一、营业收入"), says("3", "五(1)")), "revenue"), pair(says("Profit for\nthe year", "净利润"), "net_profit"))
    entries = [
        (1, line("Annual report", year.cast("string"))),
        (2, line(says("Consolidated income statement", "合并及公司利润表"), "单位：元", weeks(year), weeks(F.when(company % 6 == 0, year).otherwise(year - 1)), header, income)),
        (3, line(says("Consolidated balance sheet", "合并及公司资产负债表"), "单位：元", header, balance, F.when(even, says("Total equity", "所有者权益合计")).otherwise(last))),
        (4, line(F.when(even, last).otherwise("notes"), F.when(early, cash))),
        (5, F.when(early, "notes").otherwise(cash)),
    ]
    return years(spark, sf).select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).cast("bigint").alias("page_number"), t.alias("text")) for n, t in entries))))


def figures(spark, sf):
    return statements.extract_statements(written(pages(spark, sf), "pages"))  # rendered once, read for titles and for texts


# The figures as columns, and the checks worked out on them.
WIDE = """w AS (SELECT *, assets - liabilities + CASE WHEN company % 11 = 4 THEN 9 ELSE 0 END AS equity, assets_p - liabilities_p AS equity_p, floor(assets / 2) AS cur_assets, floor(assets_p / 2) AS cur_assets_p, floor(liabilities / 4) AS cur_liabilities, floor(liabilities_p / 4) AS cur_liabilities_p,
  -300 AS investing, -200 AS investing_p, 100 AS financing, 100 AS financing_p, 7 AS exchange, -9 AS exchange_p, ocf - CASE WHEN company % 2 = 0 THEN 193 ELSE 200 END AS net, ocf_p - CASE WHEN company % 2 = 0 THEN 109 ELSE 100 END AS net_p, 1000 AS opening, 1000 AS opening_p,
  ocf + CASE WHEN company % 11 = 3 THEN 812 ELSE 807 END AS closing, ocf_p + 891 AS closing_p, 3 + (company + 1) % 2 AS balance_end, CASE WHEN company % 26 = 6 THEN 4 ELSE 5 END AS cash_page, CASE company % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 6 END AS columns FROM y)"""
_entry = lambda s, m, c, p, e: f"{{'s': '{s}', 'm': '{m}', 'a': {c}, 'b': {c}_p, 'p': {p}, 'e': {e}}}"
FIGURES = f"""{WIDE}, fig AS (SELECT doc_id, company, period_year, columns, unnest([{", ".join([_entry("income", "revenue", "revenue", 2, 2), _entry("income", "net_profit", "net_profit", 2, 2), *(_entry("balance", m, c, 3, "balance_end") for m, c in (("current_assets", "cur_assets"), ("total_assets", "assets"), ("current_liabilities", "cur_liabilities"), ("total_liabilities", "liabilities"), ("total_equity", "equity"))), *(_entry("cash", m, c, "cash_page", "cash_page") for m, c in (("operating_cash_flow", "ocf"), ("investing_cash_flow", "investing"), ("financing_cash_flow", "financing"), ("exchange_effect", "exchange"), ("net_change", "net"), ("opening_cash", "opening"), ("closing_cash", "closing")))])}]) AS f FROM w)"""
_sections = lambda p, fx: f"abs(ocf{p} + investing{p} + financing{p} + {fx} - net{p}) <= 0.5"
_inside = " AND ".join(f"{_sections(p, f'exchange{p}')} AND abs(opening{p} + net{p} - closing{p}) <= 0.5" for p in ("", "_p"))
_after = " AND ".join(f"{_sections(p, '0')} AND abs(opening{p} + net{p} + exchange{p} - closing{p}) <= 0.5" for p in ("", "_p"))
RECONCILED = f"{WIDE}, rec AS (SELECT *, abs(assets - liabilities - equity) <= 0.5 AND abs(assets_p - liabilities_p - equity_p) <= 0.5 AS balance_ok, ({_inside}) OR ({_after}) AS cash_ok FROM w)"


@R.query("st2_extract_statements", f"WITH {YEARS}, {FIGURES} SELECT doc_id, f.s AS statement, f.m AS metric, f.a::DOUBLE AS current, f.b::DOUBLE AS previous, f.p::BIGINT AS start_page, f.e::BIGINT AS end_page, columns::INTEGER AS columns FROM fig")
def st2(spark, sf):
    return figures(spark, sf).select("doc_id", "statement", "metric", "current", "previous", "start_page", "end_page", "columns")


@R.query("st1_parse_numbers", f"WITH {YEARS} SELECT doc_id, revenue, net_profit, ocf, 0e0 AS dash, -153e0 AS wide, NULL::DOUBLE AS none FROM y")
def st1(spark, sf):
    shown = years(spark, sf).select("doc_id", *(statements.parse_number(amount(F.col(c))).alias(c) for c in ("revenue", "net_profit", "ocf")), statements.parse_number(F.lit("—")).alias("dash"), statements.parse_number(F.lit("（153）")).alias("wide"), statements.parse_number(F.lit("n/a")).alias("none"))
    return shown


def reconciled(spark, sf):
    return statements.reconcile(statements.wide(figures(spark, sf)))


@R.query("st3_reconcile", f"WITH {YEARS}, {RECONCILED} SELECT doc_id, balance_ok, cash_ok FROM rec")
def st3(spark, sf):
    return reconciled(spark, sf).select("doc_id", "balance_ok", "cash_ok")


TARGETS = """tg AS (SELECT company, period_year AS report_year, company * 10000 + period_year AS report_id, CASE WHEN company % 17 = 2 THEN period_year + 1 ELSE period_year END AS titled, company % 19 <> 7 AS trusted FROM {vintages} WHERE accounting_basis = 'original')"""
CHECKED = f"""{YEARS}, {RECONCILED}, {TARGETS}, checked AS (SELECT tg.company, tg.report_year, tg.report_id, CASE WHEN doc_id IS NULL THEN 0 ELSE 3 END AS statements, CASE WHEN doc_id IS NULL THEN 0 ELSE 10 END AS values,
  concat_ws(',', CASE WHEN doc_id IS NULL THEN 'statements' END, CASE WHEN NOT coalesce(balance_ok, false) THEN 'balance' END, CASE WHEN NOT coalesce(cash_ok, false) THEN 'cash' END, CASE WHEN doc_id IS NULL OR tg.company % 8 = 5 OR tg.company % 7 = 3 THEN 'units' END,
    CASE WHEN cash_page <= balance_end THEN 'pages' END, CASE WHEN doc_id IS NULL THEN 'values' END, CASE WHEN titled <> tg.report_year THEN 'title' END, CASE WHEN NOT trusted THEN 'source' END) AS checks FROM tg LEFT JOIN rec ON report_id = doc_id)"""


def ready(spark, sf):
    company, year = F.col("company"), F.col("period_year")
    title = F.concat(F.when(company % 17 == 2, year + 1).otherwise(year).cast("string"), F.lit("年年度报告"))
    url = F.when(company % 19 == 7, "https://cninfo.com.cn.example.org/x").otherwise("https://www.cninfo.com.cn/x")
    targets = view(spark, sf, "vintages").where("accounting_basis = 'original'").select("company", year.alias("report_year"), (company * 10000 + year).alias("report_id"), title.alias("title"), url.alias("url"), F.lit(5).alias("page_count"))
    return statements.readiness(reconciled(spark, sf), targets)


@R.query("st4_report_readiness", f"WITH {CHECKED} SELECT report_id, statements, values, checks, CASE WHEN checks = '' THEN 'ready_for_human_review' ELSE 'needs_review' END AS status FROM checked")
def st4(spark, sf):
    return ready(spark, sf).select("report_id", "statements", "values", F.concat_ws(",", "checks").alias("checks"), "status")


@R.query("st4_company_packages", f"""WITH {CHECKED}, g AS (SELECT company, count(*) AS target, count(*) FILTER (statements > 0) AS processed, count(*) FILTER (checks = '') AS ready, max(report_year) - min(report_year) + 1 = count(DISTINCT report_year) AS continuous FROM checked GROUP BY company)
SELECT company, target, processed, ready, continuous, CASE WHEN processed = 0 THEN 'not_started' WHEN processed < target THEN 'in_progress' WHEN continuous AND ready = target THEN 'ready' ELSE 'needs_review' END AS package_status FROM g""")
def st4_packages(spark, sf):
    return statements.company_packages(ready(spark, sf)).select("company", "target", "processed", "ready", "continuous", "package_status")


@R.query("st5_snapshot", f"""WITH {YEARS}, {FIGURES} SELECT doc_id, f.m AS metric, f.a::DOUBLE AS current, round((f.a - f.b) / abs(nullif(f.b, 0)), 6) AS change, f.p::BIGINT AS start_page FROM fig WHERE f.m IN ('revenue', 'net_profit')""")
def st5(spark, sf):
    return statements.snapshot(statements.wide(figures(spark, sf))).where("metric in ('revenue', 'net_profit')").select("doc_id", "metric", "current", *six("change"), "start_page")


@R.query("st6_metric_tools", f"""WITH {YEARS}, t AS (SELECT doc_id, company, period_year, unnest([{{'k': 'net_profit_margin', 'v': net_profit / nullif(revenue, 0)}}, {{'k': 'revenue_growth', 'v': (revenue - revenue_p) / abs(nullif(revenue_p, 0))}}, {{'k': 'current_ratio', 'v': floor(assets / 2) / nullif(floor(liabilities / 4), 0)}}, {{'k': 'liabilities_to_assets', 'v': liabilities / nullif(assets, 0)}}, {{'k': 'total_liabilities', 'v': liabilities}}]) AS x FROM y)
SELECT doc_id, x.k AS tool, round(x.v, 6) AS value, CASE WHEN x.v IS NULL THEN 'missing_or_zero' END AS unavailable, CASE WHEN x.k = 'revenue_growth' AND company % 6 <> 0 AND period_year % 4 IN (0, 1) THEN 'unequal_weeks' END AS warning FROM t""")
def st6(spark, sf):
    return statements.metric_tools(statements.wide(figures(spark, sf))).select("doc_id", "tool", *six("value"), "unavailable", "warning")


@R.query("j13_answer_key", f"WITH {YEARS} SELECT doc_id, 'revenue' AS metric, company % 4 <> 0 AS current_ok, company % 7 <> 1 AS previous_ok, company % 9 <> 2 AS unit_ok, company % 5 <> 0 AS page_ok FROM y")
def j13(spark, sf):
    rows = years(spark, sf)
    key = rows.select("doc_id", F.lit("revenue").alias("metric"), F.when(F.col("company") % 4 == 0, F.col("revenue") + 1).otherwise(F.col("revenue")).alias("expected_current"), F.when(F.col("company") % 7 == 1, F.col("revenue_p") - 1).otherwise(F.col("revenue_p")).alias("expected_previous"), F.when(F.col("company") % 9 == 2, "千元").otherwise("元").alias("expected_unit"), F.when(F.col("company") % 5 == 0, 9).otherwise(2).alias("expected_page"))
    return statements.check_answers(figures(spark, sf), key)


# ---- evaluation and briefs

CHECKS = """chk AS (SELECT l.doc_id AS case_id, 'quality' AS name, (quality = 1) = NOT contains(text, '$$$') AS passed FROM labels l JOIN documents d ON l.doc_id = d.doc_id UNION ALL SELECT l.doc_id, 'toxic', (toxic = 1) = contains(lower(text), 'idiot') FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def checks(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    entry = lambda n, ok: F.struct(F.lit(n).alias("name"), ok.alias("passed"))
    return rows.select(F.col("doc_id").alias("case_id"), F.inline(F.array(entry("quality", (F.col("quality") == 1) == ~F.contains("text", F.lit("$$$"))), entry("toxic", (F.col("toxic") == 1) == F.contains(F.lower("text"), F.lit("idiot"))))))


@R.query("ag13_case_results", f"WITH {CHECKS} SELECT case_id, bool_and(passed) AS passed, count(*) AS checks FROM chk GROUP BY case_id")
def ag13(spark, sf):
    return evaluation.case_results(checks(spark, sf))


@R.query("ag13_pass_rates", f"WITH {CHECKS} SELECT name, count(passed) AS checks, count(*) FILTER (passed) AS passed, round(avg(passed::INTEGER), 6) AS rate FROM chk GROUP BY ROLLUP (name)")
def ag13_rates(spark, sf):
    return evaluation.pass_rates(checks(spark, sf)).select("name", "checks", "passed", *six("rate"))


DAY = f"DATE '{AS_OF}'"
BRIEF = f"""{FEATURED}, {LIMITED}, {EVENTS}, {RADAR}, {POINTS}, dl AS (SELECT instrument_id, attention AS latest_attention, published_date AS latest_day FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY published_date DESC, title DESC, announcement_id) AS n FROM {{disclosures}} WHERE published_date <= {DAY} AND instrument_id % 6 <> 5) WHERE n = 1),
an AS (SELECT instrument_id, max(published_date) AS report_day FROM {{disclosures}} WHERE category = '财务报告' AND instrument_id % 5 <> 3 GROUP BY instrument_id), hi AS (SELECT company AS instrument_id, count(*) AS periods, max(published_date) AS last_day, max_by(revenue_growth, period_year) AS rg, max_by(net_profit_growth, period_year) AS pg, max_by(operating_cash_flow_growth, period_year) AS cg FROM pts WHERE as_of = DATE '2002-12-31' AND company % 4 <> 1 GROUP BY company),
co AS (SELECT i.instrument_id, i.instrument_id % 7 <> 6 AS known, r.trade_date AS latest_date, r.volume_ratio, r.trigger_count, dl.latest_day, dl.latest_attention, an.report_day, hi.periods, hi.last_day, rg, pg, cg, CASE WHEN i.instrument_id % 8 = 1 THEN DATE '2002-06-30' END AS snapshot_day
  FROM {{identity}} i LEFT JOIN radar r ON i.instrument_id = r.instrument_id LEFT JOIN dl ON i.instrument_id = dl.instrument_id LEFT JOIN an ON i.instrument_id = an.instrument_id LEFT JOIN hi ON i.instrument_id = hi.instrument_id),
ln AS (SELECT instrument_id, unnest([{{'l': 'identity', 's': CASE WHEN known THEN 'verified' ELSE 'partial' END, 'd': NULL::DATE}}, {{'l': 'market', 's': CASE WHEN latest_date IS NULL THEN 'unavailable' WHEN volume_ratio IS NOT NULL THEN 'verified' ELSE 'partial' END, 'd': latest_date}}, {{'l': 'disclosures', 's': CASE WHEN latest_day IS NULL THEN 'unavailable' ELSE 'verified' END, 'd': latest_day}},
  {{'l': 'annual_report', 's': CASE WHEN report_day IS NULL THEN 'unavailable' ELSE 'verified' END, 'd': report_day}}, {{'l': 'financial_history', 's': CASE WHEN periods >= 2 THEN 'verified' WHEN periods IS NOT NULL OR snapshot_day IS NOT NULL THEN 'partial' ELSE 'unavailable' END, 'd': coalesce(last_day, snapshot_day)}}]) AS x FROM co),
cv AS (SELECT instrument_id, avg(CASE x.s WHEN 'verified' THEN 1e0 WHEN 'partial' THEN 0.5e0 ELSE 0e0 END) AS coverage, count(*) FILTER (x.s = 'verified') AS verified, count(*) FILTER (x.s = 'partial') AS partial, count(*) FILTER (x.s = 'unavailable') AS unavailable FROM ln GROUP BY instrument_id)"""


def brief_inputs(spark, sf):
    identity = view(spark, sf, "identity").select("instrument_id", (F.col("instrument_id") % 7 != 6).alias("known"))
    radar = radar_rows(spark, sf).select("instrument_id", F.col("trade_date").alias("latest_date"), F.col("volume_ratio").isNotNull().alias("has_ratio"), "trigger_count")
    rows = view(spark, sf, "disclosures")
    latest = brief.latest_attention(rows.where((F.col("published_date") <= F.lit(AS_OF).cast("date")) & (F.col("instrument_id") % 6 != 5)))
    annual = rows.where("category = '财务报告' and instrument_id % 5 <> 3").groupBy("instrument_id").agg(F.max("published_date").alias("report_day"))
    last = lambda c: F.max_by(c, "period_year").alias(c)
    history = latest_points(spark, sf).where("company % 4 <> 1").groupBy(F.col("company").alias("instrument_id")).agg(F.count("*").alias("periods"), F.max("published_date").alias("last_day"), last("revenue_growth"), last("net_profit_growth"), last("operating_cash_flow_growth"))
    snapshots = identity.where("instrument_id % 8 = 1").select("instrument_id", F.lit("2002-06-30").cast("date").alias("snapshot_day"))
    return identity, radar, latest, annual, history, snapshots


def laned(inputs):
    identity, radar, latest, annual, history, snapshots = inputs
    return brief.lanes(identity, radar.drop("trigger_count"), latest.drop("latest_attention"), annual, history.select("instrument_id", "periods", "last_day"), snapshots)


@R.query("ag14_evidence_lanes", f"WITH {BRIEF} SELECT instrument_id, x.l AS lane, x.s AS status, x.d AS as_of FROM ln")
def ag14(spark, sf):
    return laned(brief_inputs(spark, sf))


@R.query("ag14_coverage", f"WITH {BRIEF} SELECT instrument_id, round(coverage, 6) AS coverage, verified, partial, unavailable, CASE WHEN coverage >= 0.8e0 THEN '证据覆盖较完整' WHEN coverage >= 0.5e0 THEN '可生成初步研究' ELSE '证据不足，优先补充来源' END AS label FROM cv")
def ag14_coverage(spark, sf):
    return brief.coverage(laned(brief_inputs(spark, sf))).select("instrument_id", *six("coverage"), "verified", "partial", "unavailable", "label")


@R.query(
    "tk9_primary_question",
    f"""WITH {BRIEF}, z AS (SELECT co.*, coverage, coalesce(pg > 0 AND cg < 0, false) AS cash, coalesce(rg > 0 AND pg < 0, false) AS prof FROM co JOIN cv USING (instrument_id)),
    k AS (SELECT *, CASE WHEN coverage < 0.5e0 THEN 'evidence_gap' WHEN cash THEN 'financial_cash_mismatch' WHEN prof THEN 'financial_profit_pressure' WHEN trigger_count >= 2 THEN 'market_compound' WHEN latest_attention = '高' THEN 'disclosure_high' WHEN trigger_count = 1 THEN 'market_single' ELSE 'initial_review' END AS question FROM z)
    SELECT instrument_id, question, CASE question WHEN 'evidence_gap' THEN 100 WHEN 'financial_cash_mismatch' THEN 95 WHEN 'financial_profit_pressure' THEN 92 WHEN 'market_compound' THEN 90 WHEN 'disclosure_high' THEN 85 WHEN 'market_single' THEN 70 ELSE 10 END AS priority,
    CASE WHEN trigger_count IS NULL THEN 'insufficient' WHEN trigger_count > 0 THEN 'attention' ELSE 'clear' END AS market_pillar, CASE WHEN latest_attention IS NULL THEN 'insufficient' WHEN latest_attention = '高' THEN 'attention' ELSE 'clear' END AS disclosure_pillar, CASE WHEN periods IS NULL THEN 'insufficient' WHEN cash OR prof THEN 'attention' ELSE 'clear' END AS financial_pillar FROM k""",
)
def tk9(spark, sf):
    inputs = brief_inputs(spark, sf)
    identity, radar, latest, _, history, _ = inputs
    rows = brief.coverage(laned(inputs)).join(radar.select("instrument_id", "trigger_count"), "instrument_id", "left").join(latest.drop("latest_day"), "instrument_id", "left").join(history, "instrument_id", "left")
    return brief.primary_question(rows)


# ---- sources, sinks and the stream


@R.query("io1_governed_csv", "SELECT lpad(company::VARCHAR, 6, '0') AS company_code, period_year, report_year, published_date, revenue, accounting_basis FROM {vintages}")
def io1(spark, sf):
    path = shared_dir(spark, "facts")
    rows = view(spark, sf, "vintages").select(F.lpad(F.col("company").cast("string"), 6, "0").alias("company_code"), "period_year", "report_year", "published_date", "revenue", "accounting_basis", F.lit("x").alias("notes"))
    rows.write.option("header", True).csv(path)
    return landed.read_facts(spark, path, "company_code string, period_year int, report_year int, published_date date, revenue double, accounting_basis string")


@R.query("io2_header_aliases", "SELECT instrument_id, trade_date, open, close, amount AS volume, NULL::DOUBLE AS amount FROM {bars}")
def io2(spark, sf):
    rows = view(spark, sf, "bars").select("instrument_id", F.col("trade_date").alias(" 日期 "), F.col("open").alias("开盘"), F.col("close").alias("收盘"), F.col("amount").alias("成交额"))
    return landed.amount_is_volume(landed.rename(rows, landed.BAR_ALIASES, ["trade_date", "open", "close"])).select("instrument_id", "trade_date", "open", "close", "volume", "amount")


@R.query("io3_bar_payloads", "SELECT instrument_id, trade_date, open, high, low, close, volume, turnover FROM {bars} WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def io3(spark, sf):
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.array(*(text_of(c) for c in ("trade_date", "open", "close", "high", "low", "volume", "amount", "turnover")), F.lit("x"))
    named = F.when(F.col("instrument_id") % 2 == 0, F.to_json(F.struct(F.col("rows").alias("qfqday"), F.array().cast("array<array<string>>").alias("other")))).otherwise(F.to_json(F.struct(F.col("rows").alias("day"))))
    payloads = view(spark, sf, "bars").groupBy("instrument_id").agg(F.collect_list(row).alias("rows")).select("instrument_id", named.alias("payload"))
    return landed.parse_bars(payloads, F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")).select("instrument_id", "trade_date", "open", "high", "low", "close", "volume", "turnover")


@R.query("io4_disclosure_payloads", "SELECT instrument_id, announcement_id, title, CAST(published_date + INTERVAL 1 DAY AS DATE) AS published_date, 'https://www.cninfo.com.cn/new/disclosure/detail?stockCode=' || lpad(instrument_id::VARCHAR, 6, '0') || '&announcementId=' || announcement_id || '&orgId=g%26' || instrument_id || '&announcementTime=' || CAST(published_date + INTERVAL 1 DAY AS DATE)::VARCHAR AS url FROM {disclosures}")
def io4(spark, sf):
    rows = view(spark, sf, "disclosures").withColumn("_page", F.floor(F.col("announcement_id") / 300))
    item = F.struct(F.lpad(F.col("instrument_id").cast("string"), 6, "0").alias("secCode"), F.col("title").alias("announcementTitle"), (F.unix_millis(F.col("published_date").cast("timestamp")) + 20 * 3_600_000).alias("announcementTime"), F.col("announcement_id").cast("string").alias("announcementId"), F.concat(F.lit("g&"), F.col("instrument_id").cast("string")).alias("orgId"))
    payloads = rows.groupBy("instrument_id", "_page").agg(F.collect_list(item).alias("announcements")).select("instrument_id", F.to_json(F.struct("announcements")).alias("payload"))
    return landed.parse_disclosures(payloads)


# The primary source comes in two chunks that share half a year; some instruments' are all unsound, others' missing.
SOURCES = """b0 AS (SELECT *, instrument_id % 3 = 0 OR instrument_id % 5 = 1 OR max(trade_date) OVER (PARTITION BY instrument_id) < DATE '1998-01-01' AS lost FROM {bars}), pri AS (SELECT instrument_id, trade_date, 1 AS chunk, 2 AS copies FROM {bars} WHERE instrument_id % 3 <> 0 AND trade_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
  UNION ALL SELECT instrument_id, trade_date, 2, 1 FROM {bars} WHERE instrument_id % 3 <> 0 AND trade_date >= DATE '1999-07-01')"""


def two_sources(spark, sf):
    rows = view(spark, sf, "bars").withColumn("ingest_seq", F.lit(1))
    own = rows.where("instrument_id % 3 <> 0").withColumn("high", F.when(F.col("instrument_id") % 5 == 1, F.col("low") - 1).otherwise(F.col("high")))
    first = own.where("trade_date between date'1998-01-01' and date'1999-12-31'").withColumns({"chunk": F.lit(1), "volume": F.col("volume") + 1})
    second = own.where("trade_date >= date'1999-07-01'").withColumns({"chunk": F.lit(2), "volume": F.col("volume") + 2})
    late = first.withColumns({"ingest_seq": F.lit(2), "close": F.lit(0.0)})  # arrives last and is unsound
    return first.unionByName(second).unionByName(late), rows


@R.query("io5_merge_sources", f"""WITH {SOURCES} SELECT instrument_id, trade_date, CASE WHEN lost THEN 'fallback' ELSE 'primary' END AS source, close, volume + CASE WHEN lost THEN 0 WHEN trade_date >= DATE '1999-07-01' THEN 2 ELSE 1 END AS volume FROM b0 WHERE lost OR trade_date >= DATE '1998-01-01'""")
def io5(spark, sf):
    return landed.merge_sources(*two_sources(spark, sf)).select("instrument_id", "trade_date", "source", "close", "volume")


@R.query("io5_source_coverage", f"""WITH {SOURCES}, l AS (SELECT DISTINCT instrument_id, lost FROM b0), p AS (SELECT p.instrument_id, 'primary' AS source, chunk, sum(copies)::BIGINT AS rows, instrument_id % 5 <> 1 AS good, count(*) AS n, min(trade_date) AS lo, max(trade_date) AS hi, count(*) FILTER (chunk = 2 AND trade_date <= DATE '1999-12-31') AS again FROM pri p GROUP BY p.instrument_id, chunk)
SELECT p.instrument_id, source, chunk, rows, CASE WHEN good THEN n ELSE 0 END AS sound, CASE WHEN good THEN lo END AS first_date, CASE WHEN good THEN hi END AS last_date, CASE WHEN good THEN n ELSE 0 END AS dates, CASE WHEN good THEN again ELSE 0 END AS overlap, NOT lost AS elected FROM p JOIN l USING (instrument_id)
UNION ALL SELECT instrument_id, 'fallback', 0, count(*), count(*), min(trade_date), max(trade_date), count(*), 0, lost FROM b0 GROUP BY instrument_id, lost""")
def io5_coverage(spark, sf):
    return landed.source_coverage(*two_sources(spark, sf))


@R.query("io6_audit_packages", """WITH p AS (SELECT company, period_year, report_year, chr(123) || '"accounting_basis":"' || accounting_basis || '","company":' || company || ',"notes":null,"period_year":' || period_year || ',"report_year":' || report_year || chr(125) AS payload FROM {vintages}) SELECT company, period_year, report_year, payload, sha256(payload) AS sha256 FROM p""")
def io6(spark, sf):
    rows = view(spark, sf, "vintages").select("company", "period_year", "report_year", "accounting_basis", F.lit(None).cast("string").alias("notes"))
    return sinks.audit_packages(rows, ["company", "period_year", "report_year"])


@R.query("ss1_disclosure_feed", f"WITH {NORMAL}, {WINDOWS} SELECT g.instrument_id, g.announcement_id, g.category, CASE WHEN baseline IS NULL THEN '首次基准' WHEN published_date = baseline THEN '同日待复核' ELSE '新增' END AS status FROM graded g JOIN win w ON g.instrument_id = w.instrument_id AND published_date BETWEEN start_date AND end_date")
def ss1(spark, sf):
    base = shared_dir(spark, "feed")
    rows = view(spark, sf, "disclosures").select("instrument_id", "announcement_id", "title", "published_date", "url")
    # the feed lands twice, the second time with part of the first
    rows.write.parquet(f"{base}/landed")
    rows.where("announcement_id % 3 = 0").write.mode("append").parquet(f"{base}/landed")
    feed.run_feed(feed.disclosure_feed(spark, f"{base}/landed", rows.schema.simpleString()[7:-1].replace(":", " "), "4000 days"), f"{base}/store", f"{base}/checkpoint")
    return feed.in_window(spark.read.parquet(f"{base}/store"), windows(spark, sf)).select("instrument_id", "announcement_id", "category", "status")


QUERIES, ORACLE_SQL = R.queries, {name: duck(body) for name, body in R.sql.items()}
