"""WARC, URL rules, top-k search and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
import re
import time
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import sentencepiece
from test_documents import brute_components, secrets, simhash_of

import corpus_pipeline
from equity_jobs.llm import covertree, queries, urlrules, warc

PAGES = "page_id bigint, url string, html string, digest string, path string"


def same(spark, name, sf="/root/testdata/sf0.001", tables=("pages", "embeddings")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet(['{sf}/{t}.parquet'])")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)


def pages():
    blob = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, 0).decode("latin-1")
    made = [(1, "http://a.b/c", "same", "x", "y"), (5, "http://a.b/d", "same", None, None), (3, None, "", None, None), (4, "no scheme", None, None, None), (2, "https://x/\r\n y", "é" * 100_000, None, None), (9, "u", blob, None, None), (None, "n", "same", None, None)]
    return [*made, made[0], *((100 + i, f"http://h{i}", f"<p>{i % 50}</p>" * 200, None, None) for i in range(200))]


def test_warc_round_trip(spark):
    table = spark.createDataFrame(pages(), PAGES).repartition(2)
    first = {}
    for p in pages():
        body = (p[2] or "").encode()
        if p[0] is not None:
            first[body] = min(first.get(body, p[0]), p[0])
    want = []
    for p in pages():
        body = (p[2] or "").encode()
        back = p[0] != first[body]
        want.append((p[0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if back else "response", first[body] if back else None))
    for split in (512, 1 << 20):
        got = [tuple(r) for r in warc.archive_round_trip(table, split_bytes=split).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_round_trip(table.limit(0)).count() == 0
    kinds = {r.record_type for r in warc.archive_round_trip(table, least_bytes=10).where("payload_bytes < 10").collect()}
    assert kinds == {"response"}


def test_ranges_own_each_record_once():
    made = b"".join(gzip.compress(warc.record(f"urn:page:{i}", "u", "D", bytes([31, 139, 8]) * (i * 7), i * 21, None, "d"), 1 if i % 2 else 0) for i in range(40))

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    for step in (1, 97, 5000):
        found = [r for at in range(0, len(made), step) for r in warc.records(File(made), len(made), at, min(at + step, len(made)))]
        assert [warc.parse(raw)["record_id"] for _, raw in found] == [f"urn:page:{i}" for i in range(40)]


def test_url_rules(spark):
    urls = ["HTTP://Shop.Example.COM/de/x?q", "http://example.net/en/1", "http://example.net", "http://example.net/", "http://badexample.com/de/1", "x://fr.org/fr/#a", "x://org/fr/", None, "", "nothing", "http://a.b.c.example.net/en/?/de/", "://net/x", "http://example.com/de"]
    table = spark.createDataFrame([(i, u, None, "c", "c") for i, u in enumerate(urls * 3)], PAGES)
    rules = urlrules.rules_frame(spark, queries.URL_RULES)
    parsed = [r.partition(" ")[::2] for r in queries.URL_RULES]

    def want(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(t), t, v) for v, t in parsed for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    for parts in (1, 5):
        got = {r.page_id: tuple(r)[1:] for r in urlrules.judge_urls(table, rules, partitions=parts).collect()}
        assert got == {i: want(u) for i, u in enumerate(urls * 3)}
    assert {r.verdict for r in urlrules.judge_urls(table, rules.limit(0), default="block").collect()} == {"block"}
    assert urlrules.judge_urls(table.limit(0), rules).count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op4_url_filters", "op9_exact_top_k"])
def test_sql(spark, name):
    same(spark, name)


def test_top_k_in_blocks(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] * 3 + draw.normal(size=8) * 0.3], 0) for i in range(600)]
    rows += [(1000 + i, [1.0] * 8, 0) for i in range(100)] + [(2000, None, 0), (2020, [float("nan")] * 8, 0), (2040, [1.0, None] * 4, 0), (None, [1.0] * 8, 0), (2060, [0.5] * 3, 1), rows[0]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in covertree.top_k(table, k=7, block=90, query_block=10, sample=50).collect()}
    good = {r[0]: np.floor(np.pad(np.array(r[1], np.float32).astype(float), (0, 8 - len(r[1]))) * 64) for r in rows if r[0] is not None and r[0] not in (2000, 2020, 2040)}
    ids = np.array(sorted(good))
    points = np.array([good[i] for i in ids])
    want = {}
    for q in ids[ids % 20 == 0]:
        scores = points @ good[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:7]
        want |= {(int(q), n): (int(ids[j]), int(scores[j])) for n, j in enumerate(order, 1)}
    assert got == want
    assert covertree.top_k(table.limit(0)).count() == 0
    assert covertree.top_k(table.where("vec_id in (0, 20)")).count() == 2


@pytest.mark.parametrize("largest", [1e8, 1e300, 1.7e308])
def test_top_k_of_wide_components(spark, largest):
    draw = np.random.default_rng(7)
    made = draw.normal(size=(300, 6))
    made[::3] *= largest / np.abs(made).max()
    made[1::7] = made[3]  # ties
    made[2, 0], made[5, :] = largest, 0.0
    made[20] = made[40] * (1 + 2.0**-52)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id bigint, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in covertree.top_k(table, k=6, block=70, query_block=6, sample=40).collect()}
    exact = [[math.floor(Fraction(x) * 64) for x in v.tolist()] for v in made]
    want = {}
    for q in range(0, 300, 20):
        scores = sorted((-sum(x * y for x, y in zip(exact[q], exact[i], strict=True)), i) for i in range(300) if i != q)
        for n, (score, i) in enumerate(scores[:6], 1):
            want[q, n] = (i, max(-(2**63), min(2**63 - 1, -score)))
    assert got == want


def test_sortable_scores():
    scores = sorted([0, 1, -1, 255, 256, -255, -256, 2**70, -(2**70), 2**2100, -(2**2100), 2**2100 + 1, -(2**2100) - 1])
    assert sorted(scores, key=covertree.sortable) == scores


def test_cover_tree_keeps_its_invariants():
    draw = np.random.default_rng(9)
    points = np.concatenate([draw.normal(size=(200, 5)), draw.normal(size=(300, 5)) * 0.01 + 3, np.ones((40, 5))])
    order, gap, levels = covertree.net_levels(points)
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    for count, radius, parent in levels:
        net = order[:count]  # nesting: every level begins with the one above
        inner = apart[np.ix_(net, net)] + np.diag(np.full(count, np.inf))
        assert inner.min() > radius or count == 1  # separation
        assert (apart[np.arange(len(points)), order[parent]] <= radius + 1e-12).all()  # covering
    assert len(order) == len(np.unique(points, axis=0)) and [c for c, *_ in levels] == sorted(c for c, *_ in levels)

    def below(node):
        for child in node.children:
            assert np.isin(child.points, node.points).all()
            below(child)
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        assert np.sqrt(((points[node.points] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-12
        assert node.children or len(node.points) <= covertree.LEAF

    below(covertree.cover_tree(points))


@pytest.mark.parametrize("large", [1e9, 1e200, 1.7e308])
def test_one_large_component_leaves_other_pairs_on_the_fast_path(large):
    draw = np.random.default_rng(11)
    data = np.floor(64 * draw.normal(size=(800, 64))) / 64
    data[17, 5] = large
    down = max(int(np.frexp(large)[1]) - covertree.FINITE, 0)
    points = np.ldexp(data, -down)
    queries, ids = np.arange(0, 800, 20), np.arange(800)
    run = covertree.Search(points[queries], queries, np.full(40, -np.inf), points, ids, 20, 2.0 * 64 * 2.0**-52)
    run.exact_queries, run.exact_data = lambda r: covertree.whole(data[queries[r]]), lambda c: covertree.whole(data[c])
    run.visit(covertree.cover_tree(points[queries]), covertree.cover_tree(points))
    assert len(run.abreast()[0]) < 0.05 * run.total
    want = []
    for q in queries.tolist():
        own = covertree.whole(data[q])
        scored = sorted((-sum(x * y for x, y in zip(own, covertree.whole(data[c]), strict=True)), c) for c in range(800) if c != q)
        want += [(q, c, -s) for s, c in scored[:20]]
    assert list(zip(*run.ranked(4096.0), strict=True)) == want


def test_levels_of_few_points_are_left_out():
    points = np.random.default_rng(12).normal(size=(4096, 64))
    begun = time.perf_counter()
    covertree.cover_tree(points)
    assert time.perf_counter() - begun < 1.0
    order, _, levels = covertree.net_levels(points, covertree.THIN)
    assert len(order) * covertree.THIN <= 4096 and levels[-1][0] <= len(order)


def test_share_of_pairs_pruned():
    draw = np.random.default_rng(10)
    centres = draw.normal(size=(20, 16)) * 50
    data = np.floor(centres[draw.integers(0, 20, 4000)] + draw.normal(size=(4000, 16)))
    queries = data[:400]
    run = covertree.Search(queries, np.arange(400), np.full(400, -np.inf), data, np.arange(4000), 20)
    run.visit(covertree.cover_tree(queries), covertree.cover_tree(data))
    assert run.pairs < 0.5 * run.total
    scores = queries @ data.T
    np.fill_diagonal(scores, -np.inf)
    assert np.array_equal(run.scores, -np.sort(-scores, axis=1)[:, :20])


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    odd = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, None, 0), (None, "the and of the thing", "en", None, 3)], docs.schema))
    ids = {r.doc_id for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf)
        assert odd.columns == docs.columns, name
        odd = corpus_pipeline.written(odd, "test")
    kept = {r.doc_id for r in odd.collect()}
    assert None in kept and 10**6 not in kept and kept < ids


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    prints = {i: simhash_of(t) for i, t in docs.items()}
    docs = {i: docs[i] for i, root in brute_components(prints).items() if i == root}
    for i, body in docs.items():
        out, at = "", 0
        for _, start, end in sorted(secrets(body), key=lambda s: s[1:]):
            if start >= at:
                out += body[at:start] + "[SECRET]"
            at = max(at, end)
        docs[i] = out + body[at:]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    result = corpus_pipeline.run(spark, sf).collect()
    found = {r.doc_id for r in result}
    assert found <= set(docs) and len(found) >= 0.8 * len(docs)
    assert len((set(docs) & clean) - found) <= 1 and len(found & toxic) <= 0.2 * len(set(docs) & toxic) + 1
    for r in result:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_the_driver_collects_between_stages(spark):
    """Spark's cleaner and the plans' classes wait for the driver's JVM, which seldom collects by itself."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES[2:]:
        before = full()
        stage(spark, docs, sf)
        assert full() > before
