"""Personal data beyond the base patterns: recall on planted forms, long texts, the estimation."""

import numpy as np

from equity_jobs.llm import pii

# form, what announces it
PLANTED = {
    "email": [("jane.doe (at) mail{n} (dot) example (dot) com", "contact"), ("info{n} [at] site.org", "write to"), ("a_b{n}(at)host.de", "or")],
    "ip": [("2001:0db8:85a3:0000:0000:8a2e:0370:7{n:03d}", "host"), ("fe80::1ff:fe23:4567:{n}", "and"), ("192[.]168[.]1[.]{n}", "server")],
    "card": [("4539_1488_0343_{n:04d}", "card"), ("5500 0000 0000 {n:04d}", "and"), ("3782 822463 1{n:04d}", "amex")],
    "phone": [("(487) 555-{n:04d}", "call"), ("487.555.{n:04d}", "tel"), ("0044 20 7946 {n:04d}", "or")],
}
# forms that look alike and are none
DECOYS = ["timestamp 1700000000{n:03d}", "file logo{n}(at)2x.png", "order 0000000000000{n:03d}", "isbn 978316148{n:04d}"]


def planted(count=30):
    draw = np.random.default_rng(4)
    word = lambda: "".join(draw.choice(list("abdeginorstu"), 6))
    texts, spans = [], []
    for n in range(count):
        text, own = word(), []
        for kind, forms in PLANTED.items():
            for form, lead in forms:
                value = form.format(n=n + 1)
                text += f" {word()} {lead} "
                own.append((kind, len(text), len(text) + len(value)))
                text += f"{value} {word()}."
        texts.append(text)
        spans.append(set(own))
    return texts, spans


#: decoys that the method takes for addresses, a stated limit: any version in brackets
TAKEN = ["version 1[.]2[.]3[.]{n} release"]


def test_planted_forms_are_found(spark):
    texts, want = planted()
    decoys = [f"one {d.format(n=n)} two" for n in range(20) for d in DECOYS]
    taken = [f"one {d.format(n=n)} two" for n in range(20) for d in TAKEN]
    docs = spark.createDataFrame(list(enumerate(texts + decoys + taken)), "doc_id bigint, text string")
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if not s.base} for r in pii.find_personal_data(docs).collect()}
    base = {r.doc_id: {(s.start, s.end) for s in r.spans if s.base} for r in pii.find_personal_data(docs).collect()}
    for kind in pii.KINDS:
        asked = [(i, s) for i, own in enumerate(want) for s in own if s[0] == kind and not any(a < s[2] and s[1] < b for a, b in base[i])]
        assert len(asked) >= 50
        assert sum(s in got[i] for i, s in asked) >= 0.9 * len(asked), kind
    assert sum(len(got[i] - own) for i, own in enumerate(want)) == 0
    start = len(texts) + len(decoys)
    assert sum(bool(got[i]) for i in range(len(texts), start)) <= 0.1 * len(decoys)
    # a stated limit: at most one span of one kind each
    assert all(len(got[i]) <= 1 and {kind for kind, *_ in got[i]} <= {"ip"} for i in range(start, start + len(taken)))


def test_long_texts_do_not_grow_the_stack(spark):
    texts = ["x (at) y" + ".z" * 2_000, "x (at) y" + ".z" * 100_000, "x (at) y (dot) com " * 5_000, "a@b" + ".c" * 100_000, "1.2.3.4 " * 5_000, "(" * 200_000, "12:" * 70_000, "9" * 4_000, "+1 " + "2-" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert [(s.start, s.end) for s in got[1]] == [(0, len(texts[1]))]
    assert len(got[2]) == 5_000 and (got[2][-1].start, got[2][-1].end) == (19 * 4_999, len(texts[2]) - 1)
    assert [(s.start, s.end, s.base) for s in got[3]] == [(0, len(texts[3]), True)]
    assert [s.start for s in got[4]] == list(range(0, 40_000, 8))
    assert not any(got[i] for i in (5, 6, 7, 8))


def test_looser_spans_yield_to_base_spans(spark):
    table = spark.createDataFrame([(0, "+1 (487) 555-7209 then (487) 555-7201")], "doc_id bigint, text string")
    rows = pii.open_spans(pii.candidates(table)).collect()
    assert sorted((r.start, r.end, r.base) for r in rows) == [(0, 17, True), (23, 37, False)]


def test_sums_before(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        sizes = [i % 7 for i in range(n)]
        table = spark.createDataFrame([(sizes,)], "s array<int>")
        assert table.select(pii._sums_before(table["s"]).alias("b")).first().b == [sum(sizes[:i]) for i in range(n)]


def test_estimate_finds_the_hidden_reliabilities():
    draw = np.random.default_rng(0)
    true = draw.random(20_000) < 0.6
    right = {"form": (0.9, 0.8), "listed": (0.7, 0.9), "announced": (0.8, 0.95)}
    counts = {}
    for t in true:
        votes = tuple(0 if draw.random() < 0.2 else (1 if draw.random() < (a if t else 1 - b) else -1) for a, b in right.values())
        counts[votes] = counts.get(votes, 0) + 1
    found = pii.estimate([(dict(zip(right, v, strict=True)), n) for v, n in counts.items()], rounds=300)
    assert abs(found.prior - 0.6) < 0.05
    for name, (a, b) in right.items():
        assert abs(found.right[name][0] - a) < 0.05 and abs(found.right[name][1] - b) < 0.05
    # one step by brute force, over rows and not counts
    rows = [v for v, n in counts.items() for _ in range(n)]
    weights = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v in rows]
    once = pii.estimate([(dict(zip(right, v, strict=True)), n) for v, n in counts.items()], rounds=1)
    assert abs(once.prior - np.mean(weights)) < 1e-9
    for k, name in enumerate(right):
        cast = [(w, v[k]) for w, v in zip(weights, rows, strict=True) if v[k]]
        assert abs(once.right[name][0] - (4 + sum(w for w, v in cast if v > 0)) / (5 + sum(w for w, _ in cast))) < 1e-9
