"""The pipeline's near-duplicates against brute force on five-word shingles."""

import numpy as np

import corpus_pipeline
from equity_jobs.llm import resemblance

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def jaccard_roots(texts):
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def edited(draw, words, n):
    words = list(words)
    for at in draw.choice(len(words), n, replace=False):
        words[at] = f"new{draw.integers(1 << 30)}"
    return words


def near_copies():
    """Chains and groups of copies with edited words, and a line that most documents share."""
    draw = np.random.default_rng(7)
    line = [f"licence{i}" for i in range(12)]
    texts = []
    for _ in range(40):
        words = [f"w{draw.integers(4000)}" for _ in range(draw.integers(30, 300))]
        for _ in range(draw.integers(1, 6)):
            texts.append(" ".join([*words, *line]))
            words = edited(draw, words, int(draw.integers(0, 1 + len(words) // 40)))
    texts += ["one", "one", "One two", "", texts[3], " ".join(line)]
    order = draw.permutation(len(texts))
    return {int(i): texts[k] for k, i in enumerate(order)}


def test_similar_links_equal_brute_force(spark, monkeypatch):
    texts = near_copies()
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()] + [(None, "one", None, None, None), (999, None, None, None, None)], DOCS).repartition(3)
    want = jaccard_roots(texts)
    assert sum(i != r for i, r in want.items()) > 30
    for often in (10, 1 << 30):  # with and without shingles known as frequent
        monkeypatch.setattr(resemblance, "OFTEN", often)
        roots = {r.node: r.root for r in resemblance.components(resemblance.similar_links(table)).collect()}
        assert {i: roots.get(i, i) for i in texts} == want
    assert resemblance.similar_links(table.limit(0)).count() == 0


def test_near_duplicate_stage_drops_edited_copies(spark):
    draw = np.random.default_rng(8)
    words = [f"w{draw.integers(4000)}" for _ in range(200)]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([words, edited(draw, words, 3), edited(draw, words, 3), [f"v{k}" for k in range(200)]])]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([*rows, (None, rows[0][1], None, None, None)], DOCS), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "None"]


def test_sketches_never_overstate_the_difference():
    draw = np.random.default_rng(9)
    for n in (1, 7, 511, 512, 2000, 9000):
        whole = np.unique(draw.integers(-(2**31), 2**31, n).astype(np.int32))
        for kept in (1.0, 0.8, 0.5, 0.0):
            other = np.unique(np.concatenate([whole[: int(kept * len(whole))], draw.integers(-(2**31), 2**31, 1 + n // 9).astype(np.int32)]))
            differ = len(np.setxor1d(whole, other))
            assert resemblance.differ(resemblance.sketch(whole), resemblance.sketch(other)) <= differ
    same = np.full(3000, 64, np.int32) * np.arange(3000, dtype=np.int32)  # counts beyond 255
    assert resemblance.differ(resemblance.sketch(same), resemblance.sketch(same[:400])) <= 2600
