"""Resampling, k-means tree search and conversation repair against SQL and brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from equity_jobs.llm import kmeans_tree, queries, repair, resample
from equity_jobs.llm.repair import ASSISTANT, NEXT, START

SF = "/root/testdata/sf0.001"
WORDS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


@pytest.mark.parametrize("name", ["op11_resampling", "op13_conversation_repair"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))


# Resampling


def runs_of(text):
    words = re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("window", [5, 37, 1 << 20])
def test_word_runs_over_windows(monkeypatch, window):
    monkeypatch.setattr(resample, "WINDOW", window)
    texts = ["Hello world, it's 42 ünïcode Ωmega", "", None, "a" * 100 + " b " + "c" * 60, "x", "one two  three-four", "ABC", "éa", "\x00 \x7f"]
    found = [{} for _ in texts]
    for _, runs in resample.word_runs(pa.array(["not this", *texts]).slice(1), 997):
        for rows, buckets in runs:
            for i, b in zip(rows.tolist(), buckets.tolist(), strict=True):
                found[i][b] = found[i].get(b, 0) + 1
    for text, own in zip(texts, found, strict=True):
        want = {}
        for run in runs_of(text)[1]:
            b = zlib.crc32(run.encode()) % 997
            want[b] = want.get(b, 0) + 1
        assert own == want


def brute_resample(docs, target, percent=5, least=20, buckets=10_000):
    count = lambda texts: np.bincount([zlib.crc32(r.encode()) % buckets for t in texts for r in runs_of(t)[1]], minlength=buckets)
    s, t = count([d[1] for d in docs]), count(target)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (float(s.sum()) + buckets) / ((float(a) + 1) * (float(t.sum()) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        words, runs = runs_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in runs)
        rows.append((doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return rows, drawn


def test_resampling_equals_brute_force(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ABC", "12"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 3, 19, 20, 25, 80])))) for i in range(400)]
    docs += [(None, " ".join(["w1"] * 30)), (1000, None), (1001, ""), (1002, "w1 " * 5000)] + [(7, docs[7][1])] * 60 + [(None, " ".join(["w1"] * 30))] * 3
    target = [" ".join(draw.choices(vocabulary[:10], k=30)) for _ in range(20)] + [None]
    table = spark.createDataFrame([(i, t, "n", -1) for i, t in docs], "doc_id bigint, text string, n_words string, score int").repartition(6)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    rows, drawn = brute_resample(docs, target, 30)
    got = resample.resample(table, aims, 30).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key(r[:4]) for r in rows)) == sorted(key((r.doc_id, r.n_features, r.weight, r.score)) for r in got)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]
    assert resample.resample(table.limit(0), aims).count() == 0
    alone = resample.resample(table, aims.limit(0)).collect()
    assert len(alone) == len(docs) and {r["rank"] for r in alone if r.n_features < 57} == {None}


def test_cutoff_is_found_at_every_place(spark, monkeypatch):
    monkeypatch.setattr(resample, "GROUP", 16)
    rows = [(i % 50 if i % 9 else None, (i * 37) % 23, i) for i in range(900)]
    table = spark.createDataFrame(rows, "id bigint, score bigint, _row bigint").repartition(9)
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    for wanted in (1, 2, 450, 451, 899, 900):
        key, rounds = resample.cutoff(table, wanted)
        assert (-key.negated, None if key.unnamed else key.id, key.row) == (order[wanted - 1][1], order[wanted - 1][0], order[wanted - 1][2])
        assert rounds <= math.log(900) / math.log(4 / 3) + 1  # a quarter goes in each round
        assert table.where(key.first()).count() == wanted
    assert resample.cutoff(table, 0)[0] is None and resample.cutoff(table, 901)[0] is None


# Nearest neighbours


def true_best(ids, points, k, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.cumsum(points[i] * points, axis=1)[:, -1]  # summed in order
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    con = duckdb.connect()
    table = con.execute(f"select vec_id, embedding from read_parquet('{sf}/embeddings.parquet') order by 1").fetchall()
    ids, points = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    got = queries.op12_nearest(spark, sf).collect()
    want = true_best(ids, points, 20)
    score_of = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(score_of) == len(got) == 20 * len(want)
    at = {int(v): i for i, v in enumerate(ids)}
    for (q, v), score in list(score_of.items())[:200]:
        assert score == np.cumsum(points[at[q]] * points[at[v]])[-1]
    hit = sum((q, v) in score_of for q, best in want.items() for v, _ in best)
    assert hit / (20 * len(want)) >= 0.9
    for q in want:
        own = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (r[1], r[2]))


def test_tree_is_fitted_on_a_sample_and_finds_clusters(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 12)) * 4
    points = (centres[np.arange(4000) % 40] + draw.normal(size=(4000, 12)) * 0.3).astype(np.float32)
    points[2000:3400] = points[17]  # one vector a third of all rows have
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    rows += [(5000, None, 0), (5020, [float("nan")] * 12, 0), (5040, [0.0] * 12, 0), (5060, [1.0, None] * 6, 0), (None, [1.0] * 12, 0), (5080, [9.0] * 3, 0), rows[0], rows[20], (5100, [], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(5)
    got = {}
    for r in kmeans_tree.nearest(table, k=5, every=40, sample=500, leaf_rows=60).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = np.array([*range(4000), 5080])
    whole = np.vstack([points.astype(float), np.pad([9.0] * 3, (0, 9))])
    want = true_best(ids, whole, 5, 40)
    assert set(got) == set(want)
    exact = sum(set(got[q].values()) & set(best) != set() and len(set(got[q].values()) & set(best)) for q, best in want.items())
    assert exact >= 0.9 * 5 * len(want)


def test_search_edges(spark):
    table = spark.createDataFrame([(0, [1e300, 1.0], 0), (20, [1e300, -1.0], 0), (21, [2.0, 2.0], 1)], "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kmeans_tree.nearest(table).collect())
    assert got == [(0, 1, 20, math.inf), (0, 2, 21, 2e300), (20, 1, 0, math.inf), (20, 2, 21, 2e300)]
    assert kmeans_tree.nearest(table.limit(0)).count() == 0
    assert kmeans_tree.nearest(table.where("vec_id = 0")).count() == 0
    assert kmeans_tree.nearest(table.where("vec_id = 21")).count() == 0


def test_walk_takes_the_best_bin_first():
    draw = np.random.default_rng(4)
    points = draw.normal(size=(600, 6))
    tree = kmeans_tree.grow(points, 60_000, 2000, branching=4)
    assert tree.leaves > 10
    order = list(tree.walk(points[3]))
    assert sorted(order) == list(range(tree.leaves))
    where = tree.place(points)
    assert set(where.tolist()) <= set(range(tree.leaves))
    seen = np.mean([list(tree.walk(p)).index(leaf) for p, leaf in zip(points[:100], where[:100], strict=True)])
    assert seen < tree.leaves / 4  # a point's own leaf comes early


# Conversation repair


def cheapest(rows):
    """Cost and letters by trying all edits with up to two inserts between rows."""
    best = None

    def go(at, state, cost, said, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows) and state in (START, ASSISTANT):
            best = (cost, said) if best is None or (cost, said) < best else best
        if inserts < 2:
            for r, t in NEXT[state].items():
                if r in "ua":
                    go(at, t, cost + 3, said + "I", inserts + 1)
        if at < len(rows):
            role, deleted, cut = rows[at]
            go(at + 1, state, cost + 4, said + "D", 0)
            for r, t in {} if deleted else NEXT[state].items():
                if r == role[:1]:
                    go(at + 1, t, cost + 3 * cut, said + "K", 0)
                if r in "ua":
                    go(at + 1, t, cost + 3 * cut + 3, said + "R", 0)

    go(0, START, 0, "", 0)
    return best


@pytest.mark.parametrize("patience", [1, 8])
def test_viterbi_equals_all_edits(patience):
    draw = random.Random(patience)
    for _ in range(1500):
        rows = [(draw.choice(["user", "assistant", "system", " ", "", "tool"]) if draw.random() < 0.8 else "user", draw.random() < 0.25, draw.random() < 0.3) for _ in range(draw.randint(0, 7))]
        walk = repair.Viterbi()
        walk.patience = patience
        letters = "".join(e[0] for r in rows for e in walk.push(r, r[0], "t", r[1], r[2])) + "".join(e[0] for e in walk.finish())
        assert (walk.cost, letters) == cheapest(rows)


def test_survivors_coalesce():
    draw, walk = random.Random(5), repair.Viterbi()
    done = 0
    for i in range(30_000):
        done += sum(1 for e in walk.push(i, draw.choice(["user", "assistant", "system"]), "t", draw.random() < 0.1, draw.random() < 0.2) if e[0] != "I")
        assert i + 1 - done <= 200
    assert walk.most_held <= 100


def brute_summary(rows):
    """rows of one conversation: turn, role, text."""
    said = lambda x: " " if x is None else x
    own = sorted(((t, said(r), said(x)) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in own:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit = cheapest([(r[1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults, strict=True)])
    out, state, i = [], START, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        keep_system = letter == "K" and own[i][1][:1] == "s"
        wanted = "s" if keep_system else "a" if state == repair.USER else "u"
        role = own[i][1] if letter == "K" else repair.ROLE[wanted]
        out.append(f"{role}:{'' if letter == 'I' else own[i][2]}")
        state, i = NEXT[state][wanted], i + (letter != "I")
    turns = [t for t, *_ in own if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_repair_equals_brute_force(spark):
    draw = random.Random(9)
    text = lambda: draw.choice(["Well.", "And so", "Why? ", "  \t", "", None, "Yes!", "é ", "x\n"])
    rows = []
    for conv in [*range(120), None, -5]:
        for turn in range(draw.randint(1, 7)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), draw.choice(["user", "assistant", "system", "user", "assistant", None, "tool"]), text()))
    rows += [(900, 5, "user", "Well.")] * 3 + [(901, None, "user", "Hm.")] * 2
    table = spark.createDataFrame([(*r, True, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, seen boolean, fault string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in repair.summary(repair.repair(repair.damaged(table))).collect()}
    spoilt = {c: [] for c, *_ in rows}
    for c, *rest in brute_damage(rows):
        spoilt[c].append(rest)
    assert got == {c: brute_summary(own) for c, own in spoilt.items()}
    assert repair.repair(repair.damaged(table.limit(0))).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"Turn {i}.") for i in range(6000)] + [(2, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    edits = repair.repair(table)
    assert edits.where("conv_id = 1").groupBy("edit").count().count() >= 2
    found = {r.conv_id: r for r in repair.summary(edits).collect()}
    assert found[1].illegal == 0 and found[1].cost == 6 and found[2].audit == "KI"


def test_numeric_symbols_are_no_letters(spark):
    from equity_jobs.llm import langid

    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["½", "²³ ①", "12 _", "", None, "é", "½ Katze"])], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, langid.learn(docs)).collect()}
    assert [got[i] for i in range(5)] == [("und", 0.0)] * 5 and "und" not in (got[5][0], got[6][0])
