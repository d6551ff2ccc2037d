"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is parsed
greedily into the longest phrases that occur in a language's text; the language that
needs the fewest phrases, normalised by log2 of the length of its text, wins.

Text is walked as the UTF-8 bytes of its lower-case letters, with one break for whatever
lies between them, so that every letter of every script is told apart by at most 257
symbols. The automata become one table state x symbol -> next state, in which a missing
transition leads to where the new phrase begins and carries a flag, so that parsing is a
table walk which numpy does for thousands of blocks of text and all languages at once.
Blocks are first walked as if a phrase began with each; then those that the block before
enters in another state are walked again from there, until both walks meet. Repetitive
text, in which they may never meet, is walked block after block; a block that comes again in
the same state is looked up. The phrases are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAK = 0  # what is no letter
BLOCK = 512  # symbols walked in a row before the states are handed on
LANES = 8192  # blocks walked at once
TOGETHER = 1 << 20  # symbols of texts whose blocks are walked together
ROUNDS = 4  # rounds of walks from other states, before what is left is walked block after block
USUAL = 4000  # characters up to which labelled texts are learned first
BETWEEN = re.compile(r"[\W\d_]+")
UNIFORM_BITS = 6.0  # what symbols drawn evenly from 64 would take
CHANCE_BITS = 160.0  # what chance may add to a text, however short


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    symbols: np.ndarray  # byte -> symbol; bytes not seen in labelled text share one
    table: np.ndarray  # (state * width + symbol) -> 2 * next state * width + flag
    roots: np.ndarray  # by language, state * width
    width: int
    phrase_bits: np.ndarray  # by language, log2 of the length of its text


def _automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text, by state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                clone = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = clone
                    at = link[at]
                link[to] = link[new] = clone
        last = new
    return step


def _letters(text: str) -> np.ndarray:
    """The bytes of the letters in lower case; 0 between words."""
    return np.frombuffer(BETWEEN.sub("\0", text.lower()).encode("utf-8", "surrogatepass"), np.uint8)


def build(samples: dict[str, list[str]]) -> LanguageModel:
    """A model from labelled texts, learned whole."""
    languages = tuple(sorted(samples))
    joined = {lang: _letters(" ".join(samples[lang])) for lang in languages}
    seen = np.zeros(256, bool)
    for text in joined.values():
        seen[np.unique(text)] = True
    seen[BREAK] = False
    told = np.flatnonzero(seen)
    symbols = np.ones(256, np.uint8)  # 1: not seen
    symbols[BREAK] = 0
    symbols[told] = np.arange(2, 2 + len(told))
    pad = 2 + len(told)
    width = pad + 1
    tables, roots, bits, base = [], [], [], 0
    for lang in languages:
        text = symbols[joined[lang]]
        step = _automaton(text)
        root = np.full(width, base * width * 2 + 1, np.int64)  # a symbol never seen is a phrase of its own
        for symbol, to in step[0].items():
            root[symbol] = (base + to) * width * 2 + 1
        rows = np.tile(root, (len(step), 1))
        for state, moves in enumerate(step):
            for symbol, to in moves.items():
                rows[state, symbol] = (base + to) * width * 2
        rows[:, pad] = (base + np.arange(len(step))) * width * 2
        # from the root the first symbol opens a phrase
        rows[0, :pad] |= 1
        tables.append(rows.astype(np.int32) if rows.max() < 2**31 else rows)
        roots.append(base * width)
        bits.append(np.log2(max(len(text), 2)))
        base += len(step)
    table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
    small = np.int32 if not len(table) or table.max() < 2**31 else np.int64
    return LanguageModel(languages, symbols, table.astype(small), np.array(roots, small), width, np.array(bits))


def _walk(model: LanguageModel, lanes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By language and lane the phrases begun and the state at the end, from the entry states."""
    upto = int((lanes != model.width - 1).sum(1).max()) if len(lanes) else 0
    state, count = entry.copy(), np.zeros(entry.shape, np.int32)
    at, flag = np.empty_like(state), np.empty_like(state)
    for column in np.ascontiguousarray(lanes[:, :upto].T).astype(model.table.dtype):
        np.add(state, column, out=at)
        np.take(model.table, at, out=state, mode="clip")
        np.bitwise_and(state, 1, out=flag)
        count += flag
        state >>= 1
    return count, state


def _rewalk(model: LanguageModel, lanes: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The walks from two entry states of each lane: how many more phrases the second begins, and where it
    ends (-1: where the first does, since they met)."""
    more, end = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1, np.int64)
    live = np.flatnonzero(first != second)
    a, b = first[live].copy(), second[live].copy()
    for k in range(BLOCK):
        if not len(live):
            return more, end
        symbol = lanes[live, k].astype(model.table.dtype)
        a, b = model.table[a + symbol], model.table[b + symbol]
        more[live] += (b & 1) - (a & 1)
        a, b = a >> 1, b >> 1
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
    end[live] = b
    return more, end


def _chained(model: LanguageModel, lanes: np.ndarray, entry: int, out: np.ndarray, entered: np.ndarray, total: np.ndarray) -> None:
    """The blocks of one text walked in order from the entry state, as far as a block is entered in
    another state than before; out, entered and total (the phrases that a block begins) are brought up to date."""
    table, known = memoryview(model.table), {}
    for b in range(len(lanes)):
        if entered[b] != entry:
            key = (lanes[b].tobytes(), entry)
            if key not in known:
                state, count = entry, 0
                for symbol in lanes[b].tolist():
                    state = table[state + symbol]
                    count += state & 1
                    state >>= 1
                known[key] = (count, state)
            entered[b] = entry
            total[b], out[b] = known[key]
        entry = int(out[b])


def phrases(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """By text and language the number of phrases of the whole text, and by text the number of symbols."""
    coded = [model.symbols[_letters(t)] for t in texts]
    sizes = np.array([len(c) for c in coded])
    total = np.zeros((len(texts), len(model.languages)), np.int64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + sizes[last] <= TOGETHER):
            size += sizes[last]
            last += 1
        total[first:last] = _counted(model, coded[first:last])
        first = last
    return total, sizes


def _counted(model: LanguageModel, coded: list[np.ndarray]) -> np.ndarray:
    blocks = -(-np.array([len(c) for c in coded]) // BLOCK)
    owner = np.repeat(np.arange(len(coded)), blocks)
    flat = np.full(len(owner) * BLOCK, model.width - 1, np.uint8)
    begins = np.concatenate([[0], np.cumsum(blocks)])[:-1] * BLOCK
    for code, begin in zip(coded, begins.tolist(), strict=True):
        flat[begin : begin + len(code)] = code
    lanes = flat.reshape(-1, BLOCK)
    count, end = [], []
    for at in range(0, len(lanes), LANES):
        part = lanes[at : at + LANES]
        walked = _walk(model, part, np.repeat(model.roots[:, None], len(part), 1))
        count.append(walked[0])
        end.append(walked[1])
    total = np.zeros((len(coded), len(model.languages)), np.int64)
    if not count:
        return total
    follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # blocks with one before them in their text
    ends = np.cumsum(blocks)
    for k, (own, out) in enumerate(zip(np.concatenate(count, 1), np.concatenate(end, 1), strict=True)):
        own, out = own.astype(np.int64), out.astype(np.int64)
        plain, begun = out.copy(), own.copy()  # where the walk from a new phrase ends, and its phrases
        entered = np.full(len(own), model.roots[k], np.int64)
        todo = follows
        for _ in range(ROUNDS):  # more than once only where walks do not meet within a block
            todo = todo[out[todo - 1] != entered[todo]]
            if not len(todo):
                break
            entered[todo] = out[todo - 1]
            more, met = _rewalk(model, lanes[todo], np.full(len(todo), model.roots[k], np.int64), entered[todo])
            begun[todo] = own[todo] + more
            now = np.where(met < 0, plain[todo], met)
            changed = todo[now != out[todo]] + 1
            out[todo] = now
            todo = np.intersect1d(changed, follows)
        todo = todo[out[todo - 1] != entered[todo]]
        texts, starts = np.unique(owner[todo], return_index=True)
        for text, b in zip(texts.tolist(), todo[starts].tolist(), strict=True):
            span = slice(b, ends[text])
            _chained(model, lanes[span], int(out[b - 1]), out[span], entered[span], begun[span])
        total[:, k] = np.bincount(owner, begun, len(coded)).astype(np.int64)
    return total


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
    """Language, score, bits per symbol and symbols of every text; "und", 0, infinity and 0 where nothing can be said."""
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    langs, scores, rates, lengths = ["und"] * len(texts), [0.0] * len(texts), [float("inf")] * len(texts), [0] * len(texts)
    if known:
        counts, sizes = phrases(model, [texts[i] for i in known])
        bits = counts * model.phrase_bits / np.maximum(sizes, 1)[:, None]
        order = np.argsort(bits, axis=1, kind="stable")
        for row, i in enumerate(known):
            best = bits[row, order[row, 0]]
            second = bits[row, order[row, 1]] if bits.shape[1] > 1 else np.inf
            langs[i], rates[i], lengths[i] = model.languages[order[row, 0]], float(best), int(sizes[row])
            scores[i] = float(1.0 if np.isinf(second) else second / (best + second) if best + second > 0 else 0.5)
    return langs, scores, rates, lengths


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 8, characters: int = 1 << 17) -> LanguageModel:
    """A model from a bounded sample of labelled rows: of each language at most docs_per_language
    distinct texts, and of those together at most `characters`. Texts of USUAL characters come
    before longer ones, then those whose hashes are lowest. The text at which a language has
    its characters is learned up to there, those after it are not. A language takes some 160
    bytes of table a character (21 MB at most), in the driver and in every task.

    Rows with a null text or language are left out; repeated rows count once; other
    columns are not read. No rows: a model of no languages.
    """
    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).where("lang is not null and text is not null")
    marked = rows.select("lang", F.xxhash64("text").alias("mark"), F.char_length("text").alias("size")).distinct()
    rank = Window.partitionBy("lang").orderBy(F.greatest("size", F.lit(USUAL)), F.xxhash64("mark"), "mark")
    chosen = {(r.lang, r.mark) for r in marked.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= docs_per_language).collect()}  # docs_per_language a language
    if not chosen:
        return build({})
    wanted = rows.withColumn("mark", F.xxhash64("text")).where(F.col("mark").isin([m for _, m in chosen]))
    samples: dict[str, list[str]] = {}
    one = F.min("text").alias("text")  # of a language and mark
    for row in wanted.groupBy("lang", "mark").agg(one).select("lang", "mark", F.substring("text", 1, characters).alias("text")).orderBy("lang", "mark").collect():
        if (row.lang, row.mark) in chosen:
            own = samples.setdefault(row.lang, [])
            own.append(row.text[: characters - sum(map(len, own))])
    return build(samples)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, bits_limit: float = UNIFORM_BITS) -> DataFrame:
    """Language of every whole text: id, lang_pred, score (0 to 1) and bits, the phrase bits per symbol.

    Null texts and texts without a letter are "und" with score 0 and infinite bits. score
    is the runner-up's share of bits, so 0.5 is a tie, which goes to the language that
    sorts first. Repeats and null ids stay; no rows: no rows. Other columns are not read,
    unless keep: then all columns stay and only rows pass whose language was found at no
    more than bits_limit bits a symbol and CHANCE_BITS besides. The default is far above
    what texts of two known languages take (5 at most), so mixed texts stay.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by languages x characters
    source = docs.select(*(docs[c] for c in docs.columns)) if keep else docs.select(docs[id_col].alias(id_col), docs[text_col].alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                langs, scores, rates, sizes = predict(sent.value, batch.column(text_col).to_pylist())
                if keep:
                    yield batch.filter(pa.array([lang != "und" and rate * n <= bits_limit * n + CHANCE_BITS for lang, rate, n in zip(langs, rates, sizes, strict=True)], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=[id_col, "lang_pred", "score", "bits"])

    kind = source.schema if keep else f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, bits double"
    return source.mapInArrow(run, kind)
