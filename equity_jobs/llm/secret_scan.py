"""Secret scans by grammar inference.

Base patterns find assignments, access keys and hex runs. The values assigned to a key
are labelled credentials: their symbol-class strings form a prefix tree, whose
statistically compatible states are merged (ALERGIA) into a probabilistic automaton. A
second automaton is inferred from other tokens in the same way. Every token that base
spans leave open is scored by its likelihood per symbol under the first, and is a secret
where that is as high as held-out labelled credentials have it, and higher than under the
second.

What is stored between the steps are places and symbol classes, never the values found.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equity_jobs.llm.common import written

KINDS = ["assign", "access", "hex", "format"]  # in the order in which spans are listed
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ of 16 and more
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
SPAN = "array<struct<kind:string,start:int,end:int,word:string,key:bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end and value of the base matches, by start, then kind as listed."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]], least: int = 12) -> list[tuple[str, int, int, str]]:
    """Tokens of at least `least` characters that base spans do not cover whole."""
    found, at = [], 0
    covered: list[list[int]] = []  # the union of the base spans
    for start, end in sorted((s, e) for _, s, e, _ in base):
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for token in TOKEN.finditer(text):
        start, end = token.span()
        if end - start < least:
            continue
        while at < len(covered) and covered[at][1] < end:
            at += 1
        if at == len(covered) or covered[at][0] > start:
            found.append(("format", start, end, token[0]))
    return found


def classes(value: str) -> str:
    """The value with letters and digits replaced by their class; other characters stay."""
    return re.sub("[A-F]", "X", re.sub("[G-Z]", "L", re.sub("[0-9]", "0", re.sub("[a-f]", "x", re.sub("[g-z]", "l", value)))))


@dataclass
class Automaton:
    """A probabilistic automaton; state 0 is the start."""

    total: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    taken: list[dict[str, int]] = field(default_factory=lambda: [{}])
    to: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def add(self, word: str) -> None:
        at = 0
        for symbol in word:
            self.total[at] += 1
            self.taken[at][symbol] = self.taken[at].get(symbol, 0) + 1
            if symbol not in self.to[at]:
                self.to[at][symbol] = len(self.total)
                for column, new in ((self.total, 0), (self.ends, 0), (self.taken, {}), (self.to, {})):
                    column.append(new)
            at = self.to[at][symbol]
        self.total[at] += 1
        self.ends[at] += 1

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether two states and all that follows b have like frequencies (Hoeffding's bound)."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            room = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > room:
                return False
            for symbol in self.taken[a].keys() | self.taken[b].keys():
                if abs(self.taken[a].get(symbol, 0) / n - self.taken[b].get(symbol, 0) / m) > room:
                    return False
                if symbol in self.to[a] and symbol in self.to[b]:
                    todo.append((self.to[a][symbol], self.to[b][symbol]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for symbol, count in self.taken[b].items():
                self.taken[a][symbol] = self.taken[a].get(symbol, 0) + count
                if symbol in self.to[a]:
                    todo.append((self.to[a][symbol], self.to[b][symbol]))
                else:
                    self.to[a][symbol] = self.to[b][symbol]

    def merge(self, alpha: float) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], [(0, s) for s in sorted(self.to[0])]
        while blue:
            parent, symbol = blue.pop(0)
            state = self.to[parent][symbol]
            if state in red:
                continue
            match = next((r for r in red if self.alike(r, state, bound)), None)
            if match is None:
                red.append(state)
            else:
                self.to[parent][symbol] = match
                self.fold(match, state)
            blue = [(r, s) for r in red for s in sorted(self.to[r]) if self.to[r][s] not in red]

    def score(self, word: str) -> float:
        """log2 likelihood per symbol, the end included; a symbol that no labelled word had here counts as one in 1,000."""
        at, bits = 0, 0.0
        for symbol in word:
            count = self.taken[at].get(symbol, 0)
            bits += math.log2(count / self.total[at]) if count else math.log2(1e-3)
            at = self.to[at].get(symbol, 0)
        return (bits + math.log2(max(self.ends[at] / max(self.total[at], 1), 1e-3))) / (len(word) + 1)


def inferred(words: list[str], alpha: float = 0.05) -> Automaton:
    automaton = Automaton()
    for word in words:
        automaton.add(word)
    automaton.merge(alpha)
    return automaton


@dataclass
class Formats:
    """The automaton of labelled credentials, that of other tokens, and the score from which a token counts."""

    secret: Automaton
    other: Automaton | None
    least: float

    def accepts(self, word: str) -> bool:
        score = self.secret.score(word)
        return score >= self.least and (self.other is None or score > self.other.score(word))


def infer(values: list[str], others: list[str] = (), alpha: float = 0.05, missed: float = 0.05, folds: int = 5) -> Formats | None:
    """Formats from labelled credentials and other tokens, both as symbol classes; None without the former.

    The least score is held out: each fold is scored by an automaton of the other folds,
    and a share `missed` of all scores lies below. Fewer than two values give their own.
    """
    if not values:
        return None
    scores: list[float] = []
    for fold in range(folds):
        rest = [v for i, v in enumerate(values) if i % folds != fold]
        if rest and len(rest) < len(values):
            held = inferred(rest, alpha)
            scores += [held.score(v) for i, v in enumerate(values) if i % folds == fold]
    secret = inferred(values, alpha)
    scores = sorted(scores) or [secret.score(v) for v in values]
    return Formats(secret, inferred(others, alpha) if others else None, scores[int(missed * len(scores))])


def is_secret(formats: Formats | None, value: str) -> bool:
    return formats is not None and formats.accepts(classes(value))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and candidates of every row's whole text: kind, start, end, the symbol classes
    (of base spans only where they are labelled credentials) and a hash of the value."""

    def told(spans: list[tuple[str, int, int, str]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b, "word": None if k == "hex" else classes(v), "key": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) >> 1} for k, a, b, v in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("key", pa.int64())]))
        for batch in batches:
            base, others = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                base.append(told(spans))
                others.append(told(candidates(text or "", spans)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, kind), pa.array(others, kind)], names=["id", "base", "candidates"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, base {SPAN}, candidates {SPAN}")


def _sampled(scanned: DataFrame, column: str, labelled: bool, sample: int) -> list[str]:
    """The symbol classes of the `sample` distinct values whose hashes are lowest."""
    spans = scanned.select(F.explode(column).alias("s")).select("s.*")
    spans = spans.where("word is not null") if labelled else spans
    rows = spans.groupBy("key").agg(F.min("word").alias("word")).orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    return [r.word for r in rows]


def learn(scanned: DataFrame, sample: int = 300, alpha: float = 0.05, others: int = 2000) -> Formats | None:
    """Formats of a bounded sample of scan(): at most `sample` distinct values of assignments and
    access keys, and at most `others` distinct tokens that base spans leave open."""
    values = _sampled(scanned, "base", True, sample)
    return infer(values, _sampled(scanned, "candidates", False, others), alpha) if values else None


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 300, alpha: float = 0.05) -> DataFrame:
    """id and spans (kind, start, end; code points, end exclusive; by start, then kind) of every row.

    Base spans are always there; spans of kind "format" are what the automata add. Null
    and empty texts have no spans; without labelled credentials nothing is added; no rows:
    no rows. Repeats and null ids stay; other columns are not read. sample bounds the
    labelled credentials learned from, alpha is the merge test's significance.
    """
    scanned = written(scan(docs, id_col, text_col), "secret-candidates")
    formats = learn(scanned, sample, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = []
            for base, others in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                found = base + [c for c in others if formats is not None and formats.accepts(c["word"])]
                spans.append(sorted(({k: s[k] for k in ("kind", "start", "end")} for s in found), key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return scanned.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, formats: Formats | None, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mark; chars_col, if there, follows the text. Null texts stay
    null; repeats, null ids and other columns stay as they are; no rows: no rows."""

    def cleaned(text: str) -> str:
        base = base_spans(text)
        spans = sorted([(s, e) for _, s, e, _ in base] + [(s, e) for _, s, e, v in candidates(text, base) if is_secret(formats, v)])
        out, at = [], 0
        for start, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else cleaned(t) for t in batch.column(text_col).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
