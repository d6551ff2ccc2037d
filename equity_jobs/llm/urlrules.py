"""URL filters by a sort-merge range join.

A host is keyed by its labels in reverse ("net.example."), so a rule's host and all its
subdomains are one interval of the key order. Rules and urls are range-partitioned and
sorted together; a sweep keeps a stack of the rules whose interval is open. Rules that
were opened in an earlier partition reach a later one as a carry of at most
(partitions x nesting depth) rows, found by a first pass over the sorted partitions.
Neither side is broadcast, and a hot host spreads over partitions because the sort key
ends in the path and the page's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equity_jobs.llm.common import ascii_lower, checkpointed

RULES = "verdict string, host string, path string"


def rules_frame(spark: SparkSession, rules: list[str]) -> DataFrame:
    """Rules written as "block example.com/de/" as a table of verdict, host and path."""
    rows = []
    for rule in rules:
        verdict, _, target = rule.partition(" ")
        host, slash, path = target.partition("/")
        rows.append((verdict, host, slash + path))
    return spark.createDataFrame(rows, RULES)


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot; the empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class _Open:
    """The rules of one host whose interval is open: the verdict by path, longest path first."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host, self.verdicts, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if self.verdicts.get(path) != "block":
            self.verdicts[path] = verdict
        self.lengths = sorted({len(p) for p in self.verdicts}, reverse=True)

    def fits(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.verdicts), None)


def _push(stack: list[_Open], key: str, host: str, path: str, verdict: str) -> None:
    while stack and not key.startswith(stack[-1].key):
        stack.pop()
    if not stack or stack[-1].key != key:
        stack.append(_Open(key, host))
    stack[-1].add(path, verdict)


def _open_at_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition, the rules still open after its last row."""
    stack: list[_Open] = []
    for batch in batches:
        kinds, keys = batch.column("kind").to_pylist(), batch.column("key").to_pylist()
        for i in (i for i, kind in enumerate(kinds) if kind == 0):
            _push(stack, keys[i], *(batch.column(c)[i].as_py() for c in ("host", "path", "verdict")))
        while keys and stack and not keys[-1].startswith(stack[-1].key):
            stack.pop()
    rows = [(TaskContext.get().partitionId(), o.key, o.host, p, v) for o in stack for p, v in o.verdicts.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "key", "host", "path", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", partitions: int | None = None) -> DataFrame:
    """id, host, path, rule and verdict of every row of pages.

    A rule fits its host and the host's subdomains where the url's path starts with the
    rule's path; the longest rule wins (host and path together, the deeper host at a tie).
    Null urls and urls without "://" have an empty host and path and get the default.
    Rules with a null or empty host are ignored; of equal rules that disagree, block wins.
    Repeated pages are judged one by one; no rules: everything gets the default. Other
    columns of pages are not read. default: the verdict where no rule fits.
    """
    spark = pages.sparkSession
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path")).select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")
    )
    rule_host = ascii_lower(F.col("host"))
    listed = rules.where(F.coalesce(F.col("host"), F.lit("")) != "").select(
        host_key(rule_host).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), rule_host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "kind", "path", "id"]
    # the two passes must see the same partitions, also after a lost executor: hence a reliable checkpoint
    events = checkpointed(urls.unionByName(listed).repartitionByRange(count, *order).sortWithinPartitions(*order))
    carry: dict[int, list[tuple]] = {}
    for row in events.mapInArrow(_open_at_end, "part bigint, key string, host string, path string, verdict string").collect():  # partitions x depth rows
        carry.setdefault(row[0], []).append(tuple(row)[1:])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        stack: list[_Open] = []
        for before in sorted(p for p in carry if p < here):
            for opened in sorted(carry[before]):
                _push(stack, *opened)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "kind", "host", "path", "verdict")]
            rows, found, verdicts = [], [], []
            for i, (key, kind, host, path, verdict) in enumerate(zip(*columns, strict=True)):
                if kind == 0:
                    _push(stack, key, host, path, verdict)
                    continue
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                best, said = None, default
                for opened in stack:
                    fit = opened.fits(path)
                    if fit is not None and (best is None or len(opened.host + fit) >= len(best)):
                        best, said = opened.host + fit, opened.verdicts[fit]
                rows.append(i)
                found.append(best)
                verdicts.append(said)
            kept = batch.select(["id", "host", "path"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    kind = urls.schema["id"].dataType.simpleString()
    return events.mapInArrow(sweep, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
