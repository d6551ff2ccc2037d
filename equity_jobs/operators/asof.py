"""Joins and snapshots as of a date, without look-ahead."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = "instrument_id"


class Cutoffs:
    """The distinct cut-off days of a table as an index by day: one entry for each day between the
    first and the last, so it is bounded by the calendar (a few hundred thousand at most)."""

    def __init__(self, cutoffs: DataFrame) -> None:
        self.days = [r[0] for r in cutoffs.select("as_of").where("as_of is not null").distinct().orderBy("as_of").collect()]
        self.count, self.first = len(self.days), self.days[0] if self.days else None
        self.listed = F.split(F.lit(",".join(map(str, self.days))), ",").cast("array<date>")
        offsets = {(d - self.first).days for d in self.days}
        self.span = max(offsets, default=0)
        ranks, seen = [], 0
        for i in range(self.span + 1):
            ranks.append(str(seen))
            seen += i in offsets
        self.ranks = F.split(F.lit(",".join(ranks)), ",").cast("array<int>")

    def before(self, day: Column) -> Column:
        """How many cut-offs are earlier than day, by one look into the index; null for null."""
        if not self.days:
            return F.when(day.isNotNull(), 0)
        at = F.date_diff(day, F.lit(self.first))
        return F.when(at <= 0, 0).when(at > self.span, self.count).otherwise(F.get(self.ranks, at))

    def within(self, start: Column, end: Column | None = None) -> Column:
        """The cut-offs from start on and before end (null: no end), as an array slice."""
        low = self.before(start)
        high = F.lit(self.count) if end is None else F.coalesce(self.before(end), F.lit(self.count))
        return F.slice(self.listed, low + 1, F.greatest(high - low, F.lit(0))) if self.days else F.array().cast("array<date>")


def point_in_time(records: DataFrame, cutoffs: DataFrame, published: str = "published_date") -> DataFrame:
    """CL13: the records accepted at each cut-off, with as_of: no more rows than are accepted.

    Records meet a slice of the sorted cut-offs and not each of them. Undated records are
    accepted nowhere; no cut-offs: no rows.
    """
    index = Cutoffs(cutoffs)
    return records.drop("as_of").withColumn("as_of", F.explode(index.within(F.col(published))))


def exclusions(records: DataFrame, cutoffs: DataFrame, published: str = "published_date") -> DataFrame:
    """CL13's excluded records, each once: reason (undated or future) and how many of the first cut-offs exclude it."""
    index = Cutoffs(cutoffs)
    rows = records.withColumn("excluded_at", F.coalesce(index.before(F.col(published)), F.lit(index.count)))
    return rows.withColumn("reason", F.when(F.col(published).isNull(), "undated").otherwise("future")).where("excluded_at > 0")


def counts_as_of(records: DataFrame, cutoffs: DataFrame, keys: list[str], measures: dict[str, Column] | None = None, published: str = "published_date") -> DataFrame:
    """CL13's counts: of every cut-off and key how many records are accepted, future and undated, and how many of the accepted fulfil each measure.

    Records are counted by the first cut-off that sees them; running totals give all
    cut-offs, so rows are one a key and cut-off however many records there are.
    """
    index = Cutoffs(cutoffs)
    named = {"accepted": F.lit(True), **(measures or {})}
    slot = F.coalesce(index.before(F.col(published)), F.lit(index.count))
    marked = records.select(*keys, slot.alias("_slot"), F.col(published).isNull().cast("bigint").alias("undated"), *((F.col(published).isNotNull() & F.coalesce(c, F.lit(False))).cast("bigint").alias(n) for n, c in named.items()))
    own = marked.groupBy(*keys, "_slot").agg(*(F.sum(c).alias(c) for c in ("undated", *named)))
    begins = own.select(*keys).distinct().select(*keys, F.lit(0).alias("_slot"), *(F.lit(0).cast("bigint").alias(c) for c in ("undated", *named)))
    own = own.unionByName(begins).groupBy(*keys, "_slot").agg(*(F.sum(c).alias(c) for c in ("undated", *named)))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_slot")
    totals = own.withColumns({"_all": F.sum("accepted").over(whole), "undated": F.sum("undated").over(whole), "_next": F.coalesce(F.lead("_slot").over(upto), F.lit(index.count)), **{c: F.sum(c).over(upto) for c in named}})
    spread = F.slice(index.listed, F.col("_slot") + 1, F.col("_next") - F.col("_slot")) if index.days else F.array().cast("array<date>")
    return totals.withColumn("as_of", F.explode(spread)).select("as_of", *keys, *named, (F.col("_all") - F.col("accepted")).alias("future"), "undated")


def sessions_around(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """For each (instrument, as_of), the latest session up to it and the first one after it.

    One union and one window over it: each request looks back and ahead at the sessions around it.
    """
    both = bars.select(KEY, F.col("trade_date").alias("day"), F.lit(0).alias("_asks"), F.col("trade_date").alias("_session")).unionByName(requests.select(KEY, F.col("as_of").alias("day"), F.lit(1).alias("_asks"), F.lit(None).cast("date").alias("_session")))
    order = Window.partitionBy(KEY).orderBy("day", "_asks")
    before = F.last("_session", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_session", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumns({"effective": before, "next": after}).where("_asks = 1").select(KEY, F.col("day").alias("as_of"), "effective", "next")


def evidence_chain(events: DataFrame, disclosures: DataFrame, window_days: int = 7, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """The disclosures of an event's window in order, and one summary row an event.

    An event asks for each day of its window, so the interval join is an equi-join on
    (instrument, day). Later disclosures are counted from a running total, not joined.
    """
    asked = events.select(KEY, "event_date").distinct().withColumn("day", F.explode(F.sequence(F.date_sub("event_date", window_days - 1), F.col("event_date"))))
    hits = asked.join(disclosures.withColumnRenamed("published_date", "day"), [KEY, "day"]).withColumn("gap", F.date_diff("event_date", "day"))
    order = Window.partitionBy(KEY, "event_date").orderBy("gap", "title", "announcement_id")
    relation = F.when(F.col("gap") == 0, "same_day").otherwise("before")
    items = hits.withColumns({"relation": relation, "place": F.row_number().over(order)})
    matched = items.groupBy(KEY, "event_date").agg(F.count("*").alias("matched"), F.count_if(F.col("gap") == 0).alias("same_day"), F.min("gap").alias("nearest_gap"))
    daily = disclosures.groupBy(KEY, F.col("published_date").alias("day")).agg(F.count("*").alias("n"))
    stream = daily.withColumn("_asks", F.lit(0)).unionByName(events.select(KEY, F.col("event_date").alias("day")).distinct().withColumns({"n": F.lit(0).cast("bigint"), "_asks": F.lit(1)}))
    everything, upto = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy("day", "_asks")
    later = stream.withColumn("future_excluded", F.sum("n").over(everything) - F.sum("n").over(upto)).where("_asks = 1").select(KEY, F.col("day").alias("event_date"), "future_excluded")
    summary = later.join(matched, [KEY, "event_date"], "left").withColumns({"matched": F.coalesce("matched", F.lit(0)), "same_day": F.coalesce("same_day", F.lit(0))})
    status = F.when(F.col("same_day") > 0, "same_day").when(F.col("matched") > 0, "before").otherwise("none")
    return items.where(F.col("place") <= top), summary.withColumn("status", status)


def _window_metrics(closes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Volatility and deepest fall of the windows of size closes that end at these places; nan where there is none."""
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size, np.nan), closes]), size)
    volatility, fall = np.full(len(ends), np.nan), np.full(len(ends), np.nan)
    for at in range(0, len(ends), 1024):  # a bounded matrix of windows
        own = windows[ends[at : at + 1024] + 1]
        fall[at : at + 1024] = np.fmin.reduce(own / np.fmax.accumulate(own, axis=1) - 1, axis=1)
        change = own[:, 1:] / own[:, :-1] - 1
        known = (~np.isnan(change)).sum(1)
        off = change - (np.nansum(change, axis=1) / np.maximum(known, 1))[:, None]
        variance = np.nansum(off * off, axis=1) / np.maximum(known - 1, 1)
        volatility[at : at + 1024] = np.where(known >= 2, np.sqrt(variance) * np.sqrt(250.0), np.nan)
    return volatility, fall


def historical_snapshot(requests: DataFrame, bars: DataFrame, size: int = 251) -> DataFrame:
    """WN11: metrics of the last `size` sessions up to each requested date; volatility and drawdown stay inside them.

    Bars and requests of an instrument meet in one task, at most one of each a day; numpy looks back
    from each request's session, so rows are never multiplied by the window's length and
    only bars and requests are shuffled.
    """
    steps = (20, 60, size - 1)
    numbers = ["close", *(f"return_{k}" for k in steps), "volatility", "max_drawdown"]
    schema = StructType([*requests.select(KEY, "as_of").schema.fields, *StructType.fromDDL(f"effective date, {', '.join(f'{n} double' for n in numbers)}, sessions bigint").fields])

    def look_back(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.sort_by("trade_date")
        days = own.column("trade_date").to_numpy().astype("datetime64[D]")
        closes = own.column("close").to_numpy().astype(np.float64)
        wanted = np.unique(asked.column("as_of").to_numpy().astype("datetime64[D]"))
        last = np.searchsorted(days, wanted, "right") - 1
        wanted, last = wanted[last >= 0], last[last >= 0]
        ends, place = np.unique(last, return_inverse=True)
        volatility, fall = _window_metrics(closes, ends, size)
        past = [np.where(last >= k, closes[last] / closes[np.maximum(last - k, 0)] - 1, np.nan) for k in steps]
        keys = pa.repeat(asked.column(KEY)[0], len(last)) if len(last) else asked.column(KEY).slice(0, 0).combine_chunks()
        made = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (closes[last], *past, volatility[place], fall[place])]
        return pa.Table.from_arrays([keys, pa.array(wanted), pa.array(days[last]), *made, pa.array(np.minimum(last + 1, size))], names=schema.names)

    held = bars.where("trade_date is not null").select(KEY, "trade_date", F.col("close").cast("double").alias("close"))
    return held.groupBy(KEY).cogroup(requests.where(f"as_of is not null and {KEY} is not null").select(KEY, "as_of").groupBy(KEY)).applyInArrow(look_back, schema)


def later_outcomes(bars: DataFrame, horizons: tuple[int, ...] = (20, 60, 120), parts: int | None = None) -> DataFrame:
    """WN12: for every session and horizon the later return, largest gain and deepest fall from a peak since; kept apart from features.

    A path's peak, low and deepest fall merge: the fall of two stretches in a row is the
    deepest of either's and of the later low under the earlier peak. Sessions are cut into
    blocks of one path's length; running values from the block's begin and towards its end
    make any path from at most two stretches, so a row costs the same at every horizon.
    All windows sort their task's rows at once, so parts, the number of tasks, should grow with the bars.
    """
    rows = bars.select(KEY, "trade_date", "close")
    rows = rows if parts is None else rows.repartition(parts, KEY)
    rows = rows.withColumn("_session", F.row_number().over(Window.partitionBy(KEY).orderBy("trade_date")))
    for k in horizons:
        rows = rows.withColumn(f"_block_{k}", F.floor((F.col("_session") - 1) / (k + 1)))
        ahead, back = (Window.partitionBy(KEY, f"_block_{k}").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_session"), F.desc("_session")))
        # from the block's begin up to here, and from here to its end
        rows = rows.withColumns({f"_high_{k}": F.max("close").over(ahead), f"_low_{k}": F.min("close").over(ahead)}).withColumn(f"_fall_{k}", F.min(F.col("close") / F.col(f"_high_{k}") - 1).over(ahead))
        rows = rows.withColumns({f"_peak_{k}": F.max("close").over(back), f"_floor_{k}": F.min("close").over(back)}).withColumn(f"_drop_{k}", F.min(F.col(f"_floor_{k}") / F.col("close") - 1).over(back))
    session = Window.partitionBy(KEY).orderBy("_session")
    made = {}
    for k in horizons:
        there = lambda c, k=k: F.lead(c, k).over(session)
        full, one = there("trade_date"), there(f"_block_{k}") == F.col(f"_block_{k}")
        fall = F.when(one, F.col(f"_drop_{k}")).otherwise(F.least(F.col(f"_drop_{k}"), there(f"_fall_{k}"), there(f"_low_{k}") / F.col(f"_peak_{k}") - 1))
        made |= {
            f"date_{k}": full, f"return_{k}": there("close") / F.col("close") - 1, f"gain_{k}": F.when(full.isNotNull(), F.greatest(F.col(f"_peak_{k}"), there(f"_high_{k}")) / F.col("close") - 1),
            f"fall_{k}": F.when(full.isNotNull(), fall), f"status_{k}": F.when(full.isNotNull(), "ok").otherwise("insufficient_future_data"),
        }
    return rows.select(KEY, "trade_date", *(c.alias(n) for n, c in made.items()))
