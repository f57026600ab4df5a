"""Gaps and islands, offsets, and windows measured in game ticks. Every window has partition keys, and orders that
end with a unique column give the same rows each time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut


def over(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_here(keys: Sequence[str], order: Sequence[str], start: int = 0) -> WindowSpec:
    """The rows of the key from `start` rows ahead to its end. Written as what came so far from the other end, since a frame
    that ends with the key is read anew for each row: with it, `last` is the next."""
    return over(keys, [F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -start)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_new: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows that begin where is_new holds; a key's first row always begins one."""
    first = F.lag(F.lit(1)).over(over(keys, order)).isNull()
    return df.withColumn("_new", F.when(first | is_new, 1).otherwise(0)).withColumn(name, F.sum("_new").over(so_far(keys, order))).drop("_new")


def running_sum(df: DataFrame, order: Sequence[str | Column], value: Column, name: str = "before") -> DataFrame:
    """+ name: the sum of value over all rows earlier in an order without ties. Rows are dealt by ranges of the order and
    summed within each range; only the ranges' totals, a row a partition, are summed in one place."""
    earlier = Window.unboundedPreceding, -1
    dealt = cut(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))  # written, so that pieces stay as they are
    starts = dealt.groupBy("_piece").agg(F.sum(value).alias("_sum"))
    starts = starts.select(F.col("_piece").alias("_p"), F.coalesce(F.sum("_sum").over(Window.orderBy("_piece").rowsBetween(*earlier)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_piece").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    return dealt.withColumn("_in", inside).join(starts, F.col("_piece") == F.col("_p")).withColumn(name, F.col("_start") + F.col("_in")).drop("_piece", "_p", "_start", "_in")


def last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], ahead: bool = False) -> DataFrame:
    """+ each of values as it last was other than null in the row's key, this row included; ahead: as it next is.

    For few keys of many rows: rows are dealt by ranges of keys and order, so that no task holds a whole key. What a range
    knows of a key at its end, a row a range and key, is put before the rows of the key in later ranges."""
    dealt = cut(df.withColumns(values).repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))  # written, so that pieces stay as they are
    by, way = (F.min_by, F.desc) if ahead else (F.max_by, F.asc)  # ahead is so far from the other end: a frame that begins at the row is read anew for each row
    known = dealt.groupBy("_piece", *keys).agg(*[by(n, F.when(F.col(n).isNotNull(), F.struct(*order))).alias(n) for n in values])
    earlier = over(keys, [way("_piece")]).rowsBetween(Window.unboundedPreceding, -1)
    brought = known.select("_piece", *keys, *[F.last(n, True).over(earlier).alias(n) for n in values], F.lit(1 if ahead else -1).alias("_edge"))
    both = dealt.withColumn("_edge", F.lit(0)).unionByName(brought, allowMissingColumns=True)
    inside = so_far(["_piece", *keys], [way(c) for c in ("_edge", *order)])
    return both.withColumns({n: F.last(n, True).over(inside) for n in values}).where("_edge = 0").drop("_piece", "_edge")


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], on: Column, hold: Column, name: str) -> DataFrame:
    """+ name: true where `on` holds, what it was the row before where only `hold` does, else false; false before a key's
    first row. A recursion on the row before, taken apart: only rows that don't hold decide, and the last of them counts."""
    decided = F.when(F.coalesce(on, F.lit(False)), True).when(~F.coalesce(hold, F.lit(False)), False)
    return df.withColumn("_decided", decided).withColumn(name, F.coalesce(F.last("_decided", True).over(so_far(keys, order)), F.lit(False))).drop("_decided")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal values: keys, value, first and last order value, and length."""
    w = over(keys, order)
    marked = islands(df, keys, order, ~F.col(value).eqNullSafe(F.lag(value).over(w)))
    at = order[0]
    return marked.groupBy(*keys, "island", value).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("length")).drop("island")


def lookback(ticks: DataFrame, n: int, keys: Sequence[str] = ("round_id",), tick: str = "tick_id", clock: str = "gt") -> DataFrame:
    """+ other: the latest tick at least n clock units earlier, else the first of the round."""
    w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(Window.unboundedPreceding, -n)
    return ticks.withColumn("other", F.coalesce(F.max(tick).over(w), F.min(tick).over(whole(keys))))


def lookforward(ticks: DataFrame, n: int, keys: Sequence[str] = ("round_id",), tick: str = "tick_id", clock: str = "gt") -> DataFrame:
    """+ other: the earliest tick at least n clock units later, else the last of the round."""
    w = Window.partitionBy(*keys).orderBy(F.desc(clock)).rangeBetween(Window.unboundedPreceding, -n)
    return ticks.withColumn("other", F.coalesce(F.min(tick).over(w), F.max(tick).over(whole(keys))))


def rows_offset(df: DataFrame, columns: Sequence[str], offsets: Sequence[int], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Past and future values by row offset, named `x (t-3)`, `x (t+2)`."""
    w = over(keys, order)
    named = lambda c, o: f"{c} (t{o:+d})" if o else f"{c} (t)"
    return df.withColumns({named(c, o): F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w) for c in columns for o in offsets})


def cum_flag(df: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str], name: str = "so_far") -> DataFrame:
    """Once true, true to the end of the key."""
    return df.withColumn(name, F.max(flag).over(so_far(keys, order)))


def time_window(df: DataFrame, low: int, high: int, keys: Sequence[str] = ("round_id",), clock: str = "gt") -> DataFrame:
    """Rows between low and high clock units after the key's first row."""
    return df.withColumn("_0", F.col(clock) - F.min(clock).over(whole(keys))).where(F.col("_0").between(low, high)).drop("_0")


def time_to_event(df: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str], clock: str = "gt") -> DataFrame:
    """+ to_event: clock units to the next row with the flag, this one included; rows with none ahead go."""
    return df.withColumn("to_event", F.last(F.when(flag, F.col(clock)), True).over(from_here(keys, order)) - F.col(clock)).where("to_event IS NOT NULL")


def asof_prev(rows: DataFrame, events: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], few_keys: bool = False) -> DataFrame:
    """For each row the columns of the last event of its key at or before it (null where there is none). Rows and
    events are put together and sorted once, so no pairs are made; of events at one place the largest values win. A key is
    one task; few_keys deals it by ranges, and then null keys and places meet no event, as in a join."""
    return _asof(rows, events, keys, order, columns, True, few_keys)


def asof_next(rows: DataFrame, events: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], few_keys: bool = False) -> DataFrame:
    """For each row the columns of the first event of its key at or after it."""
    return _asof(rows, events, keys, order, columns, False, few_keys)


def _asof(rows, events, keys, order, columns, back, few_keys):
    names = [f"next_{c}" if not back else f"prev_{c}" for c in columns]
    mark = F.struct(*columns).alias("_event")
    if few_keys:
        events = events.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, order)))
    both = rows.withColumn("_kind", F.lit(1 if back else 0)).unionByName(events.groupBy(*keys, order).agg(F.max(mark).alias("_event")).withColumn("_kind", F.lit(0 if back else 1)), allowMissingColumns=True)
    if few_keys:
        found = last_seen(both, keys, [order, "_kind"], {"_event": F.col("_event")}, not back).withColumn("_found", F.when(F.col(order).isNotNull(), F.col("_event")))
    else:
        found = both.withColumn("_found", F.last("_event", True).over((so_far if back else from_here)(keys, [order, "_kind"])))
    out = found.where(F.col("_kind") == (1 if back else 0))
    return out.withColumns({n: F.col(f"_found.{c}") for n, c in zip(names, columns)}).drop("_kind", "_event", "_found")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key."""
    by = [F.col(o).desc() if last else F.col(o) for o in order]
    return df.withColumn("_n", F.row_number().over(over(keys, by))).where("_n = 1").drop("_n")


def seconds_around(rows: DataFrame, events: DataFrame, keys: Sequence[str], clock: str = "gt") -> DataFrame:
    """+ before, after: clock units since the last event and to the next one, -1 if there is none."""
    e = events.select(*keys, clock).withColumn("at", F.col(clock))
    both = asof_next(asof_prev(rows, e, keys, clock, ["at"]), e, keys, clock, ["at"])
    return both.withColumns({"before": F.coalesce(F.col(clock) - F.col("prev_at"), F.lit(-1)), "after": F.coalesce(F.col("next_at") - F.col(clock), F.lit(-1))}).drop("prev_at", "next_at")


def rolling_share(df: DataFrame, flag: Column, span: int, keys: Sequence[str], clock: str = "gt", name: str = "share") -> DataFrame:
    """The share of rows in the next span clock units, this one included, in which the flag holds."""
    w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(0, span)
    return df.withColumn(name, F.avg(F.when(flag, 1.0).otherwise(0.0)).over(w))


def rolling_mode(df: DataFrame, value: str, classes: Sequence, span: int, keys: Sequence[str], clock: str = "gt", name: str = "mode") -> DataFrame:
    """The most frequent of the given classes over the next span; the first of equals in the order given."""
    w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(0, span)
    counts = [F.count(F.when(F.col(value) == c, 1)).over(w) for c in classes]
    ranked = F.greatest(*[F.struct(n.alias("n"), F.lit(-i).alias("i")) for i, n in enumerate(counts)])
    return df.withColumn(name, F.when(ranked["n"] > 0, F.element_at(F.array(*map(F.lit, classes)), 1 - ranked["i"])))


def dominance(times: np.ndarray, values: np.ndarray, span: float, threshold: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of time: how many rows of the next span, this one included, there are, how many of them are lower
    than the row's value less the threshold, and how many higher than it and the threshold.

    Rows go to blocks, each with its values sorted. A window's whole blocks are counted by binary search in them, its two
    ends by a look at each row: no window's rows are put together."""
    n = len(times)
    start, end = np.searchsorted(times, times, "left"), np.searchsorted(times, times + span, "right")
    low, high = values - threshold, values + threshold
    below, above = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first, last = -(-start // block), end // block  # whole blocks: first <= b < last
    for b in range(n // block):
        asks = np.flatnonzero((first <= b) & (b < last))
        if len(asks):
            own = np.sort(values[b * block : (b + 1) * block])
            below[asks] += np.searchsorted(own, low[asks], "left")
            above[asks] += block - np.searchsorted(own, high[asks], "right")
    split = first < last
    for lo, hi in ((start, np.where(split, first * block, end)), (np.where(split, last * block, end), end)):
        for k in range(int((hi - lo).max(initial=0))):
            asks = np.flatnonzero(lo + k < hi)
            there = values[lo[asks] + k]
            below[asks] += there < low[asks]
            above[asks] += there > high[asks]
    return end - start, below, above


def rolling_trend(df: DataFrame, value: str, span: int, threshold: float, keys: Sequence[str], clock: str = "gt") -> DataFrame:
    """Shares of the rows in the next span whose value is lower, alike or higher than this row's, beyond a threshold: falls,
    stays, rises. Null values are left out of the counts; a row with a null value or clock has null shares. A key's rows
    (a round's) are counted in one task, as arrays of numbers."""
    names = ("falls", "stays", "rises")
    shape = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def trend(table: pa.Table) -> pa.Table:
        clocks, values = (table.column(c).combine_chunks().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in (clock, value))
        there = np.flatnonzero(~np.isnan(clocks) & ~np.isnan(values))
        there = there[np.argsort(clocks[there], kind="stable")]
        shares = {c: np.full(len(clocks), np.nan) for c in names}
        if len(there):
            n, below, above = dominance(clocks[there], values[there], span, threshold)
            for c, count in zip(names, (below, n - below - above, above)):
                shares[c][there] = count / n
        for c in names:
            table = table.append_column(c, pa.array(shares[c], pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*keys).applyInArrow(trend, shape)


def tick_fraction(df: DataFrame, keys: Sequence[str] = ("round_id",), clock: str = "gt") -> DataFrame:
    """+ fraction: how far through its round a row lies, 0 to 1."""
    w = whole(keys)
    return df.withColumn("fraction", F.coalesce(F.try_divide(F.col(clock) - F.min(clock).over(w), F.max(clock).over(w) - F.min(clock).over(w)), F.lit(0.0)))


def since_flags(df: DataFrame, flags: dict[str, Column], keys: Sequence[str], order: Sequence[str], clock: str = "gt", few_keys: bool = False) -> DataFrame:
    """+ since_<name>: clock units since the flag last held (0 where it holds), null before it ever did. A key is one task;
    few_keys deals it by ranges."""
    at = {f"since_{n}": F.when(f, F.col(clock)) for n, f in flags.items()}
    seen = last_seen(df, keys, order, at) if few_keys else df.withColumns({n: F.last(f, True).over(so_far(keys, order)) for n, f in at.items()})
    return seen.withColumns({n: F.col(clock) - F.col(n) for n in at})


def until_next(df: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str], tick: str = "tick_id") -> DataFrame:
    """+ next_tick: the tick of the next row with the flag, strictly ahead; null if none."""
    return df.withColumn("next_tick", F.last(F.when(flag, F.col(tick)), True).over(from_here(keys, order, 1)))


def contiguous_history(df: DataFrame, keys: Sequence[str], order: str, step: int) -> DataFrame:
    """+ oldest: the first order value of the row's run of values at most step apart."""
    marked = islands(df, keys, [order], F.col(order) - F.lag(order).over(over(keys, [order])) > step)
    return marked.withColumn("oldest", F.min(order).over(whole([*keys, "island"]))).drop("island")


def rolling_fill(df: DataFrame, grid: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Values on every point of a grid: the last seen at or before it, and before the first one the first to come."""
    filled = asof_prev(grid, df, keys, order, columns)
    ahead = from_here(keys, [order])
    return filled.withColumns({c: F.coalesce(f"prev_{c}", F.last(f"prev_{c}", True).over(ahead)) for c in columns}).drop(*[f"prev_{c}" for c in columns])


def future_label(df: DataFrame, value: str, horizon: int, keys: Sequence[str], clock: str = "gt", least: int = 1) -> DataFrame:
    """+ label: the value of the last row within the horizon, null if that row is less than `least` ahead."""
    w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(Window.unboundedPreceding, horizon)  # only grows; a frame of both bounds is read anew for each row
    last = F.max(F.struct(F.col(clock).alias("at"), F.col(value).alias("value"))).over(w)
    return df.withColumn("_last", last).withColumn("label", F.when(F.col("_last.at") >= F.col(clock) + least, F.col("_last.value"))).drop("_last")


def event_contiguous(df: DataFrame, flag: Column, k: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stretches in which the flag holds within k rows either way: keys, start, end, length."""
    near = F.max(F.when(flag, 1).otherwise(0)).over(over(keys, order).rowsBetween(-k, k))
    return runs(df.withColumn("_near", near), keys, order, "_near").where("_near = 1").drop("_near")


def cum_sample_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(key, is_train): keys in hash order train until their rows reach the share of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    earlier = running_sum(counts.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))), ["_h", key], F.col("n"))
    return earlier.select(key, (F.col("before") < share * df.count()).alias("is_train"))
