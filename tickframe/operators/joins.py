"""Joins on ticks: interval stabbing and overlap by buckets, event pairs, and the set operations.

Interval joins cut the axis into buckets of a given width: an interval goes to every bucket it touches, a point to
one, so both meet in an equi-join that Spark shuffles and AQE can split. Choose the width near the usual length of
the intervals; a long interval costs one row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fk_join(fact: DataFrame, *dims: tuple[DataFrame, str]) -> DataFrame:
    """A fact table with its dimension rows; each dimension comes with the key that both share."""
    return reduce(lambda df, dim: df.join(dim[0], dim[1]), dims, fact)


def range_index(parent: DataFrame, child: DataFrame, pk: str, fk: str, child_id: str = "id") -> DataFrame:
    """Smallest and largest child id of every parent, null where it has none."""
    bounds = child.groupBy(F.col(fk).alias(pk)).agg(F.min(child_id).alias("min_id"), F.max(child_id).alias("max_id"))
    return parent.select(pk).join(bounds, pk, "left")


def interval_build(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """+ start, end: the smallest and largest of several tick columns that are there (0 and more)."""
    valid = [F.when(F.col(c) >= 0, F.col(c)) for c in columns]
    return df.withColumns({"start": F.least(*valid), "end": F.greatest(*valid)})


def _buckets(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    spread = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    return df.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(spread))


def stab_join(points: DataFrame, intervals: DataFrame, point: str, start: str = "start", end: str = "end", keys: Sequence[str] = (), width: int = 1000) -> DataFrame:
    """Pairs of a point and an interval that covers it, ends included."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    return p.join(_buckets(intervals, start, end, width, "_b"), [*keys, "_b"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_b")


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), closed: bool = True, width: int = 1000, names: tuple[str, str, str, str] = ("a_start", "a_end", "b_start", "b_end")) -> DataFrame:
    """Pairs of intervals with a common point (closed), or of half-open intervals that overlap. Each pair comes from
    the first bucket that both touch."""
    s, e, t, f = map(F.col, names)
    both = _buckets(a, names[0], names[1], width, "_b").join(_buckets(b, names[2], names[3], width, "_b"), [*keys, "_b"])
    meet = (s <= f) & (t <= e) if closed else (s < f) & (t < e)
    return both.where(meet & (F.col("_b") == F.floor(F.greatest(s, t) / width))).drop("_b")


def band_join(events: DataFrame, states: DataFrame, at: str, state: str, before: int, after: int, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Pairs with state in [at - before, at + after]."""
    spans = events.withColumns({"_lo": F.col(at) - before, "_hi": F.col(at) + after})
    return stab_join(states, spans, state, "_lo", "_hi", keys, width or max(1, before + after)).drop("_lo", "_hi")


def theta_pairs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Unordered pairs of different values of a key: keys, p1 < p2."""
    side = lambda n: df.select(*keys, F.col(value).alias(n)).distinct()
    return side("p1").join(side("p2"), list(keys)).where("p1 < p2")


def cross_event_pairs(hurt: DataFrame, keys: Sequence[str], attacker: str = "attacker") -> DataFrame:
    """Two attackers with one victim on the same keys: keys, a1 < a2."""
    return theta_pairs(hurt, keys, attacker).withColumnsRenamed({"p1": "a1", "p2": "a2"})


def next_round_join(a: DataFrame, b: DataFrame, keys: Sequence[str], round_id: str = "round_id") -> DataFrame:
    """Rows of a with rows of b of the round after, on equal keys; b's other columns come as next_<name>."""
    later = b.withColumn(round_id, F.col(round_id) - 1)
    return a.join(later.withColumnsRenamed({c: f"next_{c}" for c in later.columns if c not in (*keys, round_id)}), [*keys, round_id])


def left_event_join(states: DataFrame, events: DataFrame, roles: Sequence[str], keys: Sequence[str], player: str = "player") -> DataFrame:
    """All states, with the events in which the state's player has one of the roles: one equi-join on an exploded
    role instead of an OR."""
    named = F.explode(F.array(*[F.struct(F.col(r).alias("who"), F.lit(r).alias("role")) for r in roles]))
    by_role = events.withColumn("_r", named).select("*", F.col("_r.who").alias(player), F.col("_r.role").alias("role")).drop("_r")
    return states.join(by_role, [*keys, player], "left")


def right_range_join(spans: DataFrame, points: DataFrame, lo: str, hi: str, point: str, keys: Sequence[str], width: int) -> DataFrame:
    """All spans, each with its first point in [lo, hi] as first_<point>, null where there is none."""
    inside = stab_join(points.select(*keys, point), spans.select(*keys, lo, hi).distinct(), point, lo, hi, keys, width)
    first = inside.groupBy(*keys, lo, hi).agg(F.min(point).alias(f"first_{point}"))
    return spans.join(first, [*keys, lo, hi], "left")


def full_range_join(spans: DataFrame, points: DataFrame, lo: str, hi: str, point: str, span_id: str, point_id: str, keys: Sequence[str] = (), width: int = 1000) -> DataFrame:
    """All spans and all points, side by side where the keys are equal and the point lies in [lo, hi], else alone with nulls.

    Rows meet in buckets and leave from there: pairs, of which there may be very many, are not shuffled again. Spans whose
    next point comes after their end, and points that no span begun before reaches, are found by one sort each and put beside
    the pairs. A null key, bound or point matches nothing. Points' columns that spans also have, keys among them, come as
    point_<name>. span_id and point_id, which tell the rows of their table apart, are not needed for it. Those sorts are by
    key: without keys, each is one task."""
    from .windows import asof_next, so_far

    named = {c: f"point_{c}" for c in points.columns if c in spans.columns}
    right = points.withColumnsRenamed(named)
    at = F.col(named.get(point, point))
    equal = [F.col(k) == F.col(named[k]) for k in keys]
    met = _buckets(spans, lo, hi, width, "_b").join(right.withColumn("_pb", F.floor(at / width)), reduce(Column.__and__, equal, F.col("_b") == F.col("_pb")))
    pairs = met.where(at.between(F.col(lo), F.col(hi))).drop("_b", "_pb")

    valid = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True))
    told = points.where(valid & F.col(point).isNotNull()).select(*keys, F.col(point).alias("_at"))
    next_point = asof_next(spans.withColumn("_at", F.col(lo)), told.withColumn("_p", F.col("_at")), keys, "_at", ["_p"])
    lone_spans = next_point.where(~F.coalesce(F.col("next__p").between(F.col(lo), F.col(hi)), F.lit(False))).drop("_at", "next__p")

    begun = spans.where(valid & (F.col(lo) <= F.col(hi))).select(*keys, F.col(lo).alias("_at"), F.lit(0).alias("_kind"), F.col(hi).alias("_hi"))
    both = points.withColumns({"_at": F.col(point), "_kind": F.lit(1)}).unionByName(begun, allowMissingColumns=True)
    reached = both.withColumn("_reach", F.max("_hi").over(so_far(keys, ["_at", "_kind"])))
    lone_points = reached.where((F.col("_kind") == 1) & ~F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False))).select(*points.columns).withColumnsRenamed(named)
    return pairs.unionByName(lone_spans, allowMissingColumns=True).unionByName(lone_points, allowMissingColumns=True)


def semi(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys), list(keys), "left_semi")


def anti(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys), list(keys), "left_anti")


def quiet_rounds(rounds: DataFrame, events: DataFrame, least: int, round_id: str = "round_id", start: str = "start", end: str = "end") -> DataFrame:
    """Rounds longer than `least` in which none of the events happens."""
    return anti(rounds, events, [round_id]).where(F.col(end) - F.col(start) > least)


def with_group(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of the row's group beside the row, without a join."""
    return df.withColumns({n: a.over(Window.partitionBy(*keys)) for n, a in aggs.items()})


def union_tag(tables: dict[str, DataFrame]) -> DataFrame:
    """The distinct rows of several tables, each with its tag."""
    return reduce(DataFrame.unionByName, [df.withColumn("tag", F.lit(t)) for t, df in tables.items()]).distinct()


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def set_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return anti(a.select(*keys).distinct(), b, keys)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", slack: int = 2, last_end: bool = False) -> DataFrame:
    """Intervals of a key merged where the next begins at most slack after the end so far. last_end: end where the
    last one ends, even if an earlier one ends later."""
    from .windows import islands, over

    before = F.max(end).over(over(keys, [start, end]).rowsBetween(Window.unboundedPreceding, -1)) if not last_end else F.lag(end).over(over(keys, [start, end]))
    marked = islands(df, keys, [start, end], F.col(start) > before + slack)
    stop = F.max_by(end, F.struct(start, end)) if last_end else F.max(end)
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), stop.alias(end)).drop("island")
