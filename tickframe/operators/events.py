"""Events out of tick rows: engagements, spans outside them, states of grenades and flashes, runs of labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import band_join, stab_join
from .windows import asof_prev, carry, islands, over, runs, so_far, whole


def engagements(hurt: DataFrame, bounds: DataFrame, pre: int, post: int, clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """Hits per attacker and victim of a round, merged while the gap is at most pre + post; the span reaches pre
    before the first and post after the last, within the round. bounds: round_id, start_gt, end_gt."""
    keys = ["round_id", "attacker", "victim"]
    gap = F.col(clock) - F.lag(clock).over(over(keys, [clock, tick])) > pre + post
    marked = islands(hurt.dropDuplicates([*keys, tick]), keys, [clock, tick], gap)
    spans = marked.groupBy(*keys, "island").agg(F.min(clock).alias("_a"), F.max(clock).alias("_b"), F.count(F.lit(1)).alias("hits"), F.sort_array(F.collect_list(tick)).alias("hurt_ids")).join(bounds, "round_id")
    return spans.select(*keys, F.greatest(F.col("_a") - pre, "start_gt").alias("start"), F.least(F.col("_b") + post, "end_gt").alias("end"), "hits", "hurt_ids")


def engagement_match(eng: DataFrame, nearest: DataFrame, targets: Sequence[str], width: int, clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """round_id, attacker, victim, start, end and share_<t> for each of the targets: of the attacker's rows within an
    engagement the share whose nearest enemy (now, or at a horizon) is the victim. Where engagements of an attacker overlap,
    a row counts as a hit for the one that began last only (ties: the larger victim), but in the length of each. nearest:
    round_id, player, tick, clock and the targets."""
    own = ["round_id", "attacker", "victim", "start", "end"]
    rows = nearest.select("round_id", F.col("player").alias("attacker"), clock, tick, *targets)
    inside = stab_join(rows, eng.select(*own), clock, keys=["round_id", "attacker"], width=width)
    latest = F.row_number().over(Window.partitionBy("round_id", "attacker", tick).orderBy(F.desc("start"), F.desc("victim"), F.desc("end"))) == 1
    marked = inside.withColumn("_latest", latest)
    return marked.groupBy(*own).agg(*[F.avg(F.when(F.col("_latest") & (F.col(t) == F.col("victim")), 1.0).otherwise(0.0)).alias(f"share_{t}") for t in targets])


def non_engagement(pat: DataFrame, eng: DataFrame, width: int, clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """Spans of a living player's rows outside all of its engagements: round_id, player, start, end, n."""
    both = eng.select("round_id", F.explode(F.array("attacker", "victim")).alias("player"), "start", "end")
    busy = stab_join(pat.select("round_id", "player", clock, tick), both, clock, keys=["round_id", "player"], width=width).select(tick).distinct().withColumn("_busy", F.lit(1))
    flagged = pat.join(busy, tick, "left").withColumn("free", F.col("_busy").isNull() & F.col("alive"))
    spans = runs(flagged, ["round_id", "player"], [clock, tick], "free")
    return spans.where("free").select("round_id", "player", "start", "end", F.col("length").alias("n"))


def trajectory_segments(rows: DataFrame, seconds: int, keys: Sequence[str], clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """Segments that restart at the first row more than `seconds` after their start; keys, segment, start, end. The
    restart hangs on the row before, so a key's rows are walked in order, in batches."""
    names = [*keys, clock, tick]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begin, number = None, None, 0
        for batch in batches:
            out = []
            for *k, at, _ in batch.itertuples(index=False):
                if k != key:
                    key, begin, number = k, at, 0
                elif at - begin > seconds:
                    begin, number = at, number + 1
                out.append(number)
            yield batch.assign(segment=out)

    few = rows.select(*names)
    schema = T.StructType([*few.schema, T.StructField("segment", T.LongType())])
    cut = few.repartition(*keys).sortWithinPartitions(*names).mapInPandas(walk, schema)
    return cut.groupBy(*keys, "segment").agg(F.min(clock).alias("start"), F.max(clock).alias("end"), F.count(F.lit(1)).alias("n"))


def segment_buckets(rows: DataFrame, seconds: int, keys: Sequence[str], clock: str = "gt") -> DataFrame:
    """Fixed segments counted from the key's first row."""
    at = F.floor((F.col(clock) - F.min(clock).over(whole(keys))) / seconds)
    return rows.withColumn("segment", at).groupBy(*keys, "segment").agg(F.min(clock).alias("start"), F.max(clock).alias("end"), F.count(F.lit(1)).alias("n"))


def alive_counts_by_tick(pat: DataFrame, every: int = 1) -> DataFrame:
    """Per round and clock bucket the players of either team with a living row."""
    at = F.floor(F.col("gt") / every).alias("at")
    alive = lambda team: F.count_distinct(F.when(F.col("alive") & (F.col("team") == team), F.col("player")))
    return pat.groupBy("round_id", at).agg(alive(3).alias("ct_alive"), alive(2).alias("t_alive"))


def deaths_at(deaths: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """Per round: deaths within `width` ticks of a mark, and others. marks: round_id, tick_id."""
    m = marks.select("round_id", F.col("tick_id").alias("mark"))
    near = band_join(m, deaths.select("round_id", "tick_id"), "mark", "tick_id", width, width, ["round_id"]).select("tick_id").distinct().withColumn("_near", F.lit(1))
    return deaths.join(near, "tick_id", "left").groupBy("round_id").agg(F.count("_near").alias("at_mark"), F.count_if(F.col("_near").isNull()).alias("other"))


def smoke_state(grenades: DataFrame, positions: DataFrame, every: int = 1) -> DataFrame:
    """A row for every tick (or every so many) of a grenade's life: grenade, tick, state (thrown, and active from its active
    tick on; one without stays thrown) and its position at the last step so far. grenades: grenade, start, active, end;
    positions: grenade, tick, x, y."""
    ticks = grenades.select("grenade", "active", F.explode(F.sequence("start", "end", F.lit(every).cast("long"))).alias("tick"))
    state = F.when(F.col("tick") >= F.col("active"), "active").otherwise("thrown").alias("state")
    return asof_prev(ticks, positions, ["grenade"], "tick", ["x", "y"]).select("grenade", "tick", state, F.col("prev_x").alias("x"), F.col("prev_y").alias("y"))


def flash_state(pat: DataFrame, flashed: DataFrame, full: float, scale: float, clock: str = "gt") -> DataFrame:
    """+ amount: what is left of the last flash (1 down to 0 over `full`), over scale. flashed: player, round_id, clock."""
    e = flashed.select("round_id", "player", clock, F.col(clock).alias("at"))
    seen = asof_prev(pat, e, ["round_id", "player"], clock, ["at"])
    left = 1 - (F.col(clock) - F.col("prev_at")) / F.lit(full)
    return seen.withColumn("amount", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)), F.lit(0.0)) / F.lit(scale)).drop("prev_at")


def fire_history(
    pat: DataFrame, fired: Column, hits: DataFrame, keys: Sequence[str] = ("round_id", "player"), order: Sequence[str] = ("gt", "tick_id"), clock: str = "gt", tick: str = "tick_id", player: str = "player", floor: float = 0.5
) -> DataFrame:
    """+ since_fire and since_hold (null before the first), shots, holding, hit and victims.

    pat has recoil and reloading. The attack is held where, not reloading and over the floor, recoil rises, or stays as it
    is and was held the row before; a key's first row never is. hits (tick, attacker, victim): victims are those that the
    player hits on the tick of the row, each once and sorted, an empty list for none."""
    w, past = over(keys, order), so_far(keys, order)
    since = lambda flag: F.col(clock) - F.last(F.when(flag, F.col(clock)), True).over(past)
    before = F.lag("recoil").over(w)
    able = ~F.coalesce("reloading", F.lit(False)) & (F.col("recoil") > floor)
    out = pat.withColumns({"since_fire": since(fired), "shots": F.count(F.when(fired, 1)).over(past), "_rises": able & (F.col("recoil") > before), "_stays": able & (F.col("recoil") == before)})
    out = carry(out, keys, order, F.col("_rises"), F.col("_stays"), "holding").drop("_rises", "_stays")
    out = out.withColumn("since_hold", since(F.col("holding")))
    struck = hits.where("attacker IS NOT NULL").groupBy(F.col("tick_id").alias("_t"), F.col("attacker").alias("_a")).agg(F.sort_array(F.collect_set("victim")).alias("victims"))
    joined = out.join(struck, (F.col(tick) == F.col("_t")) & (F.col(player) == F.col("_a")), "left").drop("_t", "_a")
    none = F.array().cast(struck.schema["victims"].dataType)
    return joined.withColumns({"hit": F.col("victims").isNotNull(), "victims": F.coalesce("victims", none)})


def argmax_runs(scores: DataFrame, classes: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Runs of the class with the highest score (the first of equals): keys, best, start, end, length."""
    best = F.greatest(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("i")) for i, c in enumerate(classes)])
    named = scores.withColumn("best", F.element_at(F.array(*map(F.lit, classes)), 1 - best["i"]))
    return runs(named, keys, order, "best")


def event_detect(df: DataFrame, since: str, keys: Sequence[str], order: Sequence[str], alive: str = "alive", small: float | None = None, inside: Column | None = None) -> DataFrame:
    """+ new_fire: time since fire did not grow (and is under `small`, where given); dies: alive now and not in the next
    row; in_area, with `inside` (a key area's condition, of any of several areas)."""
    w = over(keys, order)
    fresh = F.coalesce(F.col(since) <= F.lag(since).over(w), F.lit(False))
    flags = {"new_fire": fresh if small is None else fresh & (F.col(since) < small), "dies": F.col(alive) & ~F.coalesce(F.lead(alive).over(w), F.lit(True))}
    return df.withColumns(flags if inside is None else flags | {"in_area": F.coalesce(inside, F.lit(False))})


def split_discontinuity(df: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Among a key's rows with the flag, the indices (from 0) at which a new run begins."""
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    w = over(keys, order)
    fresh = F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))
    counted = marked.withColumns({"_new": fresh, "index": F.count(F.when(F.col("_f"), 1)).over(so_far(keys, order)) - 1})
    return counted.where("_new").select(*keys, "index")


def c4_approach(rows: DataFrame, distance: str, horizon: int, delta: float, keys: Sequence[str], clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """+ approaches: the distance at the last row within the horizon is smaller by more than delta. Of rows at one clock the
    last is that of the largest tick; rows without a distance are passed over."""
    w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(Window.unboundedPreceding, horizon)  # the row itself is in it, so the last one is never earlier
    last = F.max(F.when(F.col(distance).isNotNull(), F.struct(clock, tick, F.col(distance).alias("_far")))).over(w)
    return rows.withColumn("approaches", last["_far"] < F.col(distance) - delta)


def drop_partial(labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each label goes where one of a later horizon is missing. columns: nearest horizon first."""
    out, there = {}, F.lit(True)
    for c in reversed(columns):
        out[c] = F.when(there, F.col(c))
        there = there & F.col(c).isNotNull()
    return labels.withColumns(out)


def test_outcome(df: DataFrame, test: str, ok: str, round_id: str = "round_id") -> DataFrame:
    """Per test and outcome: rounds, and the test's share of rounds with it."""
    rounds = df.select(test, ok, round_id).distinct().groupBy(test, ok).agg(F.count(F.lit(1)).alias("rounds"))
    return rounds.withColumn("share", F.col("rounds") / F.sum("rounds").over(Window.partitionBy(test)))


def teleport_reset(pat: DataFrame, jump: float, still: Column, after: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """+ reset: a jump at no speed here or within the `after` rows before."""
    w = over(keys, order)
    jumped = (F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > jump) & still
    marked = pat.withColumn("_j", F.coalesce(jumped, F.lit(False)))
    return marked.withColumn("reset", F.max("_j").over(w.rowsBetween(-after, 0))).drop("_j")


def moment_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, standard deviation, median and quartile range; infinite values count as missing."""
    from .distributions import percentiles

    finite = df.select(*keys, *[F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) for c in columns])
    out = finite.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    for c in columns:
        found = percentiles(finite, c, [0.25, 0.5, 0.75], keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.get("p", 1).alias(f"{c}_median"), (F.get("p", 2) - F.get("p", 0)).alias(f"{c}_iqr"))
        out = out.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    return out


def raw_stats(pat: DataFrame) -> DataFrame:
    """One row about the whole: rounds, ticks, players, shots, kills, hours."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    hours = (F.max("gt") - F.min("gt")) / 3600.0
    return pat.agg(F.count_distinct("round_id").alias("rounds"), F.count(F.lit(1)).alias("ticks"), F.count_distinct("player").alias("players"), kind("click").alias("shots"), kind("purchase").alias("kills"), hours.alias("hours"))
