"""Behaviour metrics of players: speed, distances to others and to cover, support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import asof_next, over, whole


def speed(pat: DataFrame, most: Column, keys: Sequence[str] = ("round_id", "player"), order: Sequence[str] = ("gt", "tick_id")) -> DataFrame:
    """+ speed (distance to the row before), scaled (over the most possible, at most 1)."""
    w = over(keys, order)
    d = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return pat.withColumn("speed", d).withColumn("scaled", F.least(F.lit(1.0), F.coalesce(F.try_divide("speed", most), F.lit(1.0))))


def speed_share(rows: DataFrame, high: float = 0.98, low: float = 0.02, keys: Sequence[str] = ("round_id", "team")) -> DataFrame:
    """Shares of rows at full speed and at a standstill."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy(*keys).agg(share(F.col("scaled") >= high).alias("full"), share(F.col("scaled") <= low).alias("still"))


def other_distance(pat_areas: DataFrame, dist: DataFrame, keys: Sequence[str], mates: bool) -> DataFrame:
    """Per key and player the least path distance to a team mate (or enemy) of the same key; null when there is none
    or no path. pat_areas: keys, player, team, area; one row a key and player."""
    a = pat_areas.select(*keys, "player", "team", F.col("area").alias("src"))
    b = pat_areas.select(*keys, F.col("player").alias("_p"), F.col("team").alias("_t"), F.col("area").alias("dst"))
    same = F.col("team") == F.col("_t")
    pairs = a.join(b, list(keys)).where((F.col("player") != F.col("_p")) & (same if mates else ~same)).join(dist, ["src", "dst"])
    best = pairs.groupBy(*keys, "player").agg(F.min("dist").alias("distance"))
    return pat_areas.select(*keys, "player").distinct().join(best, [*keys, "player"], "left")


def delta_first(df: DataFrame, column: str, keys: Sequence[str] = ("round_id", "player"), order: Sequence[str] = ("gt", "tick_id")) -> DataFrame:
    """+ delta: change since the key's first value."""
    return df.withColumn("delta", F.col(column) - F.first(column, True).over(over(keys, order)))


def cover_distance(pat_areas: DataFrame, visible: DataFrame, areas: DataFrame, dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and player the least path distance to an area that no enemy of the key sees."""
    at = pat_areas.select(*keys, "player", "team", "area").distinct()
    enemy = at.select(*keys, (5 - F.col("team")).alias("team"), F.col("area").alias("src")).distinct().join(visible.select("src", "dst"), "src").select(*keys, "team", "dst").distinct()
    reach = at.withColumnRenamed("area", "src").join(dist, "src").join(areas.select(F.col("area").alias("dst")), "dst")
    hidden = reach.join(enemy, [*keys, "team", "dst"], "left_anti")
    return hidden.groupBy(*keys, "player").agg(F.min("dist").alias("cover"))


def goal_distance(pat_areas: DataFrame, goals: DataFrame, dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """+ to_goal: path distance to the key's goal area. goals: round_id, goal."""
    far = dist.select(F.col("src").alias("area"), F.col("dst").alias("goal"), F.col("dist").alias("to_goal"))
    return pat_areas.join(goals, list(keys)).join(far, ["area", "goal"], "left")


def support_time(starts: DataFrame, sees: DataFrame, keys: Sequence[str] = ("round_id", "team"), clock: str = "gt") -> DataFrame:
    """From a player's shot until another one of the keys (a mate) sees an enemy: keys, player, start, seconds. Shots
    before the support came count once (the first); those with none are left out. starts, sees: keys, player, clock.
    Each sight is dealt to the other players of its keys, so the one looked for is the next row of the player's own."""
    players = starts.select(*keys, "player").distinct()
    by = sees.select(*keys, clock, F.col("player").alias("who")).join(players, list(keys)).where("who <> player")
    opened = asof_next(starts.select(*keys, "player", clock), by.withColumn("at", F.col(clock)), [*keys, "player"], clock, ["at"]).where("next_at IS NOT NULL")
    return opened.groupBy(*keys, "player", "next_at").agg(F.min(clock).alias("start")).withColumn("seconds", F.col("next_at") - F.col("start")).drop("next_at")


def collect_metrics(tables: Sequence[DataFrame], rounds: DataFrame, key: str = "round_id") -> DataFrame:
    from .joins import concat, semi

    return semi(concat(tables), rounds, [key])


def baiters(kills: DataFrame, pat: DataFrame, seconds: int, reach: float, width: int | None = None) -> DataFrame:
    """Kills with the mates of the victim that were within reach of it in the seconds before: tick_id, player.
    kills: tick_id, round_id, gt, victim, team (the victim's), x, y."""
    from .joins import band_join

    k = kills.select("tick_id", "round_id", F.col("gt").alias("at"), "victim", "team", F.col("x").alias("kx"), F.col("y").alias("ky"))
    p = pat.where("alive").select("round_id", "team", "player", F.col("gt").alias("state"), "x", "y")
    near = band_join(k, p, "at", "state", seconds, 0, ["round_id", "team"], width)
    return near.where((F.col("player") != F.col("victim")) & (F.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky")) <= reach)).select("tick_id", "player").distinct()


def share_of_group(df: DataFrame, flag: Column, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("share", F.avg(F.when(flag, 1.0).otherwise(0.0)).over(Window.partitionBy(*keys)))


def first_last(df: DataFrame, column: str, keys: Sequence[str], order: str) -> DataFrame:
    w = whole(keys)
    return df.withColumns({"first": F.min_by(column, order).over(w), "last": F.max_by(column, order).over(w)})
