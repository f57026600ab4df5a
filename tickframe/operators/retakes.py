"""Rounds around a plant: the state when it stands, what has happened by each tick, and what either team did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import asof_prev, over, so_far

TEAMS = {"ct": 3, "t": 2}


def states_at(events: DataFrame, pat: DataFrame, columns: Sequence[str], tick: str = "tick_id", keys: Sequence[str] = ("round_id",)) -> DataFrame:
    """A row for each event and each player of its round: the event's columns, player, team, and the columns of the player's
    last row at or before the event's tick, null before the first."""
    players = pat.select(*keys, "player", "team").distinct()
    seen = asof_prev(events.join(players, list(keys)), pat.select(*keys, "player", tick, *columns), [*keys, "player"], tick, list(columns))
    return seen.withColumnsRenamed({f"prev_{c}": c for c in columns})


def with_both_teams(events: DataFrame, pat: DataFrame, tick: str = "tick_id") -> DataFrame:
    """Events (round_id, tick and a column `event` of their own) at which players of both teams are alive."""
    alive = [F.max((F.col("team") == code) & F.coalesce("alive", F.lit(False))).alias(f"_{side}") for side, code in TEAMS.items()]
    both = states_at(events.select("round_id", tick, "event"), pat, ["alive"], tick).groupBy("event").agg(*alive).where("_ct AND _t").select("event")
    return events.join(both, "event", "left_semi")


def plant_states(plants: DataFrame, defusals: DataFrame, pat: DataFrame, rounds: DataFrame, bomb: DataFrame, slots: int = 5, columns: Sequence[str] = ("x", "y", "z", "view"), tick: str = "tick_id") -> DataFrame:
    """The first successful plant of each round while both teams live: round_id, plant_id, plant_tick, end_tick, length (in
    ticks, both ends), winner, defused, bomb_x, bomb_y, bomb_z, and ct and t: arrays of `slots` places, the living by player
    number first, then empty ones (not alive, the rest null). More than `slots` living players are cut off.

    plants and defusals: round_id, tick (of their end), event (an id), ok. A round is defused if a defusal succeeds in it
    while both teams live. rounds: round_id, end, winner. bomb: tick, bomb_x, bomb_y, bomb_z."""
    planted = with_both_teams(plants.where("ok").select("round_id", tick, "event"), pat, tick)
    first = planted.groupBy("round_id").agg(F.min(F.struct(tick, "event")).alias("_f")).select("round_id", F.col(f"_f.{tick}").alias(tick), F.col("_f.event").alias("plant_id"))
    defused = with_both_teams(defusals.where("ok").select("round_id", tick, "event"), pat, tick).select("round_id").distinct().withColumn("defused", F.lit(True))
    place = F.struct("player", F.lit(True).alias("alive"), *columns)
    living = lambda code: F.sort_array(F.collect_list(F.when(F.col("alive") & (F.col("team") == code), place)))
    seen = states_at(first, pat, ["alive", *columns], tick).groupBy("round_id", tick, "plant_id").agg(*[living(code).alias(side) for side, code in TEAMS.items()])
    types = {f.name: f.dataType for f in pat.schema}
    empty = F.struct(F.lit(None).cast(types["player"]).alias("player"), F.lit(False).alias("alive"), *[F.lit(None).cast(types[c]).alias(c) for c in columns])
    filled = {side: F.array(*[F.coalesce(F.get(side, i), empty) for i in range(slots)]) for side in TEAMS}
    out = seen.withColumns(filled).join(rounds.select("round_id", F.col("end").alias("end_tick"), "winner"), "round_id").join(defused, "round_id", "left").join(bomb.select(tick, "bomb_x", "bomb_y", "bomb_z"), tick, "left")
    return out.select("round_id", "plant_id", F.col(tick).alias("plant_tick"), "end_tick", (F.col("end_tick") - F.col(tick) + 1).alias("length"), "winner", F.coalesce("defused", F.lit(False)).alias("defused"), "bomb_x", "bomb_y", "bomb_z", *TEAMS)


KEY_EVENTS = ("fired", "planted", "defused", "exploded", "test_started", "test_ended")


def key_events(ticks: DataFrame, rounds: DataFrame, events: dict[str, DataFrame], tick: str = "tick_id") -> DataFrame:
    """tick, round_id and, for each of KEY_EVENTS and for round_ended, whether it has happened by then in the round.

    events: by name, tables of tick (where it counts) and, if they have a begin, start: such an event counts only if it began
    in the round of its tick. Names without a table never happen. ticks: round_id, tick; rounds: round_id, end."""
    begun = ticks.groupBy("round_id").agg(F.min(tick).alias("_from"))
    marks = None
    for name, df in events.items():
        start = F.col("start") if "start" in df.columns else F.lit(None).cast("long")
        own = df.select(tick, start.alias("_start"), F.lit(name).alias("_name"))
        marks = own if marks is None else marks.union(own)
    out = ticks.select("round_id", tick).join(begun, "round_id").join(rounds.select("round_id", "end"), "round_id")
    if marks is not None:
        there = marks.groupBy(tick).agg(F.collect_set(F.struct("_name", "_start")).alias("_marks"))
        out = out.join(there, tick, "left")
    holds = lambda n: F.exists("_marks", lambda m: (m["_name"] == n) & (m["_start"].isNull() | (m["_start"] >= F.col("_from"))))
    past = so_far(["round_id"], [tick])
    flags = {n: F.coalesce(F.max(holds(n)).over(past), F.lit(False)) if n in events else F.lit(False) for n in KEY_EVENTS}
    return out.withColumns(flags | {"round_ended": F.coalesce(F.col("end") <= F.col(tick), F.lit(False))}).select(tick, "round_id", *KEY_EVENTS, "round_ended")


def retake_moments(pat: DataFrame, rounds: DataFrame, explosions: DataFrame, plants: DataFrame | None = None, fired: Column | None = None, killed: Column | None = None, jump: float = 50.0, settle: int = 3, tick: str = "tick_id") -> DataFrame:
    """Two rows a round, team 3 and 2: win, players, travelled (by all of it), farthest (anyone from its first place), shots
    and kills for each player of both teams, shots for each kill, mean speed at shots, how many live in the tick before and
    after the (last) explosion (null without one), and length (ticks from the plant on, null without plants).

    Living players' rows count, from the first successful plant of the round on if plants are given (round_id, tick, ok).
    Who jumps farther than `jump` at no speed has been put back: rows up to `settle` ticks after the round's first jump don't
    count. pat: round_id, player, team, tick, alive, x, y, z, speed; fired and killed tell its rows with a shot and a kill.
    rounds: round_id, start, end, winner; explosions: round_id, tick."""
    w = over(["round_id", "player"], [tick])
    never = F.lit(False)
    live = pat.where("alive").withColumns({n: F.coalesce(c, never) if c is not None else never for n, c in (("_shot", fired), ("_kill", killed))})
    if plants is not None:
        first = plants.where("ok").groupBy("round_id").agg(F.min(tick).alias("_plant"))
        live = live.join(first, "round_id").where(F.col(tick) >= F.col("_plant"))
    gap = lambda of: F.sqrt(sum(((F.col(c) - of(c)) * (F.col(c) - of(c)) for c in ("x", "y", "z")), F.lit(0.0)))
    stepped = live.join(rounds.select("round_id", F.col("start").alias("_start")), "round_id").withColumn("_step", gap(lambda c: F.lag(c).over(w)))
    put_back = F.min(F.when((F.col("_step") > jump) & (F.col("speed") == 0) & (F.col(tick) != F.col("_start")), F.col(tick))).over(Window.partitionBy("round_id"))
    counted = stepped.withColumn("_jump", put_back).where(F.col("_jump").isNull() | (F.col(tick) > F.col("_jump") + settle))
    moved = counted.withColumns({"_step": gap(lambda c: F.lag(c).over(w)), "_far": gap(lambda c: F.first(c).over(w))})
    shot = F.when(F.col("_shot"), 1)
    each = moved.groupBy("round_id", "team", "player").agg(
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("travelled"), F.max("_far").alias("farthest"), F.count(shot).alias("shots"), F.count(F.when(F.col("_kill"), 1)).alias("kills"), F.coalesce(F.sum(F.when(F.col("_shot"), F.col("speed").cast("double"))), F.lit(0.0)).alias("_speed"), F.max(tick).alias("_last")
    )
    last = explosions.groupBy("round_id").agg(F.max(tick).alias("_blast"))
    each = each.join(last, "round_id", "left")
    lives = lambda after: F.count(F.when(F.col("_last") > F.col("_blast") if after else F.col("_last") + 1 >= F.col("_blast"), 1))
    teams = each.groupBy("round_id", "team").agg(F.count(F.lit(1)).alias("players"), *[F.sum(c).alias(c) for c in ("travelled", "shots", "kills", "_speed")], F.max("farthest").alias("farthest"), lives(False).alias("_before"), lives(True).alias("_after"))
    grid = rounds.select("round_id", "end", "winner", F.explode(F.array(*map(F.lit, TEAMS.values()))).alias("team"))
    if plants is not None:
        grid = grid.join(first, "round_id")
    length = F.col("end") - F.col("_plant") + 1 if plants is not None else F.lit(None).cast("long")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("players", "shots", "kills", "_before", "_after")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("travelled", "farthest", "_speed")}
    full = grid.join(teams, ["round_id", "team"], "left").withColumns(zero).join(last, "round_id", "left")
    both = F.sum("players").over(Window.partitionBy("round_id"))
    over_blast = lambda c: F.when(F.col("_blast").isNotNull(), F.col(c))
    return full.select(
        "round_id", "team", (F.col("winner") == F.col("team")).alias("win"), "players", "travelled", "farthest", F.try_divide("shots", both).alias("shots_per_player"), F.try_divide("kills", both).alias("kills_per_player"),
        F.try_divide("shots", "kills").alias("shots_per_kill"), F.try_divide("_speed", "shots").alias("shooting_speed"), over_blast("_before").alias("alive_before"), over_blast("_after").alias("alive_after"), length.alias("length"),
    )
