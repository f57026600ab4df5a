"""Finished questions about matches, over tables of the match log (columns as in FIXTURES.md).

Each function takes the tables as one object with an attribute for each (`tables.kills`, `tables.ticks`, ...) and
thresholds as parameters, with the published values as defaults; rates come from `games`. `run("q_kpr", kills=..., ...)`
calls one over DataFrames given by name. Player states are windowed by round and player before events meet them, so an
event that comes twice at a tick changes no movement. Ticks outside of rounds (round id -1) have no round and drop out.

parity=True gives what the published text says where it plainly meant something else: `q_no_ammo`, `q_crouch`,
`q_vis_spans`, `q_vis_others`. Its row limits and subsets of games are left out; rows come unordered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .joins import left_event_join, overlap_join, stab_join, theta_pairs
from .windows import asof_next, asof_prev, islands, over, so_far, whole

FOREVER = 10_000_000
PAIR = ["spotter_id", "spotted_id"]
SPAN = ["demo", "technique", *PAIR, "start_gt", "end_gt", "hacking"]


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def with_clock(t) -> SimpleNamespace:
    """The tables with `clock`: every tick with its round and game, joined and written once (a job of its own, run here).
    The questions that place many tables on the clock read it in place of three joins for each."""
    if hasattr(t, "clock"):
        return t
    return SimpleNamespace(**vars(t), clock=cut(_clock(t)))


def _clock(t) -> DataFrame:
    ticks = t.ticks.select(F.col("id").alias("tick_id"), "round_id", F.col("game_tick_number").alias("gt"))
    rounds = t.rounds.select(F.col("id").alias("round_id"), "game_id", "warmup", "end_tick")
    games = t.games.select(F.col("id").alias("game_id"), F.col("demo_file").alias("demo"), "game_tick_rate", "demo_tick_rate")
    return ticks.join(rounds, "round_id").join(games, "game_id")


def _placed(t, rows: DataFrame) -> DataFrame:
    """rows (with tick_id) with their tick's clock, round and game."""
    return rows.join(t.clock if hasattr(t, "clock") else _clock(t), "tick_id")


def _turned(view: Column, last: Column) -> Column:
    """Degrees from the last view to this one, over the edge at 360 where both are within 10 degrees of it."""
    return F.when((view > 350) & (last < 10), -(last + 360 - view)).when((last > 350) & (view < 10), view + 360 - last).otherwise(view - last)


def _states(t) -> DataFrame:
    """Player states with dx, dy (since the player's state before in the round), turn, moved and alive as 0 or 1."""
    w = over(["round_id", "player_id"], ["tick_id"])
    since = lambda c: F.col(c) - F.lag(c).over(w)
    found = _placed(t, t.player_at_tick).withColumns({"dx": since("pos_x"), "dy": since("pos_y"), "turn": _turned(F.col("view_x"), F.lag("view_x").over(w))})
    return found.withColumns({"moved": _flag(((F.col("dx") != 0) | (F.col("dy") != 0)) & F.col("is_alive")), "alive": _flag(F.col("is_alive"))})


def _off_view(fold: int) -> Column:
    """How far the direction of movement is from the view, both folded."""
    return F.abs((F.degrees(F.atan2("dy", "dx")) + 360) % fold - (F.col("view_x") + 360) % fold)


def _moving(c: Column) -> Column:
    return _flag(~((F.col("dx") == 0) & (F.col("dy") == 0)) & c)


# Shots, hits and kills


def q_360(t, least_turn: float = 310, jump: float = 100) -> DataFrame:
    """Hits whose attacker has turned by more than least_turn in one go. A turn starts anew where its direction changes,
    or with a jump."""
    w = over(["round_id", "player_id"], ["tick_id"])
    fresh = (F.signum("turn") != F.signum(F.lag("turn").over(w))) | (F.col("turn") > jump)
    turns = _states(t).withColumn("arc", F.sum(_flag(fresh)).over(so_far(["round_id", "player_id"], ["tick_id"])))
    turns = turns.withColumn("turn_amount", F.sum(F.abs("turn")).over(so_far(["round_id", "player_id", "arc"], ["tick_id"])))
    hits = t.hurt.select("tick_id", F.col("attacker").alias("player_id"), "victim")
    return turns.where(F.col("turn_amount") > least_turn).join(hits, ["tick_id", "player_id"]).select("round_id", "tick_id", "player_id", "victim", F.round("turn_amount", 6).alias("turn_amount"))


def q_run(t) -> DataFrame:
    """Stretches of movement: rows alive from one without movement to the next."""
    still = F.sum(1 - F.col("moved")).over(so_far(["round_id", "player_id"], ["tick_id"]))
    return _states(t).withColumn("stretch", still).where("is_alive").groupBy("round_id", "player_id", "stretch").agg(F.count(F.lit(1)).alias("length"))


def q_miss_burst(t, gap_seconds: float = 1) -> DataFrame:
    """Ticks from a hit to the last shot before the next one, in bursts of a round (a gap of a second starts one)."""
    order = ["tick_id", "shooter", "victim"]
    shots = _placed(t, t.weapon_fire.join(t.hurt.select("tick_id", "victim"), "tick_id", "left"))
    shots = shots.withColumn("hits", F.sum(_flag(F.col("victim").isNotNull())).over(so_far(["round_id"], order)))
    w = over(["round_id"], order)
    late = ~(F.col("gt") - F.lag("gt").over(w) < F.col("game_tick_rate") * gap_seconds)
    shots = islands(shots, ["round_id"], order, late, "burst_id")
    hit = F.max(F.when(F.col("victim").isNotNull(), F.col("gt"))).over(so_far(["round_id", "burst_id", "hits"], order))
    after = shots.withColumn("hit", hit).where("hit IS NOT NULL")
    last = F.coalesce(F.lead("hit").over(w) != F.col("hit"), F.lit(True))
    return after.withColumn("last", last).where("last").select("round_id", "burst_id", "gt", (F.col("gt") - F.col("hit")).alias("ticks_between_hits"))


def _hit_by(t, state: Column) -> DataFrame:
    """Head hits by attackers in a state."""
    head = t.hurt.where("hit_group = 1").select("tick_id", F.col("attacker").alias("player_id"), "victim")
    return head.join(t.player_at_tick.where(state), ["tick_id", "player_id"]).select("tick_id", F.col("player_id").alias("attacker"), "victim", "remaining_flash_time", "pos_z")


def q_flash_hs(t) -> DataFrame:
    return _hit_by(t, F.col("remaining_flash_time") > 0).drop("pos_z")


def q_jump_hs(t) -> DataFrame:
    return _hit_by(t, F.col("is_airborne")).drop("remaining_flash_time")


def q_air_kill(t) -> DataFrame:
    killed = t.kills.select("tick_id", "killer", F.col("victim").alias("player_id"))
    return killed.join(t.player_at_tick.where("is_airborne"), ["tick_id", "player_id"]).select("tick_id", "killer", F.col("player_id").alias("victim"), "pos_z")


def q_kpr(t) -> DataFrame:
    return _placed(t, t.kills).where("NOT warmup").groupBy("killer", "round_id").agg(F.count(F.lit(1)).alias("kills_per_round"))


def _kills_of(t) -> DataFrame:
    """Kills and deaths of each player, at ticks where the player has a state."""
    both = left_event_join(t.player_at_tick.select("tick_id", "player_id"), t.kills.select("tick_id", "killer", "victim"), ["killer", "victim"], ["tick_id"], "player_id")
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    return both.groupBy("player_id").agg(count("killer").alias("num_kills"), count("victim").alias("num_deaths"))


def q_move_kd(t) -> DataFrame:
    share = _states(t).groupBy("player_id").agg(F.try_divide(F.sum("moved"), F.sum("alive")).alias("percent_moved"))
    kills = F.col("num_kills")
    return share.join(_kills_of(t), "player_id").select(
        "player_id", "percent_moved", "num_kills", "num_deaths", F.try_divide(kills, F.col("num_deaths")).alias("kd"), F.try_divide(kills, F.col("percent_moved")).alias("kills_per_movement")
    )


def q_no_ammo(t, seconds: float = 2, most_weapon: int = 400, parity: bool = False) -> DataFrame:
    """Kills within seconds of a state of the killer with an empty other weapon in hand. parity: the primary weapon is
    compared with the secondary one instead of the active one with it."""
    kills = _placed(t, t.kills).select("tick_id", "killer", "weapon", (F.col("tick_id") - seconds * F.col("demo_tick_rate")).alias("lo")).where((F.col("weapon") > 0) & (F.col("weapon") < most_weapon))
    active = F.col("active_weapon")
    second = (F.col("primary_weapon") == F.col("secondary_weapon")) if parity else (F.col("secondary_weapon") == active)
    empty = ((F.col("primary_weapon") == active) & (F.col("primary_bullets_clip") == 0)) | (second & (F.col("secondary_bullets_clip") == 0))
    states = t.player_at_tick.where(empty & (active > 0) & (active < most_weapon)).select(F.col("tick_id").alias("at"), F.col("player_id").alias("killer"), "active_weapon")
    met = stab_join(states, kills, "at", "lo", "tick_id", ["killer"], 100).where("active_weapon <> weapon")
    return met.groupBy("tick_id").agg(F.max("at").alias("switched_at"), F.max("active_weapon").alias("had"), F.max("weapon").alias("weapon"), F.max("killer").alias("killer"))


def q_crouch(t, parity: bool = False) -> DataFrame:
    """Share of a player's rows alive, of a round, that are crouched. parity: of all rows."""
    crouched = F.sum(_flag(F.col("is_crouching") & F.col("is_alive")))
    return _placed(t, t.player_at_tick).where("NOT warmup").groupBy("round_id", "player_id").agg(F.try_divide(crouched, F.count(F.lit(1)) if parity else F.sum(_flag(F.col("is_alive")))).alias("pct_crouching"))


def q_pairs(t) -> DataFrame:
    """Pairs of players with a state at the same tick of a round."""
    return theta_pairs(_placed(t, t.player_at_tick), ["round_id", "tick_id"], "player_id")


def q_react_damage(t, seconds: float = 2) -> DataFrame:
    """What victims do in the time after being hurt: shares of rows alive, by direction of movement, and turning."""
    hurt = _placed(t, t.hurt).select("round_id", F.col("tick_id").alias("hurt_tick_id"), F.col("victim").alias("player_id"), (F.col("tick_id") + seconds * F.col("demo_tick_rate")).alias("hi")).distinct()
    off = _off_view(180)
    of_view = lambda low, high: _moving((off > low) & (off < high) & F.col("is_alive"))
    states = _states(t).withColumns({"forward": of_view(-1, 45), "strafe": of_view(45, 135), "backward": of_view(135, 361), "turned": F.when(F.col("is_alive"), F.col("turn")).otherwise(0.0)})
    after = stab_join(states, hurt, "tick_id", "hurt_tick_id", "hi", ["round_id", "player_id"], 100)
    share = lambda c: F.try_divide(F.sum(c), F.sum("alive"))
    return after.groupBy("game_id", "round_id", "hurt_tick_id", "player_id").agg(
        F.min("gt").alias("first_gt"), *[share(c).alias(f"percent_{c}") for c in ("forward", "backward", "strafe")], F.round(F.sum("turned"), 6).alias("amount_turn"),
        share(_flag(F.col("is_airborne") & F.col("is_alive"))).alias("percent_airborne"), share(_flag(F.col("is_crouching") & F.col("is_alive"))).alias("percent_crouching"),
    )


def q_revenge(t) -> DataFrame:
    """Victims whose first kill of the next round is that of their killer."""
    kills = _placed(t, t.kills).select("round_id", "tick_id", "killer", "victim")
    later = kills.select((F.col("round_id") - 1).alias("round_id"), F.col("tick_id").alias("next_tick"), F.col("killer").alias("victim"))
    first = kills.join(later, ["round_id", "victim"]).groupBy("round_id", "tick_id", "victim", "killer").agg(F.min("next_tick").alias("next_tick"))
    ends = kills.select(F.col("tick_id").alias("next_tick"), F.col("killer").alias("revenge_ender"), F.col("victim").alias("killer"))
    return first.join(ends, ["next_tick", "killer"]).select("round_id", "victim", "tick_id", F.col("killer").alias("revenge_starter"), "next_tick", "revenge_ender")


def q_run_hs(t, least_speed: float = 170, around: int = 1) -> DataFrame:
    """Head hits by attackers on the ground at more than least_speed, by their states before and after within `around`
    ticks."""
    hits = t.hurt.where("hit_group = 1").select("id", F.col("tick_id").alias("base"), F.col("attacker").alias("player_id"), (F.col("tick_id") - around).alias("lo"), (F.col("tick_id") + around).alias("hi"))
    near = stab_join(_placed(t, t.player_at_tick.drop("id")).where("NOT warmup AND NOT is_airborne"), hits, "tick_id", "lo", "hi", ["player_id"], 2 * around)
    w = over(["id"], ["tick_id"])
    span = lambda c: F.lead(c).over(w) - F.lag(c).over(w)
    far = F.sqrt(span("pos_x") * span("pos_x") + span("pos_y") * span("pos_y") + span("pos_z") * span("pos_z"))
    speed = F.try_divide(far, span("gt")) * F.col("game_tick_rate")
    return near.withColumn("speed", speed).where((F.col("base") == F.col("tick_id")) & (F.col("speed") > least_speed)).select("id", "tick_id", "player_id", F.round("speed", 6).alias("speed"))


def q_behind(t) -> DataFrame:
    """The states of victim and attacker at each hit."""
    state = lambda who: t.player_at_tick.select("tick_id", F.col("player_id").alias(who), *[F.col(c).alias(f"{who}_{c}") for c in ("pos_x", "pos_y", "view_x")])
    return t.hurt.select("id", "tick_id", "victim", "attacker").join(state("victim"), ["tick_id", "victim"]).join(state("attacker"), ["tick_id", "attacker"])


def q_strafe_kd(t) -> DataFrame:
    off = _off_view(90)
    rows = _states(t).withColumns({"forward": _moving((off < 45) & F.col("is_alive")), "strafe": _moving((off > 45) & F.col("is_alive"))})
    shares = rows.groupBy("player_id").agg(F.try_divide(F.sum("forward"), F.sum("alive")).alias("percent_forward_backward"), F.try_divide(F.sum("strafe"), F.sum("alive")).alias("percent_strafe"))
    return shares.join(_kills_of(t).select("player_id", F.try_divide("num_kills", "num_deaths").alias("kd")), "player_id")


def q_double_hit(t) -> DataFrame:
    """Victims of two attackers with one weapon at one tick who are alive at the end of the round."""
    side = lambda n: t.hurt.select("tick_id", "victim", "weapon", F.col("attacker").alias(n))
    both = side("attacker1").join(side("attacker2"), ["tick_id", "victim", "weapon"]).where("attacker1 < attacker2")
    alive = t.player_at_tick.where("is_alive").select(F.col("tick_id").alias("end_tick"), F.col("player_id").alias("victim"))
    return _placed(t, both).join(alive, ["end_tick", "victim"]).select("end_tick", "round_id", "tick_id", "victim", "attacker1", "attacker2", "weapon")


def q_zigzag(t) -> DataFrame:
    """Stretches with strafing to both sides that have more rows than demo ticks a second. A stretch begins with a row
    that is both forward and a strafe; the classes as published exclude each other, so it is a whole round."""
    off, alive = _off_view(360), F.col("is_alive")
    classes = {"forward": (off < 45) | ((off > 315) & alive), "right": (off > 45) & (off < 135) & alive, "left": (off > 225) & (off < 315) & alive}
    rows = _states(t).withColumns({n: _moving(c) for n, c in classes.items()})
    turn = _flag((F.col("forward") == 1) & (F.col("left") != F.col("right")))
    rows = rows.withColumn("zig", F.sum(turn).over(so_far(["round_id", "player_id"], ["tick_id"])))
    out = rows.groupBy("round_id", "player_id", "zig").agg(
        F.min("tick_id").alias("start_tick"), F.max("tick_id").alias("end_tick"), (F.bit_or("right") + F.bit_or("left")).alias("sides"), F.count(F.lit(1)).alias("length"), F.max("demo_tick_rate").alias("rate")
    )
    return out.where("sides = 2 AND length > rate").drop("rate")


# Visibility and reaction


def _spotted(t) -> DataFrame:
    """Spotted rows with the row before and after of the pair in the round, and the region: a run that ends where the
    spotted player is out of sight again."""
    keys, w = ["round_id", *PAIR], over(["round_id", *PAIR], ["tick_id"])
    rows = _placed(t, t.spotted).withColumnsRenamed({"spotter_player": "spotter_id", "spotted_player": "spotted_id"})
    rows = rows.withColumns({"was": F.lag("is_spotted", 1, False).over(w), "prev_gt": F.lag("gt", 1, 0).over(w), "next_gt": F.lead("gt").over(w)})
    return rows.withColumn("region", F.sum(_flag(F.col("was") & ~F.col("is_spotted"))).over(so_far(keys, ["tick_id"])))


def q_vis_spans(t, parity: bool = False) -> DataFrame:
    """Spans in which one player sees another, from its first row in sight to the row after its last. Where the round
    has no row after it, the last row is the end, and a span of that row alone has a null one. parity: one span for all
    regions of a round."""
    hacking = t.visibilities.select("demo", "hacking").distinct()
    seen = _spotted(t).where("is_spotted").join(hacking, "demo")
    spans = seen.groupBy("demo", *PAIR, "hacking", "round_id", *([] if parity else ["region"])).agg(F.min("gt").alias("start_gt"), F.max("next_gt").alias("end_gt"))
    return spans.select("demo", *PAIR, "start_gt", "end_gt", "hacking")


def q_vis_neighbours(t) -> DataFrame:
    """The spans of the three techniques (0 pixels adjusted, 1 unadjusted, 2 boxes) with the next one's start and the
    last one's end."""
    shape = lambda df: df.withColumnsRenamed({"start_game_tick": "start_gt", "end_game_tick": "end_gt"})
    each = [shape(t.visibilities), shape(t.visibilities_unadjusted), q_vis_spans(t)]
    spans = reduce(DataFrame.unionByName, [df.select("demo", *PAIR, "start_gt", "end_gt", "hacking").withColumn("technique", F.lit(k)) for k, df in enumerate(each)]).distinct()
    return _neighbours(spans, ["technique", "demo", *PAIR])


def _neighbours(spans: DataFrame, keys: list[str]) -> DataFrame:
    w = over(keys, ["start_gt", "end_gt"])
    return spans.withColumns({"next_start": F.lead("start_gt", 1, FOREVER).over(w), "last_end": F.lag("end_gt", 1, 0).over(w)})


def q_vis_locate(t) -> DataFrame:
    """Spans with the tick in which they start: that of the same demo which lasts from its clock to the next one's. The
    last tick of a demo has no end."""
    ticks = _placed(t, t.ticks.select(F.col("id").alias("tick_id"))).select("demo", "gt", F.struct("tick_id", "round_id", "game_id", "game_tick_rate").alias("at"))
    rows = q_vis_neighbours(t).withColumn("gt", F.col("start_gt"))
    found = asof_prev(rows, ticks, ["demo"], "gt", ["at"]).where("prev_at IS NOT NULL")
    return found.select("*", *[F.col(f"prev_at.{c}").alias(n) for c, n in (("tick_id", "start_tick"), ("round_id", "round_id"), ("game_id", "game_id"), ("game_tick_rate", "game_tick_rate"))]).drop("prev_at", "gt")


def q_vis_alive(t) -> DataFrame:
    """Located spans whose spotter is alive at the start."""
    alive = t.player_at_tick.where("is_alive").select(F.col("tick_id").alias("start_tick"), F.col("player_id").alias("spotter_id"))
    return q_vis_locate(t).join(alive, ["start_tick", "spotter_id"])


def _others(spans: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """spans with the number of other players whom the spotter sees during each. Ranges are half-open; one without an
    end goes on forever. A span asks for each other player of its keys, once: it overlaps one of that player's spans if those
    that begin before its end reach beyond its start. No two spans are paired."""
    bounds = {"a_start": F.col("start_gt"), "a_end": F.coalesce("end_gt", F.lit(FOREVER))}
    a = spans.select(*keys, "spotted_id", "start_gt", "end_gt").distinct().withColumns(bounds).where("a_start < a_end")
    asks = a.join(a.select(*keys, F.col("spotted_id").alias("other")).distinct(), keys).where("spotted_id <> other").select(*keys, "other", "spotted_id", "start_gt", "end_gt", "a_start", F.col("a_end").alias("at"), F.lit(0).alias("_b"))
    tells = a.select(*keys, F.col("spotted_id").alias("other"), F.col("a_start").alias("at"), F.lit(1).alias("_b"), F.col("a_end").alias("b_end"))
    reach = F.max("b_end").over(so_far([*keys, "other"], ["at", "_b"]))
    met = asks.unionByName(tells, allowMissingColumns=True).withColumn("reach", reach).where("_b = 0 AND reach > a_start")
    n = met.groupBy(*keys, "spotted_id", "start_gt", "end_gt").agg(F.count(F.lit(1)).alias("n"))
    counted = n.select(*[F.col(c).alias(f"_{c}") for c in own], "n")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
    return spans.join(counted, same, "left").withColumn("others", F.coalesce("n", F.lit(0))).drop("n", *[f"_{c}" for c in own])


def q_vis_others(t, parity: bool = False, width: int = 100_000) -> DataFrame:
    """parity: spans of all techniques count as others. width: of the buckets in which spans met once; changes nothing."""
    spans = cut(q_vis_alive(t))  # read three times below
    if not parity:
        return _others(spans, ["demo", "technique", "spotter_id"], ["demo", "technique", *PAIR, "start_gt", "end_gt"])
    keys = ["demo", "spotter_id"]
    plain = _others(spans.select(*keys, "spotted_id", "start_gt", "end_gt").distinct(), keys, [*keys, "spotted_id", "start_gt", "end_gt"])
    named = plain.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "spotted_id", "start_gt", "end_gt")], "others")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "spotted_id", "start_gt", "end_gt")])
    return spans.join(named, same).drop(*[f"_{c}" for c in (*keys, "spotted_id", "start_gt", "end_gt")])


def q_looks(t, gap_seconds: float = 0.1) -> DataFrame:
    """Looks of one player at another: a gap of more than gap_seconds begins one. Running and whole length in seconds."""
    keys = ["game_id", "round_id", "spotter_id", "spotted_id"]
    rows = _placed(t, t.lookers).withColumnsRenamed({"looker_player_id": "spotter_id", "looked_at_player_id": "spotted_id"})
    gap = (F.col("gt") - F.lag("gt", 1, 0).over(over(keys, ["tick_id"]))) / F.col("game_tick_rate")
    rows = rows.withColumn("gap", gap).withColumn("new_look", _flag(F.col("gap") > gap_seconds))
    rows = rows.withColumn("look_id", F.sum("new_look").over(so_far(keys, ["tick_id"]))).withColumn("step", F.when(F.col("new_look") == 1, 0.0).otherwise(F.col("gap")))
    look = [*keys, "look_id"]
    rows = rows.withColumns({"running": F.round(F.sum("step").over(so_far(look, ["tick_id"])), 6), "length": F.round(F.sum("step").over(whole(look)), 6)})
    return rows.select("demo", *keys, "tick_id", "gt", "new_look", "look_id", "running", "length")


def _first(spans: DataFrame, points: DataFrame, keys: list[str], lo: Column, hi: str, name: str) -> DataFrame:
    """spans with the first gt of their keys in [lo, hi], null where there is none. The first at or after lo is looked
    for, in one sort; no span is paired with all its points."""
    found = asof_next(spans.withColumn("gt", F.ceil(lo).cast("long")), points.select(*keys, "gt"), keys, "gt", ["gt"])
    return found.withColumn(name, F.when(F.col("next_gt") <= F.col(hi), F.col("next_gt"))).drop("gt", "next_gt")


def q_react_aim(t, before_seconds: float = 3, least_look: float = 0.1) -> DataFrame:
    """Spans with the start of the first look of some length at the one seen, from a little before the start on."""
    looks = q_looks(t).where((F.col("new_look") == 1) & (F.col("length") >= least_look))
    return _first(q_vis_others(t), looks, ["demo", *PAIR], F.col("start_gt") - F.col("game_tick_rate") * before_seconds, "next_start", "aim_gt")


def q_react_fire(t) -> DataFrame:
    """+ the spotter's first shot."""
    shots = _placed(t, t.weapon_fire).withColumnRenamed("shooter", "spotter_id")
    return _first(q_react_aim(t), shots, ["demo", "spotter_id"], F.col("start_gt"), "next_start", "fire_gt")


def q_round_bounds(t, after: int = 10) -> DataFrame:
    """Smallest and largest tick and clock of each round; earlier clocks than `after` don't count."""
    ticks = _placed(t, t.ticks.select(F.col("id").alias("tick_id"))).where(F.col("gt") > after)
    return ticks.groupBy("game_id", "round_id").agg(F.min("tick_id").alias("min_tick"), F.max("tick_id").alias("max_tick"), F.min("gt").alias("min_gt"), F.max("gt").alias("max_gt"))


def q_cover_clusters(t) -> DataFrame:
    edges = t.cover_edges.groupBy(F.col("origin_id").alias("index")).agg(F.count_distinct("cluster_id").alias("num_clusters"))
    return t.cover_origins.join(edges, "index").select("index", "x", "y", "z", "num_clusters")


def q_react_cover(t) -> DataFrame:
    """+ clusters of the spotter's cover that teammates look at when the span starts, of how many."""
    watched = _placed(t, t.team_looking_at_cover_edge_cluster).groupBy("demo", F.col("gt").alias("start_gt"), F.col("origin_player_id").alias("spotter_id")).agg(F.count_distinct("cover_edge_cluster_id").alias("watched"))
    origin = t.nearest_origin.select(F.col("tick_id").alias("start_tick"), F.col("player_id").alias("spotter_id"), "origin_id")
    clusters = q_cover_clusters(t).select(F.col("index").alias("origin_id"), "num_clusters")
    out = q_react_fire(t).join(watched, ["demo", "start_gt", "spotter_id"], "left").join(origin, ["start_tick", "spotter_id"]).join(clusters, "origin_id")
    return out.withColumn("watched", F.coalesce("watched", F.lit(0)))


def _seconds(c: Column) -> Column:
    return c / F.col("game_tick_rate")


def q_react_final(t, seen_seconds: float = 5) -> DataFrame:
    """Seconds from sight to aim and to fire, whether the pair met shortly before, and the share of clusters watched;
    the round is the one whose clock holds the start."""
    t = with_clock(t)
    bounds = q_round_bounds(t).select("game_id", F.col("min_gt").alias("gt"), F.struct("round_id", "max_gt").alias("in"))
    spans = asof_prev(q_react_cover(t).drop("round_id").withColumn("gt", F.col("start_gt")), bounds, ["game_id"], "gt", ["in"]).where("start_gt < prev_in.max_gt")
    start = F.col("start_gt")
    return spans.select(
        *SPAN, "game_id", F.col("prev_in.round_id").alias("round_id"), "start_tick", "others", (_seconds(start - F.col("last_end")) < seen_seconds).alias("seen_lately"),
        _seconds(F.col("aim_gt") - start).alias("aim_react_s"), _seconds(F.col("fire_gt") - start).alias("fire_react_s"), F.try_divide("watched", "num_clusters").alias("clusters_covered"),
        (F.col("aim_gt") - start).alias("aim_ticks"), (F.col("fire_gt") - start).alias("fire_ticks"), "game_tick_rate",
    )


# The study with hand-marked spans


def q_last_spotted(t) -> DataFrame:
    """Spotted rows with the clock at which the pair last had sight: the row before the region while out of it."""
    first = F.first("prev_gt").over(over(["round_id", *PAIR, "region"], ["tick_id"]))
    return _spotted(t).select("demo", "tick_id", "gt", *PAIR, "is_spotted", F.when(F.col("is_spotted"), F.col("gt")).otherwise(first).alias("last_spotted_gt"))


def _hand(t) -> DataFrame:
    spans = t.visibilities_unadjusted.withColumnsRenamed({"start_game_tick": "start_gt", "end_game_tick": "end_gt"}).select("demo", *PAIR, "start_gt", "end_gt", "hacking")
    return _neighbours(spans, ["demo", *PAIR])


def q_vis_compare(t) -> DataFrame:
    """Hand-marked spans with the first tick at which the log says spotted, up to the next span. One row of nulls holds
    the first tick of the log's rows that no span takes."""
    keys, hand = ["demo", *PAIR], _hand(t)
    log = q_last_spotted(t)
    first = log.where("is_spotted").groupBy(*keys, "gt").agg(F.min("tick_id").alias("tick_id"))
    met = asof_next(hand.withColumn("gt", F.col("start_gt")), first.withColumn("at", F.struct("gt", "tick_id")), keys, "gt", ["at"])
    inside = F.col("next_at.gt") <= F.col("next_start")
    spans = met.select(*keys, "start_gt", "end_gt", "next_start", "last_end", "hacking", *[F.when(inside, F.col(f"next_at.{c}")).alias(f"log_{c}") for c in ("tick_id", "gt")])
    starts = hand.groupBy(*keys).agg(F.min("start_gt").alias("from"))  # from here on some span takes each row in sight, up to FOREVER
    lost = log.join(starts, keys, "left").where(f"NOT is_spotted OR `from` IS NULL OR gt < `from` OR gt > {FOREVER}")
    rest = lost.agg(F.min("tick_id").alias("log_tick_id"), F.min("gt").alias("log_gt")).where("log_tick_id IS NOT NULL")
    return spans.unionByName(rest, allowMissingColumns=True)


def q_hand_others(t, width: int = 100_000) -> DataFrame:
    """+ the number of others in sight meanwhile. width: as in q_vis_others."""
    return _others(cut(q_vis_compare(t)), ["demo", "spotter_id"], ["demo", *PAIR, "start_gt", "end_gt"])


def q_hand_aim(t, before: float = 64 * 3, least_look: float = 0.1) -> DataFrame:
    """+ the first row of a look that has lasted, from `before` clock units ahead of the start on."""
    return _first(q_hand_others(t), q_looks(t).where(F.col("running") >= least_look), ["demo", *PAIR], F.col("start_gt") - before, "next_start", "aim_gt")


def q_hand_fire(t, before: float = 128, **aim) -> DataFrame:
    """+ the first hit of the one seen."""
    hits = _placed(t, t.hurt).withColumnsRenamed({"attacker": "spotter_id", "victim": "spotted_id"})
    return _first(q_hand_aim(t, **aim), hits, ["demo", *PAIR], F.col("start_gt") - before, "next_start", "fire_gt")


def q_hand_final(t, seen_seconds: float = 5, width: int = 100_000, **fire) -> DataFrame:
    """Reaction seconds from the hand's start and from the log's, in every round that the span overlaps."""
    t = with_clock(t)
    games = t.games.select(F.col("id").alias("game_id"), F.col("demo_file").alias("demo"), "game_tick_rate")
    spans = q_hand_fire(t, **fire).join(games, "demo").withColumns({"a_start": F.col("start_gt"), "a_end": F.coalesce("end_gt", F.lit(FOREVER))}).where("a_start < a_end")
    bounds = q_round_bounds(t, after=-1).select("game_id", "round_id", F.col("min_gt").alias("b_start"), F.col("max_gt").alias("b_end")).where("b_start < b_end")
    met, start, log = overlap_join(spans, bounds, ["game_id"], False, width), F.col("start_gt"), F.col("log_gt")
    return met.select(
        "demo", *PAIR, "start_gt", "end_gt", "hacking", "game_id", "round_id", "others", (_seconds(start - F.col("last_end")) < seen_seconds).alias("seen_lately"),
        _seconds(F.col("aim_gt") - start).alias("hand_aim_s"), _seconds(F.col("aim_gt") - log).alias("log_aim_s"), _seconds(F.col("fire_gt") - start).alias("hand_fire_s"), _seconds(F.col("fire_gt") - log).alias("log_fire_s"),
    )


# Groups of rounds and of players


def q_react_grouped(t, rounds: int = 5, most_fire: float = 2, pre_aim: float = -1.5) -> DataFrame:
    """Reactions of a player by technique and block of rounds; means are taken over whole ticks."""
    fast, fire = F.col("fire_react_s") <= most_fire, F.when(F.col("fire_react_s") <= most_fire, F.col("fire_react_s"))
    each = [f(c).alias(f"{by}_{n}") for n, c in (("aim_react_s", F.col("aim_react_s")), ("fire_react_s", fire)) for by, f in (("min", F.min), ("max", F.max))]
    mean = lambda c: F.try_divide(F.sum(c), F.count(c)) / F.max("game_tick_rate")
    means = [mean(F.col("aim_ticks")).alias("avg_aim_react_s"), mean(F.when(fast, F.col("fire_ticks"))).alias("avg_fire_react_s"), F.avg("others").alias("avg_others"), F.round(F.avg("clusters_covered"), 6).alias("avg_clusters_covered")]
    return q_react_final(t).groupBy("hacking", "technique", "game_id", F.floor(F.col("round_id") / rounds).alias("block"), "spotter_id").agg(
        F.count(F.lit(1)).alias("num"), F.min("round_id").alias("min_round_id"), F.max("round_id").alias("max_round_id"), *each, *means, F.sum(_flag(F.col("aim_react_s") < pre_aim)).alias("preaims")
    )


def q_react_split(t, **grouped) -> DataFrame:
    """Grouped reactions under the label of their kind of player (0 legit, 1 hacks, 2 pro), and once more under the
    label of hacks and legit together."""
    rows = q_react_grouped(t, **grouped)
    label = F.element_at(F.create_map(*[F.lit(x) for x in (0, "legit", 1, "hacks", 2, "pro")]), F.col("hacking"))
    return rows.withColumn("label", label).unionByName(rows.where("hacking IN (0, 1)").withColumn("label", F.lit("hacks_legit")))


QUERIES: dict[str, Callable[..., DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("q_")}


def run(name: str, how: dict | None = None, **tables: DataFrame) -> DataFrame:
    """One question over tables given by name; how: its thresholds."""
    return QUERIES[name](SimpleNamespace(**tables), **(how or {}))
