"""Plants, events so far and moments of a round, on small logs laid out by hand."""

import math

from pyspark.sql import functions as F

from tickframe.operators import distributions, events, retakes

PAT = "round_id long, tick_id long, player long, team int, alive boolean, x double, y double, z double, view double, speed double, kind string"


def log(spark):
    """Round 1: players 1 to 6 are CT, 11 and 12 are T. 6 dies at 3; 12 never lives; 11 dies at 8."""
    rows = []
    for t in range(10):
        for p in (1, 2, 3, 4, 5, 6, 11, 12):
            if p == 5 and t < 4:
                continue  # appears late
            rows.append((1, t, p, 3 if p < 10 else 2, p != 12 and not (p == 6 and t >= 3) and not (p == 11 and t >= 8), float(10 * p + t), 0.0, 1.0, 90.0, 1.0, "click" if p == 1 and t in (6, 7) else "view"))
    rows += [(2, 100, 1, 3, True, 0.0, 0.0, 0.0, 0.0, 0.0, "view"), (2, 101, 11, 2, False, 0.0, 0.0, 0.0, 0.0, 0.0, "view")]
    return spark.createDataFrame(rows, PAT)


def rounds(spark):
    return spark.createDataFrame([(1, 0, 9, 3), (2, 100, 110, 2), (3, 200, 210, 2)], 'round_id long, start long, "end" long, winner int'.replace('"', "`"))


def test_plant_states(spark):
    plants = spark.createDataFrame([(1, 2, 70, False), (1, 6, 71, True), (1, 7, 72, True), (2, 101, 73, True)], "round_id long, tick_id long, event long, ok boolean")
    bomb = spark.createDataFrame([(6, 1.0, 2.0, 3.0)], "tick_id long, bomb_x double, bomb_y double, bomb_z double")
    for tick, defused in ((7, True), (9, False)):  # at 9 no T lives
        defusals = spark.createDataFrame([(1, tick, 5, True), (1, 7, 6, False)], "round_id long, tick_id long, event long, ok boolean")
        [r] = retakes.plant_states(plants, defusals, log(spark), rounds(spark), bomb).collect()
        assert (r.plant_id, r.plant_tick, r.end_tick, r.length, r.winner, r.defused, r.bomb_x, r.bomb_z) == (71, 6, 9, 4, 3, defused, 1.0, 3.0)
        assert [(s.player, s.alive, s.x) for s in r.ct] == [(p, True, 10.0 * p + 6) for p in (1, 2, 3, 4, 5)]
        assert [(s.player, s.alive, s.x) for s in r.t] == [(11, True, 116.0)] + [(None, False, None)] * 4
    none = plants.limit(0)
    assert retakes.plant_states(none, none, log(spark), rounds(spark), bomb).count() == 0


def test_key_events(spark):
    ticks = spark.createDataFrame([(1, t) for t in range(10, 20)] + [(2, t) for t in range(20, 24)], "round_id long, tick_id long")
    ends = spark.createDataFrame([(1, 18), (2, None)], "round_id long, end long")
    planted = spark.createDataFrame([(11, 5), (14, 10), (21, 19)], "tick_id long, start long")  # of the round before, right, of the round before
    fired = spark.createDataFrame([(12,), (12,), (99,)], "tick_id long")
    out = {r.tick_id: r for r in retakes.key_events(ticks, ends, {"planted": planted, "fired": fired}).collect()}
    assert len(out) == 14
    for t, r in out.items():
        assert (r.planted, r.fired, r.defused, r.round_ended) == (14 <= t < 20, 12 <= t < 20, False, 18 <= t < 20)
    assert not any(r.fired for r in retakes.key_events(ticks, ends, {}).collect())


def test_retake_moments(spark):
    blasts = spark.createDataFrame([(1, 4), (1, 8)], "round_id long, tick_id long")
    plants = spark.createDataFrame([(1, 3, False), (1, 5, True), (2, 100, True)], "round_id long, tick_id long, ok boolean")
    out = {(r.round_id, r.team): r for r in retakes.retake_moments(log(spark), rounds(spark), blasts, plants, F.col("kind") == "click", F.col("kind") == "none").collect()}
    assert set(out) == {(1, 2), (1, 3), (2, 2), (2, 3)}
    ct, t = out[1, 3], out[1, 2]
    assert (ct.win, ct.players, ct.travelled, ct.farthest, ct.length) == (True, 5, 20.0, 4.0, 5)
    assert (ct.shots_per_player, ct.kills_per_player, ct.shots_per_kill, ct.shooting_speed) == (2 / 6, 0.0, None, 1.0)
    assert (ct.alive_before, ct.alive_after) == (5, 5) and (t.players, t.alive_before, t.alive_after, t.win) == (1, 1, 0, False)
    assert (out[2, 2].players, out[2, 2].travelled, out[2, 2].alive_before, out[2, 2].win) == (0, 0.0, None, True)
    moved = log(spark).withColumns({"x": F.when((F.col("tick_id") >= 6) & (F.col("player") == 2), F.col("x") + 500).otherwise(F.col("x")), "speed": F.when(F.col("player") == 2, 0.0).otherwise(F.col("speed"))})
    back = {(r.round_id, r.team): r for r in retakes.retake_moments(moved, rounds(spark), blasts, None, F.col("kind") == "click", settle=1).collect()}
    assert (back[1, 3].travelled, back[1, 3].players, back[1, 3].length) == (5 * 1.0, 5, None)  # ticks 8 and 9 alone count
    assert set(back) == {(r, s) for r in (1, 2, 3) for s in (2, 3)}


def test_overlapping_engagements_count_once(spark):
    eng = spark.createDataFrame([(1, 5, 8, 0, 10), (1, 5, 9, 5, 15)], "round_id long, attacker long, victim long, start long, `end` long")
    near = spark.createDataFrame([(1, 5, t, t, 9 if t >= 5 else 8, 8) for t in range(0, 16, 5)], "round_id long, player long, tick_id long, gt long, now long, later long")
    out = {r.victim: (r.share_now, r.share_later) for r in events.engagement_match(eng, near, ["now", "later"], 4).collect()}
    assert out == {8: (1 / 3, 1 / 3), 9: (1.0, 0.0)}


def test_nearest_player_heat(spark):
    rows = [(1, 1, 1, 3, True, 0.0, 0.0, 0.0), (1, 1, 2, 3, True, 3.0, 4.0, 0.0), (1, 1, 3, 3, False, 0.0, 0.1, 0.0), (1, 1, 9, 2, True, 0.0, 12.0, 0.0), (2, 2, 1, 3, True, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "round_id long, tick_id long, player long, team int, alive boolean, x double, y double, z double")
    mates = {(r.gx, r.gy): (r["mean"], r.n) for r in distributions.nearest_player_heat(df, 10.0).collect()}
    assert mates == {(0, 0): (5.0, 2)}
    cover = spark.createDataFrame([(0, 0), (5, 5), (0, 0)], "gx long, gy long")
    foes = {(r.gx, r.gy): (r["mean"], r.n) for r in distributions.nearest_player_heat(df, 10.0, teammate=False, coverage=cover, most=10.0).collect()}
    assert foes == {(0, 0): (math.dist((3, 4), (0, 12)), 1), (5, 5): (None, 0)}
