"""The finished match questions over tables of the match log's own schemas: empty ones, and hand-made ones with the
known dirt (rounds of id -1, hits that come twice, spans past the end of a round, a view across 360, no movement)."""

from types import SimpleNamespace

import pytest

from tickframe.operators import match_queries as m
from tickframe.sources import tables

RATE = 10.0


def log(spark, **rows):
    """Match tables with the rows given as dicts; the rest of each column is null."""
    made = {}
    for name in tables.table_names():
        want = tables.schema(name)
        made[name] = spark.createDataFrame([tuple(r.get(f.name) for f in want) for r in rows.get(name, [])], want)
    return SimpleNamespace(**made)


def clock(rounds=((1, 1, 20), (2, 21, 40)), stray=()):
    """One game with a tick for each game tick; strays are ticks between rounds."""
    ticks = [dict(id=k, round_id=-1 if k in stray else r, game_tick_number=100 + k, demo_tick_number=k) for r, a, b in rounds for k in range(a, b + 1)]
    return {
        "games": [dict(id=7, demo_file="d", demo_tick_rate=5.0, game_tick_rate=RATE)],
        "rounds": [dict(id=r, game_id=7, start_tick=a, end_tick=b, warmup=r == 3) for r, a, b in rounds],
        "ticks": ticks,
    }


def state(tick, player=1, **how):
    return dict(dict(tick_id=tick, player_id=player, pos_x=0.0, pos_y=0.0, pos_z=0.0, view_x=0.0, is_alive=True, is_airborne=False, is_crouching=False, remaining_flash_time=0.0), **how)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(m.QUERIES))
def test_empty_tables(spark, name):
    assert m.run(name, **vars(log(spark))).collect() == []


def test_turns_across_the_edge_count_once(spark):
    views = [0, 90, 180, 270, 355, 5, 60, 20]
    t = log(spark, **clock(), player_at_tick=[state(k + 1, view_x=float(v)) for k, v in enumerate(views)], hurt=[dict(id=k, tick_id=7, victim=2, attacker=1) for k in (1, 2)])
    assert got(m.q_360(t), "tick_id", "turn_amount") == [(7, 420.0), (7, 420.0)]  # the hit came twice; the turn didn't
    assert got(m.q_360(t, jump=80), "tick_id") == []


def test_standing_still_is_no_movement(spark):
    t = log(spark, **clock(), player_at_tick=[state(k, pos_x=float(x)) for k, x in enumerate([0, 0, 1, 2, 2, 3], 1)] + [state(7, pos_x=9.0, is_alive=False)])
    assert got(m.q_run(t), "stretch", "length") == [(1, 1), (2, 3), (3, 2)]
    assert got(m.q_move_kd(t), "percent_moved", "kd", "kills_per_movement") == [(0.5, None, 0.0)]  # no deaths: no ratio


def test_rounds_between_rounds_drop_out(spark):
    t = log(spark, **clock(stray=(3,)), kills=[dict(tick_id=k, killer=1, victim=2) for k in (2, 3, 22)])
    assert got(m.q_kpr(t), "round_id", "kills_per_round") == [(1, 1), (2, 1)]


def test_bursts_end_at_gaps_and_rounds(spark):
    shots = [1, 2, 4, 5, 15, 16, 25, 26]  # gaps of ten ticks and more, and the round's end, begin bursts
    t = log(spark, **clock(), weapon_fire=[dict(tick_id=k, shooter=1) for k in shots], hurt=[dict(id=k, tick_id=k, victim=2, attacker=1) for k in (2, 15, 25)])
    assert got(m.q_miss_burst(t), "round_id", "gt", "ticks_between_hits") == [(1, 105, 3), (1, 116, 1), (2, 126, 1)]


def test_revenge_on_the_first_kill_only(spark):
    kills = [(5, 1, 2), (6, 3, 4), (22, 2, 1), (23, 4, 9), (24, 4, 3)]
    t = log(spark, **clock(), kills=[dict(tick_id=k, killer=a, victim=b) for k, a, b in kills])
    assert got(m.q_revenge(t), "victim", "revenge_starter", "next_tick") == [(2, 1, 22)]


def test_no_ammo_parity(spark):
    hand = dict(active_weapon=1, primary_weapon=9, primary_bullets_clip=3, secondary_weapon=1, secondary_bullets_clip=0)
    t = log(spark, **clock(), kills=[dict(tick_id=15, killer=1, victim=2, weapon=4)], player_at_tick=[state(5, **hand), state(4, **hand), state(6, **hand | {"secondary_bullets_clip": 1})])
    assert got(m.q_no_ammo(t), "tick_id", "switched_at", "had") == [(15, 5, 1)]  # two seconds are ten demo ticks
    assert got(m.q_no_ammo(t, parity=True), "tick_id") == []


def test_crouch_parity(spark):
    t = log(spark, **clock(), player_at_tick=[state(1, is_crouching=True), state(2), state(3, is_alive=False, is_crouching=True)])
    assert got(m.q_crouch(t), "pct_crouching") == [(0.5,)] and got(m.q_crouch(t, parity=True), "pct_crouching") == [(1 / 3,)]


def test_death_on_the_last_tick(spark):
    hits = [dict(id=k, tick_id=4, victim=v, attacker=k, weapon=1) for k, v in ((11, 1), (12, 1), (13, 2), (14, 2), (15, 3))]
    t = log(spark, **clock(), hurt=hits, player_at_tick=[state(20, 1), state(20, 2, is_alive=False), state(20, 3)])
    assert got(m.q_double_hit(t), "victim", "attacker1", "attacker2") == [(1, 11, 12)]


def test_running_speed_needs_both_neighbours(spark):
    far = [state(k, pos_x=float(20 * k)) for k in (9, 10, 11, 15)]
    t = log(spark, **clock(), hurt=[dict(id=1, tick_id=10, attacker=1, victim=2, hit_group=1), dict(id=2, tick_id=15, attacker=1, victim=2, hit_group=1)], player_at_tick=far)
    assert got(m.q_run_hs(t), "id", "speed") == [(1, 200.0)] and got(m.q_run_hs(t, least_speed=200), "id") == []


def spotted(pair, seen, first=1):
    return [dict(tick_id=first + k, spotter_player=pair[0], spotted_player=pair[1], is_spotted=bool(x)) for k, x in enumerate(seen)]


def marked(start, end, pair=(1, 2), hacking=1):
    return dict(demo="d", spotter_id=pair[0], spotted_id=pair[1], start_game_tick=start, end_game_tick=end, hacking=hacking)


def test_spans_of_sight(spark):
    t = log(spark, **clock(), spotted=spotted((1, 2), [0, 1, 1, 0, 1]) + spotted((1, 3), [1, 0, 1, 1], first=17), visibilities=[marked(101, 102)])
    spans = {(r.spotted_id, r.start_gt, r.end_gt) for r in m.q_vis_spans(t).collect()}
    assert spans == {(2, 102, 104), (2, 105, None), (3, 117, 118), (3, 119, 120)}  # no row after it in the round: no end, or the last row's clock
    assert {(r.spotted_id, r.start_gt, r.end_gt) for r in m.q_vis_spans(t, parity=True).collect()} == {(2, 102, 104), (3, 117, 120)}
    last = {(r.spotted_id, r.tick_id): r.last_spotted_gt for r in m.q_last_spotted(t).collect()}
    assert last[2, 4] == 103 and last[2, 1] == 0 and last[3, 18] == 117


def test_others_in_sight_and_techniques(spark):
    marks = [marked(101, 110), marked(105, 130, (1, 3)), marked(110, 112, (1, 4)), marked(105, 130, (9, 5))]
    t = log(spark, **clock(), visibilities=marks, visibilities_unadjusted=[marked(103, 104, (1, 6))], player_at_tick=[state(k, p) for k in (1, 3, 5, 10) for p in (1, 9)])
    count = lambda **how: {(r.technique, r.spotter_id, r.spotted_id): r.others for r in m.q_vis_others(t, **how).collect()}
    assert count() == {(0, 1, 2): 1, (0, 1, 3): 2, (0, 1, 4): 1, (0, 9, 5): 0, (1, 1, 6): 0}  # 110 ends before 110 begins
    assert count(parity=True)[0, 1, 2] == 2 and count(width=3) == count()


def test_reactions(spark):
    looks = [dict(tick_id=k, looker_player_id=1, looked_at_player_id=2) for k in (3, 4, 5, 12, 30)]
    t = log(
        spark, **clock(), visibilities=[marked(101, 110), marked(125, 140)], player_at_tick=[state(k) for k in (1, 25)], lookers=looks, weapon_fire=[dict(tick_id=k, shooter=1) for k in (2, 8, 31)],
        nearest_origin=[dict(tick_id=k, player_id=1, origin_id=5) for k in (1, 25)], cover_origins=[dict(index=5, x=0.0, y=0.0, z=0.0)], cover_edges=[dict(origin_id=5, cluster_id=c) for c in (1, 1, 2)],
        team_looking_at_cover_edge_cluster=[dict(tick_id=1, origin_player_id=1, cover_edge_cluster_id=c) for c in (1, 1)],
    )
    assert [(r.gt, r.look_id, r.running, r.length) for r in sorted(m.q_looks(t).collect(), key=lambda r: r.gt)][:4] == [(103, 1, 0.0, 0.2), (104, 1, 0.1, 0.2), (105, 1, 0.2, 0.2), (112, 2, 0.0, 0.0)]
    out = {r.start_gt: r for r in m.q_react_final(t).collect()}
    assert (out[101].aim_react_s, out[101].fire_react_s, out[101].clusters_covered, out[101].seen_lately) == (0.2, 0.1, 0.5, False)
    assert (out[125].aim_react_s, out[125].fire_react_s, out[125].clusters_covered, out[125].seen_lately) == (-2.2, 0.6, 0.0, True)
    [(n, early, cover)] = got(m.q_react_grouped(t), "num", "preaims", "avg_clusters_covered")
    assert (n, early, cover) == (2, 1, 0.25)
    assert got(m.q_react_split(t), "label", "num") == [("hacks", 2), ("hacks_legit", 2)]


def test_hand_marked_spans_past_the_round(spark):
    t = log(spark, **clock(), visibilities=[marked(1, 2)], visibilities_unadjusted=[marked(118, 123)], spotted=spotted((1, 2), [1, 0, 1], first=1) + spotted((1, 2), [1], first=19), hurt=[dict(id=1, tick_id=19, attacker=1, victim=2), dict(id=2, tick_id=19, attacker=1, victim=2)])
    rows = {(r.demo, r.log_tick_id) for r in m.q_vis_compare(t).collect()}
    assert rows == {("d", 19), (None, 1)}  # what no span takes begins at tick 1
    assert got(m.q_hand_final(t), "round_id", "hand_fire_s", "log_fire_s") == [(1, 0.1, 0.0), (2, 0.1, 0.0)]  # the span lies in both rounds
