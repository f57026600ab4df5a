"""Carried flags, periods, moving groups and spreading grids against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import cleaning, events, spatial


def test_holding_is_carried(spark):
    rng = random.Random(4)
    rows = [(r, p, k, 10 * k, float(rng.choice([0, 0.4, 1, 1, 2, 2, 3])), rng.random() < 0.1 if rng.random() < 0.9 else None, rng.random() < 0.2) for r in range(3) for p in range(4) for k in range(60)]
    hits = [(5, 1, 9), (5, 1, 8), (5, 1, 9), (6, None, 3), (7, 99, 1)]
    pat = spark.createDataFrame(rows, "round_id long, player long, tick_id long, gt long, recoil double, reloading boolean, fires boolean").repartition(3)
    got = {(r.round_id, r.player, r.tick_id): r for r in events.fire_history(pat, F.col("fires"), spark.createDataFrame(hits, "tick_id long, attacker long, victim long")).collect()}
    for key, own in itertools.groupby(rows, key=lambda r: r[:2]):
        held, before, shot, holds, shots = False, None, None, None, 0
        for _, _, tick, gt, recoil, reloading, fires in own:
            held = before is not None and not reloading and recoil > 0.5 and (recoil > before or (recoil == before and held))
            before, shot, holds, shots = recoil, gt if fires else shot, gt if held else holds, shots + fires
            r = got[(*key, tick)]
            since = lambda at: None if at is None else gt - at  # noqa: B023, E731
            assert (r.holding, r.since_fire, r.since_hold, r.shots) == (held, since(shot), since(holds), shots)
            assert (r.hit, r.victims) == ((True, [8, 9]) if (key[1], tick) == (1, 5) else (False, []))
    assert len(got) == len(rows)


def plain_periods(rounds, half, half_ot):
    """rounds: (ct wins, t wins) in order; (index, period, half) of what stays."""

    def search(last, begin, h):
        fs = fe = cand = ss = se = None
        for i in range(last + 1, len(rounds)):
            c, t = (x - begin for x in rounds[i])
            if c == t == 0 or cand is None:
                cand = i
            if c + t + 1 == h:
                fs, fe = cand, i
        cand = None
        for i in range(len(rounds)):
            c, t = (x - begin for x in rounds[i])
            if c + t == h:
                cand = i
            if (c == h or t == h) and (c < h or t < h):
                ss, se = cand, i
        return fs, fe, ss, se

    out = [search(-1, 0, half)]
    if None in out[0]:
        return []
    for n in itertools.count():
        new = search(out[-1][3], half + n * half_ot, half_ot)
        if new[3] is None:
            break
        out.append(new)
    return [(i, p, k) for p, x in enumerate(out) if None not in x for k in (0, 1) for i in range(x[2 * k], x[2 * k + 1] + 1)]


def a_game(rng, half, half_ot):
    """A game with restarts, a broken first round and overtimes, now and then."""
    rows, ct, t = [], 0, 0
    if rng.random() < 0.3:
        rows.append((rng.randrange(0, 3), 1))
    target = half + 1
    for _ in range(90):
        if rng.random() < 0.03 and len(rows) < 12:
            ct = t = 0  # played again
        if rng.random() > 0.02:
            rows.append((ct, t))
        ct, t = (ct + 1, t) if rng.random() < 0.5 else (ct, t + 1)
        if ct == t == target - 1:
            target += half_ot
        if max(ct, t) == target:
            break
    return rows


def test_periods(spark):
    rng = random.Random(8)
    games = [a_game(rng, 5, 2) for _ in range(150)] + [[], [(0, 0)]]
    rows = [(g, 100 * g + i, *r) for g, game in enumerate(games) for i, r in enumerate(game)]
    out = cleaning.period_detect(spark.createDataFrame(rows, "game_id long, start long, ct_wins long, t_wins long").repartition(4), half=5, half_overtime=2)
    got = sorted((r.game_id, r.start % 100, r.period, r.half) for r in out.collect())
    want = sorted((g, *x) for g, game in enumerate(games) for x in plain_periods(game, 5, 2))
    assert got == want and {x[2] for x in want} >= {0, 1, 2} and len({x[0] for x in want}) > 60
    assert cleaning.period_detect(spark.createDataFrame([], "game_id long, start long, ct_wins long, t_wins long")).count() == 0


def plain_groups(stood, n, box, steps):
    """stood: {(round, at): {player: (x, y)}}."""
    found = {}
    for (r, at), here in stood.items():
        for p in here:
            stay = [q for q in here if q > p and all(p in (now := stood.get((r, at + s), {})) and q in now and all(abs(a - b) < box for a, b in zip(now[p], now[q])) for s in range(steps))]
            if len(stay) >= n - 1:
                found[r, p, at] = sorted(stay)
    out = []
    for (r, p, at), stay in sorted(found.items()):
        if found.get((r, p, at - 1)) == stay:
            continue
        end = at
        while found.get((r, p, end + 1)) == stay:
            end += 1
        out.append((r, p, stay, at, end + steps - 1))
    return sorted(out)


def test_groups_over_cell_edges(spark):
    rng = random.Random(6)
    stood, rows, tick = {}, [], 0
    for r in range(3):
        at = {p: [rng.uniform(0, 120), rng.uniform(0, 120)] for p in range(7)}
        for k in range(40):
            for p, xy in at.items():
                xy[0], xy[1] = xy[0] + rng.uniform(-9, 9), xy[1] + rng.uniform(-9, 9)
                if rng.random() < 0.95:
                    stood.setdefault((r, k), {})[p] = tuple(xy)
                    rows += [(r, tick, 10 * k, p, 0.0, 0.0), (r, tick + 1, 10 * k + 3, p, *xy)]  # the later row of the step counts
                    tick += 2
    rows += [(9, tick + k, 10 * k, p, x, 0.0) for k in range(4) for p, x in enumerate((38.0, 39.5, 41.0))]
    for k in range(4):
        stood[9, k] = {p: (x, 0.0) for p, x in enumerate((38.0, 39.5, 41.0))}
    pat = spark.createDataFrame(rows, "round_id long, tick_id long, gt long, player long, x double, y double").repartition(3)
    groups = spatial.group_move(pat, 3, 40.0, 10, 4)
    got = sorted((r.round_id, r.source, r.companions, r.start, r.end) for r in groups.collect())
    assert got == plain_groups(stood, 3, 40.0, 4) and (9, 0, [1, 2], 0, 3) in got and len(got) > 10
    first, second = (lambda p: p[0] < 70), (lambda p: p[0] > 50)
    want = []
    for r, p, stay, a, b in got:
        there = lambda test, k: all(test(stood[r, k][q]) for q in (p, *stay))  # noqa: B023, E731
        t1 = next((k for k in range(a, b + 1) if there(first, k)), None)
        t2 = next((k for k in range(t1 + 1, b + 1) if there(second, k)), None) if t1 is not None else None
        if t2 is not None:
            want.append((r, p, stay, a, b, t1, t2))
    seen = spatial.region_sequence(pat, F.col("x") < 70, F.col("x") > 50, ["round_id"], groups=groups, every=10)
    assert sorted((r.round_id, r.source, r.companions, r.start, r.end, r.t1, r.t2) for r in seen.collect()) == sorted(want)


@pytest.mark.parametrize("decay, floor, steps", [(0.9, 0, 2), (0.993, 30, 1), (0.8, 5, None)])
def test_spread(spark, decay, floor, steps):
    rng = random.Random(2)
    size = 14
    bounds = {(x, y) for x in range(size) for y in range(size) if rng.random() < 0.9}
    barrier = {(7, y) for y in range(size) if y != 3} | {(x, 20) for x in range(3)}
    now = {(2, 2): 255, (11, 12): 60, (30, 30): 100, (5, 5): 0}
    ints = lambda cells: spark.createDataFrame([(*c,) for c in cells], "gx long, gy long")
    grid = spark.createDataFrame([(*c, v) for c, v in now.items()], "gx long, gy long, n int")
    out = spatial.grid_spread(grid, ints(bounds), ints(barrier), decay, floor, steps=steps)
    before, done = None, 0
    while done != steps and now != before:
        before, done = now, done + 1
        after = {}
        for x, y in bounds - barrier:
            v = max([now.get((x, y), 0)] + [int(now.get((x + a, y + b), 0) ** decay) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)])
            if v:
                after[x, y] = floor if v < floor else max(floor, int(v**decay))
        now = {c: v for c, v in after.items() if v}
    assert {(r.gx, r.gy): r.value for r in out.collect()} == now and now
