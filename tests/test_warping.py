"""Warping against plain recursions, and the cascade of bounds against all pairs."""

import itertools
import math
import random

import numpy as np
import pytest

from tickframe.operators import trajectories, warping


def plain_cost(d, steps):
    n, m = d.shape
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways = [cost[i - a, j - b] + sum(w * d[i - 1 - c, j - 1 - e] for c, e, w in paid) for (a, b), paid in steps if a <= i and b <= j]
            cost[i, j] = min(ways, default=np.inf)
    return cost


@pytest.mark.parametrize("steps", [warping.FREE, warping.SLOPE])
def test_warp_of_many_is_the_plain_one(steps, monkeypatch):
    monkeypatch.setattr(warping, "CELLS", 300)
    rng = np.random.default_rng(5)
    gaps = [rng.random((rng.integers(1, 12), rng.integers(1, 12))) for _ in range(60)]
    seen = set()
    for k, cost, option in warping.swept(gaps, steps):
        n, m = gaps[k].shape
        seen.add(k)
        assert cost[: n + 1, : m + 1] == pytest.approx(plain_cost(gaps[k], steps), nan_ok=True)
        way = warping.matched(cost, option, n, m, steps)
        if np.isinf(cost[n, m]):
            assert way == []
            continue
        paid, (i, j) = 0.0, (0, 0)
        for x, y in way:  # each hop is a step of the pattern, and together they cost what the corner says
            here = min((sum(w * gaps[k][x - c, y - e] for c, e, w in cells), o) for o, ((a, b), cells) in enumerate(steps) if (a, b) == (x + 1 - i, y + 1 - j))
            paid, i, j = paid + here[0], x + 1, y + 1
        assert (i, j) == (n, m) and paid == pytest.approx(cost[n, m])
        assert warping.matched(cost, option, n, m, steps, parity=True)[-1] == [n - 1, m - 1]
        if steps is warping.FREE:
            assert warping.matched(cost, option, n, m, steps, parity=True) == way
    assert seen == set(range(60))


def test_dtw_properties():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.normal(size=(9, 2)), rng.normal(size=(7, 2))
        assert warping.dtw_cost(a, a) == 0 and warping.dtw_cost(a, a, warping.SLOPE) == 0
        assert warping.dtw_cost(a, b) == pytest.approx(warping.dtw_cost(b, a))
        assert warping.dtw_cost(a, b) <= warping.dtw_cost(a, b, warping.SLOPE) + 1e-12
    assert warping.dtw_cost(np.zeros((2, 2)), np.zeros((9, 2)), warping.SLOPE) == np.inf


def test_dtw_of_rows(spark):
    point = "array<struct<x double, y double>>"
    rows = [(1, [(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)]), (2, [], [(0.0, 0.0)]), (3, None, [(0.0, 0.0)]), (4, [(0.0, 0.0)], [(3.0, 4.0)])]
    out = {r.k: r for r in warping.dtw(spark.createDataFrame(rows, f"k long, path_a {point}, path_b {point}")).collect()}
    assert (out[1].dtw, out[1].matched) == (0.0, [[0, 0], [0, 1], [1, 2]])
    assert out[2].dtw is None and out[3].matched is None and (out[4].dtw, out[4].matched) == (2.5, [[0, 0]])


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = (int(rng.integers(0, 3)), int(rng.integers(1, 3)))
        rounds = [[[np.cumsum(rng.normal(size=(int(rng.integers(1, 30)), 2)), axis=0) + 5 * rng.normal(size=2) for _ in range(s)] for s in sizes] for _ in range(2)]
        us, them = map(warping.even, rounds)
        a, b = warping.signature(us), warping.signature(them)
        _, mapping = warping.map_players(a[0], b[0], sizes)
        ours, theirs = (np.concatenate([x for x in side if len(x)]) for side in (us, them))
        gaps = sum(warping.distances(p, q) for p, q in zip(ours, theirs[mapping]))
        low, middle = warping.coarse_bound(a, b, mapping), warping.fine_bound(gaps)
        for steps in (warping.FREE, warping.SLOPE):
            assert low <= middle + 1e-9 <= warping.warp(gaps[None], steps)[0][0, -1, -1] / sum(gaps.shape) + 2e-9


def ade(a, b):
    return sum(math.dist(a[(len(a) - 1) * c // 10], b[(len(b) - 1) * c // 10]) for c in range(11)) / 22


def _plain_sim(rounds, k=6):
    """pred -> the costs of its k best, over all players' mappings and all rounds of equal team sizes."""
    at = lambda p, i: p[min(i, len(p) - 1)]
    best = {}
    for i, (us, us_t) in rounds.items():
        found = []
        for j, (them, them_t) in rounds.items():
            if i == j or len(us) != len(them) or len(us_t) != len(them_t):
                continue
            n, m = max(map(len, us + us_t)), max(map(len, them + them_t))
            ways = [(us + us_t, list(a) + list(b)) for a in itertools.permutations(them) for b in itertools.permutations(them_t)]
            ade = lambda w: sum(math.dist(at(p, (n - 1) * c // 10), at(q, (m - 1) * c // 10)) for p, q in zip(*w) for c in range(11))
            w = min(ways, key=ade)
            d = np.array([[sum(math.dist(at(p, x), at(q, y)) for p, q in zip(*w)) for y in range(m)] for x in range(n)])
            cost = np.full((n + 1, m + 1), np.inf)
            cost[0, 0] = 0
            for x, y in itertools.product(range(n), range(m)):
                cost[x + 1, y + 1] = min(cost[x, y] + d[x, y], cost[x, y + 1] + d[x, y], cost[x + 1, y] + d[x, y])
            found.append(cost[n, m] / (n + m))
        best[i] = sorted(found)[:k]
    return {i: c for i, c in best.items() if c}


def test_sim_join_against_all_pairs(spark):
    # round 0's only match in DTW has other timing, and 40 rounds come before it by ADE
    late = lambda n, e: [(0.0, e)] * n + [(10.0 * x, e) for x in range(11)]
    paths = {0: late(0, 0.0), 41: late(60, 0.0)} | {r: [(10.0 * x, 15.0 + r / 10) for x in range(11)] for r in range(1, 41)}
    rows = [(r, 2, 0, i, i, True, *p) for r, path in paths.items() for i, p in enumerate(path)]
    rng = random.Random(5)
    more = {r: ([[(rng.random(), rng.random()) for _ in range(rng.randrange(1, 6))] for _ in range(2 + r % 2)], [[(rng.random(), rng.random())] * 3 for _ in range(2)]) for r in range(100, 112)}
    rows += [(r, team, k, i, i, True, *p) for r, sides in more.items() for team, side in zip((3, 2), sides) for k, path in enumerate(side) for i, p in enumerate(path)]
    pat = spark.createDataFrame(rows, "round_id long, team int, player int, gt long, tick_id long, alive boolean, x double, y double")
    rounds = warping.multi_trajectories(trajectories.make_trajectories(pat, ("round_id", "team", "player")))
    got = {}
    for r in sorted(warping.sim_join(rounds, rounds).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.pred, []).append(r)
    assert got[0][0].truth == 41 and sum(ade(paths[0], paths[r]) < got[0][0].ade for r in range(1, 41)) > 24
    want = _plain_sim({r: ([], [p]) for r, p in paths.items()} | more)
    assert set(got) == set(want) and all([r.dtw for r in got[i]] == pytest.approx(want[i]) for i in want)


def test_sim_join_query_searches_every_round(spark):
    from tickframe.plans import registry
    from tickframe.plans.domain import Tables

    at = "/root/testdata/sf0.001"
    sides = {}
    for r in trajectories.make_trajectories(Tables(spark, at).pat, ("round_id", "team", "player")).collect():
        sides.setdefault(r.round_id, ([], []))[3 - r.team].append([(p.x, p.y) for p in r.path])
    sizes = [tuple(map(len, s)) for s in sides.values()]
    got = {}
    for r in registry.QUERIES["sim_join"](spark, at).collect():
        got.setdefault(r.pred, []).append(r.truth)
    assert {i: len(v) for i, v in got.items()} == {i: min(6, sizes.count(tuple(map(len, s))) - 1) for i, s in sides.items() if sizes.count(tuple(map(len, s))) > 1}


def test_few_pairs_are_warped(spark):
    rng = random.Random(2)
    rows = []
    for r in range(150):  # twenty-five kinds of rounds, six of each
        kind = r % 25
        for team, player in ((3, 1), (3, 2), (2, 11)):
            x, y = 400.0 * (kind % 5) + 30 * player, 400.0 * (kind // 5)
            for k in range(rng.randrange(20, 40)):
                rows.append((r, team, player, k, k, True, x + 3 * k + rng.random(), y + 5 * rng.random()))
    pat = spark.createDataFrame(rows, "round_id long, team int, player int, gt long, tick_id long, alive boolean, x double, y double")
    rounds = warping.multi_trajectories(trajectories.make_trajectories(pat, ("round_id", "team", "player"))).cache()
    for slope in (False, True):
        costs = warping.sim_search(rounds, rounds, k=5, per_block=16, slope=slope)
        share = costs.where("dtw IS NOT NULL").count() / (150 * 149)
        found = {(r.pred, r.rank): r for r in warping.sim_join(rounds, rounds, k=5, per_block=16, slope=slope).collect()}
        assert share < 0.1 and len(found) == 750
        assert all(r.pred % 25 == r.truth % 25 for r in found.values())
    rounds.unpersist()


def test_no_rounds(spark):
    none = spark.createDataFrame([], "id long, ct array<array<double>>, t array<array<double>>, time long, length double, n_ct int, n_t int")
    assert warping.sim_join(none, none).count() == 0
