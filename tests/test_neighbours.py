"""Nearest areas and nearest states against plain searches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import neighbours

BOX = "area long, place long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def boxes(rng, n):
    out = []
    for k in range(n):
        low = [rng.uniform(-300, 300) for _ in range(3)]
        out.append((k, k % 3, *low, *[v + rng.uniform(0, 80) for v in low]))
    return out


def gap(p, box):
    return sum(max(box[2 + i] - p[i], 0, p[i] - box[5 + i]) ** 2 for i in range(3)) ** 0.5


@pytest.mark.parametrize("reach, k", [(5.0, 1), (40.0, 3), (10_000.0, 2), (1.0, 50)])
def test_every_point_has_its_nearest_areas(spark, reach, k):
    rng = random.Random(7)
    areas = boxes(rng, 12)
    areas += [(20, 0, *areas[0][2:])]  # a tie
    points = [(i, *[rng.uniform(-400, 400) for _ in range(3)]) for i in range(60)] + [(90, 1e5, -1e5, 0.0), (91, *areas[0][2:5]), (92, None, 0.0, 0.0)]
    out = neighbours.nearest_areas(spark.createDataFrame(points, "tick_id long, x double, y double, z double"), spark.createDataFrame(areas, BOX), reach, k)
    got = {}
    for r in out.orderBy("tick_id", "rank").collect():
        got.setdefault(r.tick_id, []).append((round(r.distance, 6), r.area))
    want = {i: sorted((round(gap(p, b), 6), b[0]) for b in areas)[:k] for i, *p in points if p[0] is not None}
    assert got == want


def test_nearest_areas_of_nothing(spark):
    none, areas = spark.createDataFrame([], "tick_id long, x double, y double, z double"), spark.createDataFrame(boxes(random.Random(1), 3), BOX)
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "tick_id long, x double, y double, z double")
    assert neighbours.nearest_areas(none, areas, 10.0).count() == 0
    assert neighbours.nearest_areas(one, areas.limit(0), 10.0).count() == 0


def some_states(rng, rounds, ticks):
    """(round, tick, gt, ct, t): players with positions, some dead."""
    out = []
    for r in range(rounds):
        for k in range(ticks):
            alive = {team: sorted(rng.sample(range(5), rng.choice([5, 5, 4, 3]))) for team in "ct"}
            rows = {team: [(p + (10 if team == "t" else 0), *[float(rng.randrange(100)) for _ in range(3)]) for p in alive[team]] for team in "ct"}
            out.append((r, r * ticks + k, k * 2, rows["c"], rows["t"]))
    return out


def plain(states, query, n, left):
    asked = [query["ct"], query["t"]]
    rows = [s for s in states if (len(s[3]), len(s[4])) == (len(asked[0]), len(asked[1]))]
    best = {}
    for r, tick, gt, *teams in rows:
        if max(s[2] for s in rows if s[0] == r) - gt <= left:
            continue
        found = []
        for ours, theirs in zip(asked, teams):
            sums = lambda f: min((sum(f(q, theirs[j][1:]) for q, j in zip(ours, way)), way) for way in itertools.permutations(range(len(ours))))
            round_ = sums(lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5)
            straight = sums(lambda a, b: sum(abs(x - y) for x, y in zip(a, b)))
            found.append((round_[0], [theirs[j][0] for j in round_[1]], [theirs[j][0] for j in straight[1]]))
        row = (found[0][0] + found[1][0], tick, found[0][1] + found[1][1], (found[0][2] + found[1][2])[query["target"]])
        best[r] = min(best.get(r, row), row, key=lambda x: (round(x[0], 9), x[1]))
    return sorted(((round(v[0], 6), r, *v[1:]) for r, v in best.items()))[:n]


def test_knn_state_over_permutations(spark):
    rng = random.Random(3)
    states = some_states(rng, 14, 30)
    spot = lambda: tuple(float(rng.randrange(100)) for _ in range(3))
    queries = [{"ct": [spot() for _ in range(a)], "t": [spot() for _ in range(b)], "target": c} for a, b, c in ((5, 5, 7), (5, 3, 0), (3, 4, 6))]
    side = "array<struct<player long, x double, y double, z double>>"
    df = spark.createDataFrame(states, f"round_id long, tick_id long, gt long, ct {side}, t {side}").withColumn("mapping", F.lit("x")).repartition(5)
    got = neighbours.knn_state(df, queries, n=6, left=5.0)
    for q, query in enumerate(queries):
        rows = [(round(r.distance, 6), r.round_id, r.tick_id, r.mapping, r.target) for r in got.where(F.col("query") == q).orderBy("distance", "round_id").collect()]
        assert rows == plain(states, query, 6, 5.0) and len(rows) == 6
    assert neighbours.knn_state(df.limit(0), queries).count() == 0
    assert neighbours.knn_state(df, [{"ct": [spot()], "t": [spot()], "target": 0}]).count() == 0


def test_team_states(spark):
    rows = [(1, 5, 9, p, 2 + p % 2, p != 3, float(p), 0.0, 1.0) for p in range(4)]
    pat = spark.createDataFrame(rows, "round_id long, tick_id long, gt long, player long, team int, alive boolean, x double, y double, z double")
    r = neighbours.team_states(pat).first()
    assert [p.player for p in r.ct] == [1] and [p.player for p in r.t] == [0, 2]
