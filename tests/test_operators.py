"""Edge cases and properties of operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.functions import scalars as s
from tickframe.operators import behaviour, cleaning, distributions, events, joins, spatial, training, windows
from tickframe.sources import tables


def test_merged_intervals_are_disjoint_and_cover(spark):
    rng = random.Random(1)
    rows = [(k % 3, a := rng.randrange(500), a + rng.randrange(30)) for k in range(200)]
    got = {}
    for r in joins.merge_intervals(spark.createDataFrame(rows, "k long, start long, end long"), ["k"], slack=0).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    for k, spans in got.items():
        spans.sort()
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        inside = {x for a, b in spans for x in range(a, b + 1)}
        assert inside == {x for q, a, b in rows if q == k for x in range(a, b + 1)}


def test_merge_last_end_differs(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 10, 20), (1, 50, 60)], "k long, start long, end long")
    assert [(r.start, r.end) for r in joins.merge_intervals(df, ["k"]).collect()] == [(0, 100)]
    assert sorted((r.start, r.end) for r in joins.merge_intervals(df, ["k"], last_end=True).collect()) == [(0, 20), (50, 60)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_stab_and_overlap_do_not_hang_on_the_width(spark, width):
    rng = random.Random(2)
    spans = [(k, a := rng.randrange(300), a + rng.randrange(40)) for k in range(60)]
    a = spark.createDataFrame(spans, "i long, start long, end long")
    got = joins.stab_join(spark.range(300).withColumnRenamed("id", "p"), a, "p", width=width)
    assert sorted((r.p, r.i) for r in got.collect()) == sorted((p, i) for p in range(300) for i, x, y in spans if x <= p <= y)
    x, y = a.toDF("a", "a_start", "a_end"), a.toDF("b", "b_start", "b_end")
    got = joins.overlap_join(x, y, width=width)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((i, j) for i, p, q in spans for j, t, u in spans if p <= u and t <= q)


def test_engagement_gap_exactly_at_the_limit(spark):
    hurt = spark.createDataFrame([(1, 1, 2, 10, 0), (1, 1, 2, 22, 1), (1, 1, 2, 35, 2), (1, 1, 2, 35, 2)], "round_id long, attacker long, victim long, gt long, tick_id long")
    bounds = spark.createDataFrame([(1, 5, 36)], "round_id long, start_gt long, end_gt long")
    got = sorted((r.start, r.end, r.hits, r.hurt_ids) for r in events.engagements(hurt, bounds, 10, 2).collect())
    assert got == [(5, 24, 2, [0, 1]), (25, 36, 1, [2])]


def test_rest_clusters_hold_all_resting_rows(spark):
    rng = random.Random(6)
    centres = {(team, site): [(300.0 * i, 100.0 * team, 50.0 * site) for i in range(3)] for team in (2, 3) for site in (0, 1)}
    rows, want = [], {}
    for key, own in centres.items():
        for i, c in enumerate(own):
            for j in range(20 + i):
                # a player's first row rests; its second is far off, its third rests beside that
                p = len(rows)
                rows += [(1, p, *key, 0, p, *(v + rng.random() / 10 for v in c)), (1, p, *key, 1, p + 1, 5000.0, 5000.0, 9.0)]
        want[key] = [20, 21, 22]
    rows += [(1, 0, 2, 0, 2, 9999, 5000.5, 5000.0, 9.0)]
    pat = spark.createDataFrame(rows, "round_id long, player long, team int, site int, gt long, tick_id long, x double, y double, z double")
    got = {}
    for r in spatial.rest_clusters(pat, k=4).collect():
        got.setdefault((r.team, r.site), []).append(r.n)
    assert {k: sum(v) for k, v in got.items()} == {k: sum(v) + (k == (2, 0)) for k, v in want.items()}
    assert sorted(got[2, 0]) == [1, 20, 21, 22]


def test_rest_clusters_query_takes_the_whole_table(spark):
    from tickframe.plans import registry
    from tickframe.plans.domain import Tables

    at, last, want = "/root/testdata/sf0.001", {}, {}
    for r in Tables(spark, at).pat.orderBy("gt", "tick_id").collect():
        x, y = last.get((r.round_id, r.player), (r.x, r.y))
        last[r.round_id, r.player] = r.x, r.y
        if math.hypot(r.x - x, r.y - y) < 1:
            want[r.team, r.k % 2] = want.get((r.team, r.k % 2), 0) + 1
    got, clusters = {}, {}
    for r in registry.QUERIES["rest_clusters"](spark, at).collect():
        got[r.team, r.site] = got.get((r.team, r.site), 0) + r.n
        clusters.setdefault((r.team, r.site), set()).add(r.cluster)
    assert got == want and all(len(c) == 50 for c in clusters.values())


def test_peek_clusters_follow_the_points(spark):
    rng = random.Random(7)
    # by coarse cells of 200, 100 and 10: (0, 0, 0), (0, 0, 2), (0, 1, 0), (5, 0, 0); exact x would order otherwise
    centres = [(150.0, 50.0, 5.0), (20.0, 20.0, 900.0), (10.0, 550.0, 5.0), (1100.0, 30.0, 5.0)]
    points = [tuple(v + rng.random() for v in c) for i, c in enumerate(centres) for _ in range(30 + i)]
    got = {r.cluster: r for r in spatial.peek_clusters(spark.createDataFrame(points, "x double, y double, z double"), k=4).collect()}
    assert [got[c].n for c in range(4)] == [30, 31, 32, 33]
    for c in range(4):
        own = np.array([p for p in points if math.dist(p, centres[c]) < 2])
        d = np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1))
        assert got[c].distance_mean == pytest.approx(d.mean()) and got[c].distance_std == pytest.approx(d.std(ddof=1))


def test_peek_query_clusters_all_points(spark):
    from tickframe.plans import registry
    from tickframe.plans.domain import Tables

    at = "/root/testdata/sf0.001"
    got = registry.QUERIES["peek_kmeans"](spark, at).collect()
    assert sum(r.n for r in got) == Tables(spark, at).pat.count() and sorted(r.cluster for r in got) == list(range(24))


def test_simple_paths_of_any_length(spark):
    edges = [(i, i + 1) for i in range(12)] + [(0, 20), (20, 12), (20, 30)]
    links = spark.createDataFrame([(a, b) for e in edges for a, b in (e, e[::-1])], "p long, q long")
    paths = lambda **how: sorted((r.path for r in spatial.simple_paths(links, 0, 12, **how).collect()), key=len)
    assert paths() == [[0, 20, 12], list(range(13))]
    assert paths(avoid=[30]) == paths() and paths(other=30) == [list(range(13))]


def test_support_comes_from_another(spark):
    starts = spark.createDataFrame([(1, 2, 10, 5), (1, 2, 10, 6), (1, 2, 12, 6), (1, 2, 14, 99)], "round_id int, team int, player int, gt int")
    sees = spark.createDataFrame([(1, 2, 10, 7), (1, 2, 10, 8), (1, 2, 12, 9), (1, 3, 11, 6)], "round_id int, team int, player int, gt int")
    got = {(r.player, r.start, r.seconds) for r in behaviour.support_time(starts, sees).collect()}
    assert got == {(10, 5, 4), (12, 6, 1)}  # a player's own sight is no support; one that never comes gives no row


def test_ngrams_within_and_across_players(spark):
    rows = [(p, 10 * p + k, c) for p, cs in ((1, [3, 1, 3, 1]), (2, [1, 1])) for k, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "player int, at int, c int")
    count = lambda keys: {(r.bag, r.prior): r.n for r in distributions.ngram_bags(df, "c", 2, keys, ["at"]).collect()}
    assert count(["player"]) == {("1,3", None): 1, ("1,3", "1,3"): 2, ("1,1", None): 1}
    assert count([]) == {("1,3", None): 1, ("1,3", "1,3"): 2, ("1,1", "1,3"): 1, ("1,1", "1,1"): 1}


def test_parity_of_place_distances_and_grids(spark):
    dist = spark.createDataFrame([(0, d, float(x)) for d, x in enumerate([5, 3, 4, 2, 9, 1])], "src int, dst int, dist double")
    areas = spark.createDataFrame([(d, 7) for d in range(6)], "area int, place int")
    [plain], [parity] = spatial.place_dist(dist, areas).collect(), spatial.place_dist(dist, areas, parity=True).collect()
    assert (plain.closest, plain.dist, plain.median) == (5, 1.0, 3.0) and (parity.closest, parity.dist, parity.median) == (5, 1.0, 9.0)
    grid = lambda *n: spark.createDataFrame([(k, 0, x) for k, x in enumerate(n) if x], "gx int, gy int, n long")
    p, q = np.array([0.25, 0.75, 0.0]), np.array([0.5, 0.25, 0.25])
    [plain], [parity] = distributions.grid_diff(grid(1, 3), grid(2, 1, 1)).collect(), distributions.grid_diff(grid(1, 3), grid(2, 1, 1), parity=True).collect()
    assert plain.tv == parity.tv == 0.5 and parity.kl == pytest.approx(-(q * (np.log(q) - p)).sum()) and plain.kl == pytest.approx((p[:2] * np.log(p[:2] / q[:2])).sum(), abs=1e-6)


def test_key_events_of_a_player(spark):
    rows = [(1, k, f, a, x) for k, (f, a, x) in enumerate([(9.0, True, 0), (0.0, True, 5), (0.05, True, 5), (0.05, False, 5), (3.0, False, 0), (2.0, False, 0)])]
    df = spark.createDataFrame(rows, "player int, at int, since double, alive boolean, x int")
    out = sorted(events.event_detect(df, "since", ["player"], ["at"], small=0.1, inside=F.col("x") == 5).collect(), key=lambda r: r["at"])
    assert [r.new_fire for r in out] == [False, True, False, True, False, False] and [r.dies for r in out] == [False, False, True, False, False, False]
    assert [r.in_area for r in out] == [False, True, True, True, False, False]


def test_wasserstein(spark):
    rows = [("a", float(x)) for x in (1, 2, 3)] + [("b", float(x)) for x in (1, 2, 3)] + [("c", float(x)) for x in (2, 3, 4)]
    got = {r.g: r.distance for r in distributions.emd1d(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a").collect()}
    assert got == {"b": pytest.approx(0), "c": pytest.approx(1)}


def test_shortest_paths_hold_the_triangle(spark):
    edges = [(i, (i * 7 + 3) % 12, 1.0 + i % 4) for i in range(12)] + [(i, (i + 1) % 12, 3.0) for i in range(12)]
    d = {(r.src, r.dst): r.dist for r in spatial.reach_matrix(spark.createDataFrame(edges, "src long, dst long, cost double")).collect()}
    assert len(d) == 144
    assert all(d[a, c] <= d[a, b] + d[b, c] + 1e-9 for a in range(12) for b in range(12) for c in range(12))


def test_sync_ticks_is_greedy(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for k in range(200):
        t += rng.randrange(1, 9)
        rows.append((k % 2, t, k))
    got = sorted(r.tick_id for r in cleaning.sync_ticks(spark.createDataFrame(rows, "round_id long, gt long, tick_id long"), 10).collect())
    want, last = [], {}
    for r, t, k in sorted(rows):
        if r not in last or t - last[r] >= 10:
            want.append(k)
            last[r] = t
    assert got == sorted(want)


def test_segments_restart(spark):
    rows = [(1, t, k) for k, t in enumerate([0, 4, 9, 11, 12, 30, 41])]
    got = sorted((r.segment, r.start, r.end, r.n) for r in events.trajectory_segments(spark.createDataFrame(rows, "p long, gt long, tick_id long"), 10, ["p"]).collect())
    assert got == [(0, 0, 9, 3), (1, 11, 12, 2), (2, 30, 30, 1), (3, 41, 41, 1)]


def test_splits_are_groupwise_and_repeatable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 50)
    once, again = (sorted(map(str, training.split_groups(df, "g").collect())) for _ in range(2))
    assert once == again
    parts = windows.cum_sample_split(df, "g").collect()
    assert len(parts) == 50 and sum(r.is_train for r in parts) == 40


def test_remix_uses_each_defence_once(spark):
    df = spark.range(40).select(F.col("id").alias("i"), (F.col("id") % 2).alias("site"))
    got = cleaning.remix_setups(df.where("i < 25"), df.where("i >= 25"), "site", "i").collect()
    assert sorted(r.def_id for r in got) == list(range(25)) and all((r.def_id - r.off_id) % 2 == 0 for r in got)


def test_slots_are_kept_freed_and_reused(spark):
    rows = [(1, 2, t, p) for t, ps in enumerate(["ab", "abc", "bc", "bcd", "bcde", "e"]) for p in ps]
    df = spark.createDataFrame(rows, "round_id long, team long, tick_id long, player string")
    got = {(r.tick_id, r.player): r.slot for r in cleaning.slot_reuse(df, 3).collect()}
    assert got == {(0, "a"): 0, (0, "b"): 1, (1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "b"): 1, (2, "c"): 2, (3, "b"): 1, (3, "c"): 2, (3, "d"): 0, (4, "b"): 1, (4, "c"): 2, (4, "d"): 0, (5, "e"): 0}


def test_angles(spark):
    row = spark.range(1).select(s.wrap(F.lit(-7.5)).alias("a"), s.wrap_half(F.lit(190.0)).alias("b"), s.angle_delta(F.lit(350.0), F.lit(10.0)).alias("c"), s.safe_div(F.lit(1.0), F.lit(0.0)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (352.5, -170.0, -20.0, None)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "kills.csv").write_text("id,tick_id,killer,victim,weapon,assister,is_headshot,is_wallbang,penetrated_objects\n1,2,3,4,5,\\N,1,0,0\n2,3,\\N,4,5,6,0,1,2\n")
    df = tables.read_table(spark, str(tmp_path / "kills.csv"), "kills")
    rows = df.orderBy("id").collect()
    assert rows[0].assister is None and rows[0].is_headshot is True and rows[1].killer is None and rows[0]._file == "kills.csv"
    tables.save_tables({"kills": df}, str(tmp_path / "out"))
    back = tables.load_tables(spark, str(tmp_path / "out"), ["kills"])["kills"]
    assert {r["n_diff"] for r in cleaning.tables_equal(df, back, ["id"]).collect()} == {0}
    tables.write_csv(back, str(tmp_path / "csv"), ["id", "killer"], ["victim"])
    tables.append_ledger(back.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "ledger"), "one")
    tables.append_ledger(back.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "ledger"), "two")
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "killer", "victim"]
    assert set(tables.table_names()) >= {"rounds", "kills"}


def test_new_files_only(spark, tmp_path):
    src, out, ledger = (str(tmp_path / n) for n in ("in", "out", "ledger"))
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.csv").write_text(f"id,tick_id,stepping_player\n{k},1,1\n")
        tables.read_new_files(spark, src, out, ledger, "footstep")
        assert spark.read.parquet(out).count() == k


#: Queries that run models or streams when they are made; their joins are those of the others.
RUN_AT_ONCE = {"rest_clusters", "peek_kmeans", "log_reg", "st_count", "st_count_sliding", "st_engage", "st_events", "st_evict", "st_fire", "st_aim", "st_replay", "st_reset"}
#: One task sees a row a group (of a few named groups) or a row a range of values here, or only an aggregate's partial rows.
FEW_ROWS = {"sum_diff", "trial_summary", "assign_ids", "cum_sample_split", "remix_setups", "infer_time", "rank_tests", "q_vis_compare"}


@pytest.mark.parametrize("limit", ["-1"])
def test_no_nested_loops_and_no_keyless_windows(spark, limit):
    """Of any query, without broadcasts; what has an equal key then has one with them, too."""
    from tickframe.plans import registry

    loops, keyless, before = [], [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for name in sorted(set(registry.QUERIES) - RUN_AT_ONCE):
            plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            if "CartesianProduct" in plan or "NestedLoop" in plan:
                loops.append(name)
            if "SinglePartition" in plan and "Window" in plan and name not in FEW_ROWS:
                keyless.append(name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert loops == [] and keyless == []


def test_running_sum(spark):
    rows = [(k % 97 * 1.5, k, k % 7) for k in range(3000)]
    out = windows.running_sum(spark.createDataFrame(rows, "v double, k long, n long").repartition(6), ["v", "k"], F.col("n")).collect()
    total, want = 0, {}
    for v, k, n in sorted(rows):
        want[v, k] = total
        total += n
    assert {(r.v, r.k): r.before for r in out} == want
    assert windows.running_sum(spark.createDataFrame([], "v double, n long"), ["v"], F.col("n")).count() == 0
