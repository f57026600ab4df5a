"""Distribution and team operators over the match tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as d
from ..operators import events as ev
from .domain import query

RP = ["round_id", "player"]


def _r(df, *columns, n=6):
    return df.withColumns({c: F.round(c, n) for c in columns})


@query("hist1d", "SELECT *, n / sum(n) OVER (PARTITION BY team) AS share FROM (SELECT team, floor(x / 7)::BIGINT AS bin, count(*) AS n FROM pat GROUP BY ALL)")
def _(t):
    return d.hist1d(t.pat, "x", 7.0, ["team"])


@query("sim_hist", "SELECT *, n / sum(n) OVER (PARTITION BY kind) AS share FROM (SELECT kind, floor(y / 5)::BIGINT AS bin, count(*) AS n FROM pat GROUP BY ALL)")
def _(t):
    return d.hist1d(t.pat, "y", 5.0, ["kind"])


@query("pct_trim", "SELECT tick_id FROM pat WHERE x BETWEEN (SELECT quantile_cont(x, 0.01) FROM pat) AND (SELECT quantile_cont(x, 0.99) FROM pat)")
def _(t):
    return d.pct_trim(t.pat, "x").select("tick_id")


@query(
    "emd1d",
    "SELECT kind, round(sum(abs(f) * w), 4) AS distance FROM (SELECT kind, x, sum(p) OVER (PARTITION BY kind ORDER BY x) AS f, lead(x) OVER (PARTITION BY kind ORDER BY x) - x AS w FROM (SELECT kind, x, sum(p) AS p FROM (SELECT kind, x, 1.0 / count(*) OVER (PARTITION BY kind) AS p FROM pat WHERE kind <> 'view' UNION ALL SELECT o.kind, v.x, -1.0 / v.n FROM (SELECT x, count(*) OVER () AS n FROM pat WHERE kind = 'view') v, (SELECT DISTINCT kind FROM pat WHERE kind <> 'view') o) GROUP BY kind, x)) GROUP BY kind",
)
def _(t):
    return _r(d.emd1d(t.pat, "x", "kind", "view"), "distance", n=4)


@query(
    "grid_diff",
    "SELECT round(sum(abs(p - q)) / 2, 6) AS tv, round(sum((p + 1e-9) * ln((p + 1e-9) / (q + 1e-9))), 6) AS kl, round((sum((p + 1e-9) * ln((p + 1e-9) / (q + 1e-9))) + sum((q + 1e-9) * ln((q + 1e-9) / (p + 1e-9)))) / 2, 6) AS skl, round(max(sa) / max(sb), 6) AS ratio FROM (SELECT coalesce(a.n, 0) / (SELECT count(*) FROM pat WHERE team = 2) AS p, coalesce(b.n, 0) / (SELECT count(*) FROM pat WHERE team = 3) AS q, (SELECT count(*) FROM pat WHERE team = 2) AS sa, (SELECT count(*) FROM pat WHERE team = 3) AS sb FROM (SELECT floor(x / 10) AS gx, floor(y / 10) AS gy, count(*) AS n FROM pat WHERE team = 2 GROUP BY ALL) a FULL JOIN (SELECT floor(x / 10) AS gx, floor(y / 10) AS gy, count(*) AS n FROM pat WHERE team = 3 GROUP BY ALL) b USING (gx, gy))",
)
def _(t):
    from ..operators.spatial import grid_counts

    return _r(d.grid_diff(grid_counts(t.pat.where("team = 2"), 10.0), grid_counts(t.pat.where("team = 3"), 10.0)), "tv", "kl", "skl", "ratio")


@query("sum_diff", "SELECT kind, k, round(k / max(CASE WHEN kind = 'view' THEN k END) OVER (), 6) AS k_ratio FROM (SELECT kind, sum(k)::BIGINT AS k FROM pat GROUP BY 1)")
def _(t):
    return _r(d.sum_diff(t.pat, "kind", "view", ["k"]), "k_ratio")


@query("lifetime", "SELECT round_id, player, least(40.0, (max(gt) - min(gt)) / 1000.0) AS seconds FROM pat WHERE alive GROUP BY ALL")
def _(t):
    return d.lifetime(t.pat, rate=1000.0)


@query("action_change", "SELECT tick_id, CASE WHEN b = 0 AND weapon = 0 THEN 0 WHEN b = 0 THEN 1 WHEN weapon = 0 AND b <> 0 THEN 2 ELSE 3 END AS change FROM (SELECT *, lag(weapon) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) AS b, row_number() OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) AS i, count(*) OVER (PARTITION BY round_id, player) AS n FROM pat) WHERE i > 6 AND i <= n - 6")
def _(t):
    return d.action_change(t.pat, "weapon", RP, ["gt", "tick_id"]).select("tick_id", "change")


@query("shots_per_kill", "SELECT round_id, player, count(*) FILTER (kind = 'click') / count(*) FILTER (kind = 'purchase') AS ratio FROM pat GROUP BY ALL HAVING count(*) FILTER (kind = 'purchase') > 0")
def _(t):
    return d.shots_per_kill(t.pat)


@query("event_bins", "SELECT floor(x / 9)::BIGINT AS bx, floor(y / 20)::BIGINT AS \"by\", quantile_cont(z, 0.5) AS median, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS iqr FROM pat GROUP BY 1, 2")
def _(t):
    return d.event_bins(t.pat, "x", "y", "z", 9.0, 20.0)


def _formed(t):
    return t.pat.select("round_id", "team", F.floor(F.col("gt") / 3600).alias("at"), (F.col("k") % 4).alias("place"))


_FORMED = "formed AS (SELECT team, places, count(*) AS ticks, count(DISTINCT round_id) AS rounds FROM (SELECT round_id, team, gt // 3600 AS at, string_agg((k % 4)::VARCHAR, ',' ORDER BY k % 4) AS places FROM pat GROUP BY ALL) GROUP BY ALL)"


@query("team_places", "SELECT * FROM formed", _FORMED)
def _(t):
    return d.team_places(_formed(t))


@query("key_places", "SELECT l.team, l.places, coalesce(ticks, 0) AS ticks, coalesce(rounds, 0) AS rounds FROM (VALUES (2, '0,1'), (3, '1,1,2'), (2, '3,3,3,3,3,3')) l(team, places) LEFT JOIN formed f ON f.team = l.team AND f.places = l.places", _FORMED)
def _(t):
    return d.key_places(d.team_places(_formed(t)), t.spark.createDataFrame([(2, "0,1"), (3, "1,1,2"), (2, "3,3,3,3,3,3")], "team int, places string"))


_STATES = "states AS (SELECT round_id, gt // 3600 AS at, count(DISTINCT CASE WHEN alive AND team = 3 THEN player END) AS ct_alive, count(DISTINCT CASE WHEN alive AND team = 2 THEN player END) AS t_alive FROM pat GROUP BY ALL)"


@query("alive_counts", "SELECT ct_alive, t_alive, count(*) AS ticks, count(DISTINCT round_id) AS rounds, count(*) FILTER (at = f) AS starts FROM (SELECT *, min(at) OVER (PARTITION BY round_id) AS f FROM states) GROUP BY ALL", _STATES)
def _(t):
    return d.alive_table(ev.alive_counts_by_tick(t.pat, 3600))


@query("start_counts", "SELECT c AS ct_alive, u AS t_alive, count(round_id) AS rounds FROM range(6) a(c) CROSS JOIN range(6) b(u) LEFT JOIN states ON ct_alive = c AND t_alive = u AND at % 24 = 0 GROUP BY ALL", _STATES)
def _(t):
    return d.start_counts(ev.alive_counts_by_tick(t.pat, 3600).where("at % 24 = 0"))


def _mistakes(t, held):
    places = t.pat.groupBy("round_id", "team", F.floor(F.col("gt") / 3600).alias("at")).agg(F.collect_set((F.col("k") % 4).cast("int")).alias("places"))
    return d.mistakes(places, held)


_MISTAKES = "SELECT team, sum(o)::BIGINT AS opportunities, sum(m)::BIGINT AS mistakes, count(*) FILTER (m > 0) AS rounds FROM (SELECT round_id, team, count(*) FILTER (c) AS o, count(*) FILTER (c AND NOT nx) AS m FROM (SELECT *, lead(c) OVER (PARTITION BY round_id, team ORDER BY at) AS nx FROM (SELECT round_id, team, gt // 3600 AS at, {} AS c FROM pat GROUP BY ALL)) GROUP BY ALL) GROUP BY 1"


@query("mistakes", _MISTAKES.format("bool_or(k % 4 = 0) AND bool_or(k % 4 = 1)"))
def _(t):
    return _mistakes(t, [0, 1])


@query("next_place", _MISTAKES.format("bool_or(k % 4 = 2)"))
def _(t):
    return _mistakes(t, [2])


@query("plant_stats", "SELECT team, count(DISTINCT round_id) AS rounds, count(*) AS ticks, count(*) FILTER (kind = 'click') AS shots, count(*) FILTER (kind = 'purchase') AS kills, count(*) / count(DISTINCT round_id) AS ticks_per_round FROM pat GROUP BY 1")
def _(t):
    return d.plant_stats(t.pat, ["team"])


@query("trial_summary", "SELECT *, round(median - max(CASE WHEN kind = 'view' THEN median END) OVER (), 6) AS delta, round((median - max(CASE WHEN kind = 'view' THEN median END) OVER ()) / max(CASE WHEN kind = 'view' THEN median END) OVER (), 6) AS relative FROM (SELECT kind, quantile_cont(x, 0.5) AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM pat GROUP BY 1)")
def _(t):
    return _r(d.trial_summary(t.pat, "kind", "x", "view"), "iqr", "delta", "relative")


@query("infer_time", "SELECT quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.99) AS p99 FROM pat")
def _(t):
    return d.infer_time(t.pat, "x")


@query(
    "ngram_bags",
    "SELECT bag, prior, count(*) AS n FROM (SELECT *, lag(bag) OVER (PARTITION BY player ORDER BY tick_id) AS prior FROM (SELECT player, tick_id, CASE WHEN b IS NOT NULL THEN least(weapon, b)::VARCHAR || ',' || greatest(weapon, b)::VARCHAR END AS bag FROM (SELECT *, lag(weapon) OVER (PARTITION BY player ORDER BY tick_id) AS b FROM pat))) WHERE bag IS NOT NULL GROUP BY ALL",
)
def _(t):
    return d.ngram_bags(t.pat, "weapon", 2, ["player"], ["tick_id"])


@query("round_cooccur", "SELECT CASE WHEN a AND b THEN 'both' WHEN a OR b THEN 'either' ELSE 'neither' END AS class, count(*) AS rounds FROM (SELECT round_id, bool_or(k = 5) AS a, bool_or(k = 9) AS b FROM pat GROUP BY 1) GROUP BY 1")
def _(t):
    return d.round_cooccur(t.pat, F.col("k") == 5, F.col("k") == 9)


@query("swing_stats", "SELECT player, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(x) AS n FROM pat GROUP BY 1")
def _(t):
    return _r(d.swing_stats(t.pat, "x"), "mean", "std")


@query("recoil_slice", "SELECT tick_id, round(change, 6) AS change FROM (SELECT *, x - lag(x, 3) OVER (PARTITION BY player ORDER BY tick_id) AS change FROM pat) WHERE x BETWEEN 10 AND 60 AND weapon BETWEEN 1 AND 2")
def _(t):
    return _r(d.slice_ranges(t.pat, {"x": (10, 60), "weapon": (1, 2)}, "x", 3, ["player"], ["tick_id"]).select("tick_id", "change"), "change")


@query("mouse_bins", "SELECT floor(dk / 4)::BIGINT AS bin, count(*) AS n FROM (SELECT y - lag(y) OVER (PARTITION BY round_id, player ORDER BY tick_id) AS dk FROM pat) WHERE dk IS NOT NULL GROUP BY 1")
def _(t):
    return d.mouse_bins(t.pat, "y", 1, 4.0, ["round_id", "player"], ["tick_id"])


@query("fitts", "SELECT round_id AS test, round(log2(2 * (end_gt - start_gt)::DOUBLE / nullif((\"end\" - start)::DOUBLE, 0)), 6) AS bits, (SELECT min(tick_id) FROM pat p WHERE p.round_id = r.round_id AND kind = 'click') AS first_shot, (SELECT min(tick_id) FROM pat p WHERE p.round_id = r.round_id AND kind = 'error') AS first_hit FROM rounds r")
def _(t):
    tests = t.rounds.select(F.col("round_id").alias("test"), (F.col("end_gt") - F.col("start_gt")).cast("double").alias("far"), (F.col("end") - F.col("start")).cast("double").alias("wide"))
    e = t.pat.select(F.col("round_id").alias("test"), F.when(F.col("kind") == "click", "shot").when(F.col("kind") == "error", "hit").alias("name"), F.col("tick_id").alias("at"))
    return _r(d.fitts(tests, e, "far", "wide"), "bits")


@query("survey_parse", "SELECT id, position, item FROM (SELECT tick_id AS id, unnest(['a' || k % 3, kind, 'z']) AS item, unnest([0, 1, 2]) AS position FROM pat WHERE k % 2 = 0)")
def _(t):
    said = F.when(F.col("k") % 2 == 0, F.concat(F.lit("my rank: a"), F.col("k") % 3, F.lit(" > "), "kind", F.lit(">z"))).otherwise("none")
    return d.survey_parse(t.pat.select(F.col("tick_id").alias("id"), said.alias("answer")))


@query(
    "rank_tests",
    "SELECT team, n, round(mean, 6) AS mean, round(mean_rank, 4) AS mean_rank, round(sum(n * power(mean_rank - (nn + 1) / 2, 2)) OVER () * 12 / (nn * (nn + 1)) / (1 - ties / (nn * nn * nn - nn)), 4) AS h FROM (SELECT team, count(*) AS n, avg(k) AS mean, avg(r) AS mean_rank, max(nn) AS nn, max(ties) AS ties FROM (SELECT team, k, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2 AS r, (SELECT count(*)::DOUBLE FROM pat) AS nn, (SELECT sum(c * c * c - c)::DOUBLE FROM (SELECT count(*)::DOUBLE AS c FROM pat GROUP BY k)) AS ties FROM pat) GROUP BY team)",
)
def _(t):
    out = d.rank_tests(t.pat, "k", "team")
    return _r(_r(out, "mean"), "mean_rank", "h", n=4)


@query("near_hit_speed", "SELECT \"within\", floor(x / 10)::BIGINT AS bin, count(*) AS n FROM (SELECT x, gt - max(CASE WHEN kind = 'error' THEN gt END) OVER (PARTITION BY player ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING) AS since FROM pat), (VALUES (600.0), (3600.0)) w(\"within\") WHERE since <= \"within\" GROUP BY ALL")
def _(t):
    from ..operators.windows import since_flags

    rows = since_flags(t.pat, {"hit": F.col("kind") == "error"}, ["player"], ["gt", "tick_id"])
    return d.near_event_bins(rows, "since_hit", "x", [600.0, 3600.0], 10.0)


@query("region_filter", "SELECT tick_id FROM (SELECT *, bool_or(x < 5 AND team = 2) OVER (PARTITION BY round_id, gt // 3600) AS i FROM pat) WHERE i")
def _(t):
    rows = t.pat.withColumn("at", F.floor(F.col("gt") / 3600))
    return d.region_filter(rows, F.col("x") < 5, F.col("team") == 2, ["round_id", "at"]).select("tick_id")


@query("region_alive", "SELECT round_id, gt // 3600 AS at, count(DISTINCT CASE WHEN alive THEN player END) AS n_alive FROM pat GROUP BY ALL HAVING bool_or(x < 20) AND count(DISTINCT CASE WHEN alive THEN player END) IN (3, 4, 5)")
def _(t):
    return d.region_alive(t.pat.withColumn("at", F.floor(F.col("gt") / 3600)), F.col("x") < 20, [3, 4, 5])


@query("metric_mean", "SELECT kind, avg(CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END) AS mean FROM pat GROUP BY 1")
def _(t):
    return t.pat.groupBy("kind").agg(F.avg(F.when(F.col("x") > 50, 1.0).otherwise(0.0)).alias("mean"))


_LAST = """ends AS (SELECT *, gt // 1800 AS half FROM pat QUALIFY row_number() OVER (PARTITION BY round_id, gt // 1800, player ORDER BY gt DESC, tick_id DESC) = 1),
gaps AS (SELECT a.round_id, a.half, a.player, a.x, a.y, a.team = b.team AS mate, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS d
  FROM ends a JOIN ends b ON a.round_id = b.round_id AND a.half = b.half AND a.player <> b.player AND a.alive AND b.alive GROUP BY ALL),
covered AS (SELECT DISTINCT floor(x / 25)::BIGINT AS gx, floor(y / 25)::BIGINT AS gy FROM pat WHERE weapon < 3)"""


@query("dist_heat", "SELECT c.gx, c.gy, m.mate, round(avg(d), 6) AS mean, count(d) AS n FROM covered c CROSS JOIN (VALUES (true), (false)) m(mate) LEFT JOIN gaps g ON floor(g.x / 25)::BIGINT = c.gx AND floor(g.y / 25)::BIGINT = c.gy AND g.mate = m.mate AND d < 80 GROUP BY ALL", _LAST)
def _(t):
    half = t.pat.withColumn("at", F.floor(F.col("gt") / 1800))
    last = half.groupBy("round_id", "at", "player").agg(F.max(F.struct("gt", "tick_id", "team", "alive", "x", "y", "z")).alias("s")).select("round_id", "at", "player", "s.*")
    cells = t.pat.where("weapon < 3").select(F.floor(F.col("x") / 25).alias("gx"), F.floor(F.col("y") / 25).alias("gy"))
    heat = lambda mate: d.nearest_player_heat(last, 25.0, ("round_id", "at"), mate, 80.0, cells).withColumn("mate", F.lit(mate))
    return _r(heat(True).unionByName(heat(False)), "mean")


@query("coverage", "SELECT floor(x / 2)::BIGINT AS gx, floor(y / 2)::BIGINT AS gy, count(*) AS n FROM pat WHERE alive GROUP BY 1, 2")
def _(t):
    from ..operators.spatial import grid_counts

    return grid_counts(t.pat.where("alive"), 2.0)


@query("eval_ranges", 'SELECT p.tick_id FROM pat p WHERE EXISTS (SELECT 1 FROM grenades g WHERE p.tick_id BETWEEN g.start AND g."end" AND g.kind4 = 2)')
def _(t):
    return d.eval_ranges(t.pat.select("tick_id"), t.grenades.where("kind4 = 2"), "tick_id", 64)


@query("nearest_mask", 'SELECT p.tick_id FROM pat p WHERE EXISTS (SELECT 1 FROM grenades g WHERE g.round_id = p.round_id AND p.tick_id BETWEEN g.start AND g."end")')
def _(t):
    return d.eval_ranges(t.pat.select("round_id", "tick_id"), t.grenades, "tick_id", 64, ["round_id"]).select("tick_id")
