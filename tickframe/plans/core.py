"""Window, interval and join operators bound to the match tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import windows as w
from .domain import Tables, query

RP = ["round_id", "player"]
GP = ["gt", "tick_id"]


@query("fk_join", "SELECT tick_id, player, number, winner FROM pat JOIN rounds USING (round_id)")
def _(t: Tables):
    return j.fk_join(t.pat, (t.rounds, "round_id")).select("tick_id", "player", "number", "winner")


@query("range_index", "SELECT r.round_id, min(tick_id) AS min_id, max(tick_id) AS max_id FROM rounds r LEFT JOIN kills k USING (round_id) GROUP BY 1")
def _(t):
    return j.range_index(t.rounds, t.kills.withColumnRenamed("round_id", "r"), "round_id", "r", "tick_id")


@query("interval_build", 'SELECT tick_id, least(start, CASE WHEN "end" % 3 > 0 THEN "end" END) AS start, greatest(start, CASE WHEN "end" % 3 > 0 THEN "end" END) AS "end" FROM grenades')
def _(t):
    g = t.grenades.select("tick_id", F.col("start").alias("a"), F.when(F.col("end") % 3 > 0, F.col("end")).otherwise(-1).alias("b"))
    return j.interval_build(g, ["a", "b"]).select("tick_id", "start", "end")


@query("stab_join", 'SELECT p.tick_id AS tick, g.tick_id AS grenade FROM pat p JOIN grenades g ON p.tick_id BETWEEN g.start AND g."end"')
def _(t):
    points, spans = t.pat.select(F.col("tick_id").alias("tick")), t.grenades.select(F.col("tick_id").alias("grenade"), "start", "end")
    return j.stab_join(points, spans, "tick", width=64).select("tick", "grenade")


_A = "a AS (SELECT tick_id AS a, start AS s, \"end\" AS e FROM grenades WHERE kind4 = 0), b AS (SELECT tick_id AS b, start AS t, \"end\" AS f FROM grenades WHERE kind4 = 1)"


def _overlap(t, closed):
    a = t.grenades.where("kind4 = 0").select(F.col("tick_id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = t.grenades.where("kind4 = 1").select(F.col("tick_id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return j.overlap_join(a, b, closed=closed, width=64).select("a", "b")


@query("overlap_join", "SELECT a, b FROM a JOIN b ON s <= f AND t <= e", _A)
def _(t):
    return _overlap(t, True)


@query("overlap_join_half_open", "SELECT a, b FROM a JOIN b ON s < f AND t < e", _A)
def _(t):
    return _overlap(t, False)


@query("band_self_join", "SELECT k.tick_id AS kill_tick, p.tick_id AS state_tick FROM kills k JOIN pat p ON p.player = k.killer AND p.tick_id BETWEEN k.tick_id - 20 AND k.tick_id + 20")
def _(t):
    e = t.kills.select(F.col("tick_id").alias("kill_tick"), F.col("killer").alias("player"))
    return j.band_join(e, t.pat.select(F.col("tick_id").alias("state_tick"), "player"), "kill_tick", "state_tick", 20, 20, ["player"]).select("kill_tick", "state_tick")


@query("lookback_join", "SELECT k.tick_id AS kill_tick, f.tick_id AS fire_tick FROM kills k JOIN fire f ON f.player = k.killer AND f.gt BETWEEN k.gt - 7200 AND k.gt")
def _(t):
    e = t.kills.select(F.col("tick_id").alias("kill_tick"), F.col("gt").alias("at"), F.col("killer").alias("player"))
    s = t.fire.select(F.col("tick_id").alias("fire_tick"), F.col("gt").alias("state"), "player")
    return j.band_join(e, s, "at", "state", 7200, 0, ["player"]).select("kill_tick", "fire_tick")


@query("theta_pair", "SELECT DISTINCT a.round_id, a.player AS p1, b.player AS p2 FROM pat a JOIN pat b USING (round_id) WHERE a.player < b.player")
def _(t):
    return j.theta_pairs(t.pat, ["round_id"], "player")


@query("cross_event_self", "SELECT DISTINCT a.round_id, a.weapon, a.attacker AS a1, b.attacker AS a2 FROM hurt a JOIN hurt b USING (round_id, weapon) WHERE a.attacker < b.attacker")
def _(t):
    return j.cross_event_pairs(t.hurt, ["round_id", "weapon"])


@query("next_round_join", "SELECT a.tick_id, b.tick_id AS next_tick_id, a.killer FROM kills a JOIN kills b ON a.killer = b.killer AND b.round_id = a.round_id + 1")
def _(t):
    return j.next_round_join(t.kills, t.kills.select("round_id", "killer", "tick_id"), ["killer"]).select("tick_id", "next_tick_id", "killer")


@query("left_event_join", "SELECT p.tick_id, p.player, k.tick_id AS kill_tick, CASE WHEN k.tick_id IS NULL THEN NULL WHEN k.killer = p.player THEN 'killer' ELSE 'victim' END AS role FROM pat p LEFT JOIN kills k ON p.tick_id = k.tick_id AND (p.player = k.killer OR p.player = k.victim)")
def _(t):
    k = t.kills.select("tick_id", "killer", "victim", F.col("tick_id").alias("kill_tick"))
    return j.left_event_join(t.pat.select("tick_id", "player"), k, ["killer", "victim"], ["tick_id"]).select("tick_id", "player", "kill_tick", "role")


@query("right_range_join", 'SELECT g.tick_id, min(f.tick_id) AS first_fire FROM grenades g LEFT JOIN fire f ON f.tick_id BETWEEN g.start AND g."end" GROUP BY 1')
def _(t):
    return j.right_range_join(t.grenades.select("tick_id", "start", "end"), t.fire.select(F.col("tick_id").alias("fire")), "start", "end", "fire", [], 64).select("tick_id", "first_fire")


@query("full_range_join", "SELECT k.tick_id AS kill_tick, f.tick_id AS hurt_tick FROM kills k FULL JOIN hurt f ON f.attacker = k.killer AND f.round_id = k.round_id AND f.gt BETWEEN k.gt - 3600 AND k.gt + 3600")
def _(t):
    k = t.kills.select("round_id", F.col("killer").alias("player"), (F.col("gt") - 3600).alias("lo"), (F.col("gt") + 3600).alias("hi"), F.col("tick_id").alias("kill_tick"))
    h = t.hurt.select("round_id", F.col("attacker").alias("player"), "gt", F.col("tick_id").alias("hurt_tick"))
    return j.full_range_join(k, h, "lo", "hi", "gt", "kill_tick", "hurt_tick", RP, 7200).select("kill_tick", "hurt_tick")


@query("asof_prev", "SELECT p.tick_id, p.player, max(f.tick_id) AS prev_fire FROM pat p LEFT JOIN fire f ON f.player = p.player AND f.tick_id <= p.tick_id GROUP BY ALL")
def _(t):
    return w.asof_prev(t.pat.select("tick_id", "player").distinct(), t.fire.select("tick_id", "player", F.col("tick_id").alias("fire")), ["player"], "tick_id", ["fire"], few_keys=True)


@query("asof_next", "SELECT p.tick_id, p.player, min(f.tick_id) AS next_fire FROM pat p LEFT JOIN fire f ON f.player = p.player AND f.tick_id >= p.tick_id GROUP BY ALL")
def _(t):
    return w.asof_next(t.pat.select("tick_id", "player").distinct(), t.fire.select("tick_id", "player", F.col("tick_id").alias("fire")), ["player"], "tick_id", ["fire"], few_keys=True)


@query("semi_rounds", "SELECT tick_id FROM pat WHERE round_id IN (SELECT round_id FROM rounds WHERE winner = 2)")
def _(t):
    return j.semi(t.pat, t.rounds.where("winner = 2"), ["round_id"]).select("tick_id")


@query("anti_grenade", 'SELECT round_id FROM rounds r WHERE "end" - start > 10 AND NOT EXISTS (SELECT 1 FROM grenades g WHERE g.round_id = r.round_id AND kind4 = 1 AND thrower = 3)')
def _(t):
    return j.quiet_rounds(t.rounds, t.grenades.where("kind4 = 1 AND thrower = 3"), 10).select("round_id")


@query("first_per_group_merge", "SELECT tick_id, min(gt) OVER (PARTITION BY round_id, player) AS first_gt, count(*) OVER (PARTITION BY round_id, player) AS n FROM pat")
def _(t):
    return j.with_group(t.pat, RP, {"first_gt": F.min("gt"), "n": F.count(F.lit(1))}).select("tick_id", "first_gt", "n")


@query("union_tag", "SELECT DISTINCT round_id, player, 'fire' AS tag FROM fire UNION SELECT DISTINCT round_id, killer, 'kill' FROM kills UNION SELECT DISTINCT round_id, victim, 'hurt' FROM hurt")
def _(t):
    return j.union_tag({"fire": t.fire.select("round_id", "player"), "kill": t.kills.select("round_id", F.col("killer").alias("player")), "hurt": t.hurt.select("round_id", F.col("victim").alias("player"))})


@query("concat", "SELECT tick_id, player, NULL::BIGINT AS victim FROM fire UNION ALL SELECT tick_id, NULL, victim FROM hurt")
def _(t):
    return j.concat([t.fire.select("tick_id", "player"), t.hurt.select("tick_id", "victim")])


@query("set_diff", "SELECT round_id, player FROM pat EXCEPT SELECT round_id, killer FROM kills")
def _(t):
    return j.set_diff(t.pat, t.kills.withColumnRenamed("killer", "player"), RP)


@query(
    "merge_intervals",
    'SELECT thrower, min(start) AS start, max("end") AS "end" FROM m GROUP BY thrower, island',
    'm AS (SELECT *, sum(CASE WHEN start > b + 2 OR b IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY thrower ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max("end") OVER (PARTITION BY thrower ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM grenades))',
)
def _(t):
    return j.merge_intervals(t.grenades, ["thrower"])


@query("lookback", "SELECT p.tick_id, coalesce(max(q.tick_id), min(r.start)) AS other FROM pat p JOIN rounds r USING (round_id) LEFT JOIN pat q ON q.round_id = p.round_id AND q.gt <= p.gt - 3600 GROUP BY 1")
def _(t):
    return w.lookback(t.pat.select("round_id", "tick_id", "gt"), 3600).select("tick_id", "other")


@query("lookforward", 'SELECT p.tick_id, coalesce(min(q.tick_id), max(r."end")) AS other FROM pat p JOIN rounds r USING (round_id) LEFT JOIN pat q ON q.round_id = p.round_id AND q.gt >= p.gt + 3600 GROUP BY 1')
def _(t):
    return w.lookforward(t.pat.select("round_id", "tick_id", "gt"), 3600).select("tick_id", "other")


@query("rows_offset", 'SELECT tick_id, lag(x, 2) OVER p AS "x (t-2)", x AS "x (t)", lead(x, 1) OVER p AS "x (t+1)" FROM pat WINDOW p AS (PARTITION BY round_id, player ORDER BY gt, tick_id)')
def _(t):
    return w.rows_offset(t.pat, ["x"], [-2, 0, 1], RP, GP).select("tick_id", "x (t-2)", "x (t)", "x (t+1)")


@query("cum_flag", "SELECT tick_id, max(y > 90) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) AS so_far FROM pat")
def _(t):
    return w.cum_flag(t.pat, F.col("y") > 90, RP, GP).select("tick_id", "so_far")


@query("time_window", "SELECT tick_id FROM pat JOIN rounds USING (round_id) WHERE gt - start_gt BETWEEN 3600 AND 7200")
def _(t):
    return w.time_window(t.pat, 3600, 7200).select("tick_id")


@query("time_to_event", "SELECT p.tick_id, min(q.gt) - p.gt AS to_event FROM pat p JOIN pat q ON q.round_id = p.round_id AND q.player = p.player AND (q.gt, q.tick_id) >= (p.gt, p.tick_id) AND q.kind = 'purchase' GROUP BY p.tick_id, p.gt")
def _(t):
    return w.time_to_event(t.pat, F.col("kind") == "purchase", RP, GP).select("tick_id", "to_event")


@query("seconds_since_hit", "SELECT p.tick_id, coalesce(p.gt - max(h.gt) FILTER (h.gt <= p.gt), -1) AS before, coalesce(min(h.gt) FILTER (h.gt >= p.gt) - p.gt, -1) AS after FROM pat p LEFT JOIN hurt h ON h.round_id = p.round_id AND h.victim = p.player GROUP BY p.tick_id, p.gt")
def _(t):
    return w.seconds_around(t.pat.select("tick_id", "round_id", "player", "gt"), t.hurt.withColumnRenamed("victim", "player"), RP).select("tick_id", "before", "after")


@query("rolling_share", "SELECT tick_id, avg(CASE WHEN kind = 'click' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY round_id ORDER BY gt RANGE BETWEEN CURRENT ROW AND 3600 FOLLOWING) AS share FROM pat")
def _(t):
    return w.rolling_share(t.pat, F.col("kind") == "click", 3600, ["round_id"]).select("tick_id", "share")


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "rolling_mode",
    "SELECT tick_id, arg_max(kind, n * 10 - i) AS mode FROM (SELECT p.tick_id, q.kind, count(*) AS n, list_position(['click', 'error', 'purchase', 'signup', 'view'], q.kind) AS i FROM pat p JOIN pat q ON q.round_id = p.round_id AND q.gt BETWEEN p.gt AND p.gt + 3600 GROUP BY ALL) GROUP BY tick_id",
)
def _(t):
    return w.rolling_mode(t.pat, "kind", _KINDS, 3600, ["round_id"]).select("tick_id", "mode")


@query("rolling_trend", "SELECT p.tick_id, avg(CASE WHEN q.x < p.x - 10 THEN 1.0 ELSE 0 END) AS falls, avg(CASE WHEN q.x < p.x - 10 OR q.x > p.x + 10 THEN 0 ELSE 1.0 END) AS stays, avg(CASE WHEN q.x > p.x + 10 THEN 1.0 ELSE 0 END) AS rises FROM pat p JOIN pat q ON q.round_id = p.round_id AND q.gt BETWEEN p.gt AND p.gt + 3600 GROUP BY 1")
def _(t):
    return w.rolling_trend(t.pat, "x", 3600, 10, ["round_id"]).select("tick_id", "falls", "stays", "rises")


@query("tick_fraction", "SELECT tick_id, coalesce((gt - start_gt) / nullif(end_gt - start_gt, 0), 0.0) AS fraction FROM pat JOIN rounds USING (round_id)")
def _(t):
    return w.tick_fraction(t.pat).select("tick_id", "fraction")


@query("tick_counters", "SELECT tick_id, gt - max(CASE WHEN kind = 'error' THEN gt END) OVER o AS since_hurt, gt - max(CASE WHEN kind = 'click' THEN gt END) OVER o AS since_fire FROM pat WINDOW o AS (PARTITION BY player ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    return w.since_flags(t.pat.select("tick_id", "player", "gt", "kind"), {"hurt": F.col("kind") == "error", "fire": F.col("kind") == "click"}, ["player"], GP, few_keys=True).select("tick_id", "since_hurt", "since_fire")


@query("until_next", "SELECT tick_id, min(CASE WHEN kind = 'click' THEN tick_id END) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_tick FROM pat")
def _(t):
    return w.until_next(t.pat, F.col("kind") == "click", RP, GP).select("tick_id", "next_tick")


@query(
    "contiguous_history",
    "SELECT tick_id, min(gt) OVER (PARTITION BY round_id, player, island) AS oldest FROM (SELECT *, sum(n) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN gt - lag(gt) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) <= 3600 THEN 0 ELSE 1 END AS n FROM pat))",
)
def _(t):
    return w.contiguous_history(t.pat, RP, "gt", 3600).select("tick_id", "oldest")


@query(
    "rolling_fill",
    "SELECT round_id, player, coalesce((SELECT max(q.tick_id) FROM pat q WHERE q.player = p.player AND q.round_id <= r.round_id), (SELECT min(q.tick_id) FROM pat q WHERE q.player = p.player)) AS tick_id FROM (SELECT round_id FROM rounds) r, (SELECT DISTINCT player FROM pat) p",
)
def _(t):
    last = t.pat.groupBy("player", "round_id").agg(F.max("tick_id").alias("tick_id"), F.min("tick_id").alias("first_id"))
    grid = t.rounds.select("round_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("player")).join(t.pat.select("player").distinct(), "player", "left_semi")
    out = w.rolling_fill(last.select("player", "round_id", F.struct("tick_id", "first_id").alias("s")), grid, ["player"], "round_id", ["s"])
    early = w.asof_prev(grid, last.select("player", "round_id", F.lit(1).alias("there")), ["player"], "round_id", ["there"])
    return out.join(early, ["player", "round_id"]).select("round_id", "player", F.when(F.col("prev_there") == 1, F.col("s.tick_id")).otherwise(F.col("s.first_id")).alias("tick_id"))


@query("future_label", "SELECT p.tick_id, arg_max(q.kind, q.gt * 1000000 + q.tick_id) AS label FROM pat p LEFT JOIN pat q ON q.round_id = p.round_id AND q.player = p.player AND q.gt BETWEEN p.gt + 60 AND p.gt + 7200 GROUP BY 1")
def _(t):
    keyed = t.pat.withColumn("value", F.struct("tick_id", "kind"))
    return w.future_label(keyed, "value", 7200, RP, least=60).select("tick_id", F.col("label.kind").alias("label"))


@query(
    "event_contiguous",
    "SELECT round_id, player, min(tick_id) AS start, max(tick_id) AS \"end\", count(*) AS length FROM (SELECT *, sum(n) OVER (PARTITION BY round_id, player ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN near IS DISTINCT FROM lag(near) OVER (PARTITION BY round_id, player ORDER BY tick_id) THEN 1 ELSE 0 END AS n FROM (SELECT round_id, player, tick_id, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY round_id, player ORDER BY tick_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM pat))) WHERE near = 1 GROUP BY round_id, player, island",
)
def _(t):
    return w.event_contiguous(t.pat, F.col("kind") == "purchase", 2, RP, ["tick_id"])


@query("first_row", "SELECT arg_min(tick_id, tick_id) AS tick_id, round_id FROM pat GROUP BY round_id")
def _(t):
    return w.first_row(t.pat, ["round_id"], ["tick_id"]).select("tick_id", "round_id")


@query("cum_sample_split", "SELECT round_id, sum(n) OVER (ORDER BY md5('0:' || round_id), round_id) - n < 0.8 * sum(n) OVER () AS is_train FROM (SELECT round_id, count(*) AS n FROM pat GROUP BY 1)")
def _(t):
    return w.cum_sample_split(t.pat, "round_id")


@query("runs", "SELECT round_id, player, team_kind AS kind, min(tick_id) AS start, max(tick_id) AS \"end\", count(*) AS length FROM (SELECT *, sum(n) OVER (PARTITION BY round_id, player ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT round_id, player, tick_id, kind AS team_kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY round_id, player ORDER BY tick_id) THEN 0 ELSE 1 END AS n FROM pat)) GROUP BY round_id, player, team_kind, island")
def _(t):
    return w.runs(t.pat, RP, ["tick_id"], "kind")
