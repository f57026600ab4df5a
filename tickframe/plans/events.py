"""Event operators over the match tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as e
from ..operators import retakes as rt
from ..operators import windows as w
from ..operators.windows import runs
from .domain import query

RP, GP = ["round_id", "player"], ["gt", "tick_id"]
_ENG = """hits AS (SELECT *, sum(n) OVER (PARTITION BY round_id, attacker, victim ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN gt - lag(gt) OVER (PARTITION BY round_id, attacker, victim ORDER BY gt, tick_id) <= 4800 THEN 0 ELSE 1 END AS n FROM hurt)),
eng AS (SELECT round_id, attacker, victim, greatest(min(gt) - 3600, min(start_gt)) AS start, least(max(gt) + 1200, min(end_gt)) AS stop, count(*) AS hits, list(tick_id ORDER BY tick_id) AS hurt_ids
  FROM hits JOIN rounds USING (round_id) GROUP BY round_id, attacker, victim, island)"""


def _eng(t):
    return e.engagements(t.hurt, t.rounds.select("round_id", "start_gt", "end_gt"), 3600, 1200)


@query("engagement", 'SELECT round_id, attacker, victim, start, stop AS "end", hits, array_to_string(hurt_ids, \',\') AS hurt_ids FROM eng', _ENG)
def _(t):
    return _eng(t).withColumn("hurt_ids", F.array_join(F.transform("hurt_ids", lambda x: x.cast("string")), ","))


_AIMED = """, aimed AS (SELECT p.*, (SELECT arg_max(q.k % 10, q.gt * 1000000 + q.tick_id) FROM pat q WHERE q.round_id = p.round_id AND q.player = p.player AND q.gt BETWEEN p.gt + 1 AND p.gt + 600) AS soon,
    (SELECT arg_max(q.k % 10, q.gt * 1000000 + q.tick_id) FROM pat q WHERE q.round_id = p.round_id AND q.player = p.player AND q.gt BETWEEN p.gt + 1 AND p.gt + 1200) AS later,
    (SELECT arg_max(q.k % 10, q.gt * 1000000 + q.tick_id) FROM pat q WHERE q.round_id = p.round_id AND q.player = p.player AND q.gt BETWEEN p.gt + 1 AND p.gt + 2400) AS last FROM pat p),
  met AS (SELECT e.round_id, e.attacker, e.victim, e.start, e.stop, p.k % 10 AS now, soon, later, last, row_number() OVER (PARTITION BY p.tick_id, p.player ORDER BY e.start DESC, e.victim DESC, e.stop DESC) = 1 AS latest
    FROM eng e JOIN aimed p ON p.round_id = e.round_id AND p.player = e.attacker AND p.gt BETWEEN e.start AND e.stop)"""
_HORIZONS = {"now": 0, "soon": 600, "later": 1200, "last": 2400}


@query("engagement_match", "SELECT round_id, attacker, victim, start, " + ", ".join(f"avg(CASE WHEN latest AND {h} = victim THEN 1.0 ELSE 0.0 END) AS share_{h}" for h in _HORIZONS) + " FROM met GROUP BY round_id, attacker, victim, start, stop", _ENG + _AIMED)
def _(t):
    aimed = t.pat.withColumns({"now": F.col("k") % 10, "_t": F.struct("tick_id", (F.col("k") % 10).alias("target"))})
    for name, horizon in _HORIZONS.items():
        if horizon:
            aimed = w.future_label(aimed, "_t", horizon, RP).withColumn(name, F.col("label.target")).drop("label")
    return e.engagement_match(_eng(t), aimed, list(_HORIZONS), 4800).drop("end")


@query(
    "non_engagement",
    "SELECT round_id, player, min(gt) AS start, max(gt) AS \"end\", count(*) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN free = lag(free) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) THEN 0 ELSE 1 END AS n FROM (SELECT p.*, p.alive AND NOT EXISTS (SELECT 1 FROM eng e WHERE e.round_id = p.round_id AND (e.attacker = p.player OR e.victim = p.player) AND p.gt BETWEEN e.start AND e.stop) AS free FROM pat p))) WHERE free GROUP BY round_id, player, i",
    _ENG,
)
def _(t):
    return e.non_engagement(t.pat, _eng(t), 4800)


@query(
    "trajectory_segments",
    'SELECT b.round_id, b.player, b.segment, min(p.gt) AS start, max(p.gt) AS "end", count(*) AS n FROM (SELECT *, lead(gt) OVER (PARTITION BY round_id, player ORDER BY gt) AS later FROM begun) b JOIN pat p ON p.round_id = b.round_id AND p.player = b.player AND p.gt >= b.gt AND (p.gt < b.later OR b.later IS NULL) GROUP BY b.round_id, b.player, b.segment',
    "begun AS (SELECT round_id, player, 0::BIGINT AS segment, min(gt) AS gt FROM pat GROUP BY round_id, player UNION ALL SELECT s.round_id, s.player, s.segment + 1, min(p.gt) FROM begun s JOIN pat p ON p.round_id = s.round_id AND p.player = s.player AND p.gt > s.gt + 3600 GROUP BY s.round_id, s.player, s.segment, s.gt)",
)
def _(t):
    return e.trajectory_segments(t.pat, 3600, RP)


@query("segment_buckets", 'SELECT round_id, player, segment, min(gt) AS start, max(gt) AS "end", count(*) AS n FROM (SELECT *, (gt - min(gt) OVER (PARTITION BY round_id, player)) // 3600 AS segment FROM pat) GROUP BY ALL')
def _(t):
    return e.segment_buckets(t.pat, 3600, RP)


_PLANTS = """roster AS (SELECT DISTINCT round_id, player, team FROM pat),
marks AS (SELECT round_id, tick_id, 'plant' AS what FROM grenades WHERE kind4 <> 0 UNION ALL SELECT round_id, tick_id, 'defusal' FROM kills WHERE headshot AND tick_id % 8 = 0),
seen AS (SELECT m.round_id, m.tick_id, what, player, team, (SELECT arg_max({'alive': alive, 'x': x, 'y': y, 'z': z, 'view': view}, tick_id) FROM pat p WHERE p.round_id = m.round_id AND p.player = r.player AND p.tick_id <= m.tick_id) AS s
  FROM marks m JOIN roster r ON r.round_id = m.round_id),
twosided AS (SELECT round_id, tick_id, what FROM seen GROUP BY ALL HAVING bool_or(team = 3 AND s.alive) AND bool_or(team = 2 AND s.alive)),
planted AS (SELECT round_id, min(tick_id) AS tick_id FROM twosided WHERE what = 'plant' GROUP BY 1),
slots AS (SELECT round_id, tick_id, player, team, s, row_number() OVER (PARTITION BY round_id, team ORDER BY player) AS i FROM planted JOIN seen USING (round_id, tick_id) WHERE what = 'plant' AND s.alive)"""
_SUMS = ", ".join(f"round(coalesce(sum(i * s.{c}) FILTER (team = {code} AND i <= 5), 0.0), 4) AS {side}_{c}" for side, code in rt.TEAMS.items() for c in ("x", "y", "z", "view"))


@query("plant_states", f"SELECT p.round_id, p.tick_id AS plant_id, p.tick_id AS plant_tick, r.\"end\" AS end_tick, r.\"end\" - p.tick_id + 1 AS length, winner, EXISTS (SELECT 1 FROM twosided b WHERE b.round_id = p.round_id AND what = 'defusal') AS defused, p.tick_id % 97 AS bomb_x, p.tick_id % 89 AS bomb_y, p.tick_id % 83 AS bomb_z, " + ", ".join(f"string_agg(player::VARCHAR, ',' ORDER BY player) FILTER (team = {code} AND i <= 5) AS {side}_players" for side, code in rt.TEAMS.items()) + f", {_SUMS} FROM planted p JOIN rounds r ON r.round_id = p.round_id JOIN slots s ON s.round_id = p.round_id GROUP BY ALL", _PLANTS)
def _(t):
    plants = t.grenades.select("round_id", "tick_id", F.col("tick_id").alias("event"), (F.col("kind4") != 0).alias("ok"))
    defusals = t.kills.select("round_id", "tick_id", F.col("tick_id").alias("event"), (F.col("headshot") & (F.col("tick_id") % 8 == 0)).alias("ok"))
    bomb = t.pat.select("tick_id", *[(F.col("tick_id") % n).alias(f"bomb_{c}") for c, n in zip("xyz", (97, 89, 83))])
    out = rt.plant_states(plants, defusals, t.pat, t.rounds, bomb)
    total = lambda side, c: F.round(F.aggregate(F.transform(side, lambda s, i: F.when(s["alive"], s[c] * (i + 1)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v), 4)
    sums = {f"{side}_{c}": total(side, c) for side in rt.TEAMS for c in ("x", "y", "z", "view")}
    players = {f"{side}_players": F.array_join(F.transform(F.filter(side, lambda s: s["alive"]), lambda s: s["player"].cast("string")), ",") for side in rt.TEAMS}
    return out.withColumns(sums | players).drop("ct", "t")


@query("alive_flags", "SELECT round_id, gt // 3600 AS at, count(DISTINCT CASE WHEN alive AND team = 3 THEN player END) AS ct_alive, count(DISTINCT CASE WHEN alive AND team = 2 THEN player END) AS t_alive FROM pat GROUP BY ALL")
def _(t):
    return e.alive_counts_by_tick(t.pat, 3600)


@query("world_deaths", "SELECT round_id, count(*) FILTER (near) AS at_mark, count(*) FILTER (NOT near) AS other FROM (SELECT k.*, EXISTS (SELECT 1 FROM grenades g WHERE g.round_id = k.round_id AND abs(g.tick_id - k.tick_id) <= 3) AS near FROM kills k) GROUP BY 1")
def _(t):
    return e.deaths_at(t.kills, t.grenades, 3)


@query("smoke_state", 'SELECT g.tick_id AS grenade, u.tick, CASE WHEN kind4 <> 3 AND u.tick >= g.start + 12 THEN $$active$$ ELSE $$thrown$$ END AS state, max_by(p.x, p.tick_id) AS x, max_by(p.y, p.tick_id) AS y FROM grenades g CROSS JOIN LATERAL (SELECT unnest(generate_series(g.start, g."end", 5)) AS tick) u LEFT JOIN pat p ON p.player = g.thrower AND p.tick_id BETWEEN g.start AND u.tick GROUP BY ALL')
def _(t):
    from ..operators.joins import stab_join

    g = t.grenades.select(F.col("tick_id").alias("grenade"), "start", F.when(F.col("kind4") != 3, F.col("start") + 12).alias("active"), "end", F.col("thrower").alias("player"))
    steps = stab_join(t.pat.select("player", F.col("tick_id").alias("tick"), "x", "y"), g, "tick", keys=["player"], width=64).select("grenade", "tick", "x", "y")
    return e.smoke_state(g, steps, 5)


@query("flash_state", "SELECT p.tick_id, coalesce(greatest(0.0, least(1.0, 1 - (p.gt - max(h.gt)) / 7200.0)), 0.0) / 3.0 AS amount FROM pat p LEFT JOIN hurt h ON h.round_id = p.round_id AND h.victim = p.player AND h.gt <= p.gt GROUP BY p.tick_id, p.gt")
def _(t):
    return e.flash_state(t.pat, t.hurt.withColumnRenamed("victim", "player"), 7200.0, 3.0).select("tick_id", "amount")


_HELD = """ordered AS (SELECT *, k % 3 AS recoil, weapon = 4 AS reloading, row_number() OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) AS n FROM pat),
held AS (SELECT round_id, player, n, recoil, tick_id, gt, false AS holding FROM ordered WHERE n = 1 UNION ALL
  SELECT o.round_id, o.player, o.n, o.recoil, o.tick_id, o.gt, NOT o.reloading AND o.recoil > 0.5 AND (o.recoil > h.recoil OR (o.recoil = h.recoil AND h.holding))
  FROM held h JOIN ordered o ON o.round_id = h.round_id AND o.player = h.player AND o.n = h.n + 1)"""


@query(
    "fire_history",
    "SELECT h.tick_id, gt - max(CASE WHEN f.tick_id IS NOT NULL THEN gt END) OVER o AS since_fire, count(f.tick_id) OVER o AS shots, holding, gt - max(CASE WHEN holding THEN gt END) OVER o AS since_hold, v.victims IS NOT NULL AS hit, coalesce(v.victims, '') AS victims FROM held h LEFT JOIN (SELECT tick_id FROM fire) f USING (tick_id) LEFT JOIN (SELECT tick_id, killer AS player, string_agg(DISTINCT victim::VARCHAR, ',') AS victims FROM kills GROUP BY ALL) v ON v.tick_id = h.tick_id AND v.player = h.player WINDOW o AS (PARTITION BY h.round_id, h.player ORDER BY gt, h.tick_id ROWS UNBOUNDED PRECEDING)",
    _HELD,
)
def _(t):
    pat = t.pat.withColumns({"recoil": F.col("k") % 3, "reloading": F.col("weapon") == 4})
    out = e.fire_history(pat, F.col("kind") == "click", t.kills.select("tick_id", F.col("killer").alias("attacker"), "victim"))
    return out.select("tick_id", "since_fire", "shots", "holding", "since_hold", "hit", F.array_join(F.transform("victims", lambda x: x.cast("string")), ",").alias("victims"))


_RUNS = "SELECT round_id, player, {0} AS {1}, min(tick_id) AS start, max(tick_id) AS \"end\", count(*) AS length FROM (SELECT *, sum(n) OVER (PARTITION BY round_id, player ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY round_id, player ORDER BY tick_id) THEN 0 ELSE 1 END AS n FROM (SELECT *, {2} AS v FROM pat))) GROUP BY round_id, player, v, i"


@query("latent_engagement", _RUNS.format("v", "target", "k % 3"))
def _(t):
    return runs(t.pat.withColumn("target", F.col("k") % 3), ["round_id", "player"], ["tick_id"], "target")


@query("latent_order", _RUNS.format("v", "order3", "weapon"))
def _(t):
    return runs(t.pat.withColumn("order3", F.col("weapon")), ["round_id", "player"], ["tick_id"], "order3")


@query("argmax_runs", _RUNS.format("v", "best", "CASE WHEN x >= y AND x >= z THEN 'x' WHEN y >= z THEN 'y' ELSE 'z' END"))
def _(t):
    return e.argmax_runs(t.pat, ["x", "y", "z"], ["round_id", "player"], ["tick_id"])


@query("event_detect", "SELECT tick_id, coalesce(k <= lag(k) OVER o, false) AS new_fire, alive AND NOT coalesce(lead(alive) OVER o, true) AS dies FROM pat WINDOW o AS (PARTITION BY round_id, player ORDER BY tick_id)")
def _(t):
    return e.event_detect(t.pat, "k", ["round_id", "player"], ["tick_id"]).select("tick_id", "new_fire", "dies")


@query("split_discontinuity", 'SELECT round_id, player, i AS "index" FROM (SELECT *, count(*) FILTER (y > 40) OVER o - 1 AS i, coalesce(lag(y > 40) OVER (PARTITION BY round_id, player ORDER BY tick_id), false) AS b FROM pat WINDOW o AS (PARTITION BY round_id, player ORDER BY tick_id ROWS UNBOUNDED PRECEDING)) WHERE y > 40 AND NOT b')
def _(t):
    return e.split_discontinuity(t.pat, F.col("y") > 40, ["round_id", "player"], ["tick_id"])


@query("c4_approach", "SELECT p.tick_id, max_by(q.x, q.gt) < p.x - 10 AS approaches FROM pat p JOIN pat q ON q.round_id = p.round_id AND q.player = p.player AND q.gt BETWEEN p.gt AND p.gt + 7200 GROUP BY p.tick_id, p.x")
def _(t):
    return e.c4_approach(t.pat, "x", 7200, 10, RP).select("tick_id", "approaches")


@query("drop_partial", "SELECT tick_id, CASE WHEN k % 3 > 0 AND weapon > 0 THEN k END AS a, CASE WHEN weapon > 0 THEN nullif(k % 3, 0) END AS b, nullif(weapon, 0) AS c FROM pat")
def _(t):
    rows = t.pat.select("tick_id", F.col("k").alias("a"), F.nullif(F.col("k") % 3, F.lit(0)).alias("b"), F.nullif("weapon", F.lit(0)).alias("c"))
    return e.drop_partial(rows, ["a", "b", "c"])


@query("test_outcome", "SELECT *, rounds / sum(rounds) OVER (PARTITION BY weapon) AS share FROM (SELECT weapon, alive, count(DISTINCT round_id) AS rounds FROM pat GROUP BY ALL)")
def _(t):
    return e.test_outcome(t.pat, "weapon", "alive")


_MOVES = """blasts AS (SELECT round_id, max(tick_id) AS blast FROM hurt WHERE damage > 60 AND tick_id % 3 = 0 GROUP BY 1), first_plant AS (SELECT round_id, min(tick_id) AS plant FROM grenades WHERE kind4 = 1 GROUP BY 1),
lived AS (SELECT p.*, (k % 4)::DOUBLE AS speed, plant, start, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz FROM pat p JOIN first_plant f ON f.round_id = p.round_id AND p.tick_id >= plant JOIN rounds r ON r.round_id = p.round_id
  WHERE alive WINDOW o AS (PARTITION BY p.round_id, player ORDER BY tick_id)),
jumped AS (SELECT round_id, min(tick_id) AS jump FROM lived WHERE sqrt(power(x - px, 2) + power(y - py, 2) + power(z - pz, 2)) > 110 AND speed = 0 AND tick_id <> start GROUP BY 1),
settled AS (SELECT l.* EXCLUDE (px, py, pz), lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy, first_value(z) OVER o AS fz
  FROM lived l LEFT JOIN jumped j ON j.round_id = l.round_id WHERE jump IS NULL OR l.tick_id > jump + 3 WINDOW o AS (PARTITION BY l.round_id, player ORDER BY l.tick_id)),
each AS (SELECT s.round_id, team, player, coalesce(sum(sqrt(power(x - px, 2) + power(y - py, 2) + power(z - pz, 2))), 0.0) AS d, max(sqrt(power(x - fx, 2) + power(y - fy, 2) + power(z - fz, 2))) AS far,
  count(*) FILTER (kind = 'click') AS shots, count(*) FILTER (kind = 'purchase') AS kills, coalesce(sum(speed) FILTER (kind = 'click'), 0.0) AS v, max(tick_id) AS last FROM settled s GROUP BY ALL),
sides AS (SELECT f.round_id, side AS team, plant, r."end" AS fin, winner, blast, count(e.player) AS players, coalesce(sum(d), 0.0) AS d, coalesce(max(far), 0.0) AS far, coalesce(sum(shots), 0) AS shots, coalesce(sum(kills), 0) AS kills, coalesce(sum(v), 0.0) AS v,
  count(*) FILTER (last + 1 >= blast) AS b, count(*) FILTER (last > blast) AS a
  FROM first_plant f JOIN rounds r USING (round_id) CROSS JOIN (VALUES (2), (3)) x(side) LEFT JOIN blasts USING (round_id) LEFT JOIN each e ON e.round_id = f.round_id AND e.team = side GROUP BY ALL)"""


@query(
    "retake_moments",
    "SELECT round_id, team, winner = team AS win, players, round(d, 4) AS travelled, round(far, 4) AS farthest, round(shots / nullif(sum(players) OVER g, 0), 6) AS shots_per_player, round(kills / nullif(sum(players) OVER g, 0), 6) AS kills_per_player, round(shots / nullif(kills, 0), 6) AS shots_per_kill, round(v / nullif(shots, 0), 6) AS shooting_speed, CASE WHEN blast IS NOT NULL THEN b END AS alive_before, CASE WHEN blast IS NOT NULL THEN a END AS alive_after, fin - plant + 1 AS length FROM sides WINDOW g AS (PARTITION BY round_id)",
    _MOVES,
)
def _(t):
    plants = t.grenades.select("round_id", "tick_id", (F.col("kind4") == 1).alias("ok"))
    blasts = t.hurt.where("damage > 60 AND tick_id % 3 = 0").select("round_id", "tick_id")
    out = rt.retake_moments(t.pat.withColumn("speed", (F.col("k") % 4).cast("double")), t.rounds, blasts, plants, F.col("kind") == "click", F.col("kind") == "purchase", jump=110.0)
    places = {"travelled": 4, "farthest": 4} | dict.fromkeys(("shots_per_player", "kills_per_player", "shots_per_kill", "shooting_speed"), 6)
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@query("teleport_reset", "SELECT tick_id, bool_or(j) OVER (PARTITION BY player ORDER BY tick_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS reset FROM (SELECT *, coalesce(sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) > 60 AND weapon = 0, false) AS j FROM pat WINDOW o AS (PARTITION BY player ORDER BY tick_id))")
def _(t):
    return e.teleport_reset(t.pat, 60.0, F.col("weapon") == 0, 2, ["player"], ["tick_id"]).select("tick_id", "reset")


@query("moment_summary", "SELECT team, round(avg(x), 6) AS x_mean, round(stddev_samp(x), 6) AS x_std, quantile_cont(x, 0.5) AS x_median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS x_iqr FROM pat GROUP BY 1")
def _(t):
    out = e.moment_summary(t.pat, ["team"], ["x"])
    return out.select("team", F.round("x_mean", 6).alias("x_mean"), F.round("x_std", 6).alias("x_std"), "x_median", F.round("x_iqr", 6).alias("x_iqr"))


@query("raw_stats", "SELECT count(DISTINCT round_id) AS rounds, count(*) AS ticks, count(DISTINCT player) AS players, count(*) FILTER (kind = 'click') AS shots, count(*) FILTER (kind = 'purchase') AS kills, (max(gt) - min(gt)) / 3600.0 AS hours FROM pat")
def _(t):
    return e.raw_stats(t.pat)
