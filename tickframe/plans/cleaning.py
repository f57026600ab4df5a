"""Cleaning operators over the match tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cleaning as c
from ..operators import retakes as rt
from .domain import query

_G = '(SELECT *, round_id // 10 AS game_id FROM rounds)'


def _rounds(t):
    return t.rounds.withColumn("game_id", F.floor(F.col("round_id") / 10))


@query("fix_rounds", 'SELECT round_id, coalesce(CASE WHEN round_id % 3 > 0 THEN "end" END, start) AS "end", coalesce(CASE WHEN round_id % 2 > 0 THEN "end" + 5 END, CASE WHEN round_id % 3 > 0 THEN "end" END, start) AS official_end FROM rounds')
def _(t):
    r = t.rounds.withColumn("official_end", F.when(F.col("round_id") % 2 > 0, F.col("end") + 5)).withColumn("end", F.when(F.col("round_id") % 3 > 0, F.col("end")))
    return c.fix_rounds(r).select("round_id", "end", "official_end")


@query("filter_rounds", f"SELECT round_id, row_number() OVER (PARTITION BY game_id ORDER BY start) AS number FROM {_G} WHERE NOT warmup AND winner IN (2, 3)")
def _(t):
    return c.filter_rounds(_rounds(t)).select("round_id", "number")


_HALVES = """won AS (SELECT *, count(*) FILTER (winner = 2) OVER s AS t_wins, count(*) FILTER (winner = 3) OVER s AS ct_wins, row_number() OVER (PARTITION BY game_id ORDER BY start) AS i
    FROM (SELECT *, round_id // 10 AS game_id, (round_id // 10 % 3 = 1 AND round_id % 10 >= 3)::INT AS stage FROM rounds)
    WINDOW s AS (PARTITION BY game_id, stage ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
periods AS (
  SELECT game_id, -1 AS p, 0 AS last, true AS going, NULL::BIGINT AS fs, NULL::BIGINT AS fe, NULL::BIGINT AS ss, NULL::BIGINT AS se FROM won GROUP BY 1
  UNION ALL
  SELECT game_id, p + 1, se, CASE WHEN p = -1 THEN fs IS NOT NULL AND ss IS NOT NULL ELSE true END, fs, fe, ss, se FROM (
    SELECT q.game_id, q.p, q.se, q.fe, (SELECT max(i) FROM won w WHERE w.game_id = q.game_id AND i <= q.se AND ct_wins + t_wins - 2 * q.b = q.h) AS ss,
           CASE WHEN q.fe IS NOT NULL THEN coalesce((SELECT max(i) FROM won w WHERE w.game_id = q.game_id AND i > q.last AND i <= q.fe AND ct_wins = q.b AND t_wins = q.b), q.last + 1) END AS fs
    FROM (SELECT g.*, (SELECT max(i) FROM won w WHERE w.game_id = g.game_id AND i > g.last AND ct_wins + t_wins - 2 * g.b + 1 = g.h) AS fe,
                 (SELECT max(i) FROM won w WHERE w.game_id = g.game_id AND greatest(ct_wins, t_wins) - g.b = g.h AND least(ct_wins, t_wins) - g.b < g.h) AS se
          FROM (SELECT game_id, p, last, CASE WHEN p = -1 THEN 0 ELSE 2 + p END AS b, CASE WHEN p = -1 THEN 2 ELSE 1 END AS h FROM periods WHERE going AND p < 9) g) q)
  WHERE se IS NOT NULL)"""


@query("period_detect", "SELECT round_id, p AS period, h AS half FROM (SELECT game_id, p, unnest([0, 1]) AS h, unnest([fs, ss]) AS a, unnest([fe, se]) AS b FROM periods WHERE p >= 0 AND going AND fs IS NOT NULL AND ss IS NOT NULL) s JOIN won ON won.game_id = s.game_id AND i BETWEEN a AND b", _HALVES)
def _(t):
    stage = F.when((F.col("game_id") % 3 == 1) & (F.col("round_id") % 10 >= 3), 1).otherwise(0)
    before = Window.partitionBy("game_id", "_s").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    won = _rounds(t).withColumn("_s", stage).withColumns({f"{side}_wins": F.count(F.when(F.col("winner") == code, 1)).over(before) for side, code in (("t", 2), ("ct", 3))})
    return c.period_detect(won, half=2, half_overtime=1).select("round_id", "period", "half")


@query("tick_to_round", 'SELECT p.tick_id, min(r.round_id) AS round_id FROM pat p JOIN (SELECT round_id, start, "end" + 7 AS e FROM rounds) r ON p.tick_id BETWEEN r.start AND r.e GROUP BY 1')
def _(t):
    return c.tick_to_round(t.pat.select("tick_id"), t.rounds.withColumn("end", F.col("end") + 7), width=64)


@query("spotter_fanout", "SELECT s.tick_id, s.spotted, p.player AS spotter FROM spotted s JOIN (SELECT DISTINCT round_id, player FROM pat) p ON p.round_id = s.round_id")
def _(t):
    return c.spotter_fanout(t.spotted.select("tick_id", "round_id", "spotted"), t.pat, ["round_id"]).select("tick_id", "spotted", "spotter")


@query(
    "pair_begin_end",
    "SELECT player, min(tick_id) AS start, max(tick_id) AS \"end\", bool_or(e = 'success') AS ok FROM (SELECT *, sum(n) OVER (PARTITION BY player ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN e = 'begin' OR coalesce(lag(e) OVER (PARTITION BY player ORDER BY tick_id) <> 'begin', true) THEN 1 ELSE 0 END AS n FROM (SELECT player, tick_id, CASE kind WHEN 'signup' THEN 'begin' WHEN 'view' THEN 'abort' ELSE 'success' END AS e FROM pat WHERE kind IN ('signup', 'view', 'click')))) GROUP BY player, island",
)
def _(t):
    e = t.pat.where(F.col("kind").isin("signup", "view", "click")).withColumn("e", F.when(F.col("kind") == "signup", "begin").when(F.col("kind") == "view", "abort").otherwise("success"))
    return c.pair_begin_end(e, ["player"], "tick_id", "e")


@query("valid_rounds", f"SELECT round_id, u - 2 AS plant_index FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY start) AS u, row_number() OVER (PARTITION BY game_id ORDER BY start DESC) AS d FROM {_G}) WHERE u > 1 AND d > 1")
def _(t):
    return c.valid_rounds(_rounds(t), "game_id").select("round_id", "plant_index")


_SAY = "CASE WHEN k % 3 = 0 THEN 'finish,t' || k % 5 ELSE 'test,t' || k % 5 || ',' || k || ',' || CASE WHEN k % 4 = 0 THEN 'x' ELSE '9' END END"


@query("parse_say", f"SELECT tick_id, split_part(m, ',', 2) AS test, TRY_CAST(split_part(m, ',', 3) AS INT) AS idx, TRY_CAST(split_part(m, ',', 4) AS INT) AS total, done FROM (SELECT *, coalesce(lead(m) OVER (PARTITION BY player ORDER BY tick_id) = 'finish,' || split_part(m, ',', 2), false) AS done FROM (SELECT tick_id, player, {_SAY} AS m FROM pat)) WHERE m LIKE 'test%'")
def _(t):
    say = t.pat.select("tick_id", "player", F.expr(_SAY).alias("message"))
    return c.parse_say(say, keys=["player"]).select("tick_id", "test", "idx", "total", "done")


@query("bot_type", "SELECT tick_id, CASE WHEN kind LIKE 'c%' THEN 'learned' WHEN kind LIKE 'p%' THEN 'human' ELSE 'unknown' END AS ct_type, CASE WHEN kind LIKE 'c%' THEN 'human' WHEN kind LIKE 'p%' THEN 'human' ELSE 'unknown' END AS t_type FROM pat")
def _(t):
    return c.prefix_labels(t.pat, "kind", [("cl", "learned", "human"), ("c", "learned", "human"), ("p", "human", "human")]).select("tick_id", "ct_type", "t_type")


@query("decimate", 'SELECT tick_id, row_number() OVER (PARTITION BY round_id ORDER BY tick_id) AS "row" FROM pat WHERE tick_id % 8 = 0')
def _(t):
    return c.decimate(t.pat).select("tick_id", "row")


@query("nth_from_start", "SELECT tick_id FROM pat JOIN rounds USING (round_id) WHERE (tick_id - start) % 5 = 0")
def _(t):
    return c.nth_from_start(t.pat, 5).select("tick_id")


@query("valid_tick_mask", "SELECT tick_id, alive AND y > 10 AND NOT kind = 'signup' AS valid FROM pat")
def _(t):
    return c.valid_tick_mask(t.pat.select("tick_id", "alive", (F.col("y") > 10).alias("a"), (F.col("kind") == "signup").alias("b")), ["alive", "a"], ["b"]).select("tick_id", "valid")


@query(
    "sync_ticks",
    "SELECT min(tick_id) AS tick_id FROM taken JOIN pat USING (round_id, gt) GROUP BY round_id, gt",
    "taken AS (SELECT round_id, min(gt) AS gt FROM pat GROUP BY round_id UNION ALL SELECT s.round_id, min(p.gt) AS gt FROM taken s JOIN pat p ON p.round_id = s.round_id AND p.gt >= s.gt + 1800 GROUP BY s.round_id, s.gt)",
)
def _(t):
    return c.sync_ticks(t.pat, 1800).select("tick_id")


@query("sync_buckets", "SELECT min(tick_id) AS tick_id FROM pat JOIN rounds USING (round_id) GROUP BY round_id, (gt - start_gt) // 1800")
def _(t):
    return c.sync_buckets(t.pat, 1800).select("tick_id")


@query("seq_index", "SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY min, player) AS seq_id FROM (SELECT round_id, player, min(tick_id) AS min, max(tick_id) AS max, count(*) AS length FROM pat GROUP BY ALL)")
def _(t):
    return c.seq_index(t.pat, ["round_id", "player"], "tick_id")


@query("round_lengths", "SELECT round_id, count(*) AS n, min(tick_id) AS min, max(tick_id) AS max, (ceil(count(*) / 8.0) * 8)::BIGINT AS padded, max_by(player, tick_id) FILTER (alive) AS last_alive FROM pat GROUP BY 1")
def _(t):
    alive = t.pat.where("alive").groupBy("round_id").agg(F.max_by("player", "tick_id").alias("last"))
    return c.round_lengths(t.pat, 8).join(alive, "round_id", "left").select("round_id", "n", "min", "max", "padded", F.col("last").alias("last_alive"))


_DEALT = "dealt AS (SELECT *, k % 2 AS site, row_number() OVER (PARTITION BY team, k % 2 ORDER BY md5(CASE team WHEN 3 THEN '0:def_id:' ELSE '0:off_id:' END || tick_id), tick_id) - 1 AS i, count(*) OVER (PARTITION BY team, k % 2) AS n FROM pat)"


@query("remix_setups", "SELECT d.site, d.tick_id AS def_id, o.tick_id AS off_id, o.player AS off_player, o.x AS off_x, o.y AS off_y FROM dealt d JOIN dealt o ON o.team = 2 AND o.site = d.site AND o.i = d.i % o.n WHERE d.team = 3", _DEALT)
def _(t):
    s = t.pat.withColumn("site", F.col("k") % 2)
    return c.remix_setups(s.where("team = 3"), s.where("team = 2"), "site", "tick_id", ["player", "x", "y"])


@query("slot_assign", "SELECT p.tick_id, s.slot FROM pat p JOIN (SELECT *, row_number() OVER (PARTITION BY round_id, team ORDER BY f, player) - 1 AS slot FROM (SELECT round_id, team, player, min(tick_id) AS f FROM pat GROUP BY ALL)) s USING (round_id, team, player) WHERE s.slot < 4")
def _(t):
    return c.slot_assign(t.pat, 4).select("tick_id", "slot")


@query("slot_reuse")
def _(t):
    return c.slot_reuse(t.pat.withColumn("at", F.floor(F.col("gt") / 7200)), 3, tick="at").select("tick_id", "player", "slot")


@query("assign_ids", "SELECT tick_id, row_number() OVER (ORDER BY round_id, gt, tick_id) - 1 + 100 AS id FROM pat")
def _(t):
    return c.assign_ids(t.pat, "round_id", ["gt", "tick_id"], 100).select("tick_id", "id")


@query("fk_check", "SELECT tick_id FROM pat WHERE k NOT IN (SELECT n_nationkey FROM nation)")
def _(t):
    return c.fk_check(t.pat, t.raw("nation"), "k", "n_nationkey").select("tick_id")


@query("tables_equal", "SELECT '<rows>' AS \"column\", count(*) FILTER (gt % 5 = 0) AS n_diff FROM pat UNION ALL SELECT 'x', count(*) FILTER (k % 2 = 0 AND gt % 5 <> 0) FROM pat UNION ALL SELECT 'weapon', 0")
def _(t):
    a = t.pat.select("tick_id", "x", "weapon")
    b = t.pat.where("gt % 5 <> 0").select("tick_id", F.when(F.col("k") % 2 == 1, F.col("x")).alias("x"), "weapon")
    return c.tables_equal(a, b, ["tick_id"])


@query("snk_flat", "SELECT tick_id, x AS \"p x\", y AS \"p y\", CASE team WHEN 2 THEN 'T' ELSE 'INVALID' END AS team FROM pat")
def _(t):
    return c.flatten(t.pat.select("tick_id", F.struct("x", "y").alias("p"), "team"), {"p": ["x", "y"]}, {"team": {2: "T"}})


_KEY = """begins AS (SELECT round_id, min(tick_id) AS lo FROM pat GROUP BY 1),
marks AS (SELECT tick_id, 'fired' AS n FROM fire UNION ALL SELECT tick_id, 'planted' FROM grenades JOIN begins USING (round_id) WHERE kind4 <> 0 AND tick_id - 30 >= lo
  UNION ALL SELECT tick_id, 'defused' FROM kills JOIN begins USING (round_id) WHERE headshot AND tick_id - 15 >= lo UNION ALL SELECT tick_id, 'exploded' FROM hurt WHERE damage > 90
  UNION ALL SELECT tick_id, CASE k % 5 WHEN 0 THEN 'test_started' ELSE 'test_ended' END FROM pat WHERE kind = 'view' AND k % 5 < 2)"""
_FLAGS = ", ".join(f"bool_or(EXISTS (SELECT 1 FROM marks m WHERE m.tick_id = p.tick_id AND n = '{n}')) OVER o AS {n}" for n in rt.KEY_EVENTS)


@query("key_events", f'SELECT p.tick_id, p.round_id, {_FLAGS}, p.tick_id >= (r.start + r."end") // 2 AS round_ended FROM pat p JOIN rounds r USING (round_id) WINDOW o AS (PARTITION BY p.round_id ORDER BY p.tick_id ROWS UNBOUNDED PRECEDING)', _KEY)
def _(t):
    ended = t.rounds.select("round_id", F.floor((F.col("start") + F.col("end")) / 2).alias("end"))
    say = lambda k: t.of("view").where(F.col("k") % 5 == k).select("tick_id")
    events = {
        "fired": t.fire.select("tick_id"),
        "planted": t.grenades.where("kind4 <> 0").select("tick_id", (F.col("tick_id") - 30).alias("start")),
        "defused": t.kills.where("headshot").select("tick_id", (F.col("tick_id") - 15).alias("start")),
        "exploded": t.hurt.where("damage > 90").select("tick_id"),
        "test_started": say(0),
        "test_ended": say(1),
    }
    return rt.key_events(t.pat, ended, events)