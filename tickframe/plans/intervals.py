"""Interval operators, sources and sinks over the match tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import intervals as v
from ..operators import windows as w
from ..sources import tables as tab
from .domain import query
from .spatial import _REACH, _edges

RP, GP = ["round_id", "player"], ["gt", "tick_id"]


def _new(t, name):
    return f"{tab.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


_FIRE = "SELECT tick_id AS id, tick_id, CASE WHEN k % 5 > 0 THEN player END AS shooter, weapon::SMALLINT AS weapon FROM pat WHERE kind = 'click'"


def _fire_csv(t, files):
    rows = t.of("click").select(F.col("tick_id").alias("id"), "tick_id", F.when(F.col("k") % 5 > 0, F.col("player")).alias("shooter"), "weapon")
    at = _new(t, "csv")
    tab.write_csv(rows.repartition(files, "tick_id"), at, ["id", "tick_id"], ["shooter", "weapon"])
    return at


@query("src_csv", _FIRE)
def _(t):
    return tab.read_table(t.spark, _fire_csv(t, 1), "weapon_fire").drop("_file")


@query("src_multi_file", _FIRE)
def _(t):
    return tab.read_table(t.spark, _fire_csv(t, 6), "weapon_fire").where("_file LIKE 'part-%'").drop("_file")


@query("src_incremental", _FIRE)
def _(t):
    src, out, ledger = _fire_csv(t, 4), _new(t, "in"), _new(t, "ledger")
    for _ in range(2):  # the second run finds nothing new
        tab.read_new_files(t.spark, src, out, ledger, "weapon_fire")
    return t.spark.read.parquet(out)


@query("snk_csv", "SELECT tick_id::VARCHAR AS id, player::VARCHAR AS player, kind FROM pat")
def _(t):
    at = _new(t, "csv")
    tab.write_csv(t.pat.withColumn("id", F.col("tick_id")), at, ["id", "player"], ["kind"])
    return t.spark.read.option("header", True).csv(at)


@query("snk_ledger", "SELECT count(*) AS n, 'a' AS batch FROM fire UNION ALL SELECT count(*), 'b' FROM kills")
def _(t):
    at = _new(t, "ledger")
    for name, df in (("a", t.fire), ("b", t.kills)):
        tab.append_ledger(df.agg(F.count(F.lit(1)).alias("n")), at, name)
    return t.spark.read.parquet(at)


_DEC = "dec AS (SELECT *, coalesce(lead(gt) OVER (PARTITION BY round_id ORDER BY gt), 1000000000) AS nxt FROM (SELECT DISTINCT round_id, gt FROM pat WHERE tick_id % 8 = 0))"
_NXT = "x.gt >= d.gt AND x.gt < d.nxt"


def _dec(t):
    return t.pat.where("tick_id % 8 = 0").select("round_id", "gt").distinct()


@query("shots_interval", f"SELECT d.round_id, d.gt, count(x.tick_id) AS shots FROM dec d LEFT JOIN fire x ON x.round_id = d.round_id AND {_NXT} GROUP BY ALL", _DEC)
def _(t):
    return v.interval_counts(_dec(t), t.fire, {"shots": F.lit(True)}, ["round_id"])


@query("next_interval_flags", f"SELECT d.round_id, d.gt, count(x.tick_id) FILTER (kind = 'error') > 0 AS hurt, count(x.tick_id) FILTER (kind = 'purchase') > 0 AS killed FROM dec d LEFT JOIN pat x ON x.round_id = d.round_id AND {_NXT} GROUP BY ALL", _DEC)
def _(t):
    return v.interval_flags(_dec(t), t.pat, {"hurt": F.col("kind") == "error", "killed": F.col("kind") == "purchase"}, ["round_id"])


@query("grenade_interval", f"SELECT d.round_id, d.gt, count(*) FILTER (p = 0) AS thrown, count(*) FILTER (p = 1) AS expired FROM dec d LEFT JOIN (SELECT round_id, unnest([0, 1]) AS p, unnest([gt, gt + k * 60]) AS gt FROM pat WHERE kind = 'signup') x ON x.round_id = d.round_id AND {_NXT} GROUP BY ALL", _DEC)
def _(t):
    spans = t.of("signup").select("round_id", F.col("gt").alias("thrown"), (F.col("gt") + F.col("k") * 60).alias("expired"))
    return v.phases(_dec(t), spans, ["thrown", "expired"], ["round_id"])


_AGG = (
    _REACH
    + """, ar AS (SELECT round_id, gt // 3600 AS b, team, player, arg_max(k % 25, gt * 1000000 + tick_id) AS area FROM pat GROUP BY ALL),
sees AS (SELECT DISTINCT a.round_id, a.b, a.team, a.player, a.area AS src FROM ar a JOIN visible v ON v.src = a.area JOIN ar e ON e.round_id = a.round_id AND e.b = a.b AND e.team <> a.team AND e.area = v.dst),
act AS (SELECT *, sum(n) OVER (PARTITION BY round_id ORDER BY b ROWS UNBOUNDED PRECEDING)::BIGINT AS event FROM (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY round_id ORDER BY b) <= 1 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT round_id, b FROM sees))),
spn AS (SELECT *, min(b) OVER (PARTITION BY round_id, event) AS start, max(b) OVER (PARTITION BY round_id, event) AS stop FROM act)"""
)


@query(
    "aggression",
    """SELECT round_id, event, start, stop AS "end", player, CASE WHEN bool_or(s) THEN 'pusher' WHEN bool_or(n) THEN 'baiter' ELSE 'lurker' END AS role FROM (
      SELECT a.round_id, p.event, p.start, p.stop, a.player, EXISTS (SELECT 1 FROM sees s WHERE s.round_id = a.round_id AND s.b = a.b AND s.player = a.player) AS s,
             EXISTS (SELECT 1 FROM sees m JOIN reach r ON r.dst = m.src WHERE m.round_id = a.round_id AND m.b = a.b AND m.team = a.team AND m.player <> a.player AND r.src = a.area AND r.dist <= 6) AS n
      FROM ar a JOIN spn p ON p.round_id = a.round_id AND p.b = a.b) GROUP BY ALL""",
    _AGG,
)
def _(t):
    from ..operators.spatial import reach_matrix

    return v.aggression(t.pat.withColumn("area", F.col("k") % 25), t.visible, reach_matrix(_edges(t)), 1, 6.0, 3600)


@query(
    "wallers",
    "SELECT round_id, player, target, min(gt) AS start, max(gt) AS \"end\" FROM (SELECT *, sum(n) OVER (PARTITION BY round_id, player, target ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN wl = lag(wl) OVER (PARTITION BY round_id, player, target ORDER BY gt, tick_id) THEN 0 ELSE 1 END AS n FROM (SELECT round_id, player, other AS target, gt, tick_id, y > 30 AND NOT k % 3 = 0 AS wl FROM pat))) WHERE wl GROUP BY round_id, player, target, i HAVING max(gt) - min(gt) >= 1800",
)
def _(t):
    looks = t.pat.select("round_id", "player", F.col("other").alias("target"), "gt", "tick_id", (F.col("y") > 30).alias("hits"), (F.col("k") % 3 == 0).alias("seen"))
    return v.wallers(looks, 1800)


@query("mappings", "SELECT m.id::INT AS id, t.player::INT AS source, CASE WHEN t.player < 3 THEN [[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]][m.id // 2 + 1][t.player + 1] ELSE 3 + [[0,1],[1,0]][m.id % 2 + 1][t.player - 2] END::INT AS target FROM range(12) m(id), (SELECT DISTINCT player FROM pat WHERE player < 5) t")
def _(t):
    m = v.mapping_table(t.spark, 3, 2)
    return m.join(t.pat.select(F.col("player").cast("int").alias("source")).distinct(), "source", "left_semi").select("id", "source", "target")


@query("event_filter", "SELECT tick_id, count(*) OVER (PARTITION BY round_id) AS total FROM kills")
def _(t):
    return v.event_filter(t.pat, F.col("kind") == "purchase", ["round_id"]).select("tick_id", "total")


@query("heat_points", "SELECT gx, gy, sum(n * w)::DOUBLE AS value FROM (SELECT floor(x / 10)::BIGINT + dx AS gx, floor(y / 10)::BIGINT + dy AS gy, 1 AS n, CASE WHEN dx = 0 AND dy = 0 THEN 4.0 WHEN dx = 0 OR dy = 0 THEN 2.0 ELSE 1.0 END AS w FROM pat, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) WHERE gx BETWEEN 0 AND 9 AND gy BETWEEN 0 AND 9 GROUP BY ALL")
def _(t):
    return v.stamped_heat(t.pat, 10.0, 10)


@query("speed_scaled", "SELECT tick_id, round(s, 6) AS speed_x, round(s - lag(s) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id), 6) AS change_x FROM (SELECT *, least(1.0, abs(x - lag(x) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id)) / (20.0 + weapon)) AS s FROM pat)")
def _(t):
    out = v.speed_scaled(t.pat, F.lit(20.0).cast("double") + F.col("weapon"), RP, GP)
    first = F.lag(F.lit(1)).over(w.over(RP, GP)).isNotNull()
    return out.select("tick_id", F.round(F.when(first, F.col("speed_x")).otherwise(F.lit(1.0)), 6).alias("speed_x"), F.round("change_x", 6).alias("change_x"))


@query("event_distance", "SELECT tick_id, e - gt AS to_event, round(y / 100 * 30, 6) AS degrees, round(least(2000.0, power(10.0, z / 64 * log10(2000.0))), 4) AS distance, (kind = 'purchase')::INT AS code FROM (SELECT *, min(CASE WHEN kind = 'purchase' THEN gt END) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM pat) WHERE e - gt <= 7200")
def _(t):
    rows = t.pat.withColumns({"a": F.col("y") / 100, "l": F.col("z") / 64})
    out = v.event_distance(rows, F.col("kind") == "purchase", "a", "l", RP, GP, 7200)
    return out.select("tick_id", "to_event", F.round("degrees", 6).alias("degrees"), F.round("distance", 4).alias("distance"), "code")


@query("visible_action", "SELECT tick_id, weapon AS code FROM pat WHERE k % 2 = 0 AND alive")
def _(t):
    return t.pat.where((F.col("k") % 2 == 0) & F.col("alive")).select("tick_id", F.col("weapon").alias("code"))


@query("test_states", "SELECT * FROM (SELECT round_id, at, ct_alive, t_alive FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY at) AS n FROM (SELECT round_id, gt // 3600 AS at, count(DISTINCT CASE WHEN alive AND team = 3 THEN player END) AS ct_alive, count(DISTINCT CASE WHEN alive AND team = 2 THEN player END) AS t_alive FROM pat GROUP BY ALL)) WHERE n = 1) WHERE round_id % 3 = 0 AND ct_alive <= 4 AND t_alive <= 3")
def _(t):
    return v.start_states(t.pat, t.rounds.select("round_id", (F.col("round_id") % 3 != 0).alias("is_train")), 4, 3)


@query("f_weapon", "SELECT tick_id, CASE k % 30 WHEN 0 THEN 'AFRICA' ELSE n_name END AS name, coalesce(n_regionkey > 2, false) AS is_gun FROM pat LEFT JOIN nation ON n_nationkey = k % 30 AND k % 30 > 0")
def _(t):
    codes = t.raw("nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("code"), "n_name", "n_regionkey")
    out = v.code_lookup(t.pat.withColumn("code", F.col("k") % 30), "code", codes)
    return out.select("tick_id", F.when(F.col("code") == 0, "AFRICA").otherwise(F.col("n_name")).alias("name"), F.coalesce(F.col("n_regionkey") > 2, F.lit(False)).alias("is_gun"))
