"""Trajectory, behaviour and training operators over the match tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behaviour as b
from ..operators import events as ev
from ..operators import neighbours as near
from ..operators import trajectories as tr
from ..operators import training as g
from ..operators import warping as wp
from ..operators import windows as w
from .domain import query
from .events import _ENG, _eng
from .spatial import _REACH, _edges

RP, GP = ["round_id", "player"], ["gt", "tick_id"]
_LIVE = "live AS (SELECT * FROM (SELECT *, bool_or(NOT alive) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) AS dead FROM pat) WHERE NOT dead)"


def _r(df, *columns, n=6):
    return df.withColumns({c: F.round(c, n) for c in columns})


@query("make_trajectories", "SELECT round_id, player, count(*) AS n, string_agg(tick_id::VARCHAR, ',' ORDER BY gt, tick_id) AS ticks FROM live GROUP BY ALL", _LIVE)
def _(t):
    out = tr.make_trajectories(t.pat)
    return out.select("round_id", "player", "n", F.array_join(F.transform("path", lambda p: p["tick_id"].cast("string")), ",").alias("ticks"))


@query("traj_length", "SELECT round_id, player, round(coalesce(sum(d), 0.0), 4) AS length, max(gt) - min(gt) AS seconds, count(*) - 1 AS steps FROM (SELECT *, sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) AS d FROM live WINDOW o AS (PARTITION BY round_id, player ORDER BY gt, tick_id)) GROUP BY ALL", _LIVE)
def _(t):
    return _r(tr.traj_length(tr.make_trajectories(t.pat)).select("round_id", "player", "length", "seconds", "steps"), "length", n=4)


def _pairs(t):
    paths = tr.make_trajectories(t.pat)
    a = paths.select("round_id", "player", F.col("path").alias("path_a"))
    later = paths.select((F.col("round_id") - 1).alias("round_id"), "player", F.col("path").alias("path_b"))
    return a.join(later, RP)


_PAIRS = _LIVE + ", ends AS (SELECT round_id, player, count(*) AS n, list([x, y] ORDER BY gt, tick_id) AS p FROM live GROUP BY ALL), twins AS (SELECT a.round_id, a.player, a.p, b.p AS q, a.n, b.n AS m FROM ends a JOIN ends b ON b.round_id = a.round_id + 1 AND b.player = a.player)"


@query("fde", "SELECT round_id, player, round(sqrt(power(p[1][1] - q[1][1], 2) + power(p[1][2] - q[1][2], 2)) + sqrt(power(p[n][1] - q[m][1], 2) + power(p[n][2] - q[m][2], 2)), 6) AS fde FROM twins", _PAIRS)
def _(t):
    return _r(tr.fde(_pairs(t)).select("round_id", "player", "fde"), "fde")


@query("ade_pct", "SELECT round_id, player, round(sum(sqrt(power(p[((n - 1) * c // 10) + 1][1] - q[((m - 1) * c // 10) + 1][1], 2) + power(p[((n - 1) * c // 10) + 1][2] - q[((m - 1) * c // 10) + 1][2], 2))) / 22, 6) AS ade FROM twins, range(11) r(c) GROUP BY round_id, player", _PAIRS)
def _(t):
    return _r(tr.ade_pct(_pairs(t)).select("round_id", "player", "ade"), "ade")


_WARP = """, rowed AS (
  SELECT round_id, player, p, q, n, m, 0::BIGINT AS i, list_concat([{'c': 0.0::DOUBLE, 'w': ''}], list_transform(range(m), lambda x: {'c': 'inf'::DOUBLE, 'w': ''})) AS cells FROM twins
  UNION ALL
  SELECT round_id, player, p, q, n, m, i + 1, list_reduce(list_concat([[{'c': 'inf'::DOUBLE, 'w': ''}]], list_transform(range(1, m + 1), lambda j: [{'c': j::DOUBLE, 'w': ''}])), lambda done, x:
      list_append(done, list_transform([{'l': done[len(done)], 'd': cells[len(done)], 'u': cells[len(done) + 1]}], lambda z:
        {'c': sqrt(power(p[i + 1][1] - q[len(done)][1], 2) + power(p[i + 1][2] - q[len(done)][2], 2)) + least(z.l.c, z.d.c, z.u.c),
         'w': (CASE WHEN z.l.c <= z.d.c AND z.l.c <= z.u.c THEN z.l.w WHEN z.d.c <= z.u.c THEN z.d.w ELSE z.u.w END) || i || '-' || (len(done) - 1) || ' '})[1]))
  FROM rowed WHERE i < n)"""


@query("dtw", "SELECT round_id, player, round(cells[m + 1].c / (n + m), 6) AS dtw, trim(cells[m + 1].w) AS matched FROM rowed WHERE i = n", _PAIRS + _WARP)
def _(t):
    way = F.array_join(F.transform("matched", lambda x: F.concat_ws("-", x[0], x[1])), " ")
    return _r(wp.dtw(_pairs(t)).select("round_id", "player", "dtw", way.alias("matched")), "dtw")


@query("sim_join")
def _(t):
    rounds = wp.multi_trajectories(tr.make_trajectories(t.pat, ("round_id", "team", "player")))
    return wp.sim_join(rounds, rounds)


@query("interpolate", "SELECT tick_id, round(first_value(x) OVER o * (1 - s) + last_value(x) OVER o * s, 6) AS line_x FROM (SELECT *, coalesce((gt - min(gt) OVER b) / nullif(max(gt) OVER b - min(gt) OVER b, 0), 0.0) AS s FROM (SELECT *, (gt - min(gt) OVER (PARTITION BY round_id, player)) // 7200 AS bl FROM pat) WINDOW b AS (PARTITION BY round_id, player, bl)) WINDOW o AS (PARTITION BY round_id, player, bl ORDER BY gt, tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(t):
    return _r(tr.interpolate(t.pat, 7200, RP).select("tick_id", "line_x"), "line_x")


@query("displacement", "SELECT round_id, player, round(avg(d), 6) AS ade, round(max_by(d, n), 6) AS fde FROM (SELECT round_id, player, sqrt(power(x - z, 2) + power(y - z, 2)) AS d, row_number() OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) AS n FROM pat) WHERE n > 1 GROUP BY ALL")
def _(t):
    return _r(tr.displacement(t.pat, RP, GP, ["x", "y"], ["z", "z"]), "ade", "fde")


@query("rel_offset", "SELECT tick_id, round(x - f, 6) AS rel_x FROM (SELECT *, first_value(x) OVER o AS f, row_number() OVER o - 1 AS n FROM pat WINDOW o AS (PARTITION BY round_id, player ORDER BY gt, tick_id)) WHERE n % 13 = 0")
def _(t):
    return _r(tr.rel_offset(t.pat, ["x"], RP, GP).select("tick_id", "rel_x"), "rel_x")


@query("push_label", "SELECT tick_id, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.25 END AS value FROM pat")
def _(t):
    m = F.col("k") % 3
    return tr.push_label(t.pat.select("tick_id", F.when(m == 0, "push").when(m == 1, "hold").otherwise("0.25").alias("label"))).select("tick_id", "value")


@query("select_rounds", "SELECT tick_id FROM pat WHERE (weapon, round_id) IN (SELECT round_id % 5, round_id FROM rounds)")
def _(t):
    return tr.select_rounds(t.pat, t.rounds.select((F.col("round_id") % 5).cast("int").alias("weapon"), "round_id"), ["weapon", "round_id"]).select("tick_id")


#: Two of each team, and two against one. A state is a player's last row of each half hour.
_ASKED = [
    {"ct": [(20.0, 30.0, 10.0), (60.0, 70.0, 40.0)], "t": [(35.0, 80.0, 5.0), (50.0, 10.0, 60.0)], "target": 2},
    {"ct": [(10.0, 90.0, 20.0), (45.0, 45.0, 45.0)], "t": [(70.0, 20.0, 30.0)], "target": 0},
]


def _knn_sql() -> str:
    """Every mapping written out: of a pair its two orders, of one its only one."""

    def gap(way: str, q: tuple, who: str) -> str:
        parts = [f"{who}.{c} - {v}" for c, v in zip("xyz", q)]
        return f"sqrt({' + '.join(f'power({p}, 2)' for p in parts)})" if way == "l2" else "(" + " + ".join(f"abs({p})" for p in parts) + ")"

    def side(team: str, own: list, way: str) -> tuple[str, str]:
        """(least sum, players in the query's order) of one team."""
        if len(own) == 1:
            return gap(way, own[0], f"{team}[1]"), f"[{team}[1].player]"
        straight, crossed = (" + ".join(gap(way, q, f"{team}[{i}]") for q, i in zip(own, order)) for order in ((1, 2), (2, 1)))
        return f"least({straight}, {crossed})", f"CASE WHEN {straight} <= {crossed} THEN [{team}[1].player, {team}[2].player] ELSE [{team}[2].player, {team}[1].player] END"

    each = []
    for q, asked in enumerate(_ASKED):
        (d_ct, m_ct), (d_t, m_t) = (side(team, asked[team], "l2") for team in ("ct", "t"))
        here = "t" if asked["target"] >= len(asked["ct"]) else "ct"
        place = asked["target"] - (len(asked["ct"]) if here == "t" else 0)
        target = f"(({side(here, asked[here], 'l1')[1]})[{place + 1}])"
        each.append(
            f"SELECT {q} AS query, round_id, at, {d_ct} + {d_t} AS d, list_concat({m_ct}, {m_t}) AS mapping, {target} AS target FROM made WHERE len(ct) = {len(asked['ct'])} AND len(t) = {len(asked['t'])} AND last - gt > 5"
        )
    return f"SELECT query, round_id, at, round(d, 6) AS distance, array_to_string(mapping, ',') AS mapping, target FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, round_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query, round_id ORDER BY d, at) AS n FROM ({' UNION ALL '.join(each)})) WHERE n = 1) WHERE r <= 5"


_STATES = """ends AS (SELECT *, gt // 1800 AS half FROM pat QUALIFY row_number() OVER (PARTITION BY round_id, gt // 1800, player ORDER BY gt DESC, tick_id DESC) = 1),
whole AS (SELECT round_id, half AS at, max(gt) AS gt, coalesce(list({'player': player, 'x': x, 'y': y, 'z': z} ORDER BY player) FILTER (alive AND team = 3), []) AS ct,
  coalesce(list({'player': player, 'x': x, 'y': y, 'z': z} ORDER BY player) FILTER (alive AND team = 2), []) AS t FROM ends GROUP BY ALL),
made AS (SELECT *, max(gt) OVER (PARTITION BY round_id, len(ct), len(t)) AS last FROM whole)"""


def _states(t):
    half = t.pat.withColumn("at", F.floor(F.col("gt") / 1800))
    last = half.groupBy("round_id", "at", "player").agg(F.max(F.struct("gt", "tick_id", "team", "alive", "x", "y", "z")).alias("s")).select("round_id", "at", "player", "s.*")
    return near.team_states(last, ("round_id", "at"))


@query("knn_state", _knn_sql(), _STATES)
def _(t):
    found = near.knn_state(_states(t), _ASKED, 5, key="at")
    return _r(found, "distance").withColumn("mapping", F.array_join(F.transform("mapping", lambda p: p.cast("string")), ","))


@query("find_similar", "SELECT round_id, min(tick_id) AS tick_id FROM pat WHERE abs(x - 40) <= 15 AND abs(y - 50) <= 20 GROUP BY 1")
def _(t):
    return tr.find_similar(t.pat, {"x": 40.0, "y": 50.0}, {"x": 15.0, "y": 20.0}, "round_id")


_SIM = """sim AS (SELECT tick_id AS pred, 'slope' AS metric, 1 AS rank, xor(tick_id, 1) AS truth FROM pat WHERE k % 3 > 0 UNION ALL SELECT tick_id, 'slope', 2, tick_id FROM pat WHERE k % 3 > 0
  UNION ALL SELECT tick_id, 'free', 1, xor(tick_id, 2) FROM pat UNION ALL SELECT tick_id, 'free', 2, xor(tick_id, 4) FROM pat),
labs AS (SELECT tick_id AS truth, y / 99 AS label FROM pat WHERE k % 4 > 0),
ranked AS (SELECT pred, label, row_number() OVER (PARTITION BY pred ORDER BY metric = 'free', rank) AS n FROM sim JOIN labs USING (truth) WHERE {}),
given AS (SELECT DISTINCT sim.pred, coalesce(label, {}) AS label FROM sim LEFT JOIN ranked r ON r.pred = sim.pred AND n = 1)"""


def _sim(t, **how):
    id_, pair = F.col("tick_id"), lambda metric, rank, truth, where="true": t.pat.where(where).select(F.col("tick_id").alias("pred"), F.lit(metric).alias("metric"), F.lit(rank).alias("rank"), truth.alias("truth"))
    flip = lambda n: id_.bitwiseXOR(F.lit(n).cast("long"))
    sim = pair("slope", 1, flip(1), "k % 3 > 0").union(pair("slope", 2, id_, "k % 3 > 0")).union(pair("free", 1, flip(2))).union(pair("free", 2, flip(4)))
    return tr.label_by_match(sim, t.pat.where("k % 4 > 0").select(id_.alias("truth"), (F.col("y") / 99).alias("label")), **how)


@query("label_by_match", "SELECT pred, label FROM given", _SIM.format("rank = 1", "0.5"))
def _(t):
    return _sim(t)


@query(
    "loo_eval",
    "SELECT CASE WHEN g.pred % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN g.label >= 0 THEN floor(g.label * 10) END::INT AS guess_decile, CASE WHEN g.label >= 0 THEN floor(l.label * 10) END::INT AS decile, count(*) AS n, round(avg(CASE WHEN g.label >= 0 THEN abs(g.label - l.label) END), 6) AS error FROM given g JOIN labs l ON l.truth = g.pred GROUP BY 1, 2, 3",
    _SIM.format("pred <> truth", "-1.0"),
)
def _(t):
    truth = t.pat.where("k % 4 > 0").select(F.col("tick_id").alias("pred"), (F.col("y") / 99).alias("label"))
    return _r(tr.loo_eval(_sim(t, leave_self_out=True), truth, t.pat.where("tick_id % 5 = 0").select(F.col("tick_id").alias("pred"))), "error")


_HM = "hm AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)), 0.0) AS speed FROM pat WINDOW o AS (PARTITION BY round_id, player ORDER BY gt, tick_id))"


def _hm(t):
    return b.speed(t.pat, 40.0 + F.col("weapon") * 10)


@query("hm_speed", "SELECT tick_id, round(speed, 6) AS speed, round(least(1.0, speed / (40.0 + weapon * 10)), 6) AS scaled FROM hm", _HM)
def _(t):
    return _r(_hm(t).select("tick_id", "speed", "scaled"), "speed", "scaled")


@query("hm_speed_share", 'SELECT round_id, team, avg(CASE WHEN s >= 0.98 THEN 1.0 ELSE 0 END) AS "full", avg(CASE WHEN s <= 0.02 THEN 1.0 ELSE 0 END) AS still FROM (SELECT *, least(1.0, speed / (40.0 + weapon * 10)) AS s FROM hm) GROUP BY ALL', _HM)
def _(t):
    return b.speed_share(_hm(t))


_AT = _REACH + ", loc AS (SELECT round_id, player, team, arg_max(k % 25, tick_id) AS area FROM pat GROUP BY ALL)"


def _at(t):
    return t.pat.groupBy("round_id", "player", "team").agg(F.max_by(F.col("k") % 25, "tick_id").alias("area"))


def _reach(t):
    from ..operators.spatial import reach_matrix

    return reach_matrix(_edges(t))


@query("hm_mate_dist", "SELECT a.round_id, a.player, min(r.dist) AS distance FROM loc a LEFT JOIN loc b ON b.round_id = a.round_id AND b.team = a.team AND b.player <> a.player LEFT JOIN reach r ON r.src = a.area AND r.dst = b.area GROUP BY ALL", _AT)
def _(t):
    return b.other_distance(_at(t), _reach(t), ["round_id"], True)


@query("hm_enemy_dist", "SELECT a.round_id, a.player, min(r.dist) AS distance FROM loc a LEFT JOIN loc b ON b.round_id = a.round_id AND b.team <> a.team LEFT JOIN reach r ON r.src = a.area AND r.dst = b.area GROUP BY ALL", _AT)
def _(t):
    return b.other_distance(_at(t), _reach(t), ["round_id"], False)


@query("hm_delta_first", "SELECT tick_id, round(x - first_value(x) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id), 6) AS delta FROM pat")
def _(t):
    return _r(b.delta_first(t.pat, "x").select("tick_id", "delta"), "delta")


@query("hm_cover", "SELECT a.round_id, a.player, min(r.dist) AS cover FROM loc a JOIN reach r ON r.src = a.area WHERE NOT EXISTS (SELECT 1 FROM loc e JOIN visible v ON v.src = e.area WHERE e.round_id = a.round_id AND e.team <> a.team AND v.dst = r.dst) GROUP BY ALL", _AT)
def _(t):
    return b.cover_distance(_at(t), t.visible, t.areas, _reach(t), ["round_id"])


@query("hm_bomb", "SELECT a.round_id, player, r.dist AS to_goal FROM loc a LEFT JOIN reach r ON r.src = a.area AND r.dst = a.round_id % 25", _AT)
def _(t):
    goals = t.rounds.select("round_id", (F.col("round_id") % 25).alias("goal"))
    return b.goal_distance(_at(t), goals, _reach(t), ["round_id"]).select("round_id", "player", "to_goal")


@query("hm_collect", "SELECT tick_id, round_id FROM fire WHERE round_id % 2 = 0 UNION ALL SELECT tick_id, round_id FROM kills WHERE round_id % 2 = 0")
def _(t):
    return b.collect_metrics([t.fire.select("tick_id", "round_id"), t.kills.select("tick_id", "round_id")], t.rounds.where("round_id % 2 = 0"))


@query("hm_trace", "SELECT tick_id FROM pat WHERE (round_id, player) IN (SELECT round_id, round_id % 10 FROM rounds)")
def _(t):
    from ..operators.joins import semi

    return semi(t.pat, t.rounds.select("round_id", (F.col("round_id") % 10).alias("player")), RP).select("tick_id")


@query(
    "hm_support",
    "SELECT round_id, team, player, min(gt) AS start, at - min(gt) AS seconds FROM (SELECT f.round_id, 2 + f.player % 2 AS team, f.player, f.gt, min(s.gt) AS at FROM fire f JOIN spotted s ON s.seen AND s.round_id = f.round_id AND s.spotter % 2 = f.player % 2 AND s.spotter <> f.player AND s.gt >= f.gt GROUP BY ALL) GROUP BY round_id, team, player, at",
)
def _(t):
    starts = t.fire.withColumn("team", (2 + F.col("player") % 2).cast("int"))
    sees = t.spotted.where("seen").select("round_id", (2 + F.col("spotter") % 2).cast("int").alias("team"), F.col("spotter").alias("player"), "gt")
    return b.support_time(starts, sees)


@query("baiters", "SELECT DISTINCT k.tick_id, p.player FROM (SELECT k.*, 2 + k.victim % 2 AS vteam, q.x AS kx, q.y AS ky FROM kills k JOIN pat q USING (tick_id)) k JOIN pat p ON p.round_id = k.round_id AND p.team = k.vteam AND p.player <> k.victim AND p.alive AND p.gt BETWEEN k.gt - 3600 AND k.gt AND sqrt(power(p.x - kx, 2) + power(p.y - ky, 2)) <= 30")
def _(t):
    k = t.kills.join(t.pat.select("tick_id", "x", "y"), "tick_id").withColumn("team", (2 + F.col("victim") % 2).cast("int"))
    return b.baiters(k, t.pat, 3600, 30.0)


_AIM = """, windowed AS (SELECT *, lag(x) OVER o AS xb, lead(x) OVER o AS xa, bool_and(alive) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS lives FROM pat WINDOW o AS (PARTITION BY round_id, player ORDER BY gt, tick_id)),
chosen AS (SELECT p.*, e.attacker, e.victim, e.start, e.stop, list_max(hurt_ids) >= p.tick_id AS hit FROM windowed p JOIN eng e ON e.round_id = p.round_id AND e.attacker = p.player AND p.gt BETWEEN e.start AND e.stop WHERE lives
  QUALIFY row_number() OVER (PARTITION BY p.tick_id, e.attacker ORDER BY hit DESC, CASE WHEN hit THEN e.start END, CASE WHEN hit THEN e.victim END, CASE WHEN NOT hit THEN e.stop END DESC, CASE WHEN NOT hit THEN e.victim END DESC) = 1),
aimed AS (SELECT c.*, c.view - degrees(atan2(v.y - c.y, v.x - c.x)) + 180 AS raw FROM chosen c ASOF LEFT JOIN pat v ON v.round_id = c.round_id AND v.player = c.victim AND v.tick_id <= c.tick_id)"""


@query("ds_aim", 'SELECT tick_id, attacker, victim, xb AS "x (t-1)", xa AS "x (t+1)", round(raw - 360 * floor(raw / 360) - 180, 6) AS turn FROM aimed', _ENG + _AIM)
def _(t):
    return _r(g.aim_rows(_eng(t), t.pat, 4800, 1, 1, ["x"]).select("tick_id", "attacker", "victim", "x (t-1)", "x (t+1)", "turn"), "turn")


@query("ds_aim_link", "SELECT round_id, attacker, victim, start, tick_id, stop - gt AS to_end FROM chosen", _ENG + _AIM)
def _(t):
    return g.aim_links(_eng(t), g.aim_rows(_eng(t), t.pat, 4800, 1, 1, ["x"]))


@query(
    "ds_nav",
    "SELECT s.round_id, s.player, s.start, (p.gt - s.start) // 1800 AS bucket, arg_min(p.tick_id, p.gt * 1000000 + p.tick_id) AS tick_id FROM (SELECT round_id, player, min(gt) AS start, max(gt) AS stop FROM (SELECT *, count(*) FILTER (NOT free) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT p.*, p.alive AND e.round_id IS NULL AS free FROM pat p LEFT JOIN (SELECT DISTINCT q.tick_id, e.round_id FROM eng e JOIN pat q ON q.round_id = e.round_id AND q.player IN (e.attacker, e.victim) AND q.gt BETWEEN e.start AND e.stop) e USING (tick_id))) WHERE free GROUP BY round_id, player, i) s JOIN pat p ON p.round_id = s.round_id AND p.player = s.player AND p.gt BETWEEN s.start AND s.stop GROUP BY s.round_id, s.player, s.start, bucket",
    _ENG,
)
def _(t):
    spans = ev.non_engagement(t.pat, _eng(t), 4800)
    return g.nav_rows(spans, t.pat, 1800, 4800)


@query("ds_next_area", "SELECT * FROM (SELECT round_id, player, at, area, lag(area) OVER o AS old_area, lead(area) OVER o AS next_area FROM (SELECT round_id, player, gt // 3600 AS at, arg_min(k % 25, gt * 1000000 + tick_id) AS area FROM pat GROUP BY ALL) WINDOW o AS (PARTITION BY round_id, player ORDER BY at)) WHERE old_area IS NOT NULL AND next_area IS NOT NULL")
def _(t):
    return g.next_area_rows(t.pat.withColumn("area", F.col("k") % 25), 3600)


@query("ds_nav_traj", "SELECT round_id, player, area, min(tick_id) AS start, max(tick_id) AS \"end\", count(*) AS length FROM (SELECT *, sum(n) OVER (PARTITION BY round_id, player ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT round_id, player, tick_id, k % 3 AS area, CASE WHEN k % 3 = lag(k % 3) OVER (PARTITION BY round_id, player ORDER BY tick_id) THEN 0 ELSE 1 END AS n FROM pat)) GROUP BY round_id, player, area, i")
def _(t):
    return g.area_sequence(t.pat.withColumn("area", F.col("k") % 3))


@query("ds_engage", "SELECT tick_id, coalesce(bool_or(kind = 'click') OVER (PARTITION BY round_id, player ORDER BY gt RANGE BETWEEN 1 FOLLOWING AND 3600 FOLLOWING), false) AS fires_soon, count(*) FILTER (kind = 'error') OVER (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hurt_before FROM pat")
def _(t):
    return g.engage_rows(t.pat).select("tick_id", "fires_soon", "hurt_before")


_TEAM = """starts AS (SELECT *, row_number() OVER (PARTITION BY round_id, team ORDER BY f, player) - 1 AS slot FROM (SELECT round_id, team, player, min(tick_id) AS f FROM pat GROUP BY ALL)),
counted AS (SELECT p.*, slot, tick_id - max(CASE WHEN kind = 'click' THEN tick_id END) OVER u AS since_shot, tick_id - max(CASE WHEN kind = 'error' THEN tick_id END) OVER u AS since_hurt, count(*) FILTER (kind = 'click') OVER u AS shots, gt // 7200 AS "when"
  FROM pat p JOIN starts USING (round_id, team, player) WHERE slot < 5 WINDOW u AS (PARTITION BY round_id, player ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING)),
latest AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY round_id, "when", player ORDER BY gt DESC, tick_id DESC) = 1),
planted AS (SELECT round_id, min(tick_id) AS plant FROM grenades WHERE kind4 = 1 GROUP BY 1), saved AS (SELECT round_id, min(tick_id) AS defusal FROM kills WHERE headshot AND tick_id % 16 = 0 GROUP BY 1),
box AS (SELECT l.round_id, l.tick_id, area, row_number() OVER (PARTITION BY l.tick_id ORDER BY sqrt(power(greatest(x0 - x, 0, x - x1), 2) + power(greatest(y0 - y, 0, y - y1), 2) + power(greatest(z0 - z, 0, z - z1), 2)), area) AS n FROM latest l, areas WHERE alive),
carried AS (SELECT round_id, tick_id, (tick_id % 97)::DOUBLE AS bx, (tick_id % 89)::DOUBLE AS "by" FROM pat WHERE kind <> 'view')"""


@query(
    "team_features",
    "SELECT l.round_id, \"when\" AS at, l.team, player, slot, round(x, 6) AS x, alive, since_shot, since_hurt, shots, area, CASE WHEN defusal <= l.tick_id THEN 'defused' WHEN plant <= l.tick_id THEN 'planted' ELSE 'carried' END AS bomb, CASE WHEN bx IS NOT NULL THEN CASE WHEN sqrt(power(bx - 20, 2) + power(\"by\" - 70, 2)) <= sqrt(power(bx - 80, 2) + power(\"by\" - 30, 2)) THEN 'A' ELSE 'B' END END AS site, round(coalesce((max(gt) OVER r - gt) / nullif(max(gt) OVER r - min(gt) OVER r, 0), 0.0), 6) AS \"left\" FROM latest l LEFT JOIN planted USING (round_id) LEFT JOIN saved USING (round_id) LEFT JOIN box ON box.tick_id = l.tick_id AND n = 1 ASOF LEFT JOIN carried c ON c.round_id = l.round_id AND c.tick_id <= l.tick_id WINDOW r AS (PARTITION BY l.round_id)",
    _TEAM,
)
def _(t):
    bomb = t.pat.where("kind <> 'view'").select("tick_id", (F.col("tick_id") % 97).cast("double").alias("bomb_x"), (F.col("tick_id") % 89).cast("double").alias("bomb_y"))
    plants = t.grenades.where("kind4 = 1").select("round_id", "tick_id")
    defusals = t.kills.where("headshot AND tick_id % 16 = 0").select("round_id", "tick_id")
    out = g.team_features(t.pat, 7200, plants, defusals, bomb, {"A": (20.0, 70.0), "B": (80.0, 30.0)}, t.areas, 20.0)
    return _r(out.drop("y", "z"), "x", "left")


@query("split_groups", "SELECT tick_id, round_id, CASE WHEN ('0x' || substr(md5('0:' || round_id), 1, 8))::BIGINT % 10000 < 8000 THEN 'train' ELSE 'test' END AS split FROM pat")
def _(t):
    return g.split_groups(t.pat, "round_id").select("tick_id", "round_id", "split")


@query("std_scale", "SELECT tick_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 4) AS scaled_x FROM pat")
def _(t):
    return _r(g.std_scale(t.pat, ["x"]).select("tick_id", "scaled_x"), "scaled_x", n=4)


@query("angle_scale", "SELECT tick_id, round(sin(radians(view)), 6) AS sin_view, round(cos(radians(view)), 6) AS cos_view FROM pat")
def _(t):
    return _r(g.angle_scale(t.pat, ["view"]).select("tick_id", "sin_view", "cos_view"), "sin_view", "cos_view")


@query("one_hot", "SELECT tick_id, (weapon = 0)::INT AS weapon_0, (weapon = 3)::INT AS weapon_3, CASE WHEN weapon IN (0, 3) THEN weapon END AS back FROM pat")
def _(t):
    return g.one_hot(t.pat, "weapon", [0, 3]).select("tick_id", "weapon_0", "weapon_3", "back")


@query("log_reg")
def _(t):
    scored, _, _ = g.log_reg(t.pat.withColumn("y1", (F.col("x") > 30).cast("int")), ["x", "y"], "y1")
    return scored.select("tick_id", "prediction", F.round("p", 3).alias("p"))


@query("first_last", "SELECT DISTINCT round_id, first_value(x) OVER o AS first, last_value(x) OVER o AS last FROM pat WINDOW o AS (PARTITION BY round_id ORDER BY tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(t):
    return b.first_last(t.pat, "x", ["round_id"], "tick_id").select("round_id", "first", "last").distinct()


@query("island_count", "SELECT round_id, player, count(*) FILTER (n = 1) AS islands FROM (SELECT round_id, player, CASE WHEN gt - lag(gt) OVER (PARTITION BY round_id, player ORDER BY gt, tick_id) <= 3600 THEN 0 ELSE 1 END AS n FROM pat) GROUP BY ALL")
def _(t):
    marked = w.islands(t.pat, RP, GP, F.col("gt") - F.lag("gt").over(w.over(RP, GP)) > 3600)
    return marked.groupBy(*RP).agg(F.max("island").alias("islands"))
