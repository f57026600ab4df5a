"""The finished match questions over match tables projected from the driver's tables.

MATCH holds the projections once, as text that both engines read: ten players in three games of ten rounds; at every
tick two players have a state. A clock second is a game tick; RATE ticks count as one second of the questions, so that
their gaps and reaction times fall where these events are some hundred ticks apart. The questions themselves are
written twice, with operators for Spark and as SQL for checking.
"""

from __future__ import annotations

from types import SimpleNamespace

from ..operators import match_queries as m
from .domain import Tables, query

RATE, DEMO_RATE = 20_000, 20

#: name: (the projection, the driver's tables that it reads beside `pat`)
MATCH: dict[str, str] = {
    "games": f"SELECT DISTINCT CAST(floor(round_id / 10.0) AS BIGINT) AS id, concat('demo', CAST(floor(round_id / 10.0) AS BIGINT)) AS demo_file, CAST({RATE} AS DOUBLE) AS game_tick_rate, CAST({DEMO_RATE} AS DOUBLE) AS demo_tick_rate FROM {{pat}}",
    "rounds": "SELECT round_id AS id, CAST(floor(round_id / 10.0) AS BIGINT) AS game_id, min(tick_id) AS start_tick, max(tick_id) AS end_tick, round_id % 7 = 0 AS warmup FROM {pat} GROUP BY round_id",
    "ticks": "SELECT tick_id AS id, CASE WHEN tick_id % 97 = 0 THEN -1 ELSE round_id END AS round_id, tick_id AS demo_tick_number, gt AS game_tick_number FROM {pat}",
    "player_at_tick": """
        SELECT tick_id, player AS player_id, floor(x / 8) AS pos_x, floor(y / 8) AS pos_y, z AS pos_z, view AS view_x, alive AS is_alive, z > 48 AS is_airborne, z < 16 AS is_crouching,
               CASE WHEN k % 5 = 0 THEN 1.5E0 ELSE 0E0 END AS remaining_flash_time, weapon + 1 AS active_weapon, 1 + k % 3 AS primary_weapon, k % 4 AS primary_bullets_clip, 4 + k % 2 AS secondary_weapon, k % 3 AS secondary_bullets_clip FROM {pat}
        UNION ALL
        SELECT tick_id, other, floor(x / 16), 12 - floor(y / 8), 64 - z, (view + 135) % 360, kind <> 'signup', z < 8, z > 40,
               CASE WHEN k % 7 = 0 THEN 0.5E0 ELSE 0E0 END, 1 + (weapon + 2) % 5, 1 + (k + 1) % 3, (k + 1) % 4, 4 + (k + 1) % 2, (k + 2) % 3 FROM {pat}""",
    "weapon_fire": "SELECT tick_id, player AS shooter, weapon + 1 AS weapon FROM {pat} WHERE kind = 'click' UNION ALL SELECT tick_id, other, weapon + 1 FROM {pat} WHERE kind = 'error'",
    "hurt": """
        SELECT 2 * tick_id AS id, tick_id, player AS victim, other AS attacker, weapon + 1 AS weapon, 1 + k % 3 AS hit_group FROM {pat} WHERE kind = 'error'
        UNION ALL SELECT 2 * tick_id + 1, tick_id, player, (player + 1) % 10, weapon + 1, 1 + k % 2 FROM {pat} WHERE kind = 'error' AND k % 2 = 0""",
    "kills": "SELECT tick_id, player AS killer, other AS victim, weapon + 1 AS weapon FROM {pat} WHERE kind = 'purchase'",
    "spotted": """
        SELECT tick_id, player AS spotter_player, other AS spotted_player, k % 2 = 0 AS is_spotted FROM {pat} WHERE kind = 'view'
        UNION ALL SELECT tick_id, player, (player + 3) % 10, k % 3 <> 0 FROM {pat} WHERE kind = 'view'""",
    "lookers": "SELECT tick_id, player AS looker_player_id, CASE WHEN k % 3 = 0 THEN (player + 3) % 10 ELSE other END AS looked_at_player_id FROM {pat} WHERE kind IN ('view', 'click', 'signup')",
    "visibilities": "SELECT concat('demo', CAST(floor(round_id / 10.0) AS BIGINT)) AS demo, player AS spotter_id, other AS spotted_id, gt AS start_game_tick, gt + k * 100 AS end_game_tick, CAST(floor(round_id / 10.0) AS INT) % 3 AS hacking FROM {pat} WHERE kind = 'signup'",
    "visibilities_unadjusted": """
        SELECT concat('demo', CAST(floor(round_id / 10.0) AS BIGINT)) AS demo, player AS spotter_id, CASE WHEN k % 2 = 0 THEN other ELSE (player + 3) % 10 END AS spotted_id, gt + 1 AS start_game_tick, gt + k * 120 AS end_game_tick,
               CAST(floor(round_id / 10.0) AS INT) % 3 AS hacking FROM {pat} WHERE kind = 'signup'""",
    "nearest_origin": "SELECT tick_id, player AS player_id, CAST(k % 25 AS INT) AS origin_id FROM {pat}",
    "team_looking_at_cover_edge_cluster": """
        SELECT tick_id, player AS origin_player_id, k % 4 AS cover_edge_cluster_id FROM {pat} WHERE kind IN ('view', 'signup') AND k % 5 <> 0
        UNION ALL SELECT tick_id, player, (k * 3 + 1) % 4 FROM {pat} WHERE kind IN ('view', 'signup') AND k % 3 = 0""",
    "cover_origins": "SELECT CAST(n_nationkey AS INT) AS index, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey % 7 AS DOUBLE) AS y, CAST(n_regionkey AS DOUBLE) AS z FROM {nation}",
    "cover_edges": "SELECT CAST(s_nationkey AS INT) AS origin_id, s_suppkey % 4 AS cluster_id FROM {supplier}",
}

#: Thresholds of the registered questions where the published ones find nothing in these tables.
HOW = {"q_run_hs": {"around": 40, "least_speed": 5}, "q_hand_aim": {"before": 3 * RATE}, "q_hand_fire": {"before": RATE}, "q_hand_final": {"before": RATE}}


def match_tables(t: Tables) -> SimpleNamespace:
    given = {"pat": t.pat, "nation": t.raw("nation"), "supplier": t.raw("supplier")}
    return SimpleNamespace(**{name: t.spark.sql(text, **{k: df for k, df in given.items() if f"{{{k}}}" in text}) for name, text in MATCH.items()})


_TABLES = ",\n".join(f'm_{name} AS ({text.format(pat="pat", nation="nation", supplier="supplier")})' for name, text in MATCH.items())
_RP = "PARTITION BY round_id, player_id ORDER BY tick_id"

#: name: a CTE, written apart from the operators. Each uses those before it.
STEPS: dict[str, str] = {
    "at": """SELECT k.id AS tick_id, k.round_id, k.game_tick_number AS gt, r.game_id, r.warmup, r.end_tick, g.demo_file AS demo, g.game_tick_rate AS rate, g.demo_tick_rate AS demo_rate
        FROM m_ticks k JOIN m_rounds r ON k.round_id = r.id JOIN m_games g ON r.game_id = g.id""",
    "state": """SELECT p.*, a.* EXCLUDE (tick_id) FROM m_player_at_tick p JOIN at a USING (tick_id)""",
    "moving": f"""SELECT *, pos_x - lag(pos_x) OVER ({_RP}) AS dx, pos_y - lag(pos_y) OVER ({_RP}) AS dy, lag(view_x) OVER ({_RP}) AS was_view FROM state""",
    "moved": f"""SELECT *, coalesce((dx <> 0 OR dy <> 0) AND is_alive, false) AS walks, NOT (coalesce(dx, 1) = 0 AND coalesce(dy, 1) = 0) AND dx IS NOT NULL AS shifts, degrees(atan2(dy, dx)) + 360 AS way, view_x + 360 AS look,
        CASE WHEN view_x > 350 AND was_view < 10 THEN view_x - was_view - 360 WHEN was_view > 350 AND view_x < 10 THEN view_x - was_view + 360 ELSE view_x - was_view END AS turn FROM moving""",
    "kd": """SELECT p.player_id, (SELECT count(*) FROM m_kills k JOIN m_player_at_tick s ON s.tick_id = k.tick_id AND s.player_id = k.killer WHERE k.killer = p.player_id) AS num_kills,
        (SELECT count(*) FROM m_kills k JOIN m_player_at_tick s ON s.tick_id = k.tick_id AND s.player_id = k.victim WHERE k.victim = p.player_id) AS num_deaths FROM (SELECT DISTINCT player_id FROM state) p""",
    "arcs": f"""SELECT *, count(*) FILTER (sign(turn) <> sign(was_turn) OR turn > 100) OVER ({_RP} ROWS UNBOUNDED PRECEDING) AS arc FROM (SELECT *, lag(turn) OVER ({_RP}) AS was_turn FROM moved)""",
    "turns": """SELECT *, sum(abs(turn)) OVER (PARTITION BY round_id, player_id, arc ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS turn_amount FROM arcs""",
    "shots": """SELECT a.*, f.shooter, h.victim, h.victim IS NOT NULL AS is_hit FROM m_weapon_fire f JOIN at a USING (tick_id) LEFT JOIN m_hurt h USING (tick_id)""",
    "bursts": """SELECT *, sum(CASE WHEN gt - before < rate THEN 0 ELSE 1 END) OVER s AS burst_id, count(*) FILTER (is_hit) OVER s AS hits FROM (
        SELECT *, lag(gt) OVER (PARTITION BY round_id ORDER BY tick_id, shooter, victim NULLS FIRST) AS before FROM shots) WINDOW s AS (PARTITION BY round_id ORDER BY tick_id, shooter, victim NULLS FIRST ROWS UNBOUNDED PRECEDING)""",
    "since_hit": """SELECT b.round_id, b.burst_id, b.gt, b.tick_id, b.shooter, b.victim, h.gt AS hit FROM bursts b JOIN bursts h ON h.is_hit AND b.hits = h.hits AND b.burst_id = h.burst_id AND b.round_id = h.round_id""",
    "sight": """SELECT *, count(*) FILTER (was AND NOT is_spotted) OVER (PARTITION BY round_id, spotter_id, spotted_id ORDER BY tick_id ROWS UNBOUNDED PRECEDING) AS region FROM (
        SELECT a.*, s.spotter_player AS spotter_id, s.spotted_player AS spotted_id, s.is_spotted, lag(s.is_spotted, 1, false) OVER p AS was, lag(a.gt, 1, 0) OVER p AS prev_gt, lead(a.gt) OVER p AS next_gt
        FROM m_spotted s JOIN at a USING (tick_id) WINDOW p AS (PARTITION BY a.round_id, s.spotter_player, s.spotted_player ORDER BY tick_id))""",
    "boxes": """SELECT s.demo, s.spotter_id, s.spotted_id, min(s.gt) AS start_gt, max(s.next_gt) AS end_gt, h.hacking FROM sight s JOIN (SELECT DISTINCT demo, hacking FROM m_visibilities) h USING (demo)
        WHERE is_spotted GROUP BY s.demo, s.spotter_id, s.spotted_id, h.hacking, s.round_id, s.region""",
    "spans": """SELECT *, coalesce(lead(start_gt) OVER s, 10000000) AS next_start, CASE WHEN row_number() OVER s = 1 THEN 0 ELSE lag(end_gt) OVER s END AS last_end FROM (
          SELECT demo, spotter_id, spotted_id, start_game_tick AS start_gt, end_game_tick AS end_gt, hacking, 0 AS technique FROM m_visibilities
          UNION SELECT demo, spotter_id, spotted_id, start_game_tick, end_game_tick, hacking, 1 FROM m_visibilities_unadjusted UNION SELECT *, 2 FROM boxes)
        WINDOW s AS (PARTITION BY technique, demo, spotter_id, spotted_id ORDER BY start_gt, end_gt NULLS FIRST)""",
    "lasting": """SELECT *, lead(gt) OVER (PARTITION BY game_id ORDER BY tick_id) AS until FROM at""",
    "located": """SELECT s.*, l.tick_id AS start_tick, l.round_id, l.game_id, l.rate AS game_tick_rate FROM spans s JOIN lasting l ON l.demo = s.demo AND s.start_gt >= l.gt AND (s.start_gt < l.until OR l.until IS NULL)""",
    "living": """SELECT l.* FROM located l JOIN m_player_at_tick p ON p.tick_id = l.start_tick AND p.player_id = l.spotter_id WHERE p.is_alive""",
    "crowded": """SELECT l.*, (SELECT count(DISTINCT o.spotted_id) FROM living o WHERE o.demo = l.demo AND o.technique = l.technique AND o.spotter_id = l.spotter_id AND o.spotted_id <> l.spotted_id
          AND o.start_gt < coalesce(l.end_gt, 10000000) AND l.start_gt < coalesce(o.end_gt, 10000000) AND l.start_gt < coalesce(l.end_gt, 10000000) AND o.start_gt < coalesce(o.end_gt, 10000000)) AS others FROM living l""",
    "peeks": """SELECT *, CASE WHEN gap > 0.1 THEN 1 ELSE 0 END AS new_look FROM (
        SELECT a.*, l.looker_player_id AS spotter_id, l.looked_at_player_id AS spotted_id, (a.gt - lag(a.gt, 1, 0) OVER (PARTITION BY a.game_id, a.round_id, l.looker_player_id, l.looked_at_player_id ORDER BY tick_id)) / a.rate AS gap FROM m_lookers l JOIN at a USING (tick_id))""",
    "looked": """SELECT *, sum(new_look) OVER (PARTITION BY game_id, round_id, spotter_id, spotted_id ORDER BY tick_id ROWS UNBOUNDED PRECEDING)::BIGINT AS look_id FROM peeks""",
    "looks": """SELECT demo, game_id, round_id, spotter_id, spotted_id, tick_id, gt, new_look, look_id,
          round(sum(CASE new_look WHEN 1 THEN 0 ELSE gap END) OVER (PARTITION BY game_id, round_id, spotter_id, spotted_id, look_id ORDER BY tick_id ROWS UNBOUNDED PRECEDING), 6) AS running,
          round(sum(CASE new_look WHEN 1 THEN 0 ELSE gap END) OVER (PARTITION BY game_id, round_id, spotter_id, spotted_id, look_id), 6) AS length FROM looked""",
    "aimed": """SELECT c.*, (SELECT min(l.gt) FROM looks l WHERE l.new_look = 1 AND l.length >= 0.1 AND l.demo = c.demo AND l.spotter_id = c.spotter_id AND l.spotted_id = c.spotted_id
          AND l.gt BETWEEN c.start_gt - 3 * c.game_tick_rate AND c.next_start) AS aim_gt FROM crowded c""",
    "fired": """SELECT c.*, (SELECT min(a.gt) FROM m_weapon_fire f JOIN at a USING (tick_id) WHERE a.demo = c.demo AND f.shooter = c.spotter_id AND a.gt BETWEEN c.start_gt AND c.next_start) AS fire_gt FROM aimed c""",
    "bounds": """SELECT game_id, round_id, min(tick_id) AS min_tick, max(tick_id) AS max_tick, min(gt) AS min_gt, max(gt) AS max_gt FROM at WHERE gt > 10 GROUP BY game_id, round_id""",
    "clusters": """SELECT o.index, o.x, o.y, o.z, count(DISTINCT e.cluster_id) AS num_clusters FROM m_cover_origins o JOIN m_cover_edges e ON e.origin_id = o.index GROUP BY o.index, o.x, o.y, o.z""",
    "covered": """SELECT f.*, n.origin_id, c.num_clusters, (SELECT count(DISTINCT w.cover_edge_cluster_id) FROM m_team_looking_at_cover_edge_cluster w JOIN at a USING (tick_id)
          WHERE a.demo = f.demo AND a.gt = f.start_gt AND w.origin_player_id = f.spotter_id) AS watched
        FROM fired f JOIN m_nearest_origin n ON n.tick_id = f.start_tick AND n.player_id = f.spotter_id JOIN clusters c ON c.index = n.origin_id""",
    "final": """SELECT c.demo, c.technique, c.spotter_id, c.spotted_id, c.start_gt, c.end_gt, c.hacking, c.game_id, b.round_id, c.start_tick, c.others, (c.start_gt - c.last_end) / c.game_tick_rate < 5 AS seen_lately,
          (c.aim_gt - c.start_gt) / c.game_tick_rate AS aim_react_s, (c.fire_gt - c.start_gt) / c.game_tick_rate AS fire_react_s, c.watched / c.num_clusters AS clusters_covered,
          c.aim_gt - c.start_gt AS aim_ticks, c.fire_gt - c.start_gt AS fire_ticks, c.game_tick_rate
        FROM covered c JOIN bounds b ON b.game_id = c.game_id AND c.start_gt >= b.min_gt AND c.start_gt < b.max_gt""",
    "log": """SELECT demo, tick_id, gt, spotter_id, spotted_id, is_spotted, CASE WHEN is_spotted THEN gt ELSE first_value(prev_gt) OVER (PARTITION BY round_id, spotter_id, spotted_id, region ORDER BY tick_id) END AS last_spotted_gt FROM sight""",
    "hand": """SELECT demo, spotter_id, spotted_id, start_game_tick AS start_gt, end_game_tick AS end_gt, hacking, lead(start_game_tick, 1, 10000000) OVER h AS next_start, lag(end_game_tick, 1, 0) OVER h AS last_end
        FROM m_visibilities_unadjusted WINDOW h AS (PARTITION BY demo, spotter_id, spotted_id ORDER BY start_game_tick, end_game_tick)""",
    "compared": """SELECT h.demo, h.spotter_id, h.spotted_id, h.start_gt, h.end_gt, h.next_start, h.last_end, h.hacking, min(l.tick_id) AS log_tick_id, min(l.gt) AS log_gt
        FROM log l FULL JOIN hand h ON h.demo = l.demo AND h.spotter_id = l.spotter_id AND h.spotted_id = l.spotted_id AND l.gt BETWEEN h.start_gt AND h.next_start AND l.is_spotted GROUP BY ALL""",
    "hand_crowd": """SELECT c.*, (SELECT count(DISTINCT o.spotted_id) FROM compared o WHERE o.demo = c.demo AND o.spotter_id = c.spotter_id AND o.spotted_id <> c.spotted_id
          AND o.start_gt < c.end_gt AND c.start_gt < o.end_gt AND c.start_gt < c.end_gt AND o.start_gt < o.end_gt) AS others FROM compared c""",
    "hand_aimed": f"""SELECT c.*, (SELECT min(l.gt) FROM looks l WHERE l.running >= 0.1 AND l.demo = c.demo AND l.spotter_id = c.spotter_id AND l.spotted_id = c.spotted_id AND l.gt BETWEEN c.start_gt - {{before_aim}} AND c.next_start) AS aim_gt FROM hand_crowd c""",
    "hand_fired": f"""SELECT c.*, (SELECT min(a.gt) FROM m_hurt h JOIN at a USING (tick_id) WHERE a.demo = c.demo AND h.attacker = c.spotter_id AND h.victim = c.spotted_id AND a.gt BETWEEN c.start_gt - {RATE} AND c.next_start) AS fire_gt FROM hand_aimed c""",
    "grouped": """SELECT hacking, technique, game_id, round_id // 5 AS block, spotter_id, count(*) AS num, min(round_id) AS min_round_id, max(round_id) AS max_round_id, min(aim_react_s) AS min_aim_react_s, max(aim_react_s) AS max_aim_react_s,
          min(fire_react_s) FILTER (fire_react_s <= 2) AS min_fire_react_s, max(fire_react_s) FILTER (fire_react_s <= 2) AS max_fire_react_s, sum(aim_ticks) / count(aim_ticks) / max(game_tick_rate) AS avg_aim_react_s,
          sum(fire_ticks) FILTER (fire_react_s <= 2) / count(fire_ticks) FILTER (fire_react_s <= 2) / max(game_tick_rate) AS avg_fire_react_s, avg(others) AS avg_others, round(avg(clusters_covered), 6) AS avg_clusters_covered, count(*) FILTER (aim_react_s < -1.5) AS preaims
        FROM final GROUP BY hacking, technique, game_id, block, spotter_id""",
}

_HEAD = "SELECT h.tick_id, h.attacker, h.victim, {} FROM m_hurt h, m_player_at_tick p WHERE p.tick_id = h.tick_id AND p.player_id = h.attacker AND h.hit_group = 1 AND {}"
_SHARE = "count(*) FILTER (is_alive AND {0}) / nullif(count(*) FILTER (is_alive), 0)"
_OFF = "abs(way % {0} - look % {0})"

#: name: the question over the steps.
QUESTIONS: dict[str, str] = {
    "q_360": "SELECT t.round_id, t.tick_id, t.player_id, h.victim, round(t.turn_amount, 6) AS turn_amount FROM turns t JOIN m_hurt h ON h.tick_id = t.tick_id AND h.attacker = t.player_id WHERE t.turn_amount > 310",
    "q_run": f"SELECT round_id, player_id, stretch, count(*) AS length FROM (SELECT *, count(*) FILTER (NOT walks) OVER ({_RP} ROWS UNBOUNDED PRECEDING) AS stretch FROM moved) WHERE is_alive GROUP BY ALL",
    "q_miss_burst": """SELECT round_id, burst_id::BIGINT AS burst_id, gt, gt - hit AS ticks_between_hits FROM (
        SELECT *, lead(hit) OVER (PARTITION BY round_id ORDER BY tick_id, shooter, victim NULLS FIRST) AS later FROM since_hit) WHERE later IS DISTINCT FROM hit""",
    "q_flash_hs": _HEAD.format("p.remaining_flash_time", "p.remaining_flash_time > 0"),
    "q_jump_hs": _HEAD.format("p.pos_z", "p.is_airborne"),
    "q_air_kill": "SELECT k.tick_id, k.killer, k.victim, p.pos_z FROM m_player_at_tick p, m_kills k WHERE k.victim = p.player_id AND k.tick_id = p.tick_id AND p.is_airborne",
    "q_kpr": "SELECT k.killer, a.round_id, count(*) AS kills_per_round FROM m_kills k JOIN at a ON a.tick_id = k.tick_id WHERE NOT a.warmup GROUP BY k.killer, a.round_id",
    "q_move_kd": """SELECT s.player_id, s.percent_moved, k.num_kills, k.num_deaths, k.num_kills / nullif(k.num_deaths, 0) AS kd, k.num_kills / nullif(s.percent_moved, 0) AS kills_per_movement
        FROM (SELECT player_id, count(*) FILTER (walks) / nullif(count(*) FILTER (is_alive), 0) AS percent_moved FROM moved GROUP BY player_id) s JOIN kd k USING (player_id)""",
    "q_no_ammo": """SELECT k.tick_id, max(p.tick_id) AS switched_at, max(p.active_weapon) AS had, max(k.weapon) AS weapon, max(k.killer) AS killer
        FROM m_kills k JOIN at a USING (tick_id) JOIN m_player_at_tick p ON p.player_id = k.killer AND p.tick_id <= k.tick_id AND p.tick_id >= k.tick_id - 2 * a.demo_rate
        WHERE p.active_weapon <> k.weapon AND p.active_weapon BETWEEN 1 AND 399 AND k.weapon BETWEEN 1 AND 399
          AND (p.primary_weapon = p.active_weapon AND p.primary_bullets_clip = 0 OR p.secondary_weapon = p.active_weapon AND p.secondary_bullets_clip = 0) GROUP BY k.tick_id""",
    "q_crouch": f"SELECT round_id, player_id, {_SHARE.format('is_crouching')} AS pct_crouching FROM state WHERE NOT warmup GROUP BY round_id, player_id",
    "q_pairs": "SELECT a.round_id, a.tick_id, a.player_id AS p1, b.player_id AS p2 FROM state a JOIN m_player_at_tick b ON a.tick_id = b.tick_id WHERE a.player_id < b.player_id",
    "q_react_damage": f"""SELECT m.game_id, m.round_id, h.hurt_tick_id, m.player_id, min(m.gt) AS first_gt, {_SHARE.format('shifts AND ' + _OFF.format(180) + ' < 45')} AS percent_forward, {_SHARE.format('shifts AND ' + _OFF.format(180) + ' > 135')} AS percent_backward,
          {_SHARE.format('shifts AND ' + _OFF.format(180) + ' > 45 AND ' + _OFF.format(180) + ' < 135')} AS percent_strafe, round(sum(CASE WHEN is_alive THEN turn ELSE 0 END), 6) AS amount_turn,
          {_SHARE.format('is_airborne')} AS percent_airborne, {_SHARE.format('is_crouching')} AS percent_crouching
        FROM (SELECT DISTINCT tick_id AS hurt_tick_id, victim FROM m_hurt) h JOIN at a ON a.tick_id = h.hurt_tick_id JOIN moved m ON m.player_id = h.victim AND m.round_id = a.round_id AND m.tick_id BETWEEN h.hurt_tick_id AND h.hurt_tick_id + 2 * a.demo_rate
        GROUP BY m.game_id, m.round_id, h.hurt_tick_id, m.player_id""",
    "q_revenge": """SELECT * FROM (WITH k AS (SELECT a.round_id, k.* FROM m_kills k JOIN at a USING (tick_id)),
        f AS (SELECT *, (SELECT min(n.tick_id) FROM k n WHERE n.killer = k.victim AND n.round_id = k.round_id + 1) AS next_tick FROM k)
        SELECT DISTINCT f.round_id, f.victim, f.tick_id, f.killer AS revenge_starter, f.next_tick, e.killer AS revenge_ender FROM f JOIN k e ON e.tick_id = f.next_tick AND e.victim = f.killer)""",
    "q_run_hs": """SELECT id, tick_id, player_id, round(speed, 6) AS speed FROM (
        SELECT h.id, h.tick_id AS base, s.tick_id, s.player_id,
          sqrt(power(lead(pos_x) OVER w - lag(pos_x) OVER w, 2) + power(lead(pos_y) OVER w - lag(pos_y) OVER w, 2) + power(lead(pos_z) OVER w - lag(pos_z) OVER w, 2)) / nullif(lead(gt) OVER w - lag(gt) OVER w, 0) * rate AS speed
        FROM m_hurt h JOIN state s ON s.player_id = h.attacker AND abs(s.tick_id - h.tick_id) <= 40 WHERE h.hit_group = 1 AND NOT s.warmup AND NOT s.is_airborne WINDOW w AS (PARTITION BY h.id ORDER BY s.tick_id)) WHERE base = tick_id AND speed > 5""",
    "q_behind": """SELECT h.id, h.tick_id, h.victim, h.attacker, v.pos_x AS victim_pos_x, v.pos_y AS victim_pos_y, v.view_x AS victim_view_x, a.pos_x AS attacker_pos_x, a.pos_y AS attacker_pos_y, a.view_x AS attacker_view_x
        FROM m_hurt h, m_player_at_tick v, m_player_at_tick a WHERE v.tick_id = h.tick_id AND a.tick_id = h.tick_id AND v.player_id = h.victim AND a.player_id = h.attacker""",
    "q_strafe_kd": f"""SELECT s.*, k.num_kills / nullif(k.num_deaths, 0) AS kd FROM (
        SELECT player_id, {_SHARE.format('shifts AND ' + _OFF.format(90) + ' < 45')} AS percent_forward_backward, {_SHARE.format('shifts AND ' + _OFF.format(90) + ' > 45')} AS percent_strafe FROM moved GROUP BY player_id) s JOIN kd k USING (player_id)""",
    "q_double_hit": """SELECT a.end_tick, a.round_id, h.tick_id, h.victim, h.attacker AS attacker1, g.attacker AS attacker2, h.weapon FROM m_hurt h JOIN m_hurt g ON g.tick_id = h.tick_id AND g.victim = h.victim AND g.weapon = h.weapon AND h.attacker < g.attacker
        JOIN at a ON a.tick_id = h.tick_id WHERE EXISTS (SELECT 1 FROM m_player_at_tick p WHERE p.tick_id = a.end_tick AND p.player_id = h.victim AND p.is_alive)""",
    "q_zigzag": f"""SELECT * FROM (WITH c AS (SELECT *, shifts AND (off < 45 OR off > 315 AND is_alive) AS fore, shifts AND is_alive AND off > 45 AND off < 135 AS rightward, shifts AND is_alive AND off > 225 AND off < 315 AS leftward FROM (SELECT *, {_OFF.format(360)} AS off FROM moved)),
        z AS (SELECT *, count(*) FILTER (fore AND leftward <> rightward) OVER ({_RP} ROWS UNBOUNDED PRECEDING) AS zig FROM c)
        SELECT round_id, player_id, zig, min(tick_id) AS start_tick, max(tick_id) AS end_tick, bit_or(rightward::INT) + bit_or(leftward::INT) AS sides, count(*) AS length FROM z GROUP BY round_id, player_id, zig HAVING sides = 2 AND length > max(demo_rate))""",
    "q_vis_spans": "SELECT * FROM boxes",
    "q_vis_neighbours": "SELECT * FROM spans",
    "q_vis_locate": "SELECT * FROM located",
    "q_vis_alive": "SELECT * FROM living",
    "q_vis_others": "SELECT * FROM crowded",
    "q_looks": "SELECT * FROM looks",
    "q_react_aim": "SELECT * FROM aimed",
    "q_react_fire": "SELECT * FROM fired",
    "q_round_bounds": "SELECT * FROM bounds",
    "q_cover_clusters": "SELECT * FROM clusters",
    "q_react_cover": "SELECT * FROM covered",
    "q_react_final": "SELECT * FROM final",
    "q_last_spotted": "SELECT * FROM log",
    "q_vis_compare": "SELECT * FROM compared",
    "q_hand_others": "SELECT * FROM hand_crowd",
    "q_hand_aim": "SELECT * FROM hand_aimed",
    "q_hand_fire": "SELECT * FROM hand_fired",
    "q_hand_final": """SELECT c.demo, c.spotter_id, c.spotted_id, c.start_gt, c.end_gt, c.hacking, b.game_id, b.round_id, c.others, (c.start_gt - c.last_end) / g.game_tick_rate < 5 AS seen_lately, (c.aim_gt - c.start_gt) / g.game_tick_rate AS hand_aim_s,
          (c.aim_gt - c.log_gt) / g.game_tick_rate AS log_aim_s, (c.fire_gt - c.start_gt) / g.game_tick_rate AS hand_fire_s, (c.fire_gt - c.log_gt) / g.game_tick_rate AS log_fire_s
        FROM hand_fired c JOIN m_games g ON g.demo_file = c.demo JOIN (SELECT game_id, round_id, min(gt) AS lo, max(gt) AS hi FROM at GROUP BY game_id, round_id) b ON b.game_id = g.id AND c.start_gt < b.hi AND b.lo < c.end_gt AND c.start_gt < c.end_gt AND b.lo < b.hi""",
    "q_react_grouped": "SELECT * FROM grouped",
    "q_react_split": "SELECT *, CASE hacking WHEN 0 THEN 'legit' WHEN 1 THEN 'hacks' WHEN 2 THEN 'pro' END AS label FROM grouped UNION ALL SELECT *, 'hacks_legit' FROM grouped WHERE hacking IN (0, 1)",
}


def _oracle_ctes(name: str) -> str:
    before = HOW["q_hand_aim"]["before"] if name == "q_hand_aim" else 64 * 3
    return ",\n".join([_TABLES, *(f"{step} AS ({sql.replace('{before_aim}', str(before))})" for step, sql in STEPS.items())])


for _name, _ask in m.QUERIES.items():
    query(_name, QUESTIONS[_name], _oracle_ctes(_name))(lambda t, ask=_ask, how=HOW.get(_name, {}): ask(match_tables(t), **how))
