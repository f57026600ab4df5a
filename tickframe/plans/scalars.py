"""Column functions over player states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import joins as j
from .domain import query

_W = "((({0}) % 360) + 360) % 360"


def _r(c, name):
    return F.round(c, 6).alias(name)


@query("f_ticks", "SELECT tick_id, ceil(x * 128.0)::BIGINT AS ticks, round(y / nullif(k % 3, 0), 6) AS seconds FROM pat")
def _(t):
    return t.pat.select("tick_id", s.ticks("x", 128.0).alias("ticks"), _r(s.seconds("y", (F.col("k") % 3).cast("double")), "seconds"))


@query("f_wrap", f"SELECT tick_id, round({_W.format('x * 9 - 500')}, 6) AS full_turn, round({_W.format('x * 9 - 500 + 180')} - 180, 6) AS half_turn, round({_W.format('view - y + 180')} - 180, 6) AS turn, greatest(-90.0, least(90.0, x - 60)) AS pitch FROM pat")
def _(t):
    a = F.col("x") * 9 - 500
    return t.pat.select("tick_id", _r(s.wrap(a), "full_turn"), _r(s.wrap_half(a), "half_turn"), _r(s.angle_delta("view", "y"), "turn"), s.clamp_pitch(F.col("x") - 60).alias("pitch"))


@query("f_angle_vec", "SELECT tick_id, round(cos(radians(y - 50)) * cos(radians(view)), 6) AS dx, round(cos(radians(y - 50)) * sin(radians(view)), 6) AS dy, round(-sin(radians(y - 50)), 6) AS dz FROM pat")
def _(t):
    dx, dy, dz = s.direction("view", F.col("y") - 50)
    return t.pat.select("tick_id", _r(dx, "dx"), _r(dy, "dy"), _r(dz, "dz"))


@query("f_view_to", "SELECT tick_id, round(degrees(atan2(y - 50, x - 50)), 6) AS yaw, round(-degrees(atan2(z, sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)))), 6) AS pitch FROM pat")
def _(t):
    yaw, pitch = s.view_of(F.col("x") - 50, F.col("y") - 50, "z")
    return t.pat.select("tick_id", _r(yaw, "yaw"), _r(pitch, "pitch"))


@query("f_head", "SELECT tick_id, z + 64.0 - 18.0 * (k % 2) AS eye_z FROM pat")
def _(t):
    return t.pat.select("tick_id", s.eye("x", "y", "z", (F.col("k") % 2).cast("double"))[2].alias("eye_z"))


@query("f_vec", "SELECT tick_id, round(sqrt((x - y) * (x - y) + (y - z) * (y - z)), 6) AS dist, round(sqrt(x * x + y * y + z * z), 6) AS size, round((x * y + y * z) / nullif(sqrt(x * x + y * y) * sqrt(y * y + z * z), 0), 6) AS cosine FROM pat")
def _(t):
    return t.pat.select("tick_id", _r(s.distance(("x", "y"), ("y", "z")), "dist"), _r(s.magnitude("x", "y", "z"), "size"), _r(s.cosine(["x", "y"], ["y", "z"]), "cosine"))


@query("f_rotate", "SELECT tick_id, round((x - 10) * cos(radians(view)) - (y - 5) * sin(radians(view)), 6) AS rx, round((x - 10) * sin(radians(view)) + (y - 5) * cos(radians(view)), 6) AS ry FROM pat")
def _(t):
    rx, ry = s.rotate("x", "y", "view", 10.0, 5.0)
    return t.pat.select("tick_id", _r(rx, "rx"), _r(ry, "ry"))


@query("f_move_dir", f"SELECT tick_id, round({_W.format('degrees(atan2(y - 50, x - 50)) - view')}, 4) % 360 AS away FROM pat")
def _(t):
    return t.pat.select("tick_id", (F.round(s.move_angle(F.col("x") - 50, F.col("y") - 50, "view"), 4) % 360).alias("away"))


@query("f_speed", "SELECT tick_id, round(least(1.0, sqrt(x * x + y * y) / nullif(weapon * 50.0, 0)), 6) AS speed FROM pat")
def _(t):
    return t.pat.select("tick_id", _r(F.when(F.col("weapon") > 0, s.scaled_speed("x", "y", F.col("weapon") * 50.0)).otherwise(F.lit(1.0)), "speed"))


@query("f_map_px", "SELECT tick_id, (x + 2000) / 4.0 AS px, (3000 - y) / 4.0 AS py FROM pat")
def _(t):
    px, py = s.map_pixels("x", "y", -2000.0, 3000.0, 4.0)
    return t.pat.select("tick_id", px.alias("px"), py.alias("py"))


@query("f_safe_div", "SELECT tick_id, round(x / nullif(k % 4, 0), 6) AS q FROM pat")
def _(t):
    return t.pat.select("tick_id", _r(s.safe_div("x", (F.col("k") % 4).cast("double")), "q"))


@query("f_split", "SELECT tick_id, 'a_' || k || ',b_' || weapon AS said, k::VARCHAR AS a, weapon::VARCHAR AS b FROM pat")
def _(t):
    m = s.text_to_map(F.concat(F.lit("a_"), "k", F.lit(",b_"), "weapon"))
    rows = t.pat.select("tick_id", m.alias("m"))
    return rows.select("tick_id", s.map_to_text("m").alias("said"), F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("f_log_dist", "SELECT tick_id, round(least(2000.0, power(10.0, y / 90 * log10(2000.0))), 4) AS d FROM pat")
def _(t):
    return t.pat.select("tick_id", F.round(s.log_distance(F.col("y") / 90), 4).alias("d"))


_LO, _HI, _PT = ["x0", "y0", "z0"], ["x1", "y1", "z1"], ["x", "y", "z"]


@query("pt_in_box", "SELECT tick_id, area FROM pat JOIN areas ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def _(t):
    return j.stab_join(t.pat, t.areas, "x", "x0", "x1", width=30).where(s.in_box(_PT, _LO, _HI)).select("tick_id", "area")


@query("box_overlap", "SELECT a.area, b.area AS other FROM areas a JOIN areas b ON a.area < b.area AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1")
def _(t):
    b = t.areas.select(F.col("area").alias("other"), *[F.col(c).alias(f"b_{c}") for c in _LO + _HI])
    near = j.overlap_join(t.areas, b, width=100, names=("x0", "x1", "b_x0", "b_x1"))
    return near.where((F.col("area") < F.col("other")) & s.boxes_overlap(_LO, _HI, [f"b_{c}" for c in _LO], [f"b_{c}" for c in _HI])).select("area", "other")


@query("box_dist", "SELECT tick_id, area, round(sqrt(power(greatest(x0 - x, 0, x - x1), 2) + power(greatest(y0 - y, 0, y - y1), 2)), 6) AS d FROM pat JOIN areas ON areas.area = pat.k % 25")
def _(t):
    return t.pat.join(t.areas, t.areas.area == t.pat.k % 25).select("tick_id", "area", _r(s.box_distance(["x", "y"], ["x0", "y0"], ["x1", "y1"]), "d"))


@query("player_box", "SELECT tick_id, x - 16.0 AS x0, y + 16.0 AS y1, z + 72.0 - 18.0 * (k % 2) AS z1 FROM pat")
def _(t):
    b = s.player_box("x", "y", "z", (F.col("k") % 2).cast("double"))
    return t.pat.select("tick_id", b["x0"].alias("x0"), b["y1"].alias("y1"), b["z1"].alias("z1"))


@query(
    "ray_box",
    "SELECT tick_id, area, greatest(least(a, b), least(c, d)) <= least(greatest(a, b), greatest(c, d)) AND least(greatest(a, b), greatest(c, d)) >= 0 AS hits FROM (SELECT tick_id, area, (x0 - x) / vx AS a, (x1 - x) / vx AS b, (y0 - y) / vy AS c, (y1 - y) / vy AS d FROM (SELECT *, k % 7 + 1.5 AS vx, k % 5 - 2.5 AS vy FROM pat JOIN areas ON areas.area = pat.k % 25))",
)
def _(t):
    hits, _, _ = s.ray_box(["x", "y"], [F.col("k") % 7 + F.lit(1.5).cast("double"), F.col("k") % 5 - F.lit(2.5).cast("double")], ["x0", "y0"], ["x1", "y1"])
    return t.pat.join(t.areas, t.areas.area == t.pat.k % 25).select("tick_id", "area", hits.alias("hits"))


@query("line_point", "SELECT tick_id, round(sqrt(power(100 * z, 2) + power(100 * y, 2)) / 100.0, 6) AS d FROM pat")
def _(t):
    zero, far = [F.lit(0.0)] * 3, [F.lit(100.0), F.lit(0.0), F.lit(0.0)]
    return t.pat.select("tick_id", _r(s.line_distance(_PT, zero, far), "d"))


@query("move_bin", f"SELECT tick_id, (CASE WHEN sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) < 20 THEN 0 ELSE 1 + floor(({_W.format('round(' + _W.format('degrees(atan2(y - 50, x - 50)) - view') + ', 9) + 22.5')}) / 45.0) END + 9 * (k % 3))::INT AS bin FROM pat")
def _(t):
    return t.pat.select("tick_id", s.move_bin(F.col("x") - 50, F.col("y") - 50, "view", F.col("k") % 3, 20.0).alias("bin"))
