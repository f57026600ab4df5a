"""Spatial and graph operators over states and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours as near
from ..operators import spatial as s
from ..sources import tables as tab
from .domain import query

_IN = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
_DIST = "sqrt(power(greatest(x0 - x, 0, x - x1), 2) + power(greatest(y0 - y, 0, y - y1), 2) + power(greatest(z0 - z, 0, z - z1), 2))"


def _edges(t):
    return t.edges.withColumn("cost", 1.0 + F.col("src") % 3 + F.col("dst") % 3)


_REACH = "costs AS (SELECT src, dst, 1.0 + src % 3 + dst % 3 AS cost FROM edges), walk AS (SELECT area AS src, area AS dst, 0.0::DOUBLE AS dist, 0 AS n FROM areas UNION SELECT w.src, c.dst, min(w.dist + c.cost)::DOUBLE, n + 1 FROM walk w JOIN costs c ON c.src = w.dst WHERE n < 12 GROUP BY w.src, c.dst, n), reach AS (SELECT src, dst, min(dist) AS dist FROM walk GROUP BY src, dst)"


@query("src_columnar", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src_subset", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t):
    return tab.read_columns(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_quantity") > 45)


@query("result_by_key", "SELECT * FROM kills WHERE round_id = 3")
def _(t):
    return tab.result_by_key(t.kills, "round_id", 3)


@query("place_box", "SELECT place, min(x0) AS x0, min(y0) AS y0, min(z0) AS z0, max(x1) AS x1, max(y1) AS y1, max(z1) AS z1, string_agg(area::VARCHAR, ',' ORDER BY area) AS areas FROM areas GROUP BY 1")
def _(t):
    return s.place_box(t.areas).withColumn("areas", F.array_join(F.transform("areas", lambda x: x.cast("string")), ","))


@query("overlap_area", f"SELECT tick_id, area, z BETWEEN z0 AND z1 AS in3d FROM pat JOIN areas ON {_IN}")
def _(t):
    return s.containing_areas(t.pat, t.areas, 30, 2).select("tick_id", "area", F.col("z").between(F.col("z0"), F.col("z1")).alias("in3d"))


@query("nearest_area", f"SELECT tick_id, area, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY tick_id ORDER BY d, area) AS n FROM (SELECT tick_id, area, {_DIST} AS d FROM pat, areas)) WHERE n = 1")
def _(t):
    return near.nearest_areas(t.pat, t.areas, 10.0).select("tick_id", "area", F.round("distance", 6).alias("distance"))


@query("nearest_cells", f'SELECT tick_id, area, n AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY tick_id ORDER BY d, area) AS n FROM (SELECT tick_id, area, {_DIST} AS d FROM pat, areas)) WHERE n <= 3')
def _(t):
    return near.nearest_areas(t.pat, t.areas, 40.0, 3).select("tick_id", "area", "rank")


@query("above_below", f"SELECT tick_id, arg_min(area, z0 * 1000 + area) FILTER (z0 > z) AS above, arg_min(area, -z1 * 1000 + area) FILTER (z1 < z) AS below FROM pat JOIN areas ON {_IN} GROUP BY 1")
def _(t):
    return s.above_below(t.pat, t.areas, 30)


@query("reach_matrix", "SELECT * FROM reach", _REACH)
def _(t):
    return s.reach_matrix(_edges(t))


@query("closeness", "SELECT src, dst, round(255 * (1 - (dist - (SELECT min(dist) FROM reach)) / (SELECT max(dist) - min(dist) FROM reach)))::INT AS closeness FROM reach", _REACH)
def _(t):
    return s.closeness(s.reach_matrix(_edges(t)))


@query("place_dist", "SELECT src, place, arg_min(dst, dist * 1000 + dst) AS closest, min(dist) AS dist, list(dist ORDER BY dist)[greatest(0, count(*) // 2 - 1) + 1] AS median FROM reach JOIN areas ON area = dst GROUP BY ALL", _REACH)
def _(t):
    return s.place_dist(s.reach_matrix(_edges(t)), t.areas)


_LINKS = "links AS (SELECT DISTINCT a.place AS p, b.place AS q FROM edges JOIN areas a ON a.area = src JOIN areas b ON b.area = dst WHERE a.place <> b.place)"


@query("place_links", "SELECT * FROM links", _LINKS)
def _(t):
    return s.place_links(t.edges, t.areas)


_PATHS = _LINKS + ", ways AS (SELECT [0::BIGINT] AS path UNION ALL SELECT list_append(path, q::BIGINT) FROM ways JOIN links ON p = path[-1] WHERE NOT list_contains(path, q) AND q <> 3 AND path[-1] <> 4 AND len(path) <= 8)"


@query("simple_paths", "SELECT array_to_string(path, ',') AS path FROM ways WHERE path[-1] = 4", _PATHS)
def _(t):
    return s.simple_paths(s.place_links(t.edges, t.areas), 0, 4, [3]).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("path_minimal", "SELECT array_to_string(path, ',') AS path FROM ways a WHERE path[-1] = 4 AND NOT EXISTS (SELECT 1 FROM ways b WHERE b.path[-1] = 4 AND b.path[-2] = a.path[-2] AND len(b.path) < len(a.path) AND list_has_all(a.path, b.path))", _PATHS)
def _(t):
    paths = s.simple_paths(s.place_links(t.edges, t.areas), 0, 4, [3])
    return s.path_minimal(paths).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("danger_pairs", "SELECT DISTINCT v.src, v.dst, e.dst AS hidden FROM visible v JOIN edges e ON e.src = v.dst WHERE v.src <> e.dst AND NOT EXISTS (SELECT 1 FROM visible w WHERE w.src = v.src AND w.dst = e.dst)")
def _(t):
    return s.danger_pairs(t.visible, t.edges)


@query("visible_union", "SELECT DISTINCT round_id, team, dst AS seen FROM pat JOIN visible ON src = k % 25")
def _(t):
    return s.visible_union(t.pat.select("round_id", "team", (F.col("k") % 25).alias("area")).distinct(), t.visible, ["round_id", "team"])


@query("wall_heat", "SELECT weapon, floor(x / 10)::BIGINT AS gx, floor(y / 10)::BIGINT AS gy, count(*) AS n FROM pat GROUP BY ALL")
def _(t):
    return s.grid_counts(t.pat, 10.0, ["weapon"])


@query("grid_blur", "SELECT gx + dx AS gx, gy + dy AS gy, sum(n * w)::DOUBLE AS value FROM (SELECT floor(x / 10)::BIGINT AS gx, floor(y / 10)::BIGINT AS gy, count(*) AS n FROM pat GROUP BY ALL), (VALUES (0, 0, 4.0), (1, 0, 2.0), (-1, 0, 2.0), (0, 1, 2.0), (0, -1, 2.0), (1, 1, 1.0)) o(dx, dy, w) GROUP BY ALL")
def _(t):
    return s.grid_blur(s.grid_counts(t.pat, 10.0), {(0, 0): 4, (1, 0): 2, (-1, 0): 2, (0, 1): 2, (0, -1): 2, (1, 1): 1})


@query("nav_counts", "SELECT round_id, k % 25 AS area, unnest([2, 3]) AS team, unnest([count(*) FILTER (team = 2), count(*) FILTER (team = 3)]) AS friends, unnest([count(*) FILTER (team = 3), count(*) FILTER (team = 2)]) AS enemies FROM pat GROUP BY round_id, k % 25")
def _(t):
    return s.nav_counts(t.pat.withColumn("area", F.col("k") % 25))


_GROUPS = """stood AS (SELECT round_id, gt // 7200 AS at, player, x, y FROM pat QUALIFY row_number() OVER (PARTITION BY round_id, gt // 7200, player ORDER BY gt DESC, tick_id DESC) = 1),
beside AS (SELECT a.round_id, a.at, a.player AS source, b.player AS q FROM stood a JOIN stood b ON a.round_id = b.round_id AND a.at = b.at AND a.player < b.player AND abs(a.x - b.x) < 40 AND abs(a.y - b.y) < 40),
begun AS (SELECT round_id, source, at, list(q ORDER BY q) AS companions FROM beside a WHERE EXISTS (SELECT 1 FROM beside b WHERE b.round_id = a.round_id AND b.source = a.source AND b.q = a.q AND b.at = a.at + 1) GROUP BY ALL HAVING count(*) >= 2),
groups AS (SELECT round_id, source, companions, min(at) AS start, max(at) + 1 AS "end" FROM (SELECT *, at - row_number() OVER (PARTITION BY round_id, source, companions ORDER BY at) AS i FROM begun) GROUP BY round_id, source, companions, i)"""


def _groups(t):
    return s.group_move(t.pat, 3, 40.0, 7200, 2)


def _named(df):
    return df.withColumn("companions", F.array_join(F.transform("companions", lambda x: x.cast("string")), ","))


@query("group_move", "SELECT round_id, source, array_to_string(companions, ',') AS companions, start, \"end\" FROM groups", _GROUPS)
def _(t):
    return _named(_groups(t))


_INSIDE = """, members AS (SELECT *, unnest(list_concat([source], companions)) AS player FROM groups),
inside AS (SELECT m.round_id, source, companions, start, "end", at, bool_and(x < 45) AS in1, bool_and(x > 15) AS in2 FROM members m JOIN stood USING (round_id, player) WHERE at BETWEEN start AND "end" GROUP BY ALL)"""


@query("region_sequence", "SELECT round_id, source, array_to_string(companions, ',') AS companions, start, \"end\", t1, min(a.at) AS t2 FROM inside a JOIN (SELECT round_id, source, companions, start, min(at) AS t1 FROM inside WHERE in1 GROUP BY ALL) b USING (round_id, source, companions, start) WHERE in2 AND a.at > t1 GROUP BY ALL", _GROUPS + _INSIDE)
def _(t):
    return _named(s.region_sequence(t.pat, F.col("x") < 45, F.col("x") > 15, ["round_id"], groups=_groups(t), every=7200))


@query("region_sequence_player", "SELECT p.round_id, p.player, t1, min(gt) AS t2 FROM pat p JOIN (SELECT round_id, player, min(gt) AS t1 FROM pat WHERE x < 20 GROUP BY ALL) f ON f.round_id = p.round_id AND f.player = p.player AND p.gt > t1 AND p.x > 60 GROUP BY ALL")
def _(t):
    return s.region_sequence(t.pat, F.col("x") < 20, F.col("x") > 60, ["round_id", "player"])


_SPREAD = """cells AS (SELECT floor(x / 10)::BIGINT AS gx, floor(y / 10)::BIGINT AS gy, least(255, 20 * count(*)) AS n FROM pat GROUP BY ALL),
ground AS (SELECT DISTINCT gx + dx AS gx, gy + dy AS gy FROM cells, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE NOT ((gx + dx) % 5 = 3 AND (gy + dy) % 2 = 0)),
spread AS (SELECT 0 AS step, gx, gy, n::INT AS value FROM cells WHERE gx % 3 = 0 UNION ALL
  SELECT step + 1, s.gx, s.gy, CASE WHEN v < 30 THEN 30 ELSE greatest(30, floor(power(v, 0.993)))::INT END FROM (
    SELECT step, gx + dx AS gx, gy + dy AS gy, max(CASE WHEN dx = 0 AND dy = 0 THEN value ELSE floor(power(value, 0.993))::INT END) AS v FROM spread, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE step < 3 GROUP BY ALL) s
  JOIN ground g ON g.gx = s.gx AND g.gy = s.gy WHERE v > 0)"""


@query("grid_spread", "SELECT gx, gy, value FROM spread WHERE step = 3", _SPREAD)
def _(t):
    cells = s.grid_counts(t.pat, 10.0).withColumn("n", F.least(F.lit(255), 20 * F.col("n")))
    beside = cells.select(F.explode(F.array(*[F.struct((F.col("gx") + x).alias("gx"), (F.col("gy") + y).alias("gy")) for x in (-1, 0, 1) for y in (-1, 0, 1)])).alias("c")).select("c.*")
    return s.grid_spread(cells.where("gx % 3 = 0"), beside, beside.where("gx % 5 = 3 AND gy % 2 = 0"), steps=3)


@query("rest_clusters")
def _(t):
    return s.rest_clusters(t.pat.withColumn("site", F.col("k") % 2))


@query("peek_clusters", "SELECT (k % 6) AS cluster, count(*) AS n, round(avg(x), 6) AS x_mean, round(stddev_samp(x), 6) AS x_std FROM pat GROUP BY 1")
def _(t):
    return s.cluster_stats(t.pat.withColumn("cluster", F.col("k") % 6), ["x"]).select("cluster", "n", F.round("x_mean", 6).alias("x_mean"), F.round("x_std", 6).alias("x_std"))


@query("peek_kmeans")
def _(t):
    return s.peek_clusters(t.pat)
