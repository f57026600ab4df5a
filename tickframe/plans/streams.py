"""Stream operators replayed over the stored events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..streaming import games as live
from ..streaming import state as st
from .domain import query


def _replay(t, op, keep="true"):
    at = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"

    def prepare(s):
        gt = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
        return s.where(keep).select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), gt.alias("gt"), (F.col("user_id") % 10).alias("player"), F.col("event_type").alias("kind"),
            F.col("value").alias("x"), F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("y"), (F.col("event_type") == "click").alias("fired"), (F.col("event_type") != "error").alias("alive"), F.lit(False).alias("reset"),
        ).withColumns({"game": F.floor(F.col("gt") / 86400), "other": (F.col("player") + 5) % 10, "k": F.col("y").cast("int")}).withColumns({
            "wants": F.col("fired") | (F.col("k") % 7 == 0), "recoil": (F.col("k") % 3).cast("double"), "reloading": F.col("tick_id") % 5 == 4,
            "victims": F.when(F.col("kind") == "purchase", F.array("other")), "target": F.col("other"), "view": (F.col("x") * 7) % 360,
        })

    return st.replay(t.spark, f"{t.dir}/events.parque[t]", op, f"{at}/out", f"{at}/ledger", prepare)


_WM = "wm AS (SELECT max(ts) - INTERVAL 10 MINUTE AS late FROM events)"


@query("st_count", "SELECT start, start + INTERVAL 1 HOUR AS \"end\", kind, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start, event_type AS kind FROM events) WHERE start + INTERVAL 1 HOUR <= (SELECT late FROM wm) GROUP BY ALL", _WM)
def _(t):
    return _replay(t, lambda s: st.count_windows(s, "1 hour", keys=["kind"])).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("st_count_sliding", "SELECT start, start + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) WHERE start + INTERVAL 2 HOUR <= (SELECT late FROM wm) GROUP BY 1", _WM)
def _(t):
    return _replay(t, lambda s: st.count_windows(s, "2 hours", "1 hour")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "st_engage",
    "SELECT player, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS hits FROM (SELECT *, sum(n) OVER (PARTITION BY player ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT ts, user_id % 10 AS player, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WHERE event_type = 'error')) GROUP BY player, i HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_type = 'error')",
)
def _(t):
    out = _replay(t, lambda s: st.engagement_sessions(s, "1 hour", keys=["player"]), "event_type = 'error'")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _fire_sql(forget: int, reset: str = "false") -> str:
    """CTEs of the state of every row, by recursion over a player's rows; a stretch begins anew after a reset or a long gap."""
    return f"""seen AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY gt, tick_id) AS o, sum(({reset})::INT) OVER (PARTITION BY round_id ORDER BY gt, tick_id ROWS UNBOUNDED PRECEDING) AS era FROM pat),
    spaced AS (SELECT *, coalesce(gt - lag(gt) OVER w > {forget}, true) AS new, coalesce(lead(gt) OVER w - gt > {forget}, true) AS final, max(gt) OVER (PARTITION BY round_id, era) AS era_end,
      row_number() OVER (PARTITION BY round_id, player ORDER BY o) AS n FROM seen WINDOW w AS (PARTITION BY round_id, player, era ORDER BY o)),
    states AS (
      SELECT round_id, player, n, o, era, tick_id, gt, 1000 AS since_fire, 1000 AS since_hold, false AS holding, (k % 3)::DOUBLE AS recoil, (kind = 'click')::INT AS shots, []::BIGINT[] AS victims FROM spaced WHERE n = 1
      UNION ALL
      SELECT b.round_id, b.player, b.n, b.o, b.era, b.tick_id, b.gt,
        CASE WHEN new OR NOT alive THEN 1000 WHEN kind = 'click' THEN 0 ELSE least(1000, since_fire + 1) END,
        CASE WHEN new OR NOT alive THEN 1000 WHEN kind = 'click' OR k % 7 = 0 THEN 0 ELSE least(1000, since_hold + 1) END,
        NOT new AND alive AND b.tick_id % 5 <> 4 AND k % 3 > 0.5 AND (k % 3 > recoil OR (k % 3 = recoil AND holding)),
        (k % 3)::DOUBLE, CASE WHEN new THEN 0 ELSE shots END + (kind = 'click')::INT, CASE WHEN NOT new AND alive AND kind = 'purchase' THEN [other] ELSE [] END
      FROM states a JOIN spaced b ON b.round_id = a.round_id AND b.player = a.player AND b.n = a.n + 1),
    counted AS (SELECT s.*, (SELECT count(DISTINCT player) FROM spaced b WHERE b.round_id = s.round_id AND b.era = s.era AND b.o <= s.o AND b.gt >= s.gt - {forget}) AS known,
      (SELECT count(*) FROM spaced b WHERE b.round_id = s.round_id AND b.o < s.o AND final AND CASE WHEN b.era = s.era THEN s.gt ELSE era_end END > b.gt + {forget}) AS evicted FROM states s)"""


_FIRED = "SELECT round_id AS game, player, tick_id, gt, since_fire, since_hold, holding, shots, len(victims) > 0 AS hit, array_to_string(victims, ',') AS victims, known, evicted FROM counted"


def _fired(t, forget=86_400, reset=None):
    out = _replay(t, lambda s: live.fire_state(s if reset is None else s.withColumn("reset", reset), forget=forget))
    return out.withColumn("victims", F.array_join(F.transform("victims", lambda v: v.cast("string")), ","))


@query("st_fire", _FIRED, _fire_sql(86_400))
def _(t):
    return _fired(t)


@query("st_reset", _FIRED, _fire_sql(86_400, "tick_id % 50 = 0"))
def _(t):
    return _fired(t, reset=F.col("tick_id") % 50 == 0)


@query("st_evict", _FIRED, _fire_sql(7_200))
def _(t):
    return _fired(t, forget=7_200)


@query("st_replay", "SELECT round_id AS game, tick_id, since_fire, shots FROM states", _fire_sql(86_400))
def _(t):
    return _fired(t).select("game", "tick_id", "since_fire", "shots")


_AIM = """seen AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY gt, tick_id) AS o FROM pat),
stood AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / nullif(gt - lag(gt) OVER w, 0), 0.0) AS speed FROM seen WHERE alive WINDOW w AS (PARTITION BY round_id, player ORDER BY o)),
aimed AS (SELECT a.round_id, a.player, a.tick_id, a.gt, a.o, a.other, a.alive AND b.o IS NOT NULL AS ok, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS far, c.alive AS target_alive, CASE WHEN c.alive THEN b.speed ELSE 0.0 END AS target_speed,
  a.view - degrees(atan2(b.y - a.y, b.x - a.x)) + 180 AS raw
  FROM seen a ASOF LEFT JOIN stood b ON b.round_id = a.round_id AND b.player = a.other AND b.o < a.o ASOF LEFT JOIN seen c ON c.round_id = a.round_id AND c.player = a.other AND c.o < a.o),
turned AS (SELECT *, raw - 360 * floor(raw / 360) - 180 AS turn, count(*) FILTER (NOT ok) OVER (PARTITION BY round_id, player ORDER BY o) AS part FROM aimed)"""


@query("st_aim", "SELECT round_id AS game, player, tick_id, gt, other AS target, round(far, 6) AS far, round(turn, 6) AS turn, round(turn - first_value(turn) OVER w, 6) AS since_first, round(turn - lag(turn, 3) OVER w, 6) AS change, target_alive, round(target_speed, 6) AS target_speed FROM turned WHERE ok WINDOW w AS (PARTITION BY round_id, player, part ORDER BY o)", _AIM)
def _(t):
    out = _replay(t, live.aim_state)
    return out.withColumns({c: F.round(c, 6) for c in ("far", "turn", "since_first", "change", "target_speed")})


@query(
    "st_events",
    "SELECT test, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, max((kind = 'purchase')::INT) AS ok FROM (SELECT *, count(*) FILTER (late) OVER (PARTITION BY test ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT ts, user_id % 10 AS test, event_type AS kind, ts >= lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) + INTERVAL 1 HOUR AS late FROM events)) GROUP BY test, i HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT late FROM wm)",
    _WM,
)
def _(t):
    return _replay(t, lambda s: st.test_events(s.select("ts", F.col("player").alias("test"), F.when(F.col("kind") == "purchase", "success").otherwise("step").alias("name")))).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
