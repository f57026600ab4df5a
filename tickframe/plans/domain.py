"""Match-log tables projected from the driver's tables, for the registered queries: as DataFrames and, for checking,
as the same text in SQL. `events` gives one player state a row; days are rounds, seconds are the clock."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder. player: ten of them, five a side; the other party of an event is of the other team."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def pat(self) -> DataFrame:
        seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        return (
            self.raw("events")
            .select(F.col("event_id").alias("tick_id"), seconds.alias("gt"), (F.col("user_id") % 10).alias("player"), F.col("event_type").alias("kind"), F.col("value").alias("x"), k.cast("double").alias("y"), k.alias("k"))
            .withColumns(
                {
                    "round_id": F.floor(F.col("gt") / 86400),
                    "team": (2 + F.col("player") % 2).cast("int"),
                    "z": (F.col("tick_id") % 64).cast("double"),
                    "view": (F.col("x") * 7) % 360,
                    "weapon": (F.col("tick_id") % 5).cast("int"),
                    "alive": F.col("kind") != "error",
                    "other": (F.col("player") + 5) % 10,
                }
            )
        )

    def of(self, kind: str) -> DataFrame:
        return self.pat.where(F.col("kind") == kind)

    @cached_property
    def rounds(self) -> DataFrame:
        bounds = self.pat.groupBy("round_id").agg(F.min("tick_id").alias("start"), F.max("tick_id").alias("end"), F.min("gt").alias("start_gt"), F.max("gt").alias("end_gt"))
        return bounds.withColumns({"number": (F.col("round_id") + 1), "winner": (2 + F.col("round_id") % 2), "warmup": F.col("round_id") % 7 == 0})

    @cached_property
    def fire(self) -> DataFrame:
        return self.of("click").select("tick_id", "round_id", "gt", "player", "weapon")

    @cached_property
    def hurt(self) -> DataFrame:
        return self.of("error").select("tick_id", "round_id", "gt", F.col("player").alias("victim"), F.col("other").alias("attacker"), "weapon", F.col("k").alias("damage"))

    @cached_property
    def kills(self) -> DataFrame:
        return self.of("purchase").select("tick_id", "round_id", "gt", F.col("player").alias("killer"), F.col("other").alias("victim"), "weapon", (F.col("k") % 2 == 0).alias("headshot"))

    @cached_property
    def spotted(self) -> DataFrame:
        return self.of("view").select("tick_id", "round_id", "gt", F.col("player").alias("spotter"), F.col("other").alias("spotted"), (F.col("k") % 2 == 0).alias("seen"))

    @cached_property
    def grenades(self) -> DataFrame:
        return self.of("signup").select("tick_id", "round_id", F.col("player").alias("thrower"), F.col("tick_id").alias("start"), (F.col("tick_id") + F.col("k")).alias("end"), (F.col("k") % 4).alias("kind4"))

    @cached_property
    def areas(self) -> DataFrame:
        """A nation is an area of its region; supplier counts place it."""
        return self.raw("nation").select(
            F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("place"), (F.col("n_nationkey") * 40 % 500).cast("double").alias("x0"), (F.col("n_nationkey") % 5 * 20).cast("double").alias("y0"), (F.col("n_nationkey") % 3 * 20).cast("double").alias("z0")
        ).withColumns({"x1": F.col("x0") + 60, "y1": F.col("y0") + 25, "z1": F.col("z0") + 25})

    @cached_property
    def edges(self) -> DataFrame:
        """Area i leads to i + 1 and i + 5, and back."""
        a = self.areas
        one = a.select(F.col("area").alias("src"), F.explode(F.array(F.col("area") + 1, F.col("area") + 5)).alias("dst")).where("dst < 25")
        return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    @cached_property
    def visible(self) -> DataFrame:
        """Areas of one place see each other, as do areas ten apart."""
        a = self.areas
        same = a.select(F.col("area").alias("src"), "place").join(a.select(F.col("area").alias("dst"), "place"), "place").select("src", "dst")
        far = a.select(F.col("area").alias("src"), (F.col("area") + 10).alias("dst")).where("dst < 25")
        return same.unionAll(far).distinct()


PREFIX = r"""
WITH RECURSIVE pat AS (
  SELECT *, gt // 86400 AS round_id, (2 + player % 2)::INT AS team, (tick_id % 64)::DOUBLE AS z, (x * 7) % 360 AS view, (tick_id % 5)::INT AS weapon,
         kind <> 'error' AS alive, (player + 5) % 10 AS other
  FROM (SELECT event_id AS tick_id, datediff('second', TIMESTAMP '2024-01-01', ts) AS gt, user_id % 10 AS player, event_type AS kind, value AS x,
               regexp_extract(props, '(\d+)', 1)::INT AS k, k::DOUBLE AS y FROM events)),
rounds AS (SELECT *, round_id + 1 AS number, 2 + round_id % 2 AS winner, round_id % 7 = 0 AS warmup FROM (
  SELECT round_id, min(tick_id) AS start, max(tick_id) AS "end", min(gt) AS start_gt, max(gt) AS end_gt FROM pat GROUP BY round_id)),
fire AS (SELECT tick_id, round_id, gt, player, weapon FROM pat WHERE kind = 'click'),
hurt AS (SELECT tick_id, round_id, gt, player AS victim, other AS attacker, weapon, k AS damage FROM pat WHERE kind = 'error'),
kills AS (SELECT tick_id, round_id, gt, player AS killer, other AS victim, weapon, k % 2 = 0 AS headshot FROM pat WHERE kind = 'purchase'),
spotted AS (SELECT tick_id, round_id, gt, player AS spotter, other AS spotted, k % 2 = 0 AS seen FROM pat WHERE kind = 'view'),
grenades AS (SELECT tick_id, round_id, player AS thrower, tick_id AS start, tick_id + k AS "end", k % 4 AS kind4 FROM pat WHERE kind = 'signup'),
areas AS (SELECT *, x0 + 60 AS x1, y0 + 25 AS y1, z0 + 25 AS z1 FROM (
  SELECT n_nationkey AS area, n_regionkey AS place, (n_nationkey * 40 % 500)::DOUBLE AS x0, (n_nationkey % 5 * 20)::DOUBLE AS y0, (n_nationkey % 3 * 20)::DOUBLE AS z0 FROM nation)),
half_edges AS (SELECT area AS src, unnest([area + 1, area + 5]) AS dst FROM areas),
edges AS (SELECT src, dst FROM half_edges WHERE dst < 25 UNION ALL SELECT dst, src FROM half_edges WHERE dst < 25),
visible AS (SELECT a.area AS src, b.area AS dst FROM areas a JOIN areas b USING (place) UNION SELECT area, area + 10 FROM areas WHERE area + 10 < 25)
"""


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of Tables; sql is its SELECT over the same tables, with more CTEs where it needs them."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            own = re.sub(r"\bat\b", '"at"', (f", {ctes}\n" if ctes else "") + sql)  # a reserved word there
            ORACLES[name] = PREFIX + own
        return make

    return register
