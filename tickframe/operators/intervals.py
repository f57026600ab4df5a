"""What happens between a row and the next one of its key, and states seen over spans of ticks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import islands, over


def _with_row(rows: DataFrame, events: DataFrame, keys: Sequence[str], clock: str) -> DataFrame:
    """Events with the clock of the last row of their key at or before them, as `_row`. Events before the first row go."""
    both = rows.select(*keys, clock, F.col(clock).alias("_at")).unionByName(events.withColumn("_at", F.lit(None).cast("long")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(clock, F.col("_at").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_row", F.last("_at", True).over(w)).where("_at IS NULL AND _row IS NOT NULL").drop("_at")


def interval_counts(rows: DataFrame, events: DataFrame, counts: dict[str, Column], keys: Sequence[str], clock: str = "gt") -> DataFrame:
    """+ for each name how many of its events lie in [row, next row) of the key. Events are put to their row by one
    sort with the rows and counted there; rows of one clock share their counts."""
    names = list(counts)
    placed = _with_row(rows, events.select(*keys, clock, *[F.when(c, 1).alias(n) for n, c in counts.items()]), keys, clock)
    per = placed.groupBy(*keys, F.col("_row").alias(clock)).agg(*[F.count(n).alias(n) for n in names])
    return rows.join(per, [*keys, clock], "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def interval_flags(rows: DataFrame, events: DataFrame, flags: dict[str, Column], keys: Sequence[str], clock: str = "gt") -> DataFrame:
    """+ for each name whether such an event lies between this row and the next."""
    return interval_counts(rows, events, flags, keys, clock).withColumns({n: F.col(n) > 0 for n in flags})


def phases(rows: DataFrame, spans: DataFrame, columns: Sequence[str], keys: Sequence[str], clock: str = "gt") -> DataFrame:
    """+ for each phase column of the spans (a clock value) how many begin between this row and the next."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("phase"), F.col(c).alias("when")) for c in columns]))
    e = spans.select(*keys, parts.alias("p")).select(*keys, F.col("p.phase").alias("phase"), F.col("p.when").alias(clock)).where(F.col(clock).isNotNull())
    return interval_counts(rows, e, {c: F.col("phase") == c for c in columns}, keys, clock)


def aggression(pat_areas: DataFrame, visible: DataFrame, dist: DataFrame, gap: int, bait: float, every: int) -> DataFrame:
    """Stretches of a round in which players of both teams see each other's areas, ended by `gap` buckets without:
    round_id, event, start, end, player, role. pusher: sees an enemy; baiter: within bait of a pusher of its team; the
    rest lurk. pat_areas: round_id, player, team, area, gt; the areas of a player in a bucket are its last one's."""
    at = pat_areas.groupBy("round_id", F.floor(F.col("gt") / every).alias("bucket"), "team", "player").agg(F.max_by("area", F.struct("gt", "tick_id")).alias("area"))
    enemy = at.select("round_id", "bucket", (5 - F.col("team")).alias("team"), F.col("area").alias("dst")).distinct()
    sees = at.withColumnRenamed("area", "src").join(visible.select("src", "dst"), "src").join(enemy, ["round_id", "bucket", "team", "dst"]).select("round_id", "bucket", "team", "player", "src").distinct()
    active = sees.select("round_id", "bucket").distinct()
    marked = islands(active, ["round_id"], ["bucket"], F.col("bucket") - F.lag("bucket").over(over(["round_id"], ["bucket"])) > gap, "event")
    spans = marked.withColumns({"start": F.min("bucket").over(Window.partitionBy("round_id", "event")), "end": F.max("bucket").over(Window.partitionBy("round_id", "event"))})
    inside = at.join(spans, ["round_id", "bucket"]).join(sees.select("round_id", "bucket", "player", F.lit(1).alias("_sees")), ["round_id", "bucket", "player"], "left")
    mate = sees.select("round_id", "bucket", "team", F.col("player").alias("_p"), F.col("src").alias("dst"))
    near = inside.where("_sees IS NULL").withColumnRenamed("area", "src").join(mate, ["round_id", "bucket", "team"]).where("_p <> player").join(dist, ["src", "dst"]).where(F.col("dist") <= bait)
    close = near.select("round_id", "bucket", "player", F.lit(1).alias("_near")).distinct()
    roles = inside.join(close, ["round_id", "bucket", "player"], "left").groupBy("round_id", "event", "start", "end", "player").agg(F.max("_sees").alias("_s"), F.max("_near").alias("_n"))
    return roles.select("round_id", "event", "start", "end", "player", F.when(F.col("_s") == 1, "pusher").when(F.col("_n") == 1, "baiter").otherwise("lurker").alias("role"))


def wallers(looks: DataFrame, least: int, clock: str = "gt") -> DataFrame:
    """Stretches in which a player looks at an enemy it can't see for at least `least`: round_id, player, target, start,
    end. looks: round_id, player, target, clock, tick_id, hits (the look meets the enemy), seen."""
    keys = ["round_id", "player", "target"]
    flagged = looks.withColumn("_wall", F.col("hits") & ~F.col("seen"))
    w = over(keys, [clock, "tick_id"])
    marked = islands(flagged, keys, [clock, "tick_id"], F.col("_wall") != F.lag("_wall").over(w))
    spans = marked.where("_wall").groupBy(*keys, "island").agg(F.min(clock).alias("start"), F.max(clock).alias("end")).drop("island")
    return spans.where(F.col("end") - F.col("start") >= least)


def mapping_table(spark, ct: int, t: int) -> DataFrame:
    """All ways to map the slots of each team to itself: id, source, target (slots of t follow those of ct)."""
    ways = [(i, j) for i in permutations(range(ct)) for j in permutations(range(t))]
    rows = [(k, s, g) for k, (a, b) in enumerate(ways) for s, g in enumerate([*a, *(ct + x for x in b)])]
    return spark.createDataFrame(rows, "id int, source int, target int")


def event_filter(df: DataFrame, flag: Column, keys: Sequence[str]) -> DataFrame:
    """Rows with the event, and the key's total of them."""
    return df.where(flag).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def stamped_heat(points: DataFrame, cell: float, bins: int) -> DataFrame:
    """Counts on a grid, each point weighing 4 in its cell, 2 beside and 1 across; clipped at the edges."""
    from .spatial import grid_blur, grid_counts

    weights = {(x, y): 4.0 / (1 if x == y == 0 else 2 if 0 in (x, y) else 4) for x in (-1, 0, 1) for y in (-1, 0, 1)}
    return grid_blur(grid_counts(points, cell), weights).where(F.col("gx").between(0, bins - 1) & F.col("gy").between(0, bins - 1))


def speed_scaled(df: DataFrame, most: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """+ speed_x, speed_y (over the most, 0 to 1) and their change against the row before."""
    w = over(keys, order)
    v = {f"speed_{c}": F.least(F.lit(1.0), F.abs(F.col(c) - F.lag(c).over(w)) / most) for c in ("x", "y")}
    out = df.withColumns(v)
    return out.withColumns({f"change_{c}": F.col(f"speed_{c}") - F.lag(f"speed_{c}").over(w) for c in ("x", "y")})


def event_distance(df: DataFrame, flag: Column, angle: str, far: str, keys: Sequence[str], order: Sequence[str], limit: float, clock: str = "gt") -> DataFrame:
    """Rows before the next event (at most limit ahead): to_event, degrees (30 times the scaled angle), distance
    (from its logarithm), and code 1 at the event itself."""
    from ..functions.scalars import log_distance
    from .windows import time_to_event

    rows = time_to_event(df, flag, keys, order, clock).where(F.col("to_event") <= limit)
    return rows.withColumns({"degrees": F.col(angle) * 30.0, "distance": log_distance(F.col(far)), "code": F.when(flag, 1).otherwise(0)})


def start_states(pat: DataFrame, split: DataFrame, most_ct: int, most_t: int) -> DataFrame:
    """First states of the test rounds with few enough players: round_id, at, ct_alive, t_alive. split: round_id,
    is_train."""
    from .events import alive_counts_by_tick
    from .windows import first_row

    first = first_row(alive_counts_by_tick(pat, 3600), ["round_id"], ["at"])
    return first.join(split.where("NOT is_train").select("round_id"), "round_id", "left_semi").where((F.col("ct_alive") <= most_ct) & (F.col("t_alive") <= most_t))


def code_lookup(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """+ the columns of a code table (column, ...) by code; unknown codes get nulls."""
    return df.join(table, column, "left")
