"""Training sets: per-tick rows around engagements, sampled states, scaled features, and a logistic model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import stab_join
from .windows import asof_prev, over, rows_offset, runs


def aim_rows(eng: DataFrame, pat: DataFrame, width: int, past: int = 13, future: int = 13, columns: Sequence[str] = ("x", "y", "view"), clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """The attacker's rows inside its engagements with past and future values, and turn: degrees (-180 to 180) from where
    the victim's last row up to the tick stands to where the attacker looks, null before the victim has one.

    An attacker has one engagement at a tick: one with a hit still to come before one without; of those with one the first
    to begin (then the smaller victim), of those without the last to end (then the larger). Rows of which any in the window
    from `past` before to `future` after is not alive are left out. eng has hurt_ids, the ticks of its hits."""
    w = over(["round_id", "player"], [clock, tick])
    near = rows_offset(pat, columns, [*range(-past, 0), *range(1, future + 1)], ["round_id", "player"], [clock, tick])
    near = near.withColumn("_lives", F.every("alive").over(w.rowsBetween(-past, future))).where("_lives").drop("_lives")
    spans = eng.select("round_id", "attacker", "victim", "start", "end", F.array_max("hurt_ids").alias("_hit"))
    inside = stab_join(near.withColumnRenamed("player", "attacker"), spans, clock, keys=["round_id", "attacker"], width=width)
    hit = F.col("_hit") >= F.col(tick)
    order = [hit.desc(), F.when(hit, F.col("start")).asc(), F.when(hit, F.col("victim")).asc(), F.when(~hit, F.col("end")).desc(), F.when(~hit, F.col("victim")).desc()]
    one = Window.partitionBy("round_id", "attacker", tick).orderBy(*order)
    chosen = inside.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "_hit")
    where = pat.select("round_id", F.col("player").alias("victim"), tick, F.col("x").alias("_vx"), F.col("y").alias("_vy"))
    seen = asof_prev(chosen, where, ["round_id", "victim"], tick, ["_vx", "_vy"])
    turn = F.pmod(F.col("view") - F.degrees(F.atan2(F.col("prev__vy") - F.col("y"), F.col("prev__vx") - F.col("x"))) + 180, F.lit(360.0)) - 180
    return seen.withColumn("turn", turn).drop("prev__vx", "prev__vy")


def aim_links(eng: DataFrame, aim: DataFrame, clock: str = "gt") -> DataFrame:
    """Engagements to their rows: attacker, victim, start, tick_id, to_end."""
    keys = ["round_id", "attacker", "victim", "start"]
    return eng.select(*keys, "end").join(aim.select(*keys, "tick_id", clock), keys).withColumn("to_end", F.col("end") - F.col(clock)).select(*keys, "tick_id", "to_end")


def nav_rows(spans: DataFrame, pat: DataFrame, step: int, width: int, clock: str = "gt") -> DataFrame:
    """The first row of every step of time inside each span of a player: round_id, player, start, bucket, tick_id."""
    inside = stab_join(pat.select("round_id", "player", clock, "tick_id"), spans, clock, keys=["round_id", "player"], width=width)
    cut = inside.withColumn("bucket", F.floor((F.col(clock) - F.col("start")) / step))
    return cut.groupBy("round_id", "player", "start", "bucket").agg(F.min(F.struct(clock, "tick_id"))["tick_id"].alias("tick_id"))


def next_area_rows(pat_areas: DataFrame, step: int, keys: Sequence[str] = ("round_id", "player"), clock: str = "gt") -> DataFrame:
    """A sample per step of time with the areas of the samples before and after: area, old_area, next_area."""
    at = pat_areas.groupBy(*keys, F.floor(F.col(clock) / step).alias("at")).agg(F.min_by("area", F.struct(clock, "tick_id")).alias("area"))
    w = over(keys, ["at"])
    return at.withColumns({"old_area": F.lag("area").over(w), "next_area": F.lead("area").over(w)}).where("old_area IS NOT NULL AND next_area IS NOT NULL")


def area_sequence(pat_areas: DataFrame, keys: Sequence[str] = ("round_id", "player"), order: Sequence[str] = ("tick_id",)) -> DataFrame:
    """A player's areas in order, each stay one row."""
    return runs(pat_areas, keys, order, "area")


def engage_rows(pat: DataFrame, keys: Sequence[str] = ("round_id", "player"), order: Sequence[str] = ("gt", "tick_id"), horizon: int = 3600, clock: str = "gt") -> DataFrame:
    """+ fires_soon: a shot within the horizon; hurt_before: hits so far."""
    w = Window.partitionBy(*keys).orderBy(clock).rangeBetween(1, horizon)
    back = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    soon = F.coalesce(F.max(F.col("kind") == "click").over(w), F.lit(False))
    return pat.withColumns({"fires_soon": soon, "hurt_before": F.count(F.when(F.col("kind") == "error", 1)).over(back)})


def team_features(pat: DataFrame, every: int, plants: DataFrame, defusals: DataFrame, bomb: DataFrame, sites: dict[str, tuple[float, float]], areas: DataFrame, reach: float, slots: int = 5, clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """Long features per round, time bucket and player of the first `slots` of its team: slot, last position and alive, the
    nearest area (null for the dead), ticks since the last shot and hit taken (null before one), shots so far, bomb (carried, planted,
    defused), the site nearer to the bomb, and the share of the round's time left (0 to 1).

    plants, defusals: round_id, tick of success. bomb: tick, bomb_x, bomb_y; the last place up to the player's row counts.
    sites: name to centre; ties go to the first by name. areas, reach: see nearest_areas."""
    from .cleaning import slot_assign
    from .neighbours import nearest_areas

    past = over(["round_id", "player"], [clock, tick]).rowsBetween(Window.unboundedPreceding, 0)
    since = lambda kind: F.col(tick) - F.last(F.when(F.col("kind") == kind, F.col(tick)), True).over(past)
    rows = slot_assign(pat, slots).withColumns({"since_shot": since("click"), "since_hurt": since("error"), "shots": F.count(F.when(F.col("kind") == "click", 1)).over(past), "at": F.floor(F.col(clock) / every)})
    names = ["slot", "x", "y", "z", "alive", "since_shot", "since_hurt", "shots"]
    last = rows.groupBy("round_id", "at", "team", "player").agg(F.max_by(F.struct(tick, clock, *names), F.struct(clock, tick)).alias("s")).select("round_id", "at", "team", "player", "s.*")
    first = lambda df, name: df.groupBy("round_id").agg(F.min(tick).alias(name))
    last = last.join(first(plants, "_plant"), "round_id", "left").join(first(defusals, "_defusal"), "round_id", "left")
    status = F.when(F.col("_defusal") <= F.col(tick), "defused").when(F.col("_plant") <= F.col(tick), "planted").otherwise("carried")
    placed = asof_prev(last.withColumn("bomb", status), bomb.join(pat.select(tick, "round_id"), tick), ["round_id"], tick, ["bomb_x", "bomb_y"])
    gaps = [F.struct(F.hypot(F.col("prev_bomb_x") - x, F.col("prev_bomb_y") - y).alias("d"), F.lit(name).alias("name")) for name, (x, y) in sorted(sites.items())]
    r = Window.partitionBy("round_id")
    left = F.coalesce(F.try_divide(F.max(clock).over(r) - F.col(clock), F.max(clock).over(r) - F.min(clock).over(r)), F.lit(0.0))
    found = placed.withColumns({"site": F.when(F.col("prev_bomb_x").isNotNull(), F.least(*gaps)["name"]), "left": F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))})
    near = nearest_areas(last.where("alive").withColumn("_key", F.struct("round_id", "at", "player")), areas, reach, key="_key").select(F.col("_key.*"), "area")
    return found.join(near, ["round_id", "at", "player"], "left").select("round_id", "at", "team", "player", *names, "area", "bomb", "site", "left")


def split_groups(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """+ split: train or test by a hash of the group, so it can be had again from the ids."""
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    return df.withColumn("split", F.when(at < share * 10_000, "train").otherwise("test"))


def std_scale(df: DataFrame, columns: Sequence[str], ref: str | None = None) -> DataFrame:
    """+ scaled_<c>: (value, or its difference to ref) less the mean, over the standard deviation (0 for a constant)."""
    v = {c: F.col(c) - F.col(ref) if ref else F.col(c) for c in columns}
    stats = df.agg(*[f(v[c]).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, dev = (lambda c: stats[f"m_{c}"] or 0.0), (lambda c: stats[f"s_{c}"] or 0.0)
    return df.withColumns({f"scaled_{c}": (v[c] - mean(c)) / dev(c) if dev(c) else F.lit(0.0) for c in columns})


def std_unscale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """The way back: stats has (mean, deviation) by column."""
    return df.withColumns({c: F.col(f"scaled_{c}") * s + m for c, (m, s) in stats.items()})


def angle_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """+ sin_<c>, cos_<c>, and back_<c>, the angle again from both."""
    out = df.withColumns({f"{n}_{c}": f(F.radians(c)) for c in columns for n, f in (("sin", F.sin), ("cos", F.cos))})
    return out.withColumns({f"back_{c}": F.degrees(F.atan2(f"sin_{c}", f"cos_{c}")) for c in columns})


def one_hot(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """+ <column>_<value> of 0 or 1, and back: the value again."""
    hot = df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values})
    best = F.greatest(*[F.struct(F.col(f"{column}_{v}").alias("p"), F.lit(-i).alias("i")) for i, v in enumerate(values)])
    return hot.withColumn("back", F.when(best["p"] > 0, F.element_at(F.array(*map(F.lit, values)), 1 - best["i"])))


def log_reg(df: DataFrame, columns: Sequence[str], label: str, seed: int = 1):
    """A scaled logistic model: (rows with probability and prediction, area under the curve, confusion counts)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("_y", F.col(label).cast("double"))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol="_y", predictionCol="prediction")]
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    auc = BinaryClassificationEvaluator(labelCol="_y").evaluate(out)
    scored = out.withColumn("p", vector_to_array("probability")[1]).drop("_v", "_s", "rawPrediction", "probability")
    return scored.drop("_y"), auc, scored.groupBy("_y", "prediction").agg(F.count(F.lit(1)).alias("n"))
