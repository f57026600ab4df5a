"""Trajectories: a player's path in a round as an array of points, and how alike paths are."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import over, so_far


def make_trajectories(pat: DataFrame, keys: Sequence[str] = ("round_id", "player"), order: Sequence[str] = ("gt", "tick_id"), columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Keys, n and path: points from the start until the first row not alive."""
    dead = F.coalesce(F.max(~F.col("alive")).over(so_far(keys, order)), F.lit(False))
    point = F.struct(*order, *columns)
    return pat.withColumn("_d", dead).where("NOT _d").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(point)).alias("path"))


def _steps(path: Column, columns: Sequence[str]) -> Column:
    gap = lambda a, b: F.sqrt(sum(((b[c] - a[c]) * (b[c] - a[c]) for c in columns), F.lit(0.0)))
    return F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), gap)


def traj_length(trajectories: DataFrame, columns: Sequence[str] = ("x", "y"), clock: str = "gt") -> DataFrame:
    """+ length, seconds, steps."""
    p = F.col("path")
    total = F.aggregate(_steps(p, columns), F.lit(0.0), lambda a, x: a + x)
    return trajectories.withColumns({"length": total, "seconds": F.element_at(p, -1)[clock] - F.element_at(p, 1)[clock], "steps": F.size(p) - 1})


def _gap(a: Column, b: Column, columns: Sequence[str]) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in columns), F.lit(0.0)))


def fde(pairs: DataFrame, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """+ fde: distance of the starts plus distance of the ends of path_a and path_b."""
    a, b = F.col("path_a"), F.col("path_b")
    return pairs.withColumn("fde", _gap(F.element_at(a, 1), F.element_at(b, 1), columns) + _gap(F.element_at(a, -1), F.element_at(b, -1), columns))


def ade_pct(pairs: DataFrame, columns: Sequence[str] = ("x", "y"), cuts: int = 10) -> DataFrame:
    """+ ade: distances at 0, 1/cuts, ... 1 of each path's rows, summed over twice their number."""
    at = lambda p, k: F.element_at(p, (F.floor((F.size(p) - 1) * k / cuts) + 1).cast("int"))
    total = sum((_gap(at(F.col("path_a"), k), at(F.col("path_b"), k), columns) for k in range(cuts + 1)), F.lit(0.0))
    return pairs.withColumn("ade", total / (2 * (cuts + 1)))


def mappings(n: int) -> list[tuple[int, list[int]]]:
    """(id, targets) of all ways to map n slots to n slots."""
    return [(k, list(p)) for k, p in enumerate(permutations(range(n)))]


def label_by_match(sim: DataFrame, labels: DataFrame, leave_self_out: bool = False) -> DataFrame:
    """pred, label: of each predicted round the label of its best match with one, by the slope-limited metric if it has such a
    match, else by the free one; 0.5 without a match. leave_self_out: matches of every rank count but the round itself, and
    -1 stands for none. sim: pred, metric (slope or free), rank (from 1), truth; labels: truth, label."""
    own = sim.where(F.col("pred") != F.col("truth")) if leave_self_out else sim.where("rank = 1")
    found = own.join(labels, "truth").groupBy("pred").agg(F.min_by("label", F.struct(F.col("metric") != "slope", "rank", "truth")).alias("label"))
    return sim.select("pred").distinct().join(found, "pred", "left").select("pred", F.coalesce("label", F.lit(-1.0 if leave_self_out else 0.5)).alias("label"))


def loo_eval(predicted: DataFrame, truth: DataFrame, test: DataFrame, key: str = "pred") -> DataFrame:
    """Confusion counts: split (test or train), guess_decile and decile (tenths of the predicted and the true label, cut), n
    and the mean absolute error. Predictions below 0, the unlabelled, have null deciles and no error. truth: key, label;
    test: the keys of the test split."""
    both = predicted.withColumnRenamed("label", "guess").join(truth, key).join(test.select(key).distinct().withColumn("_test", F.lit(True)), key, "left")
    known = lambda c: F.when(F.col("guess") >= 0, c)
    split = F.when(F.col("_test").isNotNull(), "test").otherwise("train").alias("split")
    deciles = [known(F.floor(F.col(c) * 10)).cast("int").alias(n) for c, n in (("guess", "guess_decile"), ("label", "decile"))]
    return both.groupBy(split, *deciles).agg(F.count(F.lit(1)).alias("n"), F.avg(known(F.abs(F.col("guess") - F.col("label")))).alias("error"))


def find_similar(rows: DataFrame, ref: dict[str, float], radii: dict[str, float], group: str, tick: str = "tick_id") -> DataFrame:
    """The first tick of each group within the radius of a reference in every column."""
    near = rows
    for c, v in ref.items():
        near = near.where(F.abs(F.col(c) - v) <= radii[c])
    return near.groupBy(group).agg(F.min(tick).alias(tick))


def interpolate(rows: DataFrame, block: int, keys: Sequence[str], clock: str = "gt", columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Each row's position on the straight line between the first and last row of its block of time."""
    b = F.floor((F.col(clock) - F.min(clock).over(Window.partitionBy(*keys))) / block)
    cut = rows.withColumn("_b", b)
    w = Window.partitionBy(*keys, "_b")
    t0, t1 = F.min(clock).over(w), F.max(clock).over(w)
    share = F.coalesce(F.try_divide(F.col(clock) - t0, t1 - t0), F.lit(0.0))
    line = lambda c: F.min_by(c, F.struct(clock, "tick_id")).over(w) * (1 - share) + F.max_by(c, F.struct(clock, "tick_id")).over(w) * share
    return cut.withColumns({f"line_{c}": line(c) for c in columns}).drop("_b")


def displacement(rows: DataFrame, keys: Sequence[str], order: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Per key the mean and final distance between two positions of a row, first row left out: keys, ade, fde."""
    d = F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)), F.lit(0.0)))
    late = rows.withColumns({"_d": d, "_n": F.row_number().over(over(keys, order))}).where("_n > 1")
    return late.groupBy(*keys).agg(F.avg("_d").alias("ade"), F.max_by("_d", "_n").alias("fde"))


def rel_offset(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], every: int = 13) -> DataFrame:
    """Offsets from the key's first position, of every nth row."""
    w = over(keys, order)
    out = rows.withColumns({f"rel_{c}": F.col(c) - F.first(c).over(w) for c in columns} | {"_n": F.row_number().over(w) - 1})
    return out.where(F.pmod("_n", F.lit(every)) == 0).drop("_n")


def push_label(labels: DataFrame, column: str = "label") -> DataFrame:
    """An enum label to 1 (push), 0 (hold), or its fraction."""
    value = F.when(F.col(column) == "push", 1.0).when(F.col(column) == "hold", 0.0).otherwise(F.expr(f"try_cast({column} AS DOUBLE)"))
    return labels.withColumn("value", value)


def select_rounds(df: DataFrame, ids: DataFrame, keys: Sequence[str] = ("file", "round_id")) -> DataFrame:
    return df.join(ids.select(*keys), list(keys), "left_semi")
