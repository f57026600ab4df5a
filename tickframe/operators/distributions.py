"""Histograms, comparisons of distributions, team formations and round statistics. `title` names the group compared."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import over, running_sum, so_far, whole


def hist1d(df: DataFrame, value: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Keys, bin, n and share (of the key's rows), bins of a width from 0."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def percentiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = (), accuracy: int | None = None, ranks: int = 1000) -> DataFrame:
    """keys and p, an array of the interpolated percentiles of a value; without keys it is one row, empty for no values. Nulls and NaN don't count.

    In two passes: a sketch whose error in rank is at most 1 / ranks gives for each percentile two values that it lies
    between; then the rows below are counted exactly and of the values between each with how often it occurs, so no group's
    values are held at once. Groups of up to 4 * ranks rows are counted by value whole. accuracy: the sketch's own answer (rank within 1 / accuracy), not interpolated."""
    key = [f"_k{i}" for i in range(len(keys))]
    there = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.where(there).select(*[F.col(c).alias(k) for c, k in zip(keys, key)], F.col(value).alias("_v"))
    back = [F.col(k).alias(c) for k, c in zip(key, keys)]
    if accuracy is not None:
        return rows.groupBy(*key).agg(F.percentile_approx("_v", list(at), accuracy).alias("p")).select(*back, "p")
    edges = [min(1.0, max(0.0, q + d)) for q in at for d in (-2 / ranks, 2 / ranks)]
    sketch = rows.groupBy(*key).agg(F.percentile_approx("_v", edges, ranks).alias("_e"), F.count(F.lit(1)).alias("_n"))
    named = sketch.withColumnsRenamed({k: f"{k}s" for k in key})
    if key:
        both = rows.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in key]))
    else:  # one row
        r = sketch.first()
        both = rows.withColumns({"_e": F.array(*[F.lit(e) for e in r["_e"]]) if r["_e"] else F.lit(None).cast(sketch.schema["_e"].dataType), "_n": F.lit(r["_n"])})
    e = lambda i: F.get("_e", i)
    # of each percentile: 0 for a row below what it lies between, the value for one between; what is above doesn't count
    many = F.col("_n") > 4 * ranks  # in a smaller group the step from one rank to the next is more than the sketch's slack
    low = lambda i: F.lit(False) if at[i] <= 2 / ranks else many & (F.col("_v") < e(2 * i))
    high = lambda i: F.lit(False) if at[i] >= 1 - 2 / ranks else many & (F.col("_v") > e(2 * i + 1))
    marks = F.array_compact(F.array(*[F.when(~high(i), F.struct(F.lit(i).alias("i"), F.when(~low(i), F.col("_v")).alias("v"))) for i in range(len(at))]))
    counts = both.select(*key, "_n", F.explode(marks).alias("m")).groupBy(*key, "_n", "m.i", "m.v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*key, "i").orderBy(F.asc_nulls_first("v"))
    before = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("i") + 1) * (F.col("_n") - 1)
    placed = counts.withColumns({"to": before, "rank": rank}).withColumn("from", F.col("to") - F.col("c"))
    holds = lambda r: F.max(F.when((F.col("from") <= r) & (r < F.col("to")) & F.col("v").isNotNull(), F.col("v")))
    ends = placed.groupBy(*key, "i").agg(holds(F.floor("rank")).alias("a"), holds(F.ceil("rank")).alias("b"), F.max(F.col("rank") - F.floor("rank")).alias("t"))
    exact = ends.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("p")))).alias("_p"))
    return exact.select(*back, F.transform("_p", lambda x: x["p"]).alias("p"))


def pct_trim(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, keys: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Rows between two percentiles of their key. The percentiles of each key are found first (see percentiles)."""
    found = percentiles(df, value, [low, high], keys, accuracy)
    if not keys:
        r = found.first()
        return df.where(F.col(value).between(*(r["p"] if r and r["p"] else (None, None))))
    found = found.withColumnsRenamed({k: f"_trim_{k}" for k in (*keys, "p")})
    same = [F.col(k).eqNullSafe(F.col(f"_trim_{k}")) for k in keys]
    return df.join(found, same).where(F.col(value).between(F.get("_trim_p", 0), F.get("_trim_p", 1))).select(*df.columns)


def emd1d(df: DataFrame, value: str, group: str, base: object, most_groups: int = 10_000) -> DataFrame:
    """1-D Wasserstein distance of each group to the base group: the area between their distribution functions.
    Values are counted first, so what is sorted is one row per distinct value. Each group needs the base group's values
    beside its own; more than most_groups groups are refused."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(group).agg(F.sum("_n").alias("_all"))
    shares = counts.join(sizes, group).withColumn("_p", F.col("_n") / F.col("_all"))
    b = shares.where(F.col(group) == base).select(value, (-F.col("_p")).alias("_p"))
    per = shares.where(F.col(group) != base).select(group, value, "_p")
    names = [r[0] for r in sizes.where(F.col(group) != base).select(group).limit(most_groups + 1).collect()]  # the groups compared: a few titles
    if len(names) > most_groups:
        raise ValueError(f"more than {most_groups} groups; raise most_groups if that is meant")
    mirrored = b.withColumn(group, F.explode(F.array(*map(F.lit, names)))).select(group, value, "_p") if names else per
    steps = per.union(mirrored).groupBy(group, value).agg(F.sum("_p").alias("_p"))
    w = over([group], [value])
    area = F.abs(F.sum("_p").over(so_far([group], [value]))) * (F.lead(value).over(w) - F.col(value))
    return steps.withColumn("_a", area).groupBy(group).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("distance"))


def grid_diff(a: DataFrame, b: DataFrame, cell: Sequence[str] = ("gx", "gy"), value: str = "n", smooth: float = 1e-9, parity: bool = False) -> DataFrame:
    """One row: total variation, KL(a, b), symmetric KL (the mean of both ways) and the ratio of points. parity: KL as
    published, which takes shares for their logarithms: minus the sum of q * (log q - p)."""
    sa, sb = a.agg(F.sum(value)).first()[0] or 1, b.agg(F.sum(value)).first()[0] or 1
    both = a.select(*cell, F.col(value).alias("_a")).join(b.select(*cell, F.col(value).alias("_b")), list(cell), "full")
    p, q = F.coalesce("_a", F.lit(0)) / F.lit(float(sa)), F.coalesce("_b", F.lit(0)) / F.lit(float(sb))
    kl = lambda x, y: F.sum((x + smooth) * F.log((x + smooth) / (y + smooth)))
    if parity:
        kl = lambda x, y: -F.sum(F.when(y > 0, y * (F.log(y) - x)).otherwise(0.0))
    return both.agg((F.sum(F.abs(p - q)) / 2).alias("tv"), kl(p, q).alias("kl"), ((kl(p, q) + kl(q, p)) / 2).alias("skl"), F.lit(sa / sb).alias("ratio"))


def sum_diff(df: DataFrame, group: str, base: object, columns: Sequence[str]) -> DataFrame:
    """Sums per group and their ratios to the base group's."""
    sums = df.groupBy(group).agg(*[F.sum(c).alias(c) for c in columns])
    first = lambda c: F.max(F.when(F.col(group) == base, F.col(c))).over(Window.partitionBy())
    return sums.withColumns({f"{c}_ratio": F.try_divide(F.col(c), first(c)) for c in columns})


def lifetime(pat: DataFrame, keys: Sequence[str] = ("round_id", "player"), clock: str = "gt", cap: float = 40.0, rate: float = 1.0) -> DataFrame:
    """Seconds from a player's first to its last living row of a round, at most cap."""
    alive = pat.where("alive")
    return alive.groupBy(*keys).agg(F.least(F.lit(cap), (F.max(clock) - F.min(clock)) / F.lit(rate)).alias("seconds"))


def action_change(pat: DataFrame, move: str, keys: Sequence[str], order: Sequence[str], trim: int = 6) -> DataFrame:
    """+ change: 0 stays still, 1 starts, 2 stops, 3 keeps moving or turns; a key's first and last `trim` rows go."""
    w = over(keys, order)
    n = F.count(F.lit(1)).over(whole(keys))
    before, now = F.lag(move).over(w), F.col(move)
    code = F.when((before == 0) & (now == 0), 0).when((before == 0) & (now != 0), 1).when((before != 0) & (now == 0), 2).otherwise(3)
    rows = pat.withColumns({"change": code, "_i": F.row_number().over(w), "_n": n})
    return rows.where((F.col("_i") > trim) & (F.col("_i") <= F.col("_n") - trim)).drop("_i", "_n")


def shots_per_kill(pat: DataFrame, keys: Sequence[str] = ("round_id", "player")) -> DataFrame:
    """Shots per kill where there is a kill."""
    n = pat.groupBy(*keys).agg(F.count_if(F.col("kind") == "click").alias("_s"), F.count_if(F.col("kind") == "purchase").alias("_k"))
    return n.where("_k > 0").select(*keys, (F.col("_s") / F.col("_k")).alias("ratio"))


def _middle(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """keys, median and iqr of a value."""
    found = percentiles(df, value, [0.25, 0.5, 0.75], keys)
    return found.select(*keys, F.get("p", 1).alias("median"), (F.get("p", 2) - F.get("p", 0)).alias("iqr"))


def event_bins(df: DataFrame, x: str, y: str, value: str, dx: float, dy: float) -> DataFrame:
    """Median and quartile range of a value per cell, of cells with a value."""
    cells = df.select(F.floor(F.col(x) / dx).alias("bx"), F.floor(F.col(y) / dy).alias("by"), F.col(value).alias("value"))
    return _middle(cells, "value", ["bx", "by"])


def team_places(pat_places: DataFrame, keys: Sequence[str] = ("round_id", "team", "at")) -> DataFrame:
    """The sorted places of a team at a time, then ticks and rounds of each such formation."""
    formed = pat_places.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.col("place").cast("string"))), ",").alias("places"))
    return formed.groupBy("team", "places").agg(F.count(F.lit(1)).alias("ticks"), F.count_distinct("round_id").alias("rounds"))


def key_places(formations: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts of the listed formations (team, places), 0 where they never happen."""
    return listed.join(formations, ["team", "places"], "left").select("team", "places", F.coalesce("ticks", F.lit(0)).alias("ticks"), F.coalesce("rounds", F.lit(0)).alias("rounds"))


def alive_table(states: DataFrame) -> DataFrame:
    """By (ct_alive, t_alive): states, rounds, and rounds that begin so. states: round_id, at, ct_alive, t_alive."""
    first = F.min("at").over(whole(["round_id"]))
    return states.withColumn("_f", F.col("at") == first).groupBy("ct_alive", "t_alive").agg(F.count(F.lit(1)).alias("ticks"), F.count_distinct("round_id").alias("rounds"), F.count_if("_f").alias("starts"))


def mistakes(places: DataFrame, held: Sequence[int], keys: Sequence[str] = ("round_id", "team"), order: str = "at") -> DataFrame:
    """Opportunities (all held places are covered) and mistakes (not so in the next state) per team. places:
    keys, order, places (array)."""
    want = F.array(*map(F.lit, held))
    covered = F.size(F.array_except(want, F.col("places"))) == 0
    w = over(keys, [order])
    rows = places.withColumn("_now", covered).withColumn("_next", F.lead("_now").over(w))
    per = rows.groupBy(*keys).agg(F.count_if("_now").alias("_o"), F.count_if(F.col("_now") & ~F.col("_next")).alias("_m"))
    return per.groupBy("team").agg(F.sum("_o").alias("opportunities"), F.sum("_m").alias("mistakes"), F.count_if(F.col("_m") > 0).alias("rounds"))


def start_counts(starts: DataFrame, most_ct: int = 5, most_t: int = 5) -> DataFrame:
    """Rounds by (ct_alive, t_alive), with 0 for combinations that never happen."""
    n = starts.groupBy("ct_alive", "t_alive").agg(F.count(F.lit(1)).alias("rounds"))
    spark = starts.sparkSession
    every = spark.range(most_ct + 1).select(F.col("id").alias("ct_alive"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most_t).cast("long"))).alias("t_alive"))
    return every.join(n, ["ct_alive", "t_alive"], "left").select("ct_alive", "t_alive", F.coalesce("rounds", F.lit(0)).alias("rounds"))


def plant_stats(pat: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rounds, ticks, shots, kills and ticks per round of each key."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    out = pat.groupBy(*keys).agg(F.count_distinct("round_id").alias("rounds"), F.count(F.lit(1)).alias("ticks"), kind("click").alias("shots"), kind("purchase").alias("kills"))
    return out.withColumn("ticks_per_round", F.col("ticks") / F.col("rounds"))


def trial_summary(df: DataFrame, group: str, value: str, base: object) -> DataFrame:
    """Median and quartile range of trials, and the median's difference and relative difference to the base group's."""
    out = _middle(df, value, [group])
    first = F.max(F.when(F.col(group) == base, F.col("median"))).over(Window.partitionBy())
    return out.withColumns({"delta": F.col("median") - first, "relative": F.try_divide(F.col("median") - first, first)})


def infer_time(df: DataFrame, value: str, accuracy: int | None = None) -> DataFrame:
    """One row: percentiles of times, exact (see percentiles) or, with accuracy, by a sketch; nulls without times."""
    found = percentiles(df, value, [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99], (), accuracy)
    return found.select(*[F.get("p", i).alias(n) for i, n in enumerate(("p1", "p10", "p25", "median", "p75", "p90", "p99"))])


def ngram_bags(df: DataFrame, value: str, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Transitions between the sorted n-grams of a sequence: bag, prior (the bag one row before; null at first), n.
    Grams and transitions don't cross keys; without keys they cross players, as published, in one sorted sequence."""
    w = over(keys, order)
    parts = [F.lag(value, k).over(w) for k in range(n)]
    bag = F.when(F.lag(F.lit(1), n - 1).over(w).isNotNull() if n > 1 else F.lit(True), F.array_join(F.transform(F.sort_array(F.array(*parts)), lambda x: x.cast("string")), ","))
    rows = df.select(*keys, *order, bag.alias("bag")).withColumn("prior", F.lag("bag").over(w))
    return rows.where("bag IS NOT NULL").groupBy("bag", "prior").agg(F.count(F.lit(1)).alias("n"))


def round_cooccur(df: DataFrame, a: Column, b: Column, round_id: str = "round_id") -> DataFrame:
    """Rounds with both, either or neither."""
    per = df.groupBy(round_id).agg(F.max(a).alias("_a"), F.max(b).alias("_b"))
    name = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a") | F.col("_b"), "either").otherwise("neither")
    return per.groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("rounds"))


def swing_stats(df: DataFrame, value: str, keys: Sequence[str] = ("player",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def slice_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], change: str, back: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows inside all ranges, + change: the difference of a column to `back` rows earlier."""
    out = df.withColumn("change", F.col(change) - F.lag(change, back).over(over(keys, order)))
    for c, (lo, hi) in ranges.items():
        out = out.where(F.col(c).between(lo, hi))
    return out


def mouse_bins(df: DataFrame, value: str, back: int, width: float, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Histogram of a value's change over `back` rows."""
    rows = df.withColumn("_d", F.col(value) - F.lag(value, back).over(over(keys, order)))
    return rows.where("_d IS NOT NULL").groupBy(F.floor(F.col("_d") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fitts(tests: DataFrame, events: DataFrame, distance: str, width: str) -> DataFrame:
    """Index of difficulty log2(2D / W), and the first shot and hit of each test. events: test, name, at."""
    first = lambda n: F.min(F.when(F.col("name") == n, F.col("at")))
    firsts = events.groupBy("test").agg(first("shot").alias("first_shot"), first("hit").alias("first_hit"))
    bits = F.log2(2 * F.col(distance) / F.nullif(F.col(width), F.lit(0.0)))
    return tests.withColumn("bits", bits).join(firsts, "test", "left").select("test", "bits", "first_shot", "first_hit")


def survey_parse(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Free text `rank: a > b > c` to a row per item: id, item, position."""
    items = F.split(F.regexp_extract(text, r"rank:\s*(.*)$", 1), r"\s*>\s*")
    return answers.where(F.col(text).rlike("rank:")).select("id", F.posexplode(items).alias("position", "item"))


def rank_tests(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group: n, mean, mean rank (ties share the mean of their ranks) and the Kruskal-Wallis H of all groups with
    the correction for ties. Ranks come from counts of distinct values, summed along ranges of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_sum(counts, [value], F.col("_c"), "_before")
    ranks = placed.select(value, (F.col("_before") + (F.col("_c") + 1) / 2).alias("_rank"), (F.col("_c") * F.col("_c") * F.col("_c") - F.col("_c")).alias("_tie"), "_c")
    total, ties = ranks.agg(F.sum("_c"), F.sum("_tie")).first()
    n = float(total or 0)
    fix = 1 - float(ties or 0) / (n**3 - n) if n > 1 else 1.0
    by = df.join(ranks, value).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg("_rank").alias("mean_rank"))
    h = F.sum(F.col("n") * F.pow(F.col("mean_rank") - (n + 1) / 2, 2)).over(Window.partitionBy()) * (12 / (n * (n + 1)) if n else 0.0) / (fix or 1.0)
    return by.withColumn("h", h)


def near_event_bins(df: DataFrame, since: str, value: str, limits: Sequence[float], width: float) -> DataFrame:
    """Histograms of a value for rows at most t after an event, for several t."""
    rows = df.where(F.col(since).isNotNull()).withColumn("within", F.explode(F.array(*map(F.lit, limits)))).where(F.col(since) <= F.col("within"))
    return rows.groupBy("within", F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def region_filter(pat: DataFrame, inside: Column, any_of: Column | None = None, keys: Sequence[str] = ("round_id",)) -> DataFrame:
    """Rows inside; or with any_of, all rows of keys in which a row of any_of is inside."""
    if any_of is None:
        return pat.where(inside)
    return pat.withColumn("_in", F.max(inside & any_of).over(whole(keys))).where("_in").drop("_in")


def region_alive(pat: DataFrame, inside: Column, counts: Sequence[int], keys: Sequence[str] = ("round_id", "at")) -> DataFrame:
    """Keys with a player inside and so many players alive."""
    per = pat.groupBy(*keys).agg(F.max(inside).alias("_in"), F.count_distinct(F.when(F.col("alive"), F.col("player"))).alias("n_alive"))
    return per.where(F.col("_in") & F.col("n_alive").isin(*counts)).drop("_in")


def heat_mean(df: DataFrame, value: str, cell: float) -> DataFrame:
    """The mean of a value per grid cell."""
    return df.groupBy(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def nearest_player_heat(states: DataFrame, cell: float, keys: Sequence[str] = ("round_id", "tick_id"), teammate: bool = True, most: float = 1e5, coverage: DataFrame | None = None) -> DataFrame:
    """gx, gy, n and the mean distance from the living players in a cell to their nearest living teammate (or enemy) of the
    same keys. Players without one nearer than `most` don't count. coverage (gx, gy): other cells are left out, and covered
    cells without a distance have a null mean. states: keys, player, team, alive, x, y, z, a row a player."""
    a = states.where("alive").select(*keys, "player", "team", "x", "y", "z")
    b = a.withColumnsRenamed({c: f"_{c}" for c in ("player", "team", "x", "y", "z")})
    side = F.col("team") == F.col("_team") if teammate else F.col("team") != F.col("_team")
    gap = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in ("x", "y", "z")), F.lit(0.0)))
    pairs = a.join(b, list(keys)).where((F.col("player") != F.col("_player")) & side)
    nearest = pairs.groupBy(*keys, "player").agg(F.min(gap).alias("_d"), F.first("x").alias("x"), F.first("y").alias("y")).where(F.col("_d") < most)
    heat = heat_mean(nearest, "_d", cell)
    return heat if coverage is None else coverage.select("gx", "gy").distinct().join(heat, ["gx", "gy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def eval_ranges(rows: DataFrame, ranges: DataFrame, at: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows inside any of the ranges (start, end)."""
    from .joins import stab_join

    ids = stab_join(rows.select(*keys, at), ranges.select(*keys, "start", "end"), at, keys=keys, width=width).select(*keys, at).distinct()
    return rows.join(ids, [*keys, at], "left_semi")
