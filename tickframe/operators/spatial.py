"""Areas, places and the graph between them; grids. Points meet areas through grid cells, never as all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_box
from .joins import stab_join
from .windows import islands, over

LOW, HIGH = ["x0", "y0", "z0"], ["x1", "y1", "z1"]


def place_box(areas: DataFrame) -> DataFrame:
    """Bounds and areas (sorted) of every place."""
    return areas.groupBy("place").agg(*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH], F.sort_array(F.collect_list("area")).alias("areas"))


def containing_areas(points: DataFrame, areas: DataFrame, width: int, axes: int = 3) -> DataFrame:
    """Pairs of a point and an area with it, in two or three axes. Both are cut along x."""
    return stab_join(points, areas, "x", "x0", "x1", width=width).where(in_box(["x", "y", "z"][:axes], LOW[:axes], HIGH[:axes]))


def above_below(points: DataFrame, areas: DataFrame, width: int, key: str = "tick_id") -> DataFrame:
    """Of the areas over or under a point in two axes: the lowest that begins above it, the highest that ends below."""
    column = containing_areas(points, areas, width, axes=2)
    above, below = F.when(F.col("z0") > F.col("z"), F.struct("z0", "area")), F.when(F.col("z1") < F.col("z"), F.struct((-F.col("z1")).alias("z1"), "area"))
    return column.groupBy(key).agg(F.min(above)["area"].alias("above"), F.min(below)["area"].alias("below"))


def reach_matrix(edges: DataFrame, max_rounds: int = 64, src: str = "src", dst: str = "dst", cost: str = "cost", most_nodes: int = 20_000) -> DataFrame:
    """Shortest distances between all pairs that are connected: src, dst, dist. Each round joins the distances so far
    with themselves, so paths double in length; lineage is cut by checkpoints. The result has a row a pair and a round
    looks at a row a triple, so it is for graphs of a map; one of more than most_nodes nodes is refused."""
    from ..sources.tables import cut

    if edges.select(F.explode(F.array(src, dst)).alias("n")).distinct().count() > most_nodes:
        raise ValueError(f"all pairs of more than {most_nodes} nodes; raise most_nodes if that is meant")
    zero = edges.select(F.explode(F.array(src, dst)).alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"))
    best = lambda df: df.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    now = cut(best(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(cost).cast("double").alias("dist")).union(zero)))
    total = now.agg(F.count(F.lit(1)), F.sum("dist")).first()
    for _ in range(max_rounds):
        a, b = now.alias("a"), now.alias("b")
        step = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"), (F.col("a.dist") + F.col("b.dist")).alias("dist"))
        now = cut(best(step))
        if (new := now.agg(F.count(F.lit(1)), F.sum("dist")).first()) == total:
            break
        total = new
    return now


def closeness(dist: DataFrame) -> DataFrame:
    """Distances scaled to 255 (nearest) down to 0 (farthest) over the table."""
    low, high = dist.agg(F.min("dist"), F.max("dist")).first()
    span = (high - low) or 1.0 if low is not None else 1.0
    return dist.select("src", "dst", F.round(255 * (1 - (F.col("dist") - (low or 0.0)) / span)).cast("int").alias("closeness"))


def place_dist(dist: DataFrame, areas: DataFrame, parity: bool = False) -> DataFrame:
    """From each area to each place: closest area and its distance, and the median (lower) distance. parity: in place of
    the median what the published reader keeps, the last distance, by area, that is no new closest one."""
    to = dist.join(areas.select(F.col("area").alias("dst"), "place"), "dst")
    closest = F.min(F.struct("dist", "dst")).alias("_m")
    if parity:
        before = F.min("dist").over(Window.partitionBy("src", "place").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1))
        kept = to.withColumn("_last", F.when(before.isNull() | (F.col("dist") >= before), F.col("dst")))
        out = kept.groupBy("src", "place").agg(closest, F.max(F.when(F.col("_last").isNotNull(), F.struct("_last", "dist")))["dist"].alias("median"))
        return out.select("src", "place", F.col("_m.dst").alias("closest"), F.col("_m.dist").alias("dist"), "median")
    out = to.groupBy("src", "place").agg(closest, F.sort_array(F.collect_list("dist")).alias("_all"))
    return out.select("src", "place", F.col("_m.dst").alias("closest"), F.col("_m.dist").alias("dist"), F.get("_all", F.greatest(F.lit(0), F.floor(F.size("_all") / 2).cast("int") - 1)).alias("median"))


def place_links(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Different places with an area edge between them."""
    a = areas.select(F.col("area").alias("src"), F.col("place").alias("p"))
    b = areas.select(F.col("area").alias("dst"), F.col("place").alias("q"))
    return edges.join(a, "src").join(b, "dst").where("p <> q").select("p", "q").distinct()


def simple_paths(links: DataFrame, start: int, goal: int, avoid: Sequence[int] = (), other: int | None = None) -> DataFrame:
    """All paths from start to goal that visit no node twice and none to avoid: path. other: the other objective, which
    is avoided with all its neighbours. Paths hold no cycle, so the search ends by itself."""
    from ..sources.tables import cut

    ok = links.where(~F.col("q").isin(*avoid)) if avoid else links
    if other is not None:
        beside = links.where(F.col("p") == other).select("q").distinct()
        ok = ok.where(F.col("q") != other).join(beside, "q", "left_anti")
    live = links.sparkSession.createDataFrame([([start],)], "path array<long>")
    done = []
    while True:
        live = live.withColumn("p", F.element_at("path", -1)).join(ok, "p").where(~F.array_contains("path", F.col("q"))).select(F.array_append("path", F.col("q").cast("long")).alias("path"))
        live = cut(live)
        done.append(live.where(F.element_at("path", -1) == goal))
        live = live.where(F.element_at("path", -1) != goal)
        if live.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def path_minimal(paths: DataFrame) -> DataFrame:
    """Without paths that hold every node of another one that has the same last hop."""
    hop = lambda c: F.slice(c, -2, 2)
    a, b = paths.select("path", hop("path").alias("hop")), paths.select(F.col("path").alias("less"), hop("path").alias("hop"))
    larger = a.join(b, "hop").where((F.size("less") < F.size("path")) & (F.size(F.array_except("less", "path")) == 0)).select("path").distinct()
    return paths.join(larger, "path", "left_anti")


def danger_pairs(visible: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, hidden): dst is seen from src, its neighbour `hidden` is not."""
    next_to = edges.select(F.col("src").alias("dst"), F.col("dst").alias("hidden")).distinct()
    return visible.join(next_to, "dst").where("src <> hidden").join(visible.select("src", F.col("dst").alias("hidden")), ["src", "hidden"], "left_anti").select("src", "dst", "hidden").distinct()


def visible_union(team_areas: DataFrame, visible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Areas seen by anyone of a key."""
    return team_areas.join(visible.select(F.col("src").alias("area"), F.col("dst").alias("seen")), "area").select(*keys, "seen").distinct()


def grid_counts(points: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*keys, F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def grid_blur(grid: DataFrame, weights: dict[tuple[int, int], float], value: str = "n") -> DataFrame:
    """Each cell spreads to its neighbours by weight: gx, gy, value."""
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in weights.items()]))
    spread = grid.withColumn("o", offsets).select((F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"), (F.col(value) * F.col("o.w")).alias("v"))
    return spread.groupBy("gx", "gy").agg(F.sum("v").alias("value"))


def grid_spread(grid: DataFrame, bounds: DataFrame, barrier: DataFrame, decay: float = 0.993, floor: int = 30, reach: int = 2, steps: int | None = None, value: str = "n") -> DataFrame:
    """Values from 0 to 255 that spread over a grid with decay: gx, gy, value of the cells over 0.

    In a step each cell within bounds that no barrier stands on takes the largest of itself and of its neighbours up to
    `reach` cells off, theirs to the power of decay; what is over 0 then decays once more, but not under the floor. Powers
    are cut to whole numbers. `steps` of them, or as many as it takes until nothing changes. bounds and barrier: gx, gy of
    cells. The grid is sparse: cells of 0 are no rows. Each step is cut from its lineage."""
    from ..sources.tables import cut

    power = lambda c: F.floor(F.pow(c, F.lit(decay))).cast("int")
    around = F.explode(F.transform(F.sequence(F.lit(0), F.lit((2 * reach + 1) ** 2 - 1)), lambda k: F.struct((F.floor(k / (2 * reach + 1)) - reach).alias("dx"), (k % (2 * reach + 1) - reach).alias("dy"))))
    inside = cut(bounds.select("gx", "gy").distinct().join(barrier.select("gx", "gy").distinct(), ["gx", "gy"], "left_anti"))
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("gx", "gy", "value"))).first()
    now, done = grid.groupBy("gx", "gy").agg(F.max(value).cast("int").alias("value")).where("value > 0"), 0
    before = None
    while steps is None or done < steps:
        spread = now.withColumn("o", around).select((F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"), F.when((F.col("o.dx") == 0) & (F.col("o.dy") == 0), F.col("value")).otherwise(power("value")).alias("v"))
        most = spread.groupBy("gx", "gy").agg(F.max("v").alias("v")).where("v > 0").join(inside, ["gx", "gy"], "left_semi")
        now = cut(most.select("gx", "gy", F.when(F.col("v") < floor, F.lit(floor)).otherwise(F.greatest(F.lit(floor), power("v"))).alias("value")).where("value > 0"))
        done += 1
        if steps is None:
            if (after := state(now)) == before:
                break
            before = after
    return now


def nav_counts(pat_areas: DataFrame, keys: Sequence[str] = ("round_id", "area")) -> DataFrame:
    """Rows per key from each team's side: friends, enemies."""
    both = pat_areas.groupBy(*keys).agg(F.count_if(F.col("team") == 2).alias("n2"), F.count_if(F.col("team") == 3).alias("n3"))
    side = F.explode(F.array(F.struct(F.lit(2).alias("team"), F.col("n2").alias("f"), F.col("n3").alias("e")), F.struct(F.lit(3).alias("team"), F.col("n3").alias("f"), F.col("n2").alias("e"))))
    return both.withColumn("s", side).select(*keys, F.col("s.team").alias("team"), F.col("s.f").alias("friends"), F.col("s.e").alias("enemies"))


def moving_pairs(pat: DataFrame, box: float, every: int, keys: Sequence[str]) -> DataFrame:
    """keys, at, p < q: players less than `box` apart on both axes at a time step. A player stands where its last row of
    the step is. Players meet through cells as wide as the box: one side goes to the cells around its own."""
    at = F.floor(F.col("gt") / every)
    last = pat.groupBy(*keys, at.alias("at"), "player").agg(F.max(F.struct("gt", "tick_id", "x", "y")).alias("s")).select(*keys, "at", "player", "s.x", "s.y")
    cell = lambda c: F.floor(F.col(c) / box)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = last.select(*keys, "at", F.col("player").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    b = last.select(*keys, "at", F.col("player").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), around("x").alias("_cx")).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("qy") / box) - 1, F.floor(F.col("qy") / box) + 1)))
    near = (F.col("p") < F.col("q")) & (F.abs(F.col("px") - F.col("qx")) < box) & (F.abs(F.col("py") - F.col("qy")) < box)
    return a.join(b, [*keys, "at", "_cx", "_cy"]).where(near).select(*keys, "at", "p", "q")


def group_move(pat: DataFrame, n: int = 3, box: float = 400.0, every: int = 1, steps: int = 64, keys: Sequence[str] = ("round_id",)) -> DataFrame:
    """Groups that move together: keys, source, companions (sorted, larger numbers than the source), start, end (steps).

    A source and its companions belong together at a step if each of these stays within `box` of the source, on both axes,
    for `steps` steps from there, at least n players in all. Runs of such steps with the same companions are one row, which
    ends with the last one's window. A player without a row in a step is with nobody."""
    pairs = moving_pairs(pat, box, every, keys)
    own = [*keys, "p", "q"]
    marked = islands(pairs, own, ["at"], F.col("at") - F.lag("at").over(over(own, ["at"])) > 1)
    spans = marked.groupBy(*own, "island").agg(F.min("at").alias("a"), F.max("at").alias("b")).where(F.col("b") - F.col("a") + 1 >= steps)
    begun = spans.select(*keys, F.col("p").alias("source"), "q", F.explode(F.sequence("a", F.col("b") - steps + 1)).alias("at"))
    groups = begun.groupBy(*keys, "source", "at").agg(F.sort_array(F.collect_set("q")).alias("companions")).where(F.size("companions") >= n - 1)
    own = [*keys, "source", "companions"]
    joined = islands(groups, own, ["at"], F.col("at") - F.lag("at").over(over(own, ["at"])) > 1)
    return joined.groupBy(*own, "island").agg(F.min("at").alias("start"), (F.max("at") + steps - 1).alias("end")).drop("island")


def region_sequence(pat: DataFrame, first: Column, second: Column, keys: Sequence[str], clock: str = "gt", groups: DataFrame | None = None, every: int = 1) -> DataFrame:
    """Keys that enter the second region after the first: keys, t1, t2 (first such). With groups (of group_move, made with
    `every`): of each group, t1 is the first step at which all of it are in the first region, t2 the first later step at
    which all are in the second, by the players' last rows of each step while the group lasts."""
    if groups is None:
        w = Window.partitionBy(*keys)
        seen = pat.withColumn("t1", F.min(F.when(first, F.col(clock))).over(w)).where(second & (F.col(clock) > F.col("t1")))
        return seen.groupBy(*keys, "t1").agg(F.min(clock).alias("t2"))
    own = [*keys, "source", "companions", "start", "end"]
    named = groups.select(*own, F.explode(F.concat(F.array("source"), "companions")).alias("player"))
    steps = named.withColumn("at", F.explode(F.sequence("start", "end")))
    last = pat.withColumns({"_1": first, "_2": second}).groupBy(*keys, F.floor(F.col(clock) / every).alias("at"), "player").agg(F.max(F.struct(clock, "tick_id", "_1", "_2")).alias("s"))
    there = steps.join(last, [*keys, "at", "player"]).groupBy(*own, "at").agg(F.every("s._1").alias("in1"), F.every("s._2").alias("in2"))
    seen = there.withColumn("t1", F.min(F.when(F.col("in1"), F.col("at"))).over(Window.partitionBy(*own))).where(F.col("in2") & (F.col("at") > F.col("t1")))
    return seen.groupBy(*own, "t1").agg(F.min("at").alias("t2"))


def kmeans(points: DataFrame, columns: Sequence[str], k: int, seed: int = 3, coarse: Sequence[float] | None = None, distance: str | None = None) -> DataFrame:
    """+ cluster, numbered by coordinates of the centres (with coarse, by their cells of these sizes first); Spark ML's
    KMeans. distance: name of a column for the distance to the centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(rows)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: ([x // w for x, w in zip(centres[i], coarse or ())], centres[i]))
    rank = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(len(order))]), F.col("_c") + 1)
    out = model.transform(rows).withColumn("cluster", rank)
    if distance:
        centre = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("_c") + 1)
        out = out.withColumn(distance, F.sqrt(sum(((F.col(c) - centre[i]) * (F.col(c) - centre[i]) for i, c in enumerate(columns)), F.lit(0.0))))
    return out.drop("_v", "_c")


def rest_clusters(pat: DataFrame, k: int = 50, most: float = 1.0, keys: Sequence[str] = ("team", "site"), columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Positions at a speed under `most`, clustered for each of the keys: keys, cluster, n, and of each column mean and
    std. The keys have few values (teams and sites); each is a fit of its own."""
    from ..sources.tables import cut
    from .behaviour import speed

    still = cut(speed(pat, F.lit(1.0)).where(F.col("speed") < most).select(*keys, *columns))
    out = None
    for key in still.select(*keys).distinct().orderBy(*keys).collect():
        own = still
        for c in keys:
            own = own.where(F.col(c).eqNullSafe(F.lit(key[c])))
        stats = cluster_stats(kmeans(own, columns, k), columns)
        stats = stats.select(*[F.lit(key[c]).cast(still.schema[c].dataType).alias(c) for c in keys], *stats.columns)
        out = stats if out is None else out.union(stats)
    if out is None:
        out = cluster_stats(still.withColumn("cluster", F.lit(0)), columns).select(*[F.lit(None).cast(still.schema[c].dataType).alias(c) for c in keys], "*")
    return out


def peek_clusters(points: DataFrame, k: int = 24, columns: Sequence[str] = ("x", "y", "z"), coarse: Sequence[float] = (200.0, 100.0, 10.0)) -> DataFrame:
    """All points clustered, labels ordered by coarse coordinates: cluster, n, mean and std of the distance to its
    centre."""
    from ..sources.tables import cut

    return cluster_stats(kmeans(cut(points.select(*columns)), columns, k, coarse=coarse, distance="distance"), ["distance"])


def cluster_stats(points: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    return points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
