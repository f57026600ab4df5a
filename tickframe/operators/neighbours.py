"""Nearest areas of a point and nearest states of a game, without a bound on how far they may be."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import box_distance
from ..sources.tables import cut
from .spatial import HIGH, LOW


def areas_within(points: DataFrame, areas: DataFrame, reach: float) -> DataFrame:
    """Pairs of a point and an area at most `reach` away, each once, with their distance. Areas go to the cells (reach
    wide) that their box, grown by reach, touches; a point goes to its own."""
    cells = lambda a, b: F.sequence(F.floor((F.col(a) - reach) / reach), F.floor((F.col(b) + reach) / reach))
    spread = areas.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))
    at = points.withColumns({"_cx": F.floor(F.col("x") / reach), "_cy": F.floor(F.col("y") / reach)})
    return at.join(spread, ["_cx", "_cy"]).withColumn("distance", box_distance(["x", "y", "z"], LOW, HIGH)).where(F.col("distance") <= reach).drop("_cx", "_cy")


def nearest_areas(points: DataFrame, areas: DataFrame, reach: float, k: int = 1, key: str = "tick_id") -> DataFrame:
    """The k nearest areas of each point (all, if there are fewer): key, area, distance, rank; ties by area.

    Expanding rings: a point with k areas within reach is settled, for every area nearer than the k-th has been met. The
    others go on with twice the reach, until all are settled or the ring holds everything. Reach is the first ring, near
    the usual distance; it changes the work, not the result. Points with a null coordinate have no row. Each ring is cut
    from its lineage, so the rings run when the result is made."""
    ends = lambda df, low, high: df.agg(*[F.min(c) for c in low], *[F.max(c) for c in high], F.count(F.lit(1))).first()
    placed = points.select(key, "x", "y", "z").dropna(subset=["x", "y", "z"])
    a, p = ends(areas, LOW, HIGH), ends(placed, ["x", "y", "z"], ["x", "y", "z"])
    k = min(k, a[6])
    far = sum((max(a[i + 3], p[i + 3]) - min(a[i], p[i])) ** 2 for i in range(3)) ** 0.5 if k and p[6] else 0.0
    left, rings = placed, []
    while True:
        last = reach >= far
        w = Window.partitionBy(key)
        near = areas_within(left, areas, reach).select(key, "area", "distance")
        ranked = near.withColumns({"rank": F.row_number().over(w.orderBy("distance", "area")), "_n": F.count(F.lit(1)).over(w)})
        settled = cut(ranked.where((F.col("rank") <= k) & (F.lit(last) | (F.col("_n") >= k))).drop("_n"))
        rings.append(settled)
        if last:
            return reduce(DataFrame.union, rings)
        left = cut(left.join(settled.where("rank = 1").select(key), key, "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.union, rings)
        reach *= 2


def team_states(pat: DataFrame, keys: Sequence[str] = ("round_id", "tick_id"), clock: str = "gt") -> DataFrame:
    """A row for each of the keys: clock, and the living of both teams, by player: ct and t, arrays of player, x, y, z. pat
    has a row for each player."""
    side = lambda team: F.sort_array(F.collect_list(F.when(F.col("alive") & (F.col("team") == team), F.struct("player", *[F.col(c).cast("double").alias(c) for c in "xyz"]))))
    return pat.groupBy(*keys).agg(F.max(clock).alias(clock), side(3).alias("ct"), side(2).alias("t"))


def best_mapping(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, ways): of gaps[state, ours, theirs], for each state the least sum over all ways to map ours to theirs, and the
    first such way."""
    n = gaps.shape[1]
    ways = np.array(list(permutations(range(n))), int)  # one way for nobody
    total = gaps[:, np.arange(n), ways].sum(axis=2)
    best = total.argmin(axis=1)
    return total[np.arange(len(total)), best], ways[best]


def knn_state(states: DataFrame, queries: Sequence[dict], n: int = 20, left: float = 5.0, group: str = "round_id", key: str = "tick_id", clock: str = "gt") -> DataFrame:
    """For each query the n groups (rounds) with the nearest state: query, group, key, distance, mapping, target.

    queries: a few situations {"ct": [(x, y, z), ...], "t": [...], "target": place of a player in ct + t}. A state (see
    team_states) is comparable if as many of each team live, and if the group goes on for more than `left` clock units
    in that make-up. Its distance is the least sum of distances over all ways to map the query's players to the state's
    within their teams; mapping holds the state's players in the query's order. target is the player that the query's
    target falls to under the mapping with the least sum of absolute differences. Ties go to the first mapping, then the
    smaller key and group.

    A team's mappings are searched on their own, as the sum over both teams is least where each is. A batch of states is
    one array against all mappings; each batch keeps its best of a group, Spark the best of all, and then the n of them
    are ranked by tasks before they meet."""
    sizes = sorted({(len(q["ct"]), len(q["t"])) for q in queries})
    named = states.select(group, key, clock, F.size("ct").alias("_ct"), F.size("t").alias("_t"), F.concat("ct", "t").alias("_all"))
    fits = reduce(lambda a, b: a | b, [(F.col("_ct") == a) & (F.col("_t") == b) for a, b in sizes], F.lit(False))
    lasting = named.where(fits).withColumn("_end", F.max(clock).over(Window.partitionBy(group, "_ct", "_t"))).where(F.col("_end") - F.col(clock) > left)
    flat = F.flatten(F.transform("_all", lambda p: F.array(p["x"], p["y"], p["z"])))
    rows = lasting.select(group, key, "_ct", "_t", flat.alias("_at"), F.transform("_all", lambda p: p["player"]).alias("_who"))
    player = rows.schema["_who"].dataType.elementType
    shape = T.StructType([T.StructField("query", T.IntegerType()), rows.schema[group], rows.schema[key], T.StructField("distance", T.DoubleType()), T.StructField("mapping", T.ArrayType(player)), T.StructField("target", player)])
    arrow = {f.name: to_arrow_type(f.dataType) for f in shape}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, query in enumerate(queries):
                a, b = len(query["ct"]), len(query["t"])
                own = batch.filter(pc.and_(pc.equal(batch.column("_ct"), a), pc.equal(batch.column("_t"), b)))
                if not len(own):
                    continue
                at = own.column("_at").flatten().to_numpy().reshape(len(own), a + b, 3)
                asked = np.array([*query["ct"], *query["t"]], float)
                apart = asked[None, :, None, :] - at[:, None, :, :]
                round_, straight = np.sqrt((apart**2).sum(axis=3)), np.abs(apart).sum(axis=3)
                halves = [slice(0, a), slice(a, a + b)]
                found = [best_mapping(round_[:, h, h]) for h in halves]
                distance = found[0][0] + found[1][0]
                order = np.concatenate([found[0][1], found[1][1] + a], axis=1)
                side = int(query["target"] >= a)
                flat_way = best_mapping(straight[:, halves[side], halves[side]])[1]
                target = flat_way[:, query["target"] - side * a] + side * a
                which = pc.dictionary_encode(own.column(group), null_encoding="encode").indices.to_numpy()
                rank = np.empty(len(own), int)
                rank[pc.array_sort_indices(own.column(key)).to_numpy()] = np.arange(len(own))
                by = np.lexsort((rank, distance, which))
                first = by[np.flatnonzero(np.diff(which[by], prepend=-1))]
                who = own.column("_who").flatten()
                base = first * (a + b)
                mapped = who.take(pa.array((base[:, None] + order[first]).ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * (a + b)), mapped)
                pick = pa.array(first)
                columns = [pa.array(np.full(len(first), q, np.int32)), own.column(group).take(pick), own.column(key).take(pick), pa.array(distance[first]), lists, who.take(pa.array(base + target[first]))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.values())], list(arrow))

    w = Window.partitionBy("query").orderBy("distance", group)
    best = rows.mapInArrow(nearest, shape).groupBy("query", group).agg(F.min(F.struct("distance", key, "mapping", "target")).alias("b"))
    ranked = best.select("query", group, "b.*").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return ranked.select("query", group, key, "distance", "mapping", "target")
