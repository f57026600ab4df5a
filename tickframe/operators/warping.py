"""Dynamic time warping of paths, and the most alike rounds by it, with exact bounds in front.

A step pattern says how a warping may go on: each option names the cell that it comes from (how many points back on
either path) and the cells that it pays for, with weights. `warp` sweeps the anti-diagonals of many pairs at once and
keeps which option each cell took, so the matched points can be read back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .trajectories import traj_length

# The two step patterns. Each option is (points back to where it comes from, cells paid: points back, weight).
FREE = (
    ((0, 1), ((0, 0, 1),)),
    ((1, 1), ((0, 0, 1),)),
    ((1, 0), ((0, 0, 1),)),
)
SLOPE = (
    ((1, 3), ((0, 2, 2), (0, 1, 1), (0, 0, 1))),
    ((1, 2), ((0, 1, 2), (0, 0, 1))),
    ((1, 1), ((0, 0, 2),)),
    ((2, 1), ((1, 0, 2), (0, 0, 1))),
    ((3, 1), ((2, 0, 2), (1, 0, 1), (0, 0, 1))),
)
CELLS = 2_000_000  # cells swept at once
CUTS = 10  # parts of a path at whose ends ADE looks
PARTS = 8  # boxes to a path in the coarse bound


def warp(gaps: np.ndarray, steps: tuple = FREE) -> tuple[np.ndarray, np.ndarray]:
    """(cost, option) of every cell for gaps[pair, i, j], the distances of point i to point j. Both have a row and a column
    before the first; the first option wins ties, and -1 stands where no option leads."""
    k, n, m = gaps.shape
    cost, option = np.full((k, n + 1, m + 1), np.inf), np.full((k, n + 1, m + 1), -1, np.int8)
    cost[:, 0, 0] = 0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        best, taken = np.full((k, len(i)), np.inf), np.full((k, len(i)), -1, np.int8)
        for o, ((a, b), paid) in enumerate(steps):
            fits = np.flatnonzero((i >= a) & (j >= b))
            x, y = i[fits], j[fits]
            way = cost[:, x - a, y - b] + sum(w * gaps[:, x - c - 1, y - d - 1] for c, d, w in paid)
            less = way < best[:, fits]
            best[:, fits] = np.where(less, way, best[:, fits])
            taken[:, fits] = np.where(less, o, taken[:, fits])
        cost[:, i, j], option[:, i, j] = best, taken
    return cost, option


def matched(cost: np.ndarray, option: np.ndarray, n: int, m: int, steps: tuple = FREE, parity: bool = False) -> list[list[int]]:
    """Pairs of points (from 0) that the cheapest warping of n to m points ends its steps on, in order; none if there is no
    warping. parity: go back by the least cost of the cell come from, without what the step pays, as the published reader
    does; with weights that differ this is not always the way that was paid for."""
    out: list[list[int]] = []
    if np.isinf(cost[n, m]):
        return out
    i, j = n, m
    while i > 0 and j > 0:
        out.append([i - 1, j - 1])
        o = int(option[i, j])
        if parity:
            o = min(range(len(steps)), key=lambda s: cost[i - steps[s][0][0], j - steps[s][0][1]] if i >= steps[s][0][0] and j >= steps[s][0][1] else np.inf)
        i, j = i - steps[o][0][0], j - steps[o][0][1]
    return out[::-1]


def swept(gaps: Sequence[np.ndarray], steps: tuple = FREE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, cost, option) of each pair's distances; pairs of like sizes are padded and swept together."""
    order = sorted(range(len(gaps)), key=lambda k: gaps[k].shape)
    while order:
        n, m, take = 0, 0, 0
        for k in order:
            n2, m2 = max(n, gaps[k].shape[0]), max(m, gaps[k].shape[1])
            if take and (take + 1) * n2 * m2 > CELLS:
                break
            n, m, take = n2, m2, take + 1
        some, order = order[:take], order[take:]
        padded = np.full((take, n, m), np.inf)
        for p, k in enumerate(some):
            padded[p, : gaps[k].shape[0], : gaps[k].shape[1]] = gaps[k]
        cost, option = warp(padded, steps)
        for p, k in enumerate(some):
            yield k, cost[p], option[p]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def dtw_cost(a: np.ndarray, b: np.ndarray, steps: tuple = FREE) -> float:
    """Cost of warping two paths (points by coordinates), over the number of points of both."""
    return float(warp(distances(a, b)[None], steps)[0][0, -1, -1] / (len(a) + len(b)))


def dtw(pairs: DataFrame, columns: Sequence[str] = ("x", "y"), slope: bool = False, parity: bool = False) -> DataFrame:
    """+ dtw of path_a and path_b (cost over the number of their points) and matched, the pairs of points (from 0) met on
    the way. Both are null for an empty path; dtw is infinite and matched empty where the pattern has no way."""
    steps = SLOPE if slope else FREE

    @F.pandas_udf("dtw double, matched array<array<int>>")
    def cost(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        points = lambda p: np.array([[q[c] for c in columns] for q in p], dtype=float).reshape(-1, len(columns))
        found: list[tuple] = [(None, None)] * len(a)
        there = [k for k, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and len(x) and len(y)]
        gaps = [distances(points(a.iloc[k]), points(b.iloc[k])) for k in there]
        for at, total, option in swept(gaps, steps):
            n, m = gaps[at].shape
            found[there[at]] = (total[n, m] / (n + m), matched(total, option, n, m, steps, parity))
        return pd.DataFrame(found, columns=["dtw", "matched"])

    return pairs.withColumn("_w", cost("path_a", "path_b")).select(*pairs.columns, "_w.dtw", "_w.matched")


def multi_trajectories(paths: DataFrame, key: str = "round_id", columns: Sequence[str] = ("x", "y"), clock: str = "gt") -> DataFrame:
    """A row per key: id, ct and t (each team's paths as flat coordinates, by player), n_ct, n_t, time (the longest
    path's), length (of all paths). paths: key, team (3 and 2), player, path."""
    flat = F.flatten(F.transform("path", lambda p: F.array(*[p[c].cast("double") for c in columns])))
    side = lambda team: F.transform(F.sort_array(F.collect_list(F.when(F.col("team") == team, F.struct("player", flat.alias("p"))))), lambda x: x["p"])
    both = traj_length(paths, columns, clock).groupBy(F.col(key).alias("id")).agg(side(3).alias("ct"), side(2).alias("t"), F.max("seconds").alias("time"), F.sum("length").alias("length"))
    return both.withColumns({"n_ct": F.size("ct"), "n_t": F.size("t")})


def even(teams: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    """Each team's paths as one array [player, step, coordinate]; a path that has ended stays at its last point."""
    n = max((len(p) for team in teams for p in team), default=0)
    return [np.array([p[np.minimum(np.arange(n), len(p) - 1)] for p in team]) if len(team) else np.empty((0, n, 0)) for team in teams]


def signature(teams: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marks, boxes, sizes) of a round's even paths: where each player is at the ends of the CUTS parts [player, 11,
    coordinate], the box of each player in each of PARTS stretches of steps [player, part, low and high, coordinate], and
    how many steps each stretch has."""
    n = max(t.shape[1] for t in teams)
    all_ = np.concatenate([t for t in teams if len(t)])
    marks = all_[:, np.arange(CUTS + 1) * (n - 1) // CUTS]
    edges = np.unique(np.arange(PARTS + 1) * n // PARTS)
    low = np.minimum.reduceat(all_, edges[:-1], axis=1)
    high = np.maximum.reduceat(all_, edges[:-1], axis=1)
    return marks, np.stack([low, high], axis=2), np.diff(edges)


def map_players(ours: np.ndarray, theirs: np.ndarray, teams: Sequence[int]) -> tuple[float, np.ndarray]:
    """(ade, mapping) by the marks: the least sum over the ways to map players within their team of the given sizes; the
    mapping holds their places in ours' order. The sum is over players, so each team is searched on its own."""
    total, out, at = 0.0, [], 0
    for size in filter(None, teams):
        a, b = ours[at : at + size], theirs[at : at + size]
        each = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=3)).sum(axis=2)
        ways = np.array(list(permutations(range(size))))
        sums = each[np.arange(size), ways].sum(axis=1)
        total += sums.min()
        out.append(ways[sums.argmin()] + at)
        at += size
    return float(total / (2 * (CUTS + 1))), np.concatenate(out)


def coarse_bound(a: tuple, b: tuple, mapping: np.ndarray) -> float:
    """No warping of the rounds with these signatures costs less. Every step of either round is paid at least once, and
    not less than the players' boxes of its stretch are from the nearest stretch of the other round."""
    low, high = a[1][:, :, 0], a[1][:, :, 1]
    low2, high2 = b[1][mapping][:, :, 0], b[1][mapping][:, :, 1]
    apart = np.maximum(0, np.maximum(low2[:, None] - high[:, :, None], low[:, :, None] - high2[:, None]))
    gaps = np.sqrt((apart**2).sum(axis=3)).sum(axis=0)
    return float(max((gaps.min(axis=1) * a[2]).sum(), (gaps.min(axis=0) * b[2]).sum()) / (a[2].sum() + b[2].sum()))


def fine_bound(gaps: np.ndarray) -> float:
    """The same by the distances of all steps."""
    return float(max(gaps.min(axis=1).sum(), gaps.min(axis=0).sum()) / sum(gaps.shape))


_SIGNED = "marks array<double>, boxes array<double>, sizes array<int>"
_SIZES = ["n_ct", "n_t"]


def _read(teams: Sequence, dims: int) -> list[np.ndarray]:
    return even([[np.asarray(p, dtype=float).reshape(-1, dims) for p in team] for team in teams])


def _blocks(rounds: DataFrame, name: str, dims: int, per_block: int) -> DataFrame:
    """Signatures, about per_block of one team size to a row: n_ct, n_t, <name> (array of id, signature, limit)."""

    @F.pandas_udf(_SIGNED)
    def sign(ct: pd.Series, t: pd.Series) -> pd.DataFrame:
        found = [signature(_read((a, b), dims)) for a, b in zip(ct, t)]
        return pd.DataFrame([(m.ravel(), x.ravel(), s) for m, x, s in found], columns=["marks", "boxes", "sizes"])

    counts = rounds.groupBy(*_SIZES).count().collect()  # a row a team size
    blocks = F.coalesce(*[F.when((F.col("n_ct") == r["n_ct"]) & (F.col("n_t") == r["n_t"]), F.lit(-(-r["count"] // per_block))) for r in counts], F.lit(1))
    dealt = rounds.withColumn("_b", F.pmod(F.xxhash64("id"), blocks))
    limit = F.col("limit") if "limit" in rounds.columns else F.lit(float("inf"))
    return dealt.groupBy(*_SIZES, "_b").agg(F.collect_list(F.struct("id", sign("ct", "t").alias("sign"), limit.alias("limit"))).alias(name)).drop("_b")


def _near(pred: DataFrame, truth: DataFrame, most: int | None, dims: int, per_block: int) -> DataFrame:
    """pred, truth, bound of pairs with equal team sizes: those whose coarse bound is within the pred's limit, or with
    `most` that many with the least bounds for each block and pred. Blocks meet blocks, pairs are made in arrays."""
    key = pred.schema["id"].dataType.simpleString()
    both = _blocks(pred, "ours", dims, per_block).join(_blocks(truth, "theirs", dims, per_block), _SIZES)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shaped(r: dict) -> tuple:
            sizes = np.asarray(r["sign"]["sizes"])
            return np.asarray(r["sign"]["marks"]).reshape(players, CUTS + 1, dims), np.asarray(r["sign"]["boxes"]).reshape(players, len(sizes), 2, dims), sizes

        for batch in batches:
            for n_ct, n_t, ours, theirs in zip(batch["n_ct"], batch["n_t"], batch["ours"], batch["theirs"]):
                players, out = n_ct + n_t, []
                signed = [(r["id"], shaped(r)) for r in theirs]
                for us in ours:
                    mine = shaped(us)
                    found = []
                    for other, sign in signed:
                        if other != us["id"]:
                            ade, mapping = map_players(mine[0], sign[0], (n_ct, n_t))
                            found.append((coarse_bound(mine, sign, mapping), other))
                    if most is not None:
                        found = sorted(found)[:most]
                    out += [(us["id"], other, bound) for bound, other in found if bound * (1 - 1e-9) <= us["limit"]]
                yield pd.DataFrame(out, columns=["pred", "truth", "bound"])

    return both.mapInPandas(look, f"pred {key}, truth {key}, bound double")


def sim_costs(pairs: DataFrame, pred: DataFrame, truth: DataFrame, dims: int = 2, slope: bool = False) -> DataFrame:
    """pairs (pred, truth, limit) + ade, dtw, mapping (places of truth's players, ct first, in pred's order), d_time, d_len.
    dtw is null where the fine bound alone is over the limit, so that the pair isn't warped."""
    steps = SLOPE if slope else FREE

    @F.pandas_udf("ade double, dtw double, mapping array<int>")
    def cost(ct_a: pd.Series, t_a: pd.Series, ct_b: pd.Series, t_b: pd.Series, limit: pd.Series) -> pd.DataFrame:
        out, gaps, at = [], [], []
        for k, (*sides, most) in enumerate(zip(ct_a, t_a, ct_b, t_b, limit)):
            us, them = _read(sides[:2], dims), _read(sides[2:], dims)
            ade, mapping = map_players(signature(us)[0], signature(them)[0], [len(x) for x in us])
            ours, theirs = (np.concatenate([x for x in side if len(x)]) for side in (us, them))
            total = sum(distances(p, q) for p, q in zip(ours, theirs[mapping]))
            out.append([ade, None, mapping])
            if fine_bound(total) * (1 - 1e-9) <= most:
                gaps.append(total)
                at.append(k)
        for k, total, _ in swept(gaps, steps):
            n, m = gaps[k].shape
            out[at[k]][1] = total[n, m] / (n + m)
        return pd.DataFrame(out, columns=["ade", "dtw", "mapping"])

    named = lambda df, name, end: df.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{end}") for c in ("ct", "t", "time", "length")])
    both = pairs.join(named(pred, "pred", "a"), "pred").join(named(truth, "truth", "b"), "truth")
    cols = ["pred", "truth", (F.col("time_a") - F.col("time_b")).alias("d_time"), (F.col("length_a") - F.col("length_b")).alias("d_len")]
    return both.select(*cols, cost("ct_a", "t_a", "ct_b", "t_b", "limit").alias("c")).select("pred", "truth", "c.*", "d_time", "d_len")


def sim_search(pred: DataFrame, truth: DataFrame, k: int = 6, dims: int = 2, slope: bool = False, per_block: int = 64) -> DataFrame:
    """Costs (see sim_costs) of all pairs that may be among the k most alike of a predicted multi-trajectory.

    First each one's k pairs with the least coarse bounds are warped; the largest of these costs is its limit. No pair whose
    coarse bound is over the limit can come among the k, nor one whose fine bound is; only the rest is warped. Bounds hold
    for both patterns, whose weights are all one or more."""
    unlimited = F.lit(float("inf")).alias("limit")
    w = Window.partitionBy("pred").orderBy("bound", "truth")
    first = _near(pred, truth, k, dims, per_block).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    begun = cut(sim_costs(first.select("pred", "truth", unlimited), pred, truth, dims, slope))
    limits = begun.groupBy("pred").agg(F.when(F.count("dtw") == k, F.max("dtw")).otherwise(F.lit(float("inf"))).alias("limit"))
    limited = cut(pred.join(limits.withColumnRenamed("pred", "id"), "id"))
    rest = _near(limited, truth, None, dims, per_block).join(begun.select("pred", "truth"), ["pred", "truth"], "left_anti")
    return begun.unionByName(sim_costs(rest.join(limits, "pred").select("pred", "truth", "limit"), pred, truth, dims, slope))


def sim_join(pred: DataFrame, truth: DataFrame, k: int = 6, dims: int = 2, slope: bool = False, per_block: int = 64) -> DataFrame:
    """For each predicted multi-trajectory (see multi_trajectories) the k most alike by DTW of all with the same team sizes,
    under the mapping of players with the least ADE: pred, truth, ade, dtw, mapping, rank, d_time, d_len; ties by truth.
    Only itself is no match. Rounds that the pattern can't warp are no match."""
    w = Window.partitionBy("pred").orderBy("dtw", "truth")
    found = sim_search(pred, truth, k, dims, slope, per_block).where(F.col("dtw") < float("inf"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("pred", "truth", "ade", "dtw", "mapping", "rank", "d_time", "d_len")


