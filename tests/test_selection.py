"""Exact percentiles, counts in windows, full range joins and dealing out, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.operators import cleaning, distributions, joins, windows

AT = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("ranks", [20, 1000])
def test_percentiles_are_exact(spark, ranks):
    rng = np.random.default_rng(2)
    groups = {"even": rng.random(3000), "skew": np.exp(8 * rng.normal(size=3000)), "ties": rng.integers(0, 5, 3000).astype(float), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0]), None: rng.normal(size=900)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "_v string, _n double").repartition(4)
    got = {r["_v"]: r.p for r in distributions.percentiles(df, "_n", AT, ["_v"], ranks=ranks).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, AT)), rel=1e-9)
    whole = distributions.percentiles(df.where("_v = 'skew'"), "_n", AT, ranks=ranks).first().p
    assert whole == pytest.approx(list(np.quantile(groups["skew"], AT)), rel=1e-9)
    assert tuple(distributions.infer_time(df.limit(0), "_n").first()) == (None,) * 7 and distributions.pct_trim(df.limit(0), "_n").count() == 0


def test_few_values_are_counted(spark):
    """Of many rows only those near the percentiles are grouped by value."""
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("v"))
    want = np.quantile([r.v for r in df.collect()], [0.3, 0.9])
    found = distributions.percentiles(df, "v", [0.3, 0.9])
    assert found.first().p == pytest.approx(list(want), rel=1e-12)


@pytest.mark.parametrize("block", [4, 64])
def test_dominance(block):
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 400, 700)).astype(float)
    values = rng.integers(0, 40, 700).astype(float)
    n, below, above = windows.dominance(times, values, 60, 5, block)
    for i in range(700):
        seen = values[(times >= times[i]) & (times <= times[i] + 60)]
        assert (n[i], below[i], above[i]) == (len(seen), (seen < values[i] - 5).sum(), (seen > values[i] + 5).sum())


def test_rolling_trend_with_nulls(spark):
    rows = [(1, 0, 5.0, "a"), (1, 1, None, "b"), (1, 2, 9.0, None), (1, None, 1.0, "c"), (2, 0, 5.0, "d")]
    out = {(r.round_id, r.gt): (r.falls, r.stays, r.rises, r.note) for r in windows.rolling_trend(spark.createDataFrame(rows, "round_id long, gt long, x double, note string"), "x", 5, 1.0, ["round_id"]).collect()}
    assert out == {(1, 0): (0, 0.5, 0.5, "a"), (1, 1): (None, None, None, "b"), (1, 2): (0, 1, 0, None), (1, None): (None, None, None, "c"), (2, 0): (0, 1, 0, "d")}
    assert windows.rolling_trend(spark.createDataFrame([], "round_id long, gt long, x double"), "x", 5, 1.0, ["round_id"]).count() == 0


def test_full_range_join(spark):
    rng = random.Random(1)
    spans = [(k, rng.choice([1, 2, None]), lo, lo + rng.randrange(0, 40) if rng.random() < 0.9 else None) for k in range(80) for lo in [rng.randrange(0, 300)]] + [(900, 1, 50, 40)]
    points = [(k, rng.choice([1, 2, 3, None]), rng.randrange(0, 300) if rng.random() < 0.9 else None) for k in range(80)]
    a, b = spark.createDataFrame(spans, "id long, key long, lo long, hi long"), spark.createDataFrame(points, "pid long, key long, at long")
    out = joins.full_range_join(a, b, "lo", "hi", "at", "id", "pid", ["key"], 16)
    pairs = {(s, p) for s, k, lo, hi in spans for p, j, at in points if None not in (k, j, lo, hi, at) and k == j and lo <= at <= hi}
    want = pairs | {(s[0], None) for s in spans if s[0] not in {x for x, _ in pairs}} | {(None, p[0]) for p in points if p[0] not in {y for _, y in pairs}}
    got = [(r.id, r.pid) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert out.columns == ["id", "key", "lo", "hi", "pid", "point_key", "at"]


def test_setups_are_dealt_evenly(spark):
    df = lambda n, k: spark.createDataFrame([(i, i % 3 if i % 3 < k else 0, f"p{i}") for i in range(n)], "id long, site long, player string")
    out = cleaning.remix_setups(df(90, 3), df(14, 2), "site", "id", ["player"]).collect()
    sites = {r.site for r in out}
    assert sites == {0, 1} and len(out) == 60 and all(r.off_player == f"p{r.off_id}" for r in out)
    for s in sites:
        used = [r.off_id for r in out if r.site == s]
        counts = [used.count(x) for x in set(used)]
        assert max(counts) - min(counts) <= 1 and len({r.def_id for r in out if r.site == s}) == 30
