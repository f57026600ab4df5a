"""Window frames whose cost grows with the rows of a key for each row: none may be left in the queries named here."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tickframe.operators import events, windows
from tickframe.plans import registry

AT = "/root/testdata/sf0.001"
#: Their frames began at the row and ended with the key, which Spark reads anew for each row.
TO_THE_END = [
    "seconds_since_hit", "lookforward", "q_vis_compare", "q_hand_final", "q_react_final", "event_distance",
    "until_next", "hm_support", "q_react_split", "q_hand_fire", "q_react_fire", "q_react_cover",
    "q_hand_aim", "q_react_aim", "q_react_grouped",
]


def frames(df) -> set[str]:
    spark, name = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, 1000)
    try:
        return set(re.findall(r"specifiedwindowframe\((\w+, \S+, \S+?)\)[,)]", df._jdf.queryExecution().executedPlan().toString()))
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", TO_THE_END)
def test_no_frame_from_the_row_to_the_end(spark, name):
    found = frames(registry.QUERIES[name](spark, AT))
    assert found and not [f for f in found if "unboundedfollowing" in f and "unboundedpreceding" not in f]


@pytest.mark.parametrize("name", ["q_hand_others", "q_vis_others"])
def test_no_pairs_of_spans(spark, name):
    """Spans are dealt to other players, not to every bucket of the clock they touch."""
    plan = registry.QUERIES[name](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("name", ["future_label", "merge_intervals", "c4_approach"])
def test_frames_only_grow(spark, name):
    """A frame that slides is read anew for each row, so it may only be a row or so wide (lag, lead)."""
    found = [[b.strip("$()") for b in f.split(", ")] for f in frames(registry.QUERIES[name](spark, AT))]
    assert found and not [f for f in found if f[1] != "unboundedpreceding" and not (f[0] == "RowFrame" and f[1] == f[2])]


def test_last_row_within_the_horizon(spark):
    """Ties, gaps, and rows too near, against a loop."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(300), k, rng.choice("xyz")) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, gt long, tick_id long, kind string")
    got = {r.tick_id: r.label for r in windows.future_label(df.withColumn("v", F.struct("tick_id", "kind")), "v", 20, ["key"], least=5).collect()}
    for key, gt, tick, _ in rows:
        ahead = [(g, t, kind) for k, g, t, kind in rows if k == key and gt + 5 <= g <= gt + 20]
        assert (got[tick] and tuple(got[tick])) == (max(ahead)[1:] if ahead else None)
    assert None in got.values()


def test_of_rows_at_one_clock_the_last_tick_counts(spark):
    rows = [(1, 0, 1, 50.0), (1, 10, 2, 90.0), (1, 10, 3, 20.0), (1, 40, 4, None)]
    df = spark.createDataFrame(rows, "key long, gt long, tick_id long, x double")
    got = {r.tick_id: r.approaches for r in events.c4_approach(df, "x", 15, 10, ["key"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: None}
    assert {r.tick_id: r.approaches for r in events.c4_approach(df, "x", 60, 10, ["key"]).collect()} == got  # a row without a distance is passed over


def test_pairs_of_a_full_range_join_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = registry.QUERIES["full_range_join"](spark, AT)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above, joined = [], 0
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-|"))
        above = [(d, node) for d, node in above if d < depth]
        if "Join" in line:
            joined += 1
            assert not [node for _, node in above if "Exchange" in node]
        above.append((depth, line))
    assert joined
