"""Nearest events of few keys with many rows: whole keys, dealt by ranges, against plain loops and SQL on odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickframe.operators import windows
from tickframe.plans import registry
from tickframe.plans.domain import Tables

AT = "/root/testdata/sf0.001"


@pytest.fixture
def ranges(spark):
    """Small ranges stay as they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, False)
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of events with null players, a null clock and events there twice, over two days."""
    at = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(5)
    rows = [(k, 3000 * k, rng.choice([1, 2, 13, None]), rng.choice(["click", "click", "error", "view"])) for k in range(55)]
    rows += [rows[7], rows[8], rows[30], (55, None, 1, "click"), (56, None, 2, "error"), (None, 90000, 1, "click"), (None, 7, 1, "view")]
    c = duckdb.connect()
    c.execute("CREATE TABLE r (id BIGINT, s INT, u BIGINT, kind VARCHAR)")
    c.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", rows)
    c.execute(f"""COPY (SELECT id AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, u AS user_id, kind AS event_type, 1.5 AS value, '{{"k": 7}}' AS props FROM r) TO '{at}/events.parquet'""")
    return at


@pytest.mark.parametrize("ahead", [False, True])
def test_last_seen(spark, ranges, ahead):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), k // 3, k, rng.choice([None] * 30 + [k]), rng.choice([None] * 400 + ["a", "b"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, at long, id long, v long, w string").repartition(5)
    out = windows.last_seen(df, ["key"], ["at", "id"], {"v2": F.col("v") * 2, "w2": F.col("w")}, ahead)
    want, seen = {}, {}
    for key, _, k, v, w in reversed(rows) if ahead else rows:
        old = seen.get(key, (None, None))
        want[k] = seen[key] = (old[0] if v is None else 2 * v, old[1] if w is None else w)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert {r.id: (r.v2, r.w2) for r in got} == want and len(got) == len(rows)
    assert len({r.task for r in got if r.key == 1}) > 1  # no task holds the key
    assert out.columns == [*df.columns, "v2", "w2"]
    assert windows.last_seen(df.limit(0), ["key"], ["at", "id"], {"v2": F.col("v")}, ahead).count() == 0


def loops(rows, ahead):
    """What the nearest click is at or before each row, or at or after it, whatever its round."""
    return sorted((r.tick_id, r.player, (min if ahead else max)([f.tick_id for f in rows if f.player == r.player and f.kind == "click" and (f.tick_id >= r.tick_id if ahead else f.tick_id <= r.tick_id)], default=-1)) for r in rows)


@pytest.mark.parametrize("name", ["asof_prev", "asof_next"])
def test_nearest_event_of_any_round(spark, name):
    rows = Tables(spark, AT).pat.select("tick_id", "round_id", "player", "kind").collect()
    got = sorted((r[0], r[1], -1 if r[2] is None else r[2]) for r in registry.QUERIES[name](spark, AT).select("tick_id", "player", name.split("_")[1] + "_fire").collect())
    rounds = {r.tick_id: r.round_id for r in rows}
    assert got == loops(rows, name == "asof_next")
    assert sum(rounds[tick] != rounds.get(near) for tick, _, near in got if near >= 0) > 400  # an earlier day's, or a later one's


def test_counters_go_over_rounds(spark):
    rows = sorted(Tables(spark, AT).pat.select("gt", "tick_id", "round_id", "player", "kind").collect())
    want, at, began, over = {}, {}, {}, 0
    for r in rows:
        at[r.player, r.kind] = r.gt
        since = [None if (r.player, kind) not in at else r.gt - at[r.player, kind] for kind in ("error", "click")]
        began.setdefault(r.round_id, r.gt)
        want[r.tick_id] = tuple(since)
        over += sum(s is not None and r.gt - s < began[r.round_id] for s in since)
    assert {r.tick_id: (r.since_hurt, r.since_fire) for r in registry.QUERIES["tick_counters"](spark, AT).collect()} == want and over > 900


@pytest.mark.parametrize("name", ["asof_prev", "asof_next", "tick_counters"])
def test_odd_events(spark, ranges, odd, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet'")
    c.execute(f"CREATE VIEW nation AS SELECT * FROM '{AT}/nation.parquet'")
    out = registry.QUERIES[name](spark, odd)
    want = c.execute(f"SELECT {', '.join(out.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
