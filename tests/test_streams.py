"""State of live games over several batches, against loops over all rows."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tickframe.streaming import games, state

START = datetime.datetime(2024, 1, 1)
ROWS = "game long, player long, tick_id long, gt long, alive boolean, reset boolean, fired boolean, wants boolean, recoil double, reloading boolean, victims array<long>, x double, y double, view double, target long, ts timestamp"


def some_rows(seed, ticks=60):
    rng = random.Random(seed)
    rows = []
    for k in range(ticks):
        gt = 10 * k + (3000 if k > 40 else 0)  # a long pause
        for game in (1, 2):
            for p in range(4):
                if rng.random() < (0.15 if p == 3 else 0.9):  # one who is seldom there
                    rows.append(
                        (game, p, k, gt, rng.random() < 0.9, game == 1 and p == 0 and rng.random() < 0.08, rng.random() < 0.3, rng.random() < 0.3, float(rng.choice([0, 1, 1, 2])), rng.random() < 0.1,
                         [9, 8, 9] if rng.random() < 0.2 else None, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(0, 360), rng.choice([1, 1, 2, None]), START + datetime.timedelta(seconds=gt))
                    )
    return rows


def by_tick(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[2], r[1])):
        out.setdefault((r[0], r[2]), []).append(r)
    return out


def plain_fire(rows, cap, forget):
    found, known, evicted = {}, {}, {}
    for (game, _), tick in by_tick(rows).items():
        mine = known.setdefault(game, {})
        if any(r[5] for r in tick):
            mine.clear()
        gone = [p for p, v in mine.items() if v["gt"] < tick[0][3] - forget]
        evicted[game] = evicted.get(game, 0) + len(gone)
        for p in gone:
            del mine[p]
        for _, p, t, gt, alive, _, fired, wants, recoil, reloading, victims, *_ in tick:
            old = mine.get(p)
            new = {"gt": gt, "fire": cap, "hold": cap, "held": False, "recoil": recoil, "shots": (old["shots"] if old else 0) + fired}
            struck = []
            if old and alive:
                new["fire"] = 0 if fired else min(cap, old["fire"] + 1)
                new["hold"] = 0 if wants else min(cap, old["hold"] + 1)
                new["held"] = not reloading and recoil > 0.5 and (recoil > old["recoil"] or (recoil == old["recoil"] and old["held"]))
                struck = sorted(set(victims or []))
            mine[p] = new
            found[game, p, t] = (new["fire"], new["hold"], new["held"], new["shots"], bool(struck), struck, len(mine), evicted[game])
    return found


def plain_aim(rows, back, forget):
    found, known = {}, {}
    for (game, _), tick in by_tick(rows).items():
        mine = known.setdefault(game, {})
        if any(r[5] for r in tick):
            mine.clear()
        for p in [p for p, v in mine.items() if v["gt"] < tick[0][3] - forget]:
            del mine[p]
        for _, p, _, gt, alive, *_, x, y, _, _, _ in tick:
            v = mine.setdefault(p, {"at": None, "speed": 0.0, "turns": [], "target": None})
            v["gt"], v["alive"] = gt, alive
            if alive:
                v["speed"] = math.dist((x, y), v["at"][:2]) / (gt - v["at"][2]) if v["at"] and gt > v["at"][2] else 0.0
                v["at"] = (x, y, gt)
            else:
                v["speed"] = 0.0
        for _, p, t, gt, alive, *_, x, y, view, target, _ in tick:
            v, them = mine[p], mine.get(target)
            if not alive or them is None or them["at"] is None:
                v["target"], v["turns"] = None, []
                continue
            turn = (view - math.degrees(math.atan2(them["at"][1] - y, them["at"][0] - x)) + 180) % 360 - 180
            v["turns"] = [*(v["turns"] if v["target"] == target else []), turn]
            v["target"] = target
            turns = v["turns"]
            found[game, p, t] = (target, math.dist((x, y), them["at"][:2]), turn, turn - turns[0], turn - turns[-1 - back] if len(turns) > back else None, them["alive"], them["speed"])
    return found


def replayed(spark, tmp_path, rows, batches, op, name):
    src = tmp_path / f"src-{name}"
    cut = sorted({r[2] for r in rows})
    for b in range(batches):
        mine = set(cut[b * len(cut) // batches : (b + 1) * len(cut) // batches])
        spark.createDataFrame([r for r in rows if r[2] in mine], ROWS).coalesce(1).write.parquet(f"{src}/b{b}")
    out = state.replay(spark, f"{src}/b*", op, f"{tmp_path}/out-{name}", f"{tmp_path}/ledger-{name}", maxFilesPerTrigger=1)
    return {(r.game, r.player, r.tick_id): tuple(r)[4:] for r in out.collect()}


@pytest.mark.parametrize("batches", [1, 5])
@pytest.mark.parametrize("forget", [100, 100_000])
def test_fire_state(spark, tmp_path, batches, forget):
    rows = some_rows(1)
    got = replayed(spark, tmp_path, rows, batches, lambda s: games.fire_state(s, cap=7, forget=forget, late="1 second"), "fire")
    want = plain_fire(rows, 7, forget)
    assert got == want
    assert (max(v[-1] for v in want.values()) > 0) == (forget == 100) and {v[0] for v in want.values()} >= {0, 7}


def test_a_reset_clears_the_whole_game(spark, tmp_path):
    row = lambda game, p, k, reset=False: (game, p, k, k, True, reset, True, True, 1.0, False, None, 0.0, 0.0, 0.0, None, START + datetime.timedelta(seconds=k))
    rows = [row(g, p, k, (g, p, k) == (1, 0, 4)) for k in range(6) for g in (1, 2) for p in (0, 1)]
    got = replayed(spark, tmp_path, rows, 3, lambda s: games.fire_state(s, late="1 second"), "reset")
    assert [got[1, 1, k][3] for k in range(6)] == [1, 2, 3, 4, 1, 2] and [got[2, 1, k][3] for k in range(6)] == [1, 2, 3, 4, 5, 6]
    assert got[1, 1, 4][0] == 1000 and got[1, 1, 5][0] == 0


@pytest.mark.parametrize("batches", [1, 4])
def test_aim_state(spark, tmp_path, batches):
    rows = some_rows(3)
    got = replayed(spark, tmp_path, rows, batches, lambda s: games.aim_state(s, back=2, forget=200, late="1 second"), "aim")
    want = plain_aim(rows, 2, 200)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    assert any(not v[5] for v in want.values()) and any(v[4] is not None for v in want.values())


def test_silent_games_are_forgotten_by_a_timer(spark, tmp_path):
    row = lambda game, k: (game, 0, k, k, True, False, True, True, 1.0, False, None, 0.0, 0.0, 0.0, None, START + datetime.timedelta(seconds=k))
    rows = [row(1, 0)] + [row(2, k) for k in (1, 50, 90, 130, 170)] + [row(1, 175)]
    for forget, shots in ((100, 1), (10_000, 2)):
        got = replayed(spark, tmp_path, rows, 7, lambda s, f=forget: games.fire_state(s, forget=f, late="1 second"), f"timer-{forget}")
        assert got[1, 0, 175][3] == shots and got[1, 0, 175][-1] == (forget == 100) and got[2, 0, 170][3] == 5


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none")
    out = state.replay(spark, f"{tmp_path}/none", games.fire_state, f"{tmp_path}/out", f"{tmp_path}/ledger")
    assert out.agg(F.count(F.lit(1))).first()[0] == 0
