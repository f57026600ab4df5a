"""A game's rows are walked as tuples, a slice at a time: the same results for any slice, and no frame a tick."""

import random

import pandas as pd
import pytest

from tickframe.streaming import games


class Kept:
    """A map or value state in memory."""

    def __init__(self):
        self.rows, self.value = {}, None

    def iterator(self):
        return iter(list(self.rows.items()))

    def keys(self):
        return iter(list(self.rows))

    def removeKey(self, key):
        del self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getMapState(self, *_):
        return Kept()

    def getValueState(self, *_):
        return Kept()

    def registerTimer(self, at):
        pass

    def deleteTimer(self, at):
        pass


class Timers:
    def getCurrentWatermarkInMs(self):
        return 0


def rows(n):
    rng = random.Random(4)
    out = []
    for k in range(n):
        gt = k // 3 * 2 + (500 if k > n // 2 else 0)
        for player in rng.sample(range(6), rng.choice([1, 1, 2])):
            out.append(dict(game=1, player=player, tick_id=k, gt=gt, alive=rng.random() < 0.9, reset=k % 40 == 39, fired=rng.random() < 0.3, wants=rng.random() < 0.4, recoil=float(rng.randrange(3)), reloading=rng.random() < 0.2,
                            victims=[3, 1, 3] if rng.random() < 0.2 else None, x=rng.random(), y=rng.random(), view=rng.random() * 360, target=rng.choice([None, 1, 2, 3]), ms=gt * 1000))
    return pd.DataFrame(out)


def walk(state, batches):
    state.init(Handle())
    return [r for b in batches for frame in state.handleInputRows((1,), iter([b.iloc[::2], b.iloc[1::2]]), Timers()) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)]


@pytest.mark.parametrize("make", [lambda: games.FireState(60, 1000, 1000, 0.5), lambda: games.AimState(60, 1000, 3)])
def test_walk_by_slices(monkeypatch, make):
    def no(*_, **__):
        raise AssertionError("a frame a tick")

    monkeypatch.setattr(pd.DataFrame, "groupby", no)
    df = rows(400)
    whole = walk(make(), [df])
    assert len(whole) > 200
    assert walk(make(), [df[df.tick_id < 150], df[df.tick_id >= 150]]) == whole
    monkeypatch.setattr(games, "_SLICE", 7)
    assert walk(make(), [df]) == whole
    if isinstance(make(), games.FireState):
        assert whole[-1][-1] > 0 and {r[-2] for r in whole} >= {1, 5}  # players were forgotten, and known


@pytest.mark.parametrize("forget, reset", [(86_400, 0), (86_400, 50), (60, 0)], ids=["st_fire", "st_reset", "st_evict"])
def test_fire_knows_and_forgets(monkeypatch, forget, reset):
    """How many players are known and forgotten, against a loop that looks at all of them at each row."""
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    df = rows(300).assign(reset=lambda d: d.tick_id % reset == 0 if reset else False)
    want, last, gone, tick = [], {}, 0, None
    for r in df.sort_values(["gt", "tick_id", "player"]).to_dict("records"):
        if r["tick_id"] != tick and r["reset"]:
            last = {}
        tick, old = r["tick_id"], [p for p, at in last.items() if at < r["gt"] - forget]
        gone += len(old)
        last = {p: at for p, at in last.items() if p not in old} | {r["player"]: r["gt"]}
        want.append((r["player"], tick, len(last), gone))
    assert [(g[1], g[2], g[-2], g[-1]) for g in walk(games.FireState(forget, 1000, 1000, 0.5), [df])] == want
    assert (gone > 0) == (forget == 60)
