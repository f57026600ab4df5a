"""State of live games, by `transformWithState`: one key a game, a map of its players inside.

A tick is all rows of a game with one tick_id; ticks go by (gt, tick_id). If any row of a tick has the reset flag, the whole
game is forgotten before the tick counts. A player whose last row is more than `forget` clock units before a tick is
forgotten by then; a timer forgets games that fell silent, by event time, of which `unit_ms` are a clock unit. What is forgotten begins anew. A micro-batch
must bring a game's ticks whole and in order; its rows of one game are sorted in memory, then walked as plain tuples, a
slice of them at a time. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FIRE = "game long, player long, tick_id long, gt long, since_fire long, since_hold long, holding boolean, shots long, hit boolean, victims array<long>, known int, evicted long"
AIM = "game long, player long, tick_id long, gt long, target long, far double, turn double, since_first double, change double, target_alive boolean, target_speed double"
_CLOCK = "gt long, ms long, evicted long, timer long"
_SLICE = 20_000  # rows that are tuples at a time, and results a frame


def _tuples(batch: pd.DataFrame, columns: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of a frame as tuples of Python values."""
    for at in range(0, len(batch), _SLICE):
        part = batch.iloc[at : at + _SLICE]
        yield from zip(*(part[c].tolist() for c in columns))


class _Game(StatefulProcessor):
    """Loads a game's players, goes through its ticks, and writes back what changed. Subclasses name the state of a player
    (VALUE, whose first column is the gt of its last row), the columns that they read (ROW) and the result, and step a row."""

    VALUE = "gt long"
    ROW: tuple[str, ...] = ()
    RESULT = ""

    def __init__(self, forget: int, unit_ms: int):
        self.forget, self.unit_ms = forget, unit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.players = handle.getMapState("players", "player long", self.VALUE)
        self.clock = handle.getValueState("clock", _CLOCK)

    def step(self, game: int, row: tuple, known: dict[int, tuple], evicted: int) -> tuple | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        game = key[0]
        known = {k[0]: tuple(v) for k, v in self.players.iterator()}
        before = dict(known)
        _, ms, evicted, timer = self.clock.get() if self.clock.exists() else (0, 0, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["gt", "tick_id", "player"], kind="stable")
        names, out = [c.split()[0] for c in self.RESULT.split(", ")], []
        oldest = min((v[0] for v in known.values()), default=math.inf)  # no player's last row is older
        for (gt, _), tick in groupby(_tuples(batch, ("gt", "tick_id", "reset", *self.ROW)), itemgetter(0, 1)):
            tick = list(tick)
            if any(r[2] for r in tick):
                known.clear()
            if oldest < gt - self.forget:
                for p in [p for p, v in known.items() if v[0] < gt - self.forget]:
                    del known[p]
                    evicted += 1
                oldest = min((v[0] for v in known.values()), default=math.inf)
            oldest = min(oldest, gt)
            self.tick(known, tick)
            for r in tick:
                result = self.step(game, r, known, evicted)
                if result is not None:
                    out.append(result)
            if len(out) >= _SLICE:
                yield pd.DataFrame(out, columns=names)
                out = []
        for p in before.keys() - known.keys():
            self.players.removeKey((p,))
        for p, v in known.items():
            if v != before.get(p):
                self.players.updateValue((p,), v)
        ms = max(ms, int(batch["ms"].max()))
        if timer:
            self.handle.deleteTimer(timer)
        # the watermark is 0 until a batch has ended; a timer before it would go off at once
        timer = max(ms, timerValues.getCurrentWatermarkInMs()) + self.unit_ms * self.forget
        self.handle.registerTimer(timer)
        self.clock.update((int(batch["gt"].max()), ms, evicted, timer))
        yield pd.DataFrame(out, columns=names)

    def tick(self, known: dict[int, tuple], rows: list[tuple]) -> None:
        """What a tick changes before its rows are stepped."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = sum(1 for _ in self.players.keys())
        gt, ms, evicted, _ = self.clock.get()
        self.players.clear()
        self.clock.update((gt, ms, evicted + gone, 0))
        yield pd.DataFrame([], columns=[c.split()[0] for c in self.RESULT.split(", ")])

    def close(self) -> None:
        pass


class FireState(_Game):
    VALUE = "gt long, since_fire long, since_hold long, holding boolean, recoil double, shots long"
    ROW = ("player", "alive", "fired", "wants", "recoil", "reloading", "victims")
    RESULT = FIRE

    def __init__(self, forget: int, unit_ms: int, cap: int, floor: float):
        super().__init__(forget, unit_ms)
        self.cap, self.floor = cap, floor

    def step(self, game: int, row: tuple, known: dict[int, tuple], evicted: int) -> tuple:
        gt, tick_id, _, player, alive, fired, wants, recoil, reloading, struck = row
        prior, cap = known.get(player), self.cap
        shots = (prior[5] if prior else 0) + bool(fired)
        if prior is None or not alive:
            now, victims = (gt, cap, cap, False, recoil, shots), []
        else:
            _, fire, hold, held, was, _ = prior
            held = not reloading and recoil > self.floor and (recoil > was or (recoil == was and held))
            now = (gt, 0 if fired else min(cap, fire + 1), 0 if wants else min(cap, hold + 1), bool(held), recoil, shots)
            victims = sorted({int(v) for v in struck}) if struck is not None else []
        known[player] = now
        return game, player, tick_id, gt, *now[1:4], shots, bool(victims), victims, len(known), evicted


def fire_state(stream: DataFrame, cap: int = 1000, floor: float = 0.5, late: str = "10 minutes", forget: int = 86_400, unit_ms: int = 1000, ts: str = "ts") -> DataFrame:
    """FIRE: per row, ticks since the last shot and the last wish to fire (at most cap, which also stands for none), whether
    the attack is held (recoil rises, or stays while it was held, over the floor and not reloading), shots so far, and whom
    the player hit; how many players the game knows, and how many it has forgotten so far. The first row after a reset or
    after being forgotten, and rows of the dead, are fresh: cap, not held, no victims.
    stream: game, player, tick_id, gt, alive, reset, fired, wants, recoil, reloading, victims (array) and the event time."""
    cols = ["game", "player", "tick_id", "gt", "alive", "reset", "fired", "wants", "recoil", "reloading", "victims"]
    rows = stream.withWatermark(ts, late).select(*cols, ts, F.unix_millis(F.col(ts)).alias("ms"))
    return rows.groupBy("game").transformWithStateInPandas(FireState(forget, unit_ms, cap, floor), FIRE, "Append", "EventTime")


class AimState(_Game):
    VALUE = "gt long, alive boolean, x double, y double, at long, speed double, target long, turns array<double>, first double"
    ROW = ("player", "alive", "x", "y", "view", "target")
    RESULT = AIM

    def __init__(self, forget: int, unit_ms: int, back: int):
        super().__init__(forget, unit_ms)
        self.back = back

    def tick(self, known: dict[int, tuple], rows: list[tuple]) -> None:
        for gt, _, _, player, alive, to_x, to_y, _, _ in rows:
            prior = known.get(player)
            _, _, x, y, at, speed, target, turns, first = prior if prior else (0, False, None, None, None, 0.0, None, [], None)
            if alive:
                speed = math.hypot(to_x - x, to_y - y) / (gt - at) if x is not None and gt > at else 0.0
                x, y, at = to_x, to_y, gt
            known[player] = (gt, bool(alive), x, y, at, speed if alive else 0.0, target, turns, first)

    def step(self, game: int, row: tuple, known: dict[int, tuple], evicted: int) -> tuple | None:
        gt, tick_id, _, player, alive, x, y, view, target = row
        own = known[player]
        target = None if pd.isna(target) else int(target)
        them = known.get(target) if target is not None else None
        if not alive or them is None or them[2] is None:
            known[player] = (*own[:6], None, [], None)
            return None
        turn = (view - math.degrees(math.atan2(them[3] - y, them[2] - x)) + 180) % 360 - 180
        turns, first = (list(own[7]), own[8]) if own[6] == target else ([], turn)
        change = turn - turns[0] if len(turns) == self.back else None
        known[player] = (*own[:6], target, [*turns, turn][-self.back :], first)
        return game, player, tick_id, gt, target, math.hypot(them[2] - x, them[3] - y), turn, turn - first, change, them[1], them[5]


def aim_state(stream: DataFrame, back: int = 3, late: str = "10 minutes", forget: int = 86_400, unit_ms: int = 1000, ts: str = "ts") -> DataFrame:
    """AIM: per row of a living player with a known target: distance and turn (degrees from where the target is to where the
    player looks, -180 to 180), the turn against that of the first row on this target in a row, and against `back` rows
    before (null while there are not as many); whether the target lives, and its speed between its last two rows (0 if
    dead). A dead target stands where it last lived. A row without these, or another target, begins anew.
    stream: game, player, tick_id, gt, alive, reset, x, y, view, target and the event time."""
    cols = ["game", "player", "tick_id", "gt", "alive", "reset", "x", "y", "view", "target"]
    rows = stream.withWatermark(ts, late).select(*cols, ts, F.unix_millis(F.col(ts)).alias("ms"))
    return rows.groupBy("game").transformWithStateInPandas(AimState(forget, unit_ms, back), AIM, "Append", "EventTime")
