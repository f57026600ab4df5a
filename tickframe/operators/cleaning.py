"""Rounds, ticks and raw events put in order before analysis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import stab_join
from .windows import islands, over, running_sum, so_far, whole


def fix_rounds(rounds: DataFrame, start: str = "start", end: str = "end", official: str = "official_end") -> DataFrame:
    """A missing end becomes the start, a missing official end the end."""
    fixed = rounds.withColumn(end, F.coalesce(end, start))
    return fixed.withColumn(official, F.coalesce(official, end))


def filter_rounds(rounds: DataFrame, game: str = "game_id", number: str = "number", strict: bool = True, winner: str = "winner", warmup: str = "warmup", start: str = "start", end: str = "end") -> DataFrame:
    """Strict: without warm-up and unwon rounds; else only without empty ones. Renumbered from 1 within a game."""
    kept = rounds.where(~F.col(warmup) & F.col(winner).isin(2, 3)) if strict else rounds.where(F.col(end) > F.col(start))
    return kept.withColumn(number, F.row_number().over(Window.partitionBy(game).orderBy(start)))


def period_detect(rounds: DataFrame, game: str = "game_id", order: str = "start", ct: str = "ct_wins", t: str = "t_wins", half: int = 15, half_overtime: int = 3) -> DataFrame:
    """The rounds of valid periods, + period (0 regulation, 1.. overtimes) and half (0, 1), by the wins before each round.

    Of each pattern the last match counts, so what a restart plays again goes. With wins counted from the period's begin, a
    first half ends at the last round, after the period before, that makes the half's wins full, and begins at the last
    round before it without wins, or else the first after the period before. A second half ends at the last round with a
    team one win short while the other has fewer, and begins at the last round before it with the half's wins. A game without
    a valid regulation has no row; an overtime without all four is left out, and without the end of its second half it is
    the game's last. A game's rounds are searched as one array, as there are few."""
    most = rounds.agg(F.max(F.greatest(ct, t))).first()[0]
    periods = 1 + max(0, ((most or 0) - half) // half_overtime)  # an overtime ends with half_overtime wins over the begin
    games = rounds.groupBy(game).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(ct).alias("_c"), F.col(t).alias("_w"), F.struct(*rounds.columns).alias("_row")))).alias("_r"))
    games = games.withColumn("_r", F.transform("_r", lambda x, i: x.withField("_i", i + 1))).withColumns({"_last": F.lit(0), "_on": F.lit(True), "_spans": F.array().cast("array<struct<period:int,half:int,a:int,b:int>>")})
    at = lambda rows, test: F.transform(F.filter(rows, test), lambda x: x["_i"])
    for p in range(periods):
        begin, h = (0, half) if p == 0 else (half + (p - 1) * half_overtime, half_overtime)
        c, w = lambda x, n=begin: x["_c"] - n, lambda x, n=begin: x["_w"] - n
        rows, later = F.col("_r"), F.filter("_r", lambda x: x["_i"] > F.col("_last"))
        games = games.withColumns(
            {
                "_fe": F.array_max(at(later, lambda x: c(x) + w(x) + 1 == h)),
                "_se": F.array_max(at(rows, lambda x: ((c(x) == h) | (w(x) == h)) & ((c(x) < h) | (w(x) < h)))),
            }
        ).withColumns(
            {
                "_fs": F.when(F.col("_fe").isNotNull(), F.coalesce(F.array_max(at(later, lambda x: (x["_i"] <= F.col("_fe")) & (c(x) == 0) & (w(x) == 0))), F.array_min(at(later, lambda x: F.lit(True))))),
                "_ss": F.array_max(at(rows, lambda x: (x["_i"] <= F.col("_se")) & (c(x) + w(x) == h))),
            }
        )
        whole = F.col("_on") & F.col("_fs").isNotNull() & F.col("_ss").isNotNull()
        span = lambda k, a, b: F.struct(F.lit(p).alias("period"), F.lit(k).alias("half"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"))  # noqa: B023, E731
        games = games.withColumns(
            {
                "_spans": F.when(whole, F.concat("_spans", F.array(span(0, "_fs", "_fe"), span(1, "_ss", "_se")))).otherwise(F.col("_spans")),
                "_on": whole if p == 0 else F.col("_on") & F.col("_se").isNotNull(),
                "_last": F.coalesce("_se", "_last"),
            }
        )
    spans = games.select("_r", F.explode("_spans").alias("_s"))
    found = spans.select("_s", F.explode(F.filter("_r", lambda x: x["_i"].between(F.col("_s.a"), F.col("_s.b")))).alias("_x"))
    return found.select("_x._row.*", F.col("_s.period").alias("period"), F.col("_s.half").alias("half"))


def tick_to_round(ticks: DataFrame, rounds: DataFrame, tick: str = "tick_id", width: int = 10_000) -> DataFrame:
    """Ticks with the first round (by id) whose span covers them; ticks between rounds have none and go."""
    pairs = stab_join(ticks, rounds.select("round_id", "start", "end"), tick, width=width)
    return pairs.groupBy(*ticks.columns).agg(F.min("round_id").alias("round_id"))


def spotter_fanout(changes: DataFrame, present: DataFrame, keys: Sequence[str], player: str = "player") -> DataFrame:
    """Each change of visibility for every player present at its tick."""
    return changes.join(present.select(*keys, F.col(player).alias("spotter")).distinct(), list(keys))


def pair_begin_end(events: DataFrame, keys: Sequence[str], at: str, kind: str, begin: str = "begin", success: str = "success") -> DataFrame:
    """Begin, abort and success events of a key to intervals: keys, start, end, ok. A success with no begin before it
    makes an interval of its own."""
    w = over(keys, [at])
    fresh = (F.col(kind) == begin) | (F.lag(kind).over(w) != begin)
    marked = islands(events, keys, [at], fresh)
    return marked.groupBy(*keys, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.max(F.col(kind) == success).alias("ok")).drop("island")


def valid_rounds(rounds: DataFrame, game: str, order: str = "start") -> DataFrame:
    """Without a game's first and last round; + plant_index, the ordinal of what is left."""
    up, down = Window.partitionBy(game).orderBy(order), Window.partitionBy(game).orderBy(F.col(order).desc())
    inner = rounds.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)}).where("_u > 1 AND _d > 1")
    return inner.withColumn("plant_index", F.col("_u") - 2).drop("_u", "_d")


def parse_say(say: DataFrame, message: str = "message", keys: Sequence[str] = ("game_id",), order: str = "tick_id") -> DataFrame:
    """Messages `test,<name>,<index>,<total>` and `finish,<name>`: a test's row with whether the next message of its
    game is its finish."""
    p = F.split(message, ",")
    rows = say.withColumns({"what": F.get(p, 0), "test": F.get(p, 1), "idx": F.expr("try_cast(get(split({0}, ','), 2) AS INT)".format(message)), "total": F.expr("try_cast(get(split({0}, ','), 3) AS INT)".format(message))})
    w = over(keys, [order])
    done = (F.lead("what").over(w) == "finish") & (F.lead("test").over(w) == F.col("test"))
    return rows.withColumn("done", F.coalesce(done, F.lit(False))).where("what = 'test'").drop("what", message)


def prefix_labels(df: DataFrame, column: str, prefixes: Sequence[tuple[str, str, str]], other: tuple[str, str] = ("unknown", "unknown")) -> DataFrame:
    """+ ct_type, t_type by the first prefix (prefix, ct, t) that fits."""
    ct, t = F.lit(other[0]), F.lit(other[1])
    for p, a, b in reversed(prefixes):
        fits = F.startswith(F.col(column), F.lit(p))
        ct, t = F.when(fits, a).otherwise(ct), F.when(fits, b).otherwise(t)
    return df.withColumns({"ct_type": ct, "t_type": t})


def decimate(df: DataFrame, n: int = 8, tick: str = "tick_id", keys: Sequence[str] = ("round_id",)) -> DataFrame:
    """Every nth tick, by id; + row, numbered anew within the keys."""
    return df.where(F.pmod(F.col(tick), F.lit(n)) == 0).withColumn("row", F.row_number().over(over(keys, [tick])))


def nth_from_start(df: DataFrame, n: int, tick: str = "tick_id", keys: Sequence[str] = ("round_id",)) -> DataFrame:
    """Every nth tick counted from the key's first."""
    return df.withColumn("_0", F.min(tick).over(whole(keys))).where(F.pmod(F.col(tick) - F.col("_0"), F.lit(n)) == 0).drop("_0")


def valid_tick_mask(flags: DataFrame, needs: Sequence[str], bars: Sequence[str]) -> DataFrame:
    """+ valid: all of needs and none of bars."""
    ok = F.lit(True)
    for c in needs:
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    for c in bars:
        ok = ok & ~F.coalesce(F.col(c), F.lit(False))
    return flags.withColumn("valid", ok)


def sync_ticks(ticks: DataFrame, step: int, keys: Sequence[str] = ("round_id",), clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """Greedy sample: a key's first tick, then always the next one at least step clock units after the last taken.
    What is taken hangs on what was, so a key's (clock, tick) pairs are walked in order, in batches."""
    names = [*keys, clock, tick]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            take = []
            for *k, at, _ in batch.itertuples(index=False):
                if k != key or at - last >= step:
                    take.append(True)
                    key, last = k, at
                else:
                    take.append(False)
            yield batch[take]

    few = ticks.select(*names)
    taken = few.repartition(*keys).sortWithinPartitions(*names).mapInPandas(walk, few.schema)
    return ticks.join(taken.select(tick), tick, "left_semi")


def sync_buckets(ticks: DataFrame, step: int, keys: Sequence[str] = ("round_id",), clock: str = "gt", tick: str = "tick_id") -> DataFrame:
    """The first tick of every step clock units since the key's first."""
    at = F.floor((F.col(clock) - F.min(clock).over(whole(keys))) / step)
    cut = ticks.withColumn("_b", at)
    return cut.withColumn("_n", F.row_number().over(over([*keys, "_b"], [clock, tick]))).where("_n = 1").drop("_b", "_n")


def seq_index(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A row per sequence: keys, min, max, length, and seq_id in order of first appearance within the first key."""
    rows = df.groupBy(*keys).agg(F.min(order).alias("min"), F.max(order).alias("max"), F.count(F.lit(1)).alias("length"))
    return rows.withColumn("seq_id", F.row_number().over(Window.partitionBy(keys[0]).orderBy("min", *keys[1:])))


def round_lengths(df: DataFrame, pad: int = 1, round_id: str = "round_id", tick: str = "tick_id", slot: str = "player", alive: str = "alive") -> DataFrame:
    """Per round: n, min, max, n padded to a multiple, and the smallest slot alive at its last tick (null if none)."""
    at = F.when(F.col(alive), F.col(slot))
    return df.groupBy(round_id).agg(F.count(F.lit(1)).alias("n"), F.min(tick).alias("min"), F.max(tick).alias("max"), F.max_by(at, tick).alias("last_alive")).withColumn("padded", (F.ceil(F.col("n") / pad) * pad).cast("long"))


def remix_setups(defence: DataFrame, offence: DataFrame, site: str, id_column: str, columns: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Each defence row with one offence row of its site, both in the order of a hash of their ids and dealt round: site,
    def_id, off_id, and of the columns off_<name>, the offence's values that take the place of the defence's own.

    Rows are numbered along ranges of that order, so a site isn't sorted in one task; a site without offence has no row."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), F.col(id_column).cast("string")).cast("binary"))
        kept = [F.col(c).alias(f"off_{c}") for c in columns] if name == "off_id" else []
        placed = running_sum(df.select(site, F.col(id_column).alias(name), *kept, key.alias("_key")), [site, "_key", name], F.lit(1), "_at")
        starts = placed.groupBy(site).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
        return placed.join(starts, site).withColumn(f"{name}_at", F.col("_at") - F.col("_from")).drop("_key", "_at", "_from")

    d, o = ranked(defence, "def_id").drop("_n"), ranked(offence, "off_id")
    dealt = d.join(o.select(site, "_n").distinct(), site).withColumn("off_id_at", F.pmod("def_id_at", "_n"))
    return dealt.join(o.drop("_n"), [site, "off_id_at"]).select(site, "def_id", "off_id", *[f"off_{c}" for c in columns])


def slot_assign(df: DataFrame, slots: int = 5, keys: Sequence[str] = ("round_id", "team"), player: str = "player", tick: str = "tick_id") -> DataFrame:
    """Slots by first appearance within a round and team, where nobody leaves; players beyond the slots go."""
    first = df.groupBy(*keys, player).agg(F.min(tick).alias("_f"))
    slot = first.withColumn("slot", F.row_number().over(over(keys, ["_f", player])) - 1).where(F.col("slot") < slots).drop("_f")
    return df.join(slot, [*keys, player])


def slot_reuse(df: DataFrame, slots: int = 5, keys: Sequence[str] = ("round_id", "team"), player: str = "player", tick: str = "tick_id") -> DataFrame:
    """Slots tick by tick: a player keeps its slot while present, a slot is free again when its player is missing from a
    tick, newcomers take the lowest free one in player order, and players beyond the slots have none. What is free
    hangs on the ticks before, so a team's rows are walked in order; the state is one slot table."""
    names = [*keys, tick, player]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        team, at, held, present = None, None, {}, []

        def close() -> list[tuple]:
            nonlocal held
            held = {p: s for p, s in held.items() if p in present}
            for p in present:
                if p not in held and (free := sorted(set(range(slots)) - set(held.values()))):
                    held[p] = free[0]
            return [(*team, at, p, held[p]) for p in present if p in held]

        for batch in batches:
            out = []
            for *k, t, p in batch.itertuples(index=False):
                if (k, t) != (team, at):
                    if present:
                        out += close()
                    if k != team:
                        held = {}
                    team, at, present = k, t, []
                present.append(p)
            yield pd.DataFrame(out, columns=[*names, "slot"])
        if present:
            yield pd.DataFrame(close(), columns=[*names, "slot"])

    few = df.select(*names).distinct()
    dealt = few.repartition(*keys).sortWithinPartitions(*names)
    return df.join(dealt.mapInPandas(walk, T.StructType([*few.schema, T.StructField("slot", T.IntegerType())])), names)


def assign_ids(df: DataFrame, group: str, order: Sequence[str], offset: int = 0) -> DataFrame:
    """+ id, dense from offset: groups in order, rows of a group by `order`. Groups are counted first and their counts
    summed along ranges of groups, so the rows stay dealt out."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    before = running_sum(counts, [group], F.col("_n"), "_before")
    ranked = df.withColumn("_r", F.row_number().over(over([group], order)) - 1)
    return ranked.join(before.drop("_n"), group).withColumn("id", F.col("_before") + F.col("_r") + offset).drop("_before", "_r")


def fk_check(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose key has no parent (null keys have none to miss)."""
    ids = parent.select(F.col(pk).alias("_pk"))
    return child.where(F.col(fk).isNotNull()).join(ids, F.col(fk) == F.col("_pk"), "left_anti")


def tables_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(column, n_diff) over rows of equal keys, and (`<rows>`, rows of one side alone)."""
    rest = [c for c in a.columns if c not in keys]
    x, y = a.alias("x"), b.alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    both = x.withColumn("_x", F.lit(1)).join(y.withColumn("_y", F.lit(1)), on, "full")
    alone = F.col("_x").isNull() | F.col("_y").isNull()
    diffs = both.agg(F.count_if(alone).alias("<rows>"), *[F.count_if(~alone & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(c) for c in rest])
    return diffs.unpivot([], ["<rows>", *rest], "column", "n_diff")


def flatten(df: DataFrame, vectors: dict[str, Sequence[str]], enums: dict[str, dict[int, str]] | None = None) -> DataFrame:
    """Structs to columns `name x`, enum codes to names, for export."""
    out = df.withColumns({f"{v} {p}": F.col(f"{v}.{p}") for v, parts in vectors.items() for p in parts}).drop(*vectors)
    for column, names in (enums or {}).items():
        out = out.withColumn(column, F.coalesce(*[F.when(F.col(column) == k, F.lit(n)) for k, n in names.items()], F.lit("INVALID")))
    return out


def running_flags(df: DataFrame, flags: dict[str, Column], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """+ each flag as 'has happened by now' within the key."""
    return df.withColumns({n: F.coalesce(F.max(f).over(so_far(keys, order)), F.lit(False)) for n, f in flags.items()})
