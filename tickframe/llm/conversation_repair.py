"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation is sound if the initials of its roles read `(s?(ua)+)?`: perhaps a system turn, then user and assistant
in turns. A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated
(its last character that is no white space isn't one of .!?). Edits: Keep costs 0; Rerole to user or assistant 3; Delete
4, required for blank and duplicate rows; Insert an empty user or assistant row anywhere 3; a truncated row that stays
adds 3. Of the cheapest edits, those whose initials (the audit) are ASCII-least are made.

The lattice has a node for each row boundary and state of the pattern. `cheapest` grows one heap from the start and one
from the ends, each label holding its cost and least audit, finishes every crossing of the least cost, and takes the
least audit put together from both halves.

Rows are dealt by conversation and stretch of `turns` turn numbers, and cut after `most_rows` rows, so neither a
conversation nor a turn is held whole. A conversation that is one piece, as nearly all are, is settled there. The others
are joined from pieces: each piece gives the cheapest edits from every state to every state (`_tables`); a chain over the
pieces of a conversation (16 costs and audits a piece, back pointers kept) picks the states at the cuts (`_chain`); the
rows are edited piece by piece (`_replay`); and the digest runs over the edited pieces in order (`_digest`). No piece but
the end inserts after its last row, so no set of edits is counted twice and an audit is never the beginning of another.

Null roles and texts count as one space: a blank row, or a role that can't be kept. A null conv_id is a conversation of
its own, null turns come first and gaps leave them out. Rows of one turn go by role, then text; equal rows are duplicates
of the first. A role without a character can't be kept. Ids may be of any type, turns are whole numbers. Other columns
are not read. No rows give an empty result, and ids without rows the values of an empty conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WS, keep

# States of the pattern: nothing yet, after system, after user, after assistant.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
CLOSING = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}  # inserts that end a conversation: cost, audit
NAMES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
_FAR = 1 << 60

Row = tuple[str, bool, int]  # initial of the role, must go, what it costs to stay


def cheapest(rows: list[Row], start: int = 0, ends: tuple[int, ...] = ENDS, insert_last: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from a state before the rows to one of `ends` after them."""
    n = len(rows)
    size = 4 * (n + 1)

    def forward(v: int) -> Iterator[tuple[int, int, str]]:
        i, p = divmod(v, 4)
        if i < n or insert_last:
            for c, q in STEP[p].items():
                if c != "s":
                    yield 4 * i + q, INSERT, "I"
        if i < n:
            initial, must_go, extra = rows[i]
            yield v + 4, DELETE, "D"
            if not must_go:
                for c, q in STEP[p].items():
                    if c == initial:
                        yield 4 * (i + 1) + q, extra, "K"
                    if c != "s":
                        yield 4 * (i + 1) + q, REROLE + extra, "R"

    def backward(v: int) -> Iterator[tuple[int, int, str]]:
        i, q = divmod(v, 4)
        into = [(p, c) for p in range(4) for c, to in STEP[p].items() if to == q]
        if i < n or insert_last:
            for p, c in into:
                if c != "s":
                    yield 4 * i + p, INSERT, "I"
        if i:
            initial, must_go, extra = rows[i - 1]
            yield v - 4, DELETE, "D"
            if not must_go:
                for p, c in into:
                    if c == initial:
                        yield 4 * (i - 1) + p, extra, "K"
                    if c != "s":
                        yield 4 * (i - 1) + p, REROLE + extra, "R"

    cost = ([_FAR] * size, [_FAR] * size)
    audit = ([""] * size, [""] * size)
    done = (bytearray(size), bytearray(size))
    heaps: tuple[list, list] = ([], [])  # (cost, rows passed, node): edits at no cost all pass a row, so labels are final when taken
    cost[0][start] = 0
    heappush(heaps[0], (0, 0, start))
    for q in ends:
        cost[1][4 * n + q] = 0
        heappush(heaps[1], (0, 0, 4 * n + q))
    best = 0 if start in ends and not n else _FAR
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        mine, other, said, over = cost[side], cost[1 - side], audit[side], done[side]
        at, _, v = heappop(heaps[side])
        if over[v]:
            continue
        over[v] = 1
        for w, more, letter in (backward if side else forward)(v):
            new = at + more
            if over[w] or new > mine[w]:
                continue
            text = letter + said[v] if side else said[v] + letter
            if new < mine[w]:
                mine[w], said[w] = new, text
                heappush(heaps[side], (new, n - w // 4 if side else w // 4, w))
                best = min(best, new + other[w])
            elif text < said[w]:
                said[w] = text
    if best == _FAR:
        return None
    return best, min(audit[0][v] + audit[1][v] for v in range(size) if cost[0][v] + cost[1][v] == best)


def edited(rows: list[tuple[str, str]], audit: str, state: int = 0) -> list[str]:
    """`role:text` of what the audit makes of rows of (role, text), begun in a state."""
    out, left = [], iter(rows)
    for letter in audit:
        if letter == "I":
            role, text = NAMES[next(c for c in STEP[state] if c != "s")], ""
        else:
            role, text = next(left)
            if letter == "D":
                continue
            if letter == "R":
                role = NAMES[next(c for c in STEP[state] if c != "s")]
        state = STEP[state][role[0]]
        out.append(f"{role}:{text}")
    return out


class Piece:
    """Rows of one conversation and stretch that are held together. later: role and text were seen at an earlier turn."""

    def __init__(self, key: tuple, sub: int):
        self.key, self.sub, self.turns, self.rows, self.again = key, sub, [], [], []

    def faults(self) -> list[str]:
        seen, out = set(), []
        for row, again in zip(self.rows, self.again):
            body = row[1].strip(WS)
            out.append("blank" if not body else "duplicate" if again or row in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add(row)
        return out

    def counts(self, faults: list[str]) -> list[int]:
        initials = [role[:1] for role, _ in self.rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return [faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal]

    def lattice(self, faults: list[str]) -> list[Row]:
        return [(role[:1], f in ("blank", "duplicate"), TRUNCATED if f == "truncated" else 0) for (role, _), f in zip(self.rows, faults)]

    def known_turns(self) -> list[int]:
        return sorted({t for t in self.turns if t is not None})


def _pieces(batches: Iterator[pa.RecordBatch], most_rows: int, more: list | None = None) -> Iterator[Piece]:
    """Pieces of rows sorted by conversation, stretch, turn, role and text. more: is set to the row's further columns."""
    piece = last = None
    for batch in batches:
        for conv, stretch, turn, role, text, later, *others in zip(*[c.to_pylist() for c in batch.columns]):
            key = (conv, stretch)
            if piece is None or piece.key != key or len(piece.rows) == most_rows:
                if piece:
                    yield piece
                piece = Piece(key, piece.sub + 1 if piece and piece.key == key else 0)
                if more is not None:
                    more[:] = others
            row = (conv, turn, role, text)
            piece.turns.append(turn)
            piece.rows.append((role, text))
            piece.again.append(later or row == last)
            last = row
    if piece:
        yield piece


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _task(work, shape: T.StructType, *how):
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(work(batches, *how), schema)

    return run


def _whole(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[tuple]:
    """Each piece as if it were its conversation."""
    for p in _pieces(batches, most_rows):
        faults, turns = p.faults(), p.known_turns()
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        cost, audit = cheapest(p.lattice(faults))
        digest = hashlib.sha256("\n".join(edited(p.rows, audit)).encode("utf-8", "surrogatepass")).hexdigest()
        yield p.key[0], gaps, *p.counts(faults), cost, audit, digest


def _tables(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[tuple]:
    """Each piece's counts, its border, and the cheapest edits from each state to each state."""
    for p in _pieces(batches, most_rows):
        faults, turns = p.faults(), p.known_turns()
        found = [cheapest(p.lattice(faults), a, (b,), False) for a in range(4) for b in range(4)]
        border = [p.rows[0][0][:1], p.rows[-1][0][:1]]
        yield p.key[0], p.key[1], p.sub, p.counts(faults), border, turns[:1] + turns[-1:], len(turns), [f and f[0] for f in found], [f and f[1] for f in found]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The states before and after each piece of a conversation; its last piece carries the counts of all."""
    conv = labels = None
    held: list[tuple] = []

    def close() -> Iterator[tuple]:
        q = min(labels, key=lambda s: (labels[s][0] + CLOSING[s][0], labels[s][1], CLOSING[s][1]))
        total, tail = labels[q][0] + CLOSING[q][0], CLOSING[q][1]
        gaps = span[1] - span[0] + 1 - distinct if span else 0
        out = []
        for stretch, sub, back in reversed(held):
            out.append((stretch, sub, back[q], q))
            q = back[q]
        for k, (stretch, sub, a, b) in enumerate(reversed(out)):
            end = k == len(out) - 1
            yield conv, stretch, sub, a, b, *((gaps, *counts, total, tail) if end else (None,) * 7)

    for batch in batches:
        for who, stretch, sub, own, border, turns, n, costs, audits in zip(*[c.to_pylist() for c in batch.columns]):
            if labels is None or who != conv:
                if labels:
                    yield from close()
                conv, labels, held, counts, span, distinct, last = who, {0: (0, 0)}, [], [0, 0, 0, 0], None, 0, None
            # labels: state -> (cost, place of its audit among those of all states). Audits of one length of rows are never
            # beginnings of each other, so they are told apart by the audit before the piece, then by the piece's own.
            found: dict[int, tuple] = {}
            for a, (cost, place) in labels.items():
                for b in range(4):
                    if costs[4 * a + b] is not None:
                        new = (cost + costs[4 * a + b], place, audits[4 * a + b], a)
                        found[b] = min(found.get(b, new), new)
            order = {b: k for k, b in enumerate(sorted(found, key=lambda b: found[b][1:3]))}
            labels = {b: (found[b][0], order[b]) for b in found}
            held.append((stretch, sub, [found[b][3] if b in found else None for b in range(4)]))
            counts = [x + y for x, y in zip(counts, own)]
            counts[3] += last is not None and last + border[0] not in ("su", "ua", "au")
            last = border[1]
            if turns:
                distinct += n - bool(span and span[1] == turns[0])
                span = (span[0] if span else turns[0], turns[-1])
    if labels:
        yield from close()


def _replay(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[tuple]:
    """The edited text of each piece. The further column of a row holds (sub, state before, audit) of its stretch."""
    plan: list = []
    for p in _pieces(batches, most_rows, plan):
        own = plan[0][p.sub] if len(plan[0]) > p.sub else None
        yield *p.key, p.sub, own["audit"], "\n".join(edited(p.rows, own["audit"], own["before"])) or None


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Audit and digest of a conversation from its edited pieces in order, one text held at a time."""
    conv, audits, digest, begun = None, None, None, False
    for batch in batches:
        for who, audit, text in zip(*[c.to_pylist() for c in batch.columns]):
            if audits is None or who != conv:
                if audits is not None:
                    yield conv, "".join(audits), digest.hexdigest()
                conv, audits, digest, begun = who, [], hashlib.sha256(), False
            audits.append(audit)
            if text is not None:
                digest.update((("\n" if begun else "") + text).encode("utf-8", "surrogatepass"))
                begun = True
    if audits is not None:
        yield conv, "".join(audits), digest.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _shape(key: T.DataType, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", key), *T.StructType.fromDDL(columns).fields])


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    order = [F.asc_nulls_first(c) for c in ("conv_id", "stretch", "turn", "role", "text")]
    return rows.select("conv_id", "stretch", "turn", "role", "text", "later", *more).repartition("conv_id", "stretch").sortWithinPartitions(*order)


def _join(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """a joined with b where the keys are the same, nulls too, with a's keys."""
    named = {k: f"{k}_b" for k in keys}
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()])
    return a.join(b.withColumnsRenamed(named), on, how).drop(*named.values())


def _joined(rows: DataFrame, key: T.DataType, most_rows: int) -> DataFrame:
    """Repair of conversations of several pieces."""
    said = F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))
    marked = rows.drop("later").withColumn("said", said)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = marked.groupBy("conv_id", "said").agg(F.count(F.lit(1)).alias("n"), F.min(place)["turn"].alias("first_turn")).where("n > 1")
    later = F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    rows = keep(_join(marked, firsts, "conv_id", "said", how="left").select("conv_id", "stretch", "turn", "role", "text", later.alias("later")), "long-conversations")

    shape = _shape(key, "stretch long, sub int, counts array<long>, border array<string>, turns array<long>, n long, costs array<long>, audits array<string>")
    tables = keep(_dealt(rows).mapInArrow(_task(_tables, shape, most_rows), shape), "repair-tables")
    in_order = [F.asc_nulls_first(c) for c in ("conv_id", "stretch", "sub")]
    shape = _shape(key, "stretch long, sub int, before int, after int, " + ", ".join(f"{c} long" for c in COUNTS) + ", tail string")
    states = keep(tables.repartition("conv_id").sortWithinPartitions(*in_order).mapInArrow(_task(_chain, shape), shape), "repair-states")

    told = _join(states, tables.select("conv_id", "stretch", "sub", "audits"), "conv_id", "stretch", "sub")
    audit = F.concat(F.element_at("audits", 4 * F.col("before") + F.col("after") + 1), F.coalesce("tail", F.lit("")))
    plans = told.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("sub", "before", audit.alias("audit")))).alias("plan"))
    planned = _join(rows, plans, "conv_id", "stretch")
    shape = _shape(key, "stretch long, sub int, audit string, repaired string")
    made = keep(_dealt(planned, "plan").mapInArrow(_task(_replay, shape, most_rows), shape), "repaired-pieces")
    shape = _shape(key, "audit string, repaired_sha256 string")
    digests = made.repartition("conv_id").sortWithinPartitions(*in_order).select("conv_id", "audit", "repaired").mapInArrow(_task(_digest, shape), shape)

    ends = states.where("cost IS NOT NULL").select("conv_id", *COUNTS)
    return _join(ends, digests, "conv_id")


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns: int = 256, most_rows: int = 1024) -> DataFrame:
    """conv_id, gaps (turn numbers missing between the first and last), blank, duplicate, truncated (rows by first fault),
    illegal (neighbours that the pattern doesn't know), cost, audit, repaired_sha256 (of `role:text` lines after the edits).
    ids: a table whose conv_id column names every conversation wanted, also those without rows."""
    key = rows.schema[conv_id].dataType
    at = F.col(turn).cast("long")
    read = rows.select(
        F.col(conv_id).alias("conv_id"), F.floor(at / turns).alias("stretch"), at.alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.lit(False).alias("later")
    )
    shape = _shape(key, ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    whole = keep(_dealt(read).mapInArrow(_task(_whole, shape, most_rows), shape), "repaired")
    several = keep(whole.groupBy("conv_id").count().where("count > 1").select("conv_id"), "long-ids")
    out = _join(whole, several, "conv_id", how="left_anti")
    if not several.isEmpty():
        out = out.unionByName(_joined(_join(read, several, "conv_id", how="left_semi"), key, most_rows))
    if ids is None:
        return out
    every = ids.select(F.col(conv_id).alias("conv_id")).distinct()
    empty = {c: F.lit(0).cast("long") for c in COUNTS} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return _join(every, out, "conv_id", how="left").select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in empty.items()])


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults at fixed places, to try repairs on. Nulls of role and text
    become one space. By crc32 of `conv_id:turn` (a null: one space) modulo 20, a row is dropped (0), loses its text (1) or
    its .!? (2), stands twice (3) or says user (4)."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    how = (F.crc32(name.cast("binary")) % 20).alias("how")
    read = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), how).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))
    return read.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")
