"""Conversation repair against a plain walk over all edits, whole and in pieces."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tickframe.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """rows of (turn, role, text): the values of a conversation, by breadth over (cost, audit, lines)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip("\t\n\x0b\x0c\r ")
        faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    states = {"": (0, "", [])}  # role initials so far, shortened to what matters

    def closed(states, spread):
        for _ in range(3):
            for k, (c, a, ls) in list(states.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    nxt = shorten(k + letter)
                    if nxt is not None:
                        new = (c + 3, a + "I", [*ls, f"{name}:"])
                        if nxt not in states or new[:2] < states[nxt][:2]:
                            states[nxt] = new
        return states

    def shorten(k):
        if not re.fullmatch(r"s?(ua)*u?", k):
            return None
        return "" if k == "" else "s" if k == "s" else "ua" if k.endswith("a") else "u"

    for (_, role, text), fault in zip(rows, faults):
        states, after = closed(states, True), {}
        for k, (c, a, ls) in states.items():
            options = [(k, c + 4, a + "D", ls)]
            if fault not in ("b", "d"):
                extra = 3 if fault == "t" else 0
                options += [(shorten(k + role[:1]) if role else None, c + extra, a + "K", [*ls, f"{role}:{text}"])]
                options += [(shorten(k + x[0]), c + 3 + extra, a + "R", [*ls, f"{x}:{text}"]) for x in ("user", "assistant")]
            for nxt, *new in options:
                if nxt is not None and (nxt not in after or tuple(new[:2]) < after[nxt][:2]):
                    after[nxt] = tuple(new)
        states = after
    states = closed(states, True)
    cost, audit, lines = min((v for k, v in states.items() if k in ("", "ua")), key=lambda v: v[:2])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def some_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["yes.", "no", "well!", "", "  \n", "what? ", "so . x", None, "Ünïcode.", "long " * 300 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.7 else rng.choice(roles)
            rows += [(c if c else None, t * rng.choice([1, 1, 2]) if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.6 else f"t{t}.")] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


def compare(found, rows):
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(row)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert got == {c: plain(own) for c, own in by.items()}


@pytest.mark.parametrize("how", [{}, {"turns": 4, "most_rows": 3}, {"turns": 2, "most_rows": 100}, {"turns": 1000, "most_rows": 1}])
def test_repair(spark, how):
    rows = some_rows(5, 60, 14)
    compare(repair.repair(spark.createDataFrame(rows, ROWS).repartition(3), **how), rows)


def test_cheapest_is_the_whole_of_its_parts():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice("suatx"), rng.random() < 0.2, rng.choice([0, 0, 3])) for _ in range(rng.randrange(0, 12))]
        k = rng.randrange(0, len(rows) + 1)
        halves = []
        for mid in range(4):
            a, b = repair.cheapest(rows[:k], 0, (mid,), False), repair.cheapest(rows[k:], mid)
            if a and b:
                halves.append((a[0] + b[0], a[1] + b[1]))
        assert min(halves) == repair.cheapest(rows)


def test_long_conversation_and_ids_without_rows(spark):
    rng = random.Random(4)
    rows = [("long", t, rng.choice(["user", "assistant"]), f"text {t % 500}" + rng.choice([".", ""])) for t in range(1500)]
    rows += [(f"c{k % 50}", k, "user", "hm.") for k in range(200)]
    df = spark.createDataFrame(rows, ROWS.replace("conv_id long", "conv_id string")).withColumn("stretch", F.lit(1)).withColumn("later", F.lit("x"))
    ids = spark.createDataFrame([("long",), ("none",)] + [(f"c{k}",) for k in range(50)], "conv_id string")
    out = repair.repair(df, ids)
    none = out.where("conv_id = 'none'").first()
    assert tuple(none)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    compare(out.where("conv_id <> 'none'"), rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], ROWS)
    assert repair.repair(none).count() == 0
    assert repair.repair(repair.damage(none), none).count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("assistant", "a. b!"), (None, None))]
    want = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if h:
            x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
            want += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    assert sorted(map(repr, map(tuple, repair.damage(spark.createDataFrame(rows, ROWS)).collect()))) == sorted(map(repr, want))
