"""PPM code lengths against a plain tree of dictionaries, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickframe.llm import language_id

DOCS = "doc_id long, text string, lang string, source string"


def plain_tree(texts, order):
    tree = defaultdict(Counter)
    for t in texts:
        data = b"\n" * order + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                tree[data[i - k : i]][data[i]] += 1
    return tree


def share(tree, context, byte, order):
    """Probability of the byte as a fraction, by method C with exclusion."""
    p, out = Fraction(1), set()
    for k in range(order, -1, -1):
        own = tree.get(context[len(context) - k :] if k else b"")
        if own is None:
            continue
        left = {b: n for b, n in own.items() if b not in out}
        n, d = sum(left.values()), len(left)
        if byte in left:
            return p * Fraction(left[byte], n + d)
        if d:
            p *= Fraction(d, n + d)
        out |= set(own)
    return p * Fraction(1, 256 - len(out))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths(order, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", 1)  # slices of the least size
    rng = random.Random(order)
    langs = {"a": "abcde ", "b": "bcdéf ", "c": "xyz"}
    texts = {l: ["".join(rng.choices(cs, k=rng.randrange(0, 200))) for _ in range(20)] for l, cs in langs.items()}
    trees, plains = [], []
    for l in langs:
        data = [np.frombuffer(b"\n" * order + t.encode(), np.uint8) for t in texts[l]]
        known, n = np.unique(np.concatenate([language_id.grams(d, order) for d in data]), return_counts=True)
        trees.append(language_id.Tree(known, n, order))
        plains.append(plain_tree(texts[l], order))
    model = language_id.Model(list(langs), trees, order)
    asked = ["abc", "", "bcdé é", "xyzzy abq \U0001f600", None, "".join(rng.choices("abcxyé ", k=9000)), "a"]
    found = model.code_lengths(pa.array([t if t is None else t.encode() for t in asked], pa.binary()))
    for t, got in zip(asked, found):
        data = b"\n" * order + (t or "").encode()
        for tree, bits in zip(plains, got):
            want = [-math.log2(share(tree, data[i - order : i], data[i], order)) for i in range(order, len(data))]
            assert abs(bits / language_id.UNIT - sum(want)) <= len(want) / language_id.UNIT
    ctx = b"abcd"[:order]
    for tree in plains:
        assert sum(share(tree, ctx, b, order) for b in range(256)) == 1


def rows(n=400, seed=3):
    rng = random.Random(seed)
    parts = {"en": ["the ", "and ", "ing ", "th", "er", "on ", "re", "wh"], "de": ["der ", "und ", "sch", "ung ", "ei", "en ", "ü"], "el": ["και ", "το ", "ος ", "αν", "ει", "ρ"]}
    out = []
    for i in range(n):
        l = rng.choice(list(parts))
        out.append((i, "".join(rng.choices(parts[l], k=rng.randrange(20, 80))), l, f"s{i % 3}"))
    odd = [(n, None, "en", None), (n + 1, "", "de", None), (n + 2, "12 34 ...", "en", None), (n + 3, "the and " * 50_000, None, None), (None, "und der ", "de", None), (5, out[5][1], "en", None), (5, out[5][1], "en", None)]
    return out + odd


def test_held_out(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(7)).repartition(4)
    got = language_id.evaluate(df, sample_rows=60).collect()
    assert len(got) == len(data)
    langs = {(i, l) for i, _, l, _ in data}
    right = Counter()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and r.doc_id < 400 and r.doc_id != 5:
            right[(r.doc_id, r.lang_pred) in langs] += 1
    assert right[True] > 100 and right[False] == 0
    by = {r.doc_id: r for r in got}
    assert [by[400 + k].lang_pred for k in range(4)] == ["und", "und", "und", "en"] and by[402].score == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    df = spark.createDataFrame(rows(150), DOCS)
    other = df.withColumn("lang", F.when(language_id.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (sorted(map(repr, language_id.evaluate(x, sample_rows=40).collect())) for x in (df, other))
    assert a == b


def test_nothing_to_learn_and_string_ids(spark):
    df = spark.createDataFrame([("a/1", "some text", None), (None, "more", "en"), ("b", "", None)], "id string, body string, lang string")
    got = language_id.evaluate(df, doc_id="id", text="body").collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == 3
    assert language_id.evaluate(df.limit(0), doc_id="id", text="body").count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(f"text {k}", "en") for k in range(300)] + [("copy", "de")] * 200, "text string, lang string")
    got = Counter(r.lang for r in language_id.sampled(df, "lang", "text", 20, 10_000).collect())
    assert got["en"] <= 20 and got["de"] <= 1
    assert sum(len(r.text) for r in language_id.sampled(df, "lang", "text", 200, 100).where("lang = 'en'").collect()) <= 100
