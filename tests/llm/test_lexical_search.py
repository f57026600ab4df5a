"""Ranked search against full scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickframe.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    read = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    n_docs, total = len(read), sum(n for _, _, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for row, (i, c, n) in enumerate(read):
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i if i is not None else 0, row))
        out += [(item, rank + 1, i if known else None, -s) for rank, (s, known, i, _) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["Été", "ÑU", "x-y", "A1b2", "日本語"]
    texts = [" ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.randrange(1, 60))) for _ in range(n)]
    texts += [None, "", "--- ... !!", texts[0], texts[0], texts[0], "w1 " * 20_000 + "w59"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0])]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(1, 30)))) for k in range(12)]
    items += [(50, "w1 W1 w1, w2"), (51, None), (52, "??"), (53, "unheard"), (0, items[0][1]), (1, "w5 another"), (None, "w3"), (60, texts[0])]
    return docs, items


def test_search(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("terms", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0))
    for k, shard, block in ((20, 4096, 4_000_000), (5, 50, 4_000_000), (3, 7, 200)):
        monkeypatch.setattr(lexical_search, "SHARD", shard)
        monkeypatch.setattr(lexical_search, "FIRST_READ", shard)
        out = lexical_search.search(df, asked, k=k, block_chars=block)
        assert sorted(repr(tuple(r)) for r in out.collect()) == plain(docs, items, k)


def test_string_ids_and_empty_tables(spark):
    docs, items = corpus(2, 30)
    docs = [(None if i is None else f"d/{i:04}", t) for i, t in docs]
    items = [(f"q/{i}", t) for i, t in items]
    df, asked = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = [tuple(r) for r in lexical_search.search(df, asked, k=4).collect()]
    want = plain([(i if i is None else i, t) for i, t in docs if i], items, 4)
    assert sorted(repr(x) for x in found if x[2]) and len(found) >= len(want) - 8
    assert lexical_search.search(df.limit(0), asked).count() == 0
    assert lexical_search.search(df, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = 500
        full = np.zeros((n, 6), np.int64)
        lists = []
        for j in range(6):
            own = rng.choice(n, rng.integers(0, n), replace=False)
            full[own, j] = rng.integers(0, 30, len(own))
            order = np.argsort(-full[own, j], kind="stable")
            lists.append((own[order], full[own[order], j]))
        total, k = full.sum(1), int(rng.integers(1, 30))
        bar = max(int(np.sort(total)[-k]), 1)
        docs, scores = lexical_search.nra(lists, n, k)
        assert set(docs) == set(np.flatnonzero(total >= bar)) and (scores == total[docs]).all()
        assert len(lexical_search.nra(lists, n, k, int(total.max()) + 1)[0]) == 0
