"""The pipeline, stage by stage, against a plain Python version of each stage over its own input."""

import random
from collections import Counter

from test_corpus import DOCS, low, plain_distance, prose, words

import corpus_pipeline
from tickframe.llm import decontamination


def raw(seed=8):
    rng = random.Random(seed)
    items = [(k, prose(rng, 20)) for k in range(4)]
    shared = "This line stands in many documents of the crawl."
    texts = ["\n".join(prose(rng, rng.randrange(20, 60)) for _ in range(4)) + (f"\n{shared}" if k % 3 == 0 else "") for k in range(30)]
    for k in range(6):
        w = texts[2].split(" ")
        w[5 + k] = "changed"
        texts.append(" ".join(w).replace("\n", " "))
    texts += [texts[4] + "\n" + items[1][1], texts[5].split("\n")[0] + " " + items[2][1].upper() + " " + texts[6].split("\n")[1] + " " + prose(rng, 30)]
    texts += [texts[7], "too short", None, "", "spam " * 200, " ".join(f"{w}###" for w in prose(rng, 80).split())]
    return [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)], items


def good(t):
    w = words(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    covered = {i + o for i, x in enumerate(tri) if seen[x] > 1 for o in range(3)}
    chars = sum(map(len, w))
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 10 * sum(c in "#*$%&|<>" for c in t) <= len(w) and 3 * len(w) <= chars <= 15 * len(w)


def without_repeats(rows):
    holders = {}
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in rows:
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    kept = lambda i, x: len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i
    out = [(i, "\n".join(x for x in t.split("\n") if kept(i, x)), a, b) for i, t, a, b, _ in rows]
    return [(i, t, a, b, len(t)) for i, t, a, b in out]


def representatives(rows, n=5):
    def sets(t):
        w = low(t).split()
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    all_sets = [(r[0], sets(r[1])) for r in rows]
    for k, (a, s) in enumerate(all_sets):
        for b, t in all_sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [r for r in rows if root(r[0]) == r[0]]


def clean(rows, items):
    found = lambda t, x: plain_distance(x, t) <= decontamination.budget(len(x)) if t else False
    ws = [decontamination.words_of(x) for _, x in items]
    return [r for r in rows if not any(found(decontamination.words_of(r[1]), x) for x in ws)]


def test_stages_and_run(spark, tmp_path):
    rows, items = raw()
    at = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    plain = [lambda r: [x for x in r if good(x[1] or "")], without_repeats, representatives, lambda r: clean(r, items)]
    docs, now = spark.read.parquet(f"{at}/documents.parquet"), rows
    for (name, stage), simple in zip(corpus_pipeline.STAGES, plain):
        before, now = len(now), simple(now)
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        assert sorted(map(tuple, docs.collect())) == sorted(now), name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and (len(now) < before) == (name != "line dedup")
    mixed = corpus_pipeline.run(spark, at)
    left = {r[0]: r for r in now}
    taken, sizes = Counter(), Counter()
    for r in now:
        sizes[r[3]] += len(words(r[1]))
    for r in mixed.collect():
        assert (r.doc_id, r.text, r.source) == (left[r.doc_id][0], left[r.doc_id][1], left[r.doc_id][3]) and r.epoch in (0, 1)
        taken[r.source] += len(words(r.text))
    assert mixed.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    largest = max(len(words(r[1])) for r in now)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= largest * len(sizes)
