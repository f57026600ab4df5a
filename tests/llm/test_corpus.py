"""Each corpus operator against a plain Python version, with nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns of clashing names."""

import hashlib
import io
import itertools
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.llm import chat_format, decontamination, licence_scan, line_dedup, near_dedup, quality_classifier, quality_rules, secret_scan, source_mixing, warc_zip
from tickframe.llm.queries import PLANTED, TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [a + b for a in ("ba", "de", "fi", "go", "lu", "mé", "ÑA", "sto") for b in ("n", "rt", "s", "lk", "que", "")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    texts = ["\n".join(prose(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    base = prose(rng, 120)
    for k in range(12):  # near copies, each with a word or two changed
        words = base.split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], texts[1].upper(), None, "", "one two", "one two", "  \t\n ", prose(rng, 20_000), "a b c d\n" * 300]
    rows = [(i, t, "en", f"src{i % 5}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, "null id text", None, None, 3), rows[2], (None, texts[0], None, "src0", 3), (None, texts[3], None, "src1", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_quality_rules(spark, docs):
    for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect():
        w = words(r.text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(tri)
        covered = {i + o for i, x in enumerate(tri) if seen[x] > 1 for o in range(3)}
        ls = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(ls) - len(set(ls)), len(covered))
        assert bool(r.fail_bits & 1) == (len(w) < 50) and bool(r.fail_bits & 2) == (100 * len(covered) > 50 * len(w))
        assert r.kept == (r.fail_bits & quality_rules.mask("v2") == 0)


def test_quality_rules_long_way_agrees(spark, docs):
    w = F.split(F.btrim(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", -1)
    slow = quality_rules.let(w, lambda x: F.when(F.size(x) < 4, 0).otherwise(quality_rules.let(quality_rules._places_by_hash(x), quality_rules._covered)))
    assert docs.where(slow != quality_rules.let(w, quality_rules._repeat_words)).count() == 0


def test_quality_ablations(spark, docs):
    rows = quality_rules.ledger(docs.withColumn("n_words", F.lit("clash"))).collect()
    for r in quality_rules.ablations(quality_rules.ledger(docs), "v3").collect():
        bit, mask = quality_rules.mask((r.rule,)), quality_rules.mask("v3")
        assert r.fails == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.fails_alone == sum(x.fail_bits & mask == bit for x in rows)
        assert r.kept_without == sum(x.fail_bits & mask & ~bit == 0 for x in rows)


CLASHING = ("n_words", "kept", "failed", "fail_bits", "n_lines", "n_dropped", "rank", "n_blocks", "block", "draw", "draws", "target", "source_size")


def test_filters_leave_clashing_columns_alone(spark, docs):
    import corpus_pipeline

    named = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in CLASHING})
    want = lambda df: all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in df.collect() for c in CLASHING)
    kept = quality_rules.quality_filter(named)
    assert kept.columns == named.columns and 0 < kept.count() == quality_rules.quality_filter(docs).count() and want(kept)
    lines = corpus_pipeline.lines(spark, named, "")
    assert lines.columns == named.columns and want(lines)
    mixed = source_mixing.mixture(named, shards=4, blocks=64)
    assert set(mixed.columns) == {*named.columns, "epoch", "shard", "place"} and mixed.count() > 0 and want(mixed)
    near = near_dedup.near_dedup(named.withColumns({"component": F.lit(1), "component_id": F.lit(2), "lo": F.lit(3)}))
    assert want(near) and near.count() == near_dedup.near_dedup(docs).count()


def test_line_dedup(spark, docs):
    rows = docs.collect()
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if r.doc_id is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(r.doc_id)
    expect = Counter()
    for r in rows:
        ls = (r.text or "").split("\n")
        kept = [x for x in ls if r.doc_id is None or len(h := holders.get(key(x), ())) < 2 or min(h) == r.doc_id]
        expect[(r.doc_id, "\n".join(kept), len(ls), len(ls) - len(kept))] += 1
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs.withColumn("n_lines", F.lit("clash"))).collect())
    assert got == expect and sum(x[3] for x in got) > 0


def shingles(t, n=4):
    w = low(t).split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    up = {r.doc_id: r.doc_id for r in rows if r.doc_id is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return Counter((d, len(s), root(d) if d is not None else None) for d, s in sets)


def test_near_classes(spark, docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_classes(docs).collect())
    assert got == brute_components(docs.collect())
    kept = Counter(r.doc_id for r in near_dedup.near_dedup(docs, shingle=4).select("doc_id").collect())
    assert kept == Counter(r.doc_id for r in docs.collect() if r.doc_id is None or (r.doc_id, len(shingles(r.text)), r.doc_id) in got)


def test_near_classes_of_a_drifting_group(spark):
    """No text is near all others: links must be found beyond one star."""
    rng = random.Random(9)
    text, rows = prose(rng, 200).split(), []
    for k in range(60):
        text[rng.randrange(200)] = f"w{k}"
        if k % 2:
            text[rng.randrange(200)] = f"v{k}"
        rows.append((k, " ".join(text), "en", "s", 1))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_classes(df).collect())
    assert got == brute_components(df.collect())


def test_posterior_bounds():
    for n, need in near_dedup.least_matches(160, 0.8, 1e-6):
        assert 0 < need < 0.8 * n and near_dedup._beta_tail(need - 1, n, 0.8) < 1e-6 <= near_dedup._beta_tail(need, n, 0.8)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ([rng.choice("abcd") for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert decontamination.myers(p, t)[0] == plain_distance(p, t)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randrange(9, 60)).capitalize() + ".") for k in range(20)] + [(20, None), (21, "too short"), (None, prose(rng, 20))]
    rows = []
    for d in range(80):
        w = prose(rng, 150).split()
        if d % 3 == 0:
            p = (items[d % 20][1]).split()
            for _ in range(rng.randrange(0, 7)):
                k = rng.randrange(len(p))
                p = rng.choice([p[:k] + ["edit"] + p[k + 1 :], p[:k] + p[k + 1 :], p[:k] + ["more"] + p[k:]])
            k = rng.choice([0, rng.randrange(150), 150])
            w[k:k] = p
        rows.append((d, " ".join(w).replace("o", "O"), "en", "s", 0))
    rows += [(None, items[3][1], None, None, None), (98, None, "", "", 0), (99, "", "", "", 0), (4, "  ", "x", "y", 1)]
    rows += [(90, "so " + items[-1][1], "en", "s", 0), (4, items[5][1] + " and more", "en", "s", 0), (None, "no item here", "", "", 0)]
    expect = set()
    for d, t, *_ in rows:
        ws = decontamination.words_of(t)
        for i, x in items:
            p = decontamination.words_of(x)
            if len(p) >= 8 and ws and (n := plain_distance(p, ws)) <= decontamination.budget(len(p)):
                expect.add((d, i, n))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (8_000_000, 1000):
        got = decontamination.contamination(docs, bench, block_chars=block).collect()
        assert sorted(map(str, {(r.doc_id, r.item_id, r.distance) for r in got})) == sorted(map(str, expect)) and len(got) == len(expect)
    assert len(expect) > 15
    assert (90, None, 0) in expect and any(d is None for d, *_ in expect)
    held = lambda t: any(plain_distance(p, ws) <= decontamination.allowed(len(p), 0.15, 8) for _, x in items if (p := decontamination.words_of(x))) if (ws := decontamination.words_of(t)) else False
    left = decontamination.decontaminate(docs.withColumn("row", F.lit("clash")), bench).collect()
    assert Counter((r.doc_id, r.text, r.row) for r in left) == Counter((d, t, "clash") for d, t, *_ in rows if not held(t))


def test_short_items_are_matched_exactly(spark):
    items = [(1, "What is the capital of France?"), (2, "北京是哪国的首都"), (3, "?!"), (4, "Who wrote it?")]
    texts = ["So: what is\nthe CAPITAL of France, they ask", "what is the big capital of France", "问：北京是哪国的首都？", "he wrote it", "Who wrote it", None]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.budget) for r in decontamination.contamination(docs, bench).collect()}
    assert got == {(0, 1, 0, 0), (2, 2, 0, 0), (4, 4, 0, 0)}
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {1, 3, 5}


def test_matches_are_written_block_by_block(spark, monkeypatch):
    log, blocks, keep = [], decontamination.item_blocks, decontamination.keep
    monkeypatch.setattr(decontamination, "item_blocks", lambda *a, **b: (log.append("read") or x for x in blocks(*a, **b)))
    monkeypatch.setattr(decontamination, "keep", lambda *a: log.append("written") or keep(*a))
    bench = spark.createDataFrame([(k, f"one two three four five six seven eight nine number{k}") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine number7", "en", "s", 0)], DOCS)
    assert decontamination.contamination(docs, bench, block_chars=1000).count() == 40
    assert len(log) > 2 and log == ["read", "written"] * (len(log) // 2)


def test_source_mixing(spark, docs):
    rows = source_mixing.mix_documents(docs, shards=8, blocks=64).collect()
    again = source_mixing.mix_documents(docs.repartition(7), shards=8, blocks=64).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again)) and len(rows) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, goal, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while over := {s for s in open_ if (goal - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}:
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    left = goal - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest


def test_mixture_shards(spark, docs):
    mixed = source_mixing.mixture(docs.withColumn("shard", F.lit("clash")), shards=4, blocks=256)
    per = {r.doc_id: r.taken for r in source_mixing.mix_documents(docs, shards=4, blocks=256).where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    got = Counter()
    for r in mixed.dropDuplicates(["doc_id", "epoch"]).collect():
        got[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in got.items() if v and k is not None} == {k: v for k, v in per.items() if v}
    assert set(mixed.columns) == {"doc_id", "text", "lang", "source", "n_chars", "epoch", "shard", "place"}


@pytest.mark.parametrize("shards", [1, 7, 64, 300])
def test_tree_gives_exact_quotas(spark, shards):
    """Also in more rounds than one (300 shards): each source its quota, each shard its capacity."""
    quotas = {0: 1000, 1: 1, 2: 370}
    df = spark.createDataFrame(list(quotas.items()), "rank int, quota long")
    rows = source_mixing.split_quotas(df, shards).collect()
    by_rank, by_shard = Counter(), Counter()
    for r in rows:
        by_rank[r.rank] += r.quota
        by_shard[r.shard] += r.quota
    base, more = divmod(1371, shards)
    assert by_rank == quotas and by_shard == {k: base + (k < more) for k in range(shards)}
    assert sorted(rows) == sorted(source_mixing.split_quotas(df.repartition(3), shards).collect())


def test_tree_is_hypergeometric(spark):
    """The first shard's share of a source, over seeds, has the mean of the distribution."""
    df = spark.createDataFrame([(0, 60), (1, 30), (2, 10)], "rank int, quota long")
    first = [{r.rank: r.quota for r in source_mixing.split_quotas(df, 4, seed).collect() if r.shard == 0} for seed in range(40)]
    assert abs(np.mean([f.get(0, 0) for f in first]) - 15) < 2 and abs(np.mean([f.get(2, 0) for f in first]) - 2.5) < 1 and len({f.get(0) for f in first}) > 3


def test_draws_of_blocks(spark, docs):
    """Each draw of a block goes to one shard; a source's blocks are drawn once or twice, or once more or not at all."""
    sized = source_mixing.sizes(docs)
    sources, drawn, shards = source_mixing.draws(sized, 300, 2000)
    of = {r["rank"]: r for r in sources.collect()}
    per_shard, n = Counter(), 0
    for r in drawn.collect():
        epochs = [d.epoch for d in r.draws]
        assert epochs == list(range(len(epochs))) and of[r["rank"]].passes <= len(epochs) <= of[r["rank"]].passes + 1
        per_shard.update(d.shard for d in r.draws)
        n += len(epochs)
    base, more = divmod(n, 300)
    assert shards == 300 and per_shard == {k: base + (k < more) for k in range(300) if base + (k < more)}


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(k % 3, rng.randrange(-(1 << 63), 1 << 63), rng.randrange(9)) for k in range(900)]
    df = spark.createDataFrame(rows, "rank int, key long, v long").repartition(5)
    got = {(r["rank"], r.key): r.before for r in source_mixing._running(df, ["rank"], source_mixing._bucket("key", 3000), ["key"], F.col("v")).collect()}
    assert got == {(a, k): sum(x[2] for x in rows if x[0] == a and x[1] < k) for a, k, _ in rows}


PAGES = [(k, f"http://x/{k}\nq", f"<p>é{k % 7}</p>" if k % 10 else None) for k in range(40)] + [(50, None, ""), (None, "u", "<p>é1</p>"), (3, "dup", "<p>é3</p>"), (60, "long", "x" * 400_000)]


@pytest.mark.parametrize("least,limit", [(0, 10**9), (5, 300)])
def test_warc(spark, least, limit):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    manifest = warc_zip.write_archives(pages, least_bytes=least, max_bytes=limit)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    expect = Counter()
    for p, _, h in PAGES:
        b = (h or "").encode()
        r = None if p is None or len(b) < least or first[h or ""] == p else first[h or ""]
        expect[(p, len(b), warc_zip.digest(b), "response" if r is None else "revisit", r)] += 1
    rows = warc_zip.read_records(manifest, span_bytes=500).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expect
    assert all(r.digest_ok is not False for r in rows)


def test_zip64_directory():
    import struct
    import zipfile

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    f = File()
    with zipfile.ZipFile(f, "w") as z:
        for k in range(70_000):
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"%d" % k)
    members = warc_zip.directory(f, len(f.getvalue()))
    assert len(members) == 70_000
    name, method, start, size = members[-1]
    assert (name, method, f.read_at(size, start)) == ("m69999", 0, b"69999")
    # a member whose sizes and place stand in the ZIP64 extra field only
    name, data = b"big", b"hello"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 3, 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 3, 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    at = len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    tail = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    f = File(local + data + central + end64 + tail)
    [(n, _, start, size)] = warc_zip.directory(f, len(f.getvalue()))
    assert (n, f.read_at(size, start)) == ("big", data)


def foreign(url, payload, kind="response", digest=None, extra=""):
    http = f"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    if kind == "warcinfo":
        block = payload
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: {url}\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + extra
    media = "application/warc-fields" if kind == "warcinfo" else "application/http;msgtype=response"
    return f"{head}Content-Type: {media}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def package(path, archives, index, name="indexes/index.cdxj", how=0):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("datapackage.json"), "{}")
        for a, data in archives.items():
            z.writestr(a, data, compress_type=how)
        if index is not None:
            z.writestr(zipfile.ZipInfo(name), index)


def test_packages_of_other_writers(spark, tmp_path):
    """Several archives, gaps between records, an index sorted by URL, a gzipped index, and an archive without one."""
    import gzip
    import json

    rng, archives, lines, want = random.Random(5), {}, [], Counter()
    for a in range(3):
        at, parts = 0, []
        info = gzip.compress(foreign("", b"software: x", "warcinfo"))
        for k in range(30):
            url, body = f"http://h{k % 4}/{a}/{k}", bytes(rng.randrange(256) for _ in range(rng.randrange(0, 900)))
            said = [None, "sha1:" + warc_zip.digest(body), "sha256:abc", "sha1:" + hashlib.sha1(body).hexdigest()][k % 4]
            kind = "revisit" if k % 10 == 9 else "response"
            raw = gzip.compress(foreign(url, body, kind, said))
            if k % 5 == 0:  # records that the index leaves out
                parts.append(info)
                at += len(info)
            lines.append(f"com,h{k % 4})/{a}/{k} 2024 {json.dumps({'url': url, 'offset': str(at), 'length': len(raw), 'filename': f'part{a}.warc.gz'})}")
            parts.append(raw)
            at += len(raw)
            payload = body if kind == "response" else b""
            own = warc_zip.digest(payload)
            ok = None if kind == "revisit" or k % 4 in (0, 2) else True
            want[(url, kind, len(body), own if said is None else said.removeprefix("sha1:"), ok)] += 1
        archives[f"archive/part{a}.warc.gz"] = b"".join(parts)
    index = "\n".join(["!meta {\"format\": \"cdxj\"}", *sorted(lines)]).encode()
    package(tmp_path / "one.wacz", archives, index)
    package(tmp_path / "two.wacz", archives, gzip.compress(index), "indexes/index.cdx.gz")
    columns = lambda rows: Counter((r.url, r.record_type, r.payload_bytes, r.payload_digest, r.digest_ok) for r in rows)
    for p in ("one", "two"):
        found = spark.createDataFrame([(f"file://{tmp_path}/{p}.wacz",)], "path string")
        assert columns(warc_zip.read_records(found, span_bytes=3000).collect()) == want
        assert warc_zip.read_records(found, span_bytes=3000).rdd.getNumPartitions() > 1
    plain = b"".join(foreign(f"http://p/{k}", b"y" * k) for k in range(20))
    package(tmp_path / "bare.wacz", {"archive/a.warc.gz": archives["archive/part0.warc.gz"], "archive/b.warc": plain}, None)
    rows = warc_zip.read_records(spark.createDataFrame([(f"file://{tmp_path}/bare.wacz",)], "path string")).collect()
    assert Counter(r.record_type for r in rows) == {"warcinfo": 6, "response": 47, "revisit": 3}
    assert [r.payload_bytes for r in rows if (r.url or "").startswith("http://p/")] == list(range(20))
    package(tmp_path / "deflated.wacz", archives, index, how=8)
    with pytest.raises(Exception, match="compressed as a member"):
        warc_zip.read_records(spark.createDataFrame([(f"file://{tmp_path}/deflated.wacz",)], "path string")).collect()


CHATS = [
    (1, 1, "assistant", "Hello <|end|> \\ <\\| wörld 🙂é"),
    (1, 0, "user", "Hi\n\nthere "),
    (1, 2, "assistant", None),
    (1, 3, "assistant", " \\"),
    (1, 3, "assistant", " \\"),
    (2, 0, None, "<|turn|>assistant<|text|>x"),
    (2, 1, "assi<|text|>stant", "no loss"),
    (None, 0, "assistant", "null id"),
    (3, None, "assistant", "早上好 " * 3000),
    (-7, 0, "user", PLANTED),
    (-7, 1, "assistant", PLANTED),
]


def test_vocabulary_files_agree():
    """Ids, offsets and masks of the rank file are those of the tokenizers library, for any script."""
    rng = random.Random(3)
    ranks, other = chat_format._encoder(TOKENIZER), chat_format._encoder(TOKENIZER.replace(".tiktoken", ".json"))
    for k in range(200):
        turns = [(rng.choice(["user", "assistant", ""]), "".join(rng.choice("ab Zé早🙂\n\t' <|\\0٣") for _ in range(rng.randrange(0, 60)))) for _ in range(4)]
        text, spans = chat_format.render([*turns, (PLANTED, PLANTED)])
        for a, b in zip(ranks(text), other(text)):
            assert a.tolist() == b.tolist()
    ids, starts, ends = ranks("x" + " " * 1_000_000 + "y")
    assert starts[0] == 0 and ends[-1] == 1_000_002 and (starts[1:] == ends[:-1]).all()


@pytest.mark.parametrize("piece,stretch", [(1_000_000, 512), (5, 512), (1_000_000, 1), (5, 2)])
def test_chat_formatting(spark, piece, stretch):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df, TOKENIZER, piece, stretch)).collect()}
    convs = {}
    for c, t, role, text in sorted(CHATS, key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == len(chat_format.render(turns)[0])


def test_loss_mask_by_search():
    rng = np.random.default_rng(0)
    cuts = np.unique(rng.integers(0, 1000, 200))
    starts, ends, spans = cuts[:-1], cuts[1:], np.array([[5, 90], [100, 101], [300, 700]])
    plain = [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends)]
    assert chat_format.loss_mask(starts, ends, spans).tolist() == plain


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    rest = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    rows = [(1, f"{mit}\n{rest}"), (2, f"x\n{mit}"), (3, "So. Licensed under CC BY-NC 4.0. Released under the MIT License.\nReleased under the MIT License."), (4, "no licence here"), (5, None), (6, ""), (None, "All rights reserved."), (7, rest)]
    got = {r.doc_id: r for r in licence_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("sentence", F.lit(1))).collect()}
    assert {k: r.licences for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT;CC-BY-NC-4.0", None: "all-rights-reserved", 7: ""}
    assert got[1].sentence_ids == "MitGrant;MitNotice;MitAsIs;MitLiability" and got[1].unmatched == "" and got[7].unmatched == "MitNotice;MitAsIs;MitLiability"
    assert all(any(c in s for c in licence_scan.CUES) for s in licence_scan.SENTENCES)


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1}

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program{2}"""
LIBRARY = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; {0} of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc."""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NOTICES = [
    ("MIT", MIT),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", GPL.format(":", ", either version 3 of the License, or (at your option) any later version.", ".  If not, see <https://www.gnu.org/licenses/>.")),
    ("GPL-2.0-or-later", GPL.format(";", "; either version 2 of the License, or (at your option) any later version.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")),
    ("GPL-3.0-only", GPL.format(":", ", version 3.", ".  If not, see <https://www.gnu.org/licenses/>.")),
    ("GPL-2.0-only", GPL.format(";", "; version 2.", "; if not, write to the Free Software Foundation, Inc.")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "Copyright (c) 2020 A. Person.  All rights reserved."),
    ("BSD-3-Clause", "Copyright (c) 2020, A. Person\n\nAll rights reserved.\n\n" + BSD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + DISCLAIMER),
    ("BSD-2-Clause", BSD + "\n\n" + DISCLAIMER),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("LGPL-2.1-or-later", LIBRARY.format("either version 2.1")),
    ("LGPL-3.0-or-later", LIBRARY.format("either version 3")),
    ("AGPL-3.0-or-later", GPL.replace("GNU General", "GNU Affero General").format(":", ", either version 3 of the License, or (at your option) any later version.", ".  If not, see <https://www.gnu.org/licenses/>.")),
    ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def test_wrapped_licences(spark):
    """The notices as printed: at several widths, plain and behind comment leaders, before and after other text."""
    assert {n for n, _ in NOTICES} == {n for n, _ in licence_scan.RULES}
    rows, want = [], {}
    for (name, notice), width, lead in itertools.product(NOTICES, (24, 60, 72, 4000), ("", "# ", " * ", "// ", "dnl ")):
        lines = [line for p in notice.split("\n\n") for line in [*textwrap.wrap(p.strip(), width, break_long_words=False, break_on_hyphens=False), ""]]
        k = len(rows)
        rows.append((k, "Some words before it\n\n" + "\n".join((lead + line).rstrip(" ") for line in lines) + "\nimport os\n"))
        want[k] = name
    rows.append((9000, "This project is\n\nlicensed under the\n\nMIT license. All rights are\nnot reserved. Permission is hereby granted"))
    got = {r.doc_id: r.licences for r in licence_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (want[k], got.get(k), rows[k][1][:300]) for k in want if got.get(k) != want[k]} == {} and 9000 not in got


def test_licences_in_long_and_repeated_rows(spark):
    """Rows of one id are one document, in order of place; a long text is read to its end; a caller's own sentence
    needs no cue."""
    long = "word " * 200_000 + ".\nReleased under the MIT License."
    rows = [(1, long), (2, "All rights reserved."), (2, "All rights reserved."), (3, "\n\nLicensed under CC BY 4.0."), (3, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licence_scan.scan(docs).collect()}
    assert got == {1: ("MitRef", "MIT"), 2: ("Reserved;Reserved", "all-rights-reserved"), 3: ("MitRef;CcByRef", "MIT;CC-BY-4.0")}
    own = licence_scan.known_sentences(spark.createDataFrame([(1, "Do as you please.")], "doc_id long, text string"), sentences={"do as you please": "Please"}, notices={})
    assert [(r.doc_id, r.sentence_id) for r in own.collect()] == [(1, "Please")]


def test_secrets(spark):
    rng = random.Random(2)
    rows, secret = [], set()
    for k in range(300):
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        tail = [f'token = "{hexa}" ', f"write to {rng.choice(VOCAB).lower()}{k}@mail7.example.com now ", ""][k % 3]
        if k % 3 == 0:
            secret.add((k, hashlib.sha256(hexa.encode()).hexdigest()))
        rows.append((k, prose(rng, 30).lower() + " " + tail + prose(rng, 5), "en", f"a/test{k}.py", 0))
    rows += [(None, None, None, None, None), (900, "", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = secret_scan.scan(docs).collect()
    assert {(r.doc_id, r.value_sha256) for r in out if r.is_secret} == secret
    assert all(rows[r.doc_id][1][r.start : r.start + r.length] for r in out)
    assert secret_scan.scan(docs.where("doc_id = 1")).where("is_secret").count() == 0


SECRET_FORMS = [  # text, its value
    ('password = "{}"', "hunter2-A9!"),
    ("DB_PASSWORD={}", "Tr0ub4dor3xyzQ9"),
    ("API_KEY={}", "sk_live_51HcAbCdEfGhIjKlMn"),
    ("export AUTH_TOKEN={}", "qwertzuiopas"),
    ('"secret": "{}"', "Zy!x w?v"),
    ("password: {}", "k9$wQ,z"),
    ("Authorization: Bearer {}", "abc.DEF-123"),
    ('password: str = "{}"', "opensezme"),
    ("x?token={}&page=2", "T7"),
]


def test_secret_candidates():
    for form, value in SECRET_FORMS:
        text = f"some words\n{form.format(value)}\nand more"
        assert text.index(value) in {a for (a, b), how in secret_scan._spans(text).items() if text[a:b] == value and how[0]}, form
    text = "a region=eu-west-1-abcdef012345 b abcdefghijklmnop12== c abcdefghijklmnopqrst"
    assert [text[a:b] for a, b in sorted(secret_scan._spans(text))] == ["eu-west-1-abcdef012345", "abcdefghijklmnop12=="]


def test_planted_forms_of_secrets(spark):
    rng = random.Random(4)
    rows, secret = [], set()
    pick = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    for k in range(600):
        short, long, plain = pick(8, "bcdfgh") + pick(3, "23456789") + "!", "sk_live_" + pick(18, "BCDFGHbcdfgh2345"), pick(12, "bcdfghjkl")
        form, value = [('password = "{}"', short), ("DB_PASSWORD={}", pick(15, "BCDbcdfg2345")), ("API_KEY={}", long), ("export AUTH_TOKEN={}", plain), ("{}", f"w{k}@mail7.example.com"), ("token = {}()", "vendor.next")][k % 6]
        line = form.format(value)
        if k % 6 < 4:
            secret.add((k, hashlib.sha256(value.encode()).hexdigest()))
        rows.append((k, prose(rng, 30).lower() + "\n" + line + "\n" + prose(rng, 5), "en", f"a/b{k}.py", 0))
    out = secret_scan.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert secret <= {(r.doc_id, r.value_sha256) for r in out if r.label == 1}
    assert {(r.doc_id, r.value_sha256) for r in out if r.is_secret} == secret
    assert all(rows[r.doc_id][1][r.start : r.start + r.length] for r in out)


def test_secret_features(spark):
    """Dictionary coverage and character transitions against loops over all documents."""
    texts = ["alpha beta gamma alpha", "Alpha beta9 x", "gamma alpha-beta", "gamma", None, "", 'token = "alphagammaX9alp" and region=eu-west-gamma-77ff'] + ["beta"] * 2
    docs = spark.createDataFrame([(k, t, "en", "a/b", 0) for k, t in enumerate(texts)] + [(0, texts[0], "en", "a/b", 0)], DOCS)
    counts = Counter(w for t in [*texts, texts[0]] if t for w in set(re.findall(r"(?<![^\W_])[^\W\d_]{4,12}(?![^\W_])", t.lower())))
    known = {w for w, n in counts.items() if n >= 3}
    assert {r.word for r in secret_scan.dictionary(docs).collect()} == known == {"alpha", "beta", "gamma"}
    pairs = Counter()
    for t in [*texts, texts[0]]:
        c = [int(x) for x in secret_scan._coded(t or "")]
        pairs.update(zip(c, c[1:]))
    for r in secret_scan.candidates(docs).collect():
        run = texts[r.doc_id][r.start : r.start + r.length]
        under = {p for p in range(len(run)) for w in known for q in range(len(run)) if run.lower().startswith(w, q) and q <= p < q + len(w)}
        c = [int(x) for x in secret_scan._coded(run)]
        log = [np.log2((pairs[a, b] + 1) / (38 + sum(n for (x, _), n in pairs.items() if x == a))) for a, b in zip(c, c[1:])]
        assert r.f_covered == pytest.approx(len(under) / len(run)) and r.f_transitions == pytest.approx(np.mean(log))
        assert r.f_covered == pytest.approx({"alphagammaX9alp": 10 / 15, "eu-west-gamma-77ff": 5 / 18}[run])


def planted_findings(n=900, seed=6):
    """Texts with one candidate each that hold a secret or not; forms that no rule over the context tells apart."""
    rng = random.Random(seed)
    pick = lambda k, chars: "".join(rng.choice(chars) for _ in range(k))
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    forms = [
        (1, lambda: f"token = \"{pick(40, hexa)}\""),
        (0, lambda: f"commit {pick(40, hexa)}"),
        (1, lambda: f"API_KEY={pick(32, base)}7"),
        (0, lambda: f"password = \"{rng.choice(VOCAB)}-{rng.choice(VOCAB)}-{rng.choice(VOCAB)}-{rng.randrange(10)}\""),
        (1, lambda: f"deploy with {pick(36, base)}4 now"),
        (0, lambda: f"see build {pick(8, hexa)}-{pick(12, hexa)}-{pick(12, hexa)} there"),
        (0, lambda: f"secret: {rng.choice(VOCAB)}_{rng.choice(VOCAB)}_{rng.choice(VOCAB)}_{rng.choice(VOCAB)}1"),
    ]
    rows = []
    for k in range(n):
        truth, make = forms[k % len(forms)]
        rows.append((k, prose(rng, 12) + " " + " ".join(rng.choice(VOCAB) for _ in range(12)) + "\n" + make() + "\n" + prose(rng, 6), "en", "a/b.py", truth))
    return rows


def test_secret_forest_on_labelled_findings(spark):
    """Trained on half of the findings with labels that come from the planting and not from any feature."""
    rows = planted_findings()
    docs = spark.createDataFrame(rows, DOCS)
    found = secret_scan.candidates(docs).groupBy("doc_id").agg(F.max_by("start", "length").alias("start"))
    labels = found.join(docs.select("doc_id", F.col("n_chars").alias("label")), "doc_id").where("doc_id % 2 = 0")
    out = [r for r in secret_scan.scan(docs, labels=labels).collect() if r.doc_id % 2]
    hits = [(r.is_secret, bool(rows[r.doc_id][4])) for r in out]
    precision = np.mean([t for s, t in hits if s])
    recall = len({r.doc_id for r in out if r.is_secret and rows[r.doc_id][4]}) / sum(r[4] for r in rows if r[0] % 2)
    assert precision > 0.93 and recall > 0.93, (precision, recall)
    assert secret_scan.scan(docs, labels=labels.where("label = 1")).where("is_secret").count() == labels.where("label = 1").count()  # one label alone: it stands


def test_secret_forest_on_held_out_findings(spark):
    found = secret_scan.seed_labels(secret_scan.candidates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).where("label is not null")
    half = F.pmod(F.xxhash64("value_sha256"), F.lit(2))
    model = secret_scan.train(found.where(half == 0))
    rows = secret_scan.score(found.where(half == 1), model).collect()
    assert np.mean([r.is_secret == (r.label == 1) for r in rows]) > 0.95


def test_quality_classifier_on_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = quality_classifier.classify(docs, labels.where(~test)).join(labels.where(test), "doc_id").collect()
    assert np.mean([(r.p_quality >= 0.5) == (r.quality == 1) for r in out]) > 0.95
    assert np.mean([(r.p_toxic >= 0.5) == (r.toxic == 1) for r in out]) > 0.9
    clean = [r for r in out if not r.toxic]
    assert np.mean([r.p_toxic < 0.5 for r in clean]) > 0.98


SCORED = "doc_id long, host string, path string, quality double, toxic double"


def plain_posteriors(rows):
    """The path's posterior of each row, by loops: one-way analysis of variance, the row left out of its sites."""
    p = np.array([1 / (1 + np.exp(-r[3])) for r in rows])
    mean, out = p.mean(), []
    of = lambda key: [[i for i, r in enumerate(rows) if key(r) == k] for k in {key(r) for r in rows}]
    levels = [of(lambda r: 0), of(lambda r: r[1]), of(lambda r: (r[1], r[2]))]
    spread = lambda groups: sum(((p[g] - p[g].mean()) ** 2).sum() for g in groups)
    strength = []
    for above, below in zip(levels, levels[1:]):
        within = spread(below) / (len(p) - len(below))
        up = len(below) - len(above)
        between = (spread(above) - spread(below)) / up - within if up else 0
        size = len(p) - sum(sum(len(b) ** 2 for b in below if b[0] in a) / len(a) for a in above)
        tau = between * up / size if size else 0
        strength.append(min(1e6, max(1, within / tau)) if tau > 0 else 1e6)
    for i, r in enumerate(rows):
        host = [j for j in range(len(rows)) if rows[j][1] == r[1] and j != i]
        path = [j for j in host if rows[j][2] == r[2]]
        h = (p[host].sum() + strength[0] * mean) / (len(host) + strength[0])
        out.append((p[path].sum() + strength[1] * h) / (len(path) + strength[1]))
    return out


def test_site_posteriors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for h, (n, level) in enumerate([(300, 3.0), (80, -2.0), (40, 0.5), (1, -4.0), (1, 4.0), (2, 0.0)]):
        rows += [(len(rows) + i, f"h{h}" if h else None, f"h{h}/{i % 3}", level + (i % 3) + float(rng.normal()), None) for i in range(n)]
    out = {r.doc_id: r for r in quality_classifier._with_sites(spark.createDataFrame(rows, SCORED).repartition(3), "quality").collect()}
    want = plain_posteriors(rows)
    assert len(out) == len(rows) and all(abs(out[r[0]].path_quality - w) < 1e-9 for r, w in zip(rows, want))
    evidence = [out[r[0]].quality for r in rows]
    mean = np.mean([1 / (1 + np.exp(-x)) for x in evidence])
    logit = lambda q: np.log(q / (1 - q))
    assert all(abs(out[r[0]].post_quality - 1 / (1 + np.exp(-(r[3] - logit(mean) + logit(w))))) < 1e-9 for r, w in zip(rows, want))
    alone = [r for r in rows if sum(x[1] == r[1] for x in rows) == 1]
    assert len(alone) == 2 and all(abs(out[r[0]].path_quality - mean) < 1e-9 for r in alone)  # no evidence for itself


def test_sites_of_equal_share_keep_it(spark):
    """One-document sites don't spread, whatever their own evidence is."""
    rows = [(i, f"host{i}", f"host{i}/x", float(i % 7 - 3), None) for i in range(40)]
    out = quality_classifier._with_sites(spark.createDataFrame(rows, SCORED), "quality").collect()
    assert len({round(r.path_quality, 9) for r in out}) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.quality_filter(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert near_dedup.near_dedup(none).count() == 0
    assert decontamination.decontaminate(none, items).count() == 0
    assert source_mixing.mix_documents(none).count() == 0 and source_mixing.mixture(none).count() == 0
    assert warc_zip.read_records(warc_zip.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(chats, TOKENIZER)).count() == 0
    assert licence_scan.scan(none).count() == 0 and secret_scan.scan(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(none, labels).count() == 0


def test_texts_of_nothing_are_kept(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0)], DOCS)
    assert near_dedup.near_dedup(docs).count() == 3
    assert line_dedup.line_dedup(docs).count() == 3
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, labels).where("keep").count() == 3
    assert source_mixing.mix_documents(docs).agg(F.sum("taken")).first()[0] == 0
