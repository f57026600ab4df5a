"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct 4-word shingles (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; with fewer words the
whole sequence is the one shingle; without words the set is empty and links with nothing). Documents whose sets have
100 * intersection >= 80 * union are linked; the classes are the connected components.

1. One pass over the texts gives each document its set size, a 128-bit hash of the set, and a signature of
   `rows * bands` minima. Documents with equal sets are one class at once; only its smallest document goes on.
2. Banding: classes that share all minima of a band share a bucket; buckets of one are dropped.
3. Star round: in each bucket every member is paired with one pivot, the member that shares most buckets (the text
   that copies were made from, if it is there), so a group of n near copies gives n pairs and not n squared.
4. Each pair's signatures are compared batch by batch. After n places with m equal, the similarity has a
   Beta(1 + m, 1 + n - m) posterior; a pair goes when P(similarity >= threshold) is under `miss`. Pairs that stay
   are verified on the full sets.
5. Components of the verified links. Then, of the documents in buckets with more than one component, the pairs across
   components that no star has compared and that can be linked at all go the same way, so no link is left out; pairs
   within a component need no comparison. Which pairs can be linked is told by prefixes of the sets, rarest shingles
   first, with a bound by position. That bound is exact.

A shingle that no other candidate has is in no intersection; documents with more than a fifth of those are no
candidates (of a text copied with many edits each, many are such).

With 32 bands of 5 a pair at similarity 0.8 exactly meets in no bucket with probability 3e-6.
Components are found by alternating large and small stars on the edge table, written to the shared folder each
round; no link list, set or component goes to the driver, and no group is gathered in one task.

Rows with a null id are linked with nothing and have a null component; null and empty texts are kept, each its own
component. Rows that share an id are one document, linked by any of its texts. Other columns pass through
`near_dedup`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep

BANDS, ROWS, BATCH = 32, 5, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int = 4) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six white spaces
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object)).astype(np.uint64)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, len(h) if width < n else n, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _ODD + h[k : len(h) - width + 1 + k])
    return np.unique(out)


@cache
def _multipliers(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, size, dtype=np.uint32)


def signature(shingles: np.ndarray, size: int, step: int = 1024) -> np.ndarray:
    """Minima of `size` linear hashes. The shingles are mixed already, so 32 bits of each and 32-bit products do, and
    numpy works on them in vectors; a step's table stays in the processor's cache."""
    a, b = _multipliers(size)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(size, np.iinfo(np.uint32).max, dtype=np.uint32)
    table = np.empty((min(step, len(x)), size), dtype=np.uint32)
    for at in range(0, len(x), step):
        some = x[at : at + step, None]
        h = np.multiply(some, a, out=table[: len(some)])
        np.minimum(least, np.add(h, b, out=h).min(axis=0), out=least)
    return least


def _sketch(bands: int, rows: int, shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sizes, lo, hi, sigs, keys = [], [], [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_hashes(text, shingle)
                ids.append(doc)
                sizes.append(len(s))
                if not len(s):
                    lo.append(None), hi.append(None), sigs.append(None), keys.append(None)
                    continue
                whole = np.array([_mix(s).sum(dtype=np.uint64), _mix(s ^ _ODD).sum(dtype=np.uint64)]).view(np.int64)
                sig = signature(s, bands * rows)
                band = np.arange(1, bands + 1, dtype=np.uint64)
                for column in sig.reshape(bands, rows).T.astype(np.uint64):
                    band = _mix(band * _ODD + column)
                lo.append(whole[0]), hi.append(whole[1]), sigs.append(sig.tobytes()), keys.append(band.view(np.int64))
            yield pd.DataFrame({"doc_id": ids, "n_shingles": sizes, "lo": pd.array(lo, dtype="Int64"), "hi": pd.array(hi, dtype="Int64"), "sig": sigs, "bands": keys})

    return run


def _beta_tail(m: int, n: int, at: float) -> float:
    """P(s >= at) for s ~ Beta(1 + m, 1 + n - m): the chance of at most m successes in n + 1 tries."""
    from math import comb

    return sum(comb(n + 1, k) * at**k * (1 - at) ** (n + 1 - k) for k in range(m + 1))


def least_matches(size: int, threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(places compared, equal places needed to go on) after each batch."""
    out = []
    for n in range(batch, size + 1, batch):
        out.append((n, next(m for m in range(n + 1) if _beta_tail(m, n, threshold) >= miss)))
    return out


def _survivors(size: int, threshold: float, miss: float):
    @F.pandas_udf("boolean")
    def survives(a: pd.Series, b: pd.Series) -> pd.Series:
        """Whether no batch of the two signatures rules out the threshold."""
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint32).reshape(-1, size) for s in (a, b))
        alive, equal, start = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
        for n, need in least_matches(size, threshold, miss):
            equal[alive] += (x[alive, start:n] == y[alive, start:n]).sum(axis=1)
            alive, start = alive[equal[alive] >= need], n
        out = np.zeros(len(x), dtype=bool)
        out[alive] = True
        return pd.Series(out)

    return survives


def _sets(shingle: int):
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle).view(np.int64) for t in texts])

    return sets


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Large star: each node's larger neighbours move to its smallest one; small star: the smaller ones do. Each round
    writes its edges; it ends when they are stars, which one aggregate tells."""
    cur = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "edges")
        down = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        moved = large.join(down, large.a == down.n)
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        cur = keep(small, "edges")
        roots, leaves = cur.select(F.col("b").alias("n")).distinct(), cur.groupBy(F.col("a").alias("n")).count()
        if leaves.where("count > 1").isEmpty() and leaves.join(roots, "n", "left_semi").isEmpty():
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that are linked. Signatures prune, full sets decide."""
    sig = sketches.select("doc_id", "sig", "n_shingles")
    one = lambda s, n: s.select(F.col("doc_id").alias(n), F.col("sig").alias(f"sig_{n}"), F.col("n_shingles").alias(f"n_{n}"))
    close = pairs.join(one(sig, "a"), "a").join(one(sig, "b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    close = keep(close.where(_survivors(size, percent / 100, miss)("sig_a", "sig_b")).select("a", "b"), "survivors")
    full = lambda n: sets.select(F.col("doc_id").alias(n), F.col("set").alias(f"set_{n}"))
    both = close.join(full("b"), "b").join(full("a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    linked = shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * percent
    return both.where(linked).select("a", "b").distinct()


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, size, shared): the documents that can be linked at all. A shingle of one document alone is in no
    intersection, so a document with more than 100 - percent hundredths of those has no link."""
    size = sets.groupBy("doc_id").agg(F.max(F.size("set")).alias("size"), F.count(F.lit(1)).alias("texts"))
    alone = sets.select("doc_id", F.explode("set").alias("s")).groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).where("doc_id = other")
    own = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    counted = size.join(own, "doc_id", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0)))
    several = F.col("texts") > 1  # rows of one id with different texts: no bound holds for all of them
    counted = counted.withColumns({"shared": F.when(several, F.lit(1 << 40)).otherwise(F.col("shared")), "size": F.when(several, F.lit(0)).otherwise(F.col("size"))})
    return counted.where(F.col("shared") * 100 >= F.col("size") * percent).select("doc_id", "size", "shared")


def _across(sets: DataFrame, open_ids: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that can be linked. Each set is ordered from its rarest shingle (counted
    among these documents) to its most frequent. What two sets share lies at or after their first common shingle, so a
    linked pair has one early enough in both that the rest of either holds the intersection it needs."""
    tokens = sets.join(open_ids, F.col("doc_id") == F.col("id")).select("id", "component", F.xxhash64("set").alias("row"), F.size("set").alias("size"), F.explode("set").alias("s"))
    counts = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = tokens.join(counts, "s").groupBy("id", "component", "row", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("known"))
    first = F.col("size") - F.size("known")  # shingles of this document alone come first and are in no intersection
    reach = F.floor(F.col("size") * (100 - percent) / 100).cast("int") + 1 - first
    head = F.slice("known", F.lit(1), F.greatest(F.lit(0), F.least(reach, F.size("known"))))
    early = keep(ordered.select("id", "component", "size", first.alias("first"), F.posexplode(head).alias("k", "t")).select("id", "component", "size", (F.col("size") - F.col("first") - F.col("k")).alias("left"), F.col("t.s").alias("s")), "early")
    x, y = early.alias("x"), early.alias("y")
    need = (F.col("x.size") + F.col("y.size")) * percent
    enough = F.least("x.left", "y.left") * (100 + percent) >= need
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & enough)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80, miss: float = 1e-6, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    key = docs.schema[doc_id].dataType
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id string, n_shingles long, lo long, hi long, sig binary, bands array<long>"
    named_text = texts.withColumn("doc_id", F.col("doc_id").cast("string"))  # a long with nulls is a float in pandas
    sketches = keep(named_text.mapInPandas(_sketch(bands, rows, shingle), schema).withColumn("doc_id", F.col("doc_id").cast(key)), "sketches")
    named = sketches.where("lo IS NOT NULL AND doc_id IS NOT NULL")
    classes = keep(named.groupBy("lo", "hi").agg(F.min("doc_id").alias("lead")), "classes")
    leads = classes.select(F.col("lead").alias("doc_id")).distinct()
    heads = named.join(leads, "doc_id", "left_semi")
    places = heads.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    crowds = keep(places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowds")
    met = keep(places.join(crowds, "bucket"), "met")
    in_crowd = met.select(F.col("id").alias("doc_id")).distinct()
    sets = keep(texts.join(in_crowd, "doc_id", "left_semi").select("doc_id", _sets(shingle)("text").alias("set")), "sets")
    able = _linkable(sets, percent)
    met = keep(met.join(able.select(F.col("doc_id").alias("id")), "id"), "met")
    fame = met.groupBy("id").agg(F.sum("n").alias("fame"))
    famous = met.select("bucket", "id").join(fame, "id")
    pivots = famous.groupBy("bucket").agg(F.min(F.struct((-F.col("fame")).alias("less"), "id")).alias("best")).select("bucket", F.col("best.id").alias("pivot"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = keep(met.join(pivots, "bucket").where("id <> pivot").select(*pair("id", "pivot")).distinct(), "stars")
    check = lambda pairs: keep(_verified(pairs, heads, sets, bands * rows, percent, miss), "links")
    links = check(stars)
    found = keep(components(links), "components")
    named_place = met.select("bucket", "id").join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = named_place.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    open_ids = keep(named_place.join(mixed, "bucket", "left_semi").select("id", "component").distinct(), "open")
    rest = _across(sets, open_ids, percent)
    more = check(rest.join(stars, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found = keep(components(links.union(more)), "components")
    # rows of one id with different texts are one document: its classes are tied together
    again = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = named.join(again, "doc_id", "left_semi").join(classes, ["lo", "hi"]).where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    if not again.isEmpty() and not several.isEmpty():
        found = keep(components(links.union(more).union(several)), "components")
    ids = classes.join(found, F.col("lead") == F.col("node"), "left").select(F.col("lo").alias("l"), F.col("hi").alias("h"), F.coalesce("component", "lead").alias("component"))
    ids = keep(ids, "ids")  # a written side has no aggregate in the join's stage, so Spark can split a class of many copies
    mine = F.col("doc_id").isNotNull() & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h"))
    out = sketches.select("doc_id", "n_shingles", "lo", "hi").join(ids, mine, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents of which one stays for each class, the one with the smallest id. Of rows that share the id, all stay."""
    classes = near_classes(docs, doc_id, **how)
    (name,) = fresh(docs, "gone")
    gone = keep(classes.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")
