"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source gets a target in words: sources in code point order (null last) weigh 3, 1, 2, repeating, and share
   150 % of all words; a target stops at twice its source's words and the excess is shared again by weight.
2. A source's documents fall into blocks by hash. The mix takes every block floor(target / words) times and, of one
   more pass, permuted blocks up to the rest; the block at the border is taken up to the document nearest the target.
   This gives each source an exact quota of block draws.
3. The tree halves the shards again and again; at each node the left half's share of every quota is drawn from the
   multivariate hypergeometric distribution, so each shard gets its capacity and each source its quota, exactly. A
   task splits one node six times at most; the nodes that are left go to tasks of their own, so no task holds more
   than FAN times the sources.
4. Each shard takes the next unused draws of each source in permuted order, and sorts its documents by a hash.

The tree and the quotas work on one row per source and per block (`blocks` in all, plus one a source), never on
documents; targets are found from one row a source. Running sums along a source's blocks go over buckets of the
permutation first and then inside each, so a source with a third of all blocks is no single task. Documents meet their
draws by a join on (source, block). Everything is a function of the seed and the ids, so reruns agree.

Null and empty texts have size 0 and are taken as their block is. A null source is a source, the last one. Rows that
share an id are taken together. Other columns pass through `mixture`, but for `epoch`, `shard` and `place`, which are
its own. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

WEIGHTS = (3, 1, 2)
SHARD_WORDS, BLOCKS_A_SHARD, FAN, BUCKET = 20_000_000, 16, 64, 256


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n.cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: rank, weight, source_size, target. With sources in order of cap / weight, the level at which
    the rest is shared is the largest (goal - caps before) / (weights from here on)."""
    everything = Window.partitionBy()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    rows = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(most)})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.sum("source_size").over(everything) * F.lit(share) - (F.sum("cap").over(order) - F.col("cap"))) / (
        F.sum("weight").over(everything) - (F.sum("weight").over(order) - F.col("weight"))
    )
    return (
        rows.withColumn("level", level)
        .withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything)))
        .select("source", "rank", "weight", "source_size", "target")
    )


def _tree(shards: int, total: int, seed: int):
    """total: the quotas of all sources together."""
    base, more = divmod(total, shards)
    room = lambda lo, hi: base * (hi - lo) + min(hi, more) - min(lo, more)

    def split(node: pd.DataFrame) -> pd.DataFrame:
        """lo, hi, rank, quota of one node; returns the same of its descendants, FAN at most."""
        node = node.sort_values("rank")
        ranks, out, todo = node["rank"].to_numpy(), [], [(int(node["lo"].iloc[0]), int(node["hi"].iloc[0]), node["quota"].to_numpy(dtype=np.int64), FAN)]
        while todo:
            lo, hi, have, fan = todo.pop()
            if hi - lo == 1 or fan == 1:
                some = have > 0
                out.append(pd.DataFrame({"lo": lo, "hi": hi, "rank": ranks[some], "quota": have[some]}))
                continue
            mid = (lo + hi) // 2
            draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, room(lo, mid), method="marginals")
            todo += [(lo, mid, draw, fan // 2), (mid, hi, have - draw, fan // 2)]
        return pd.concat(out)

    return split


def split_quotas(quotas: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """(rank, quota) of the sources to (rank, shard, quota) of every shard that has some."""
    total = int(quotas.agg(F.sum("quota")).first()[0] or 0)
    nodes, width = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("rank").cast("int").alias("rank"), F.col("quota").cast("long").alias("quota")), shards
    while True:
        nodes = nodes.groupBy("lo", "hi").applyInPandas(_tree(shards, total, seed), "lo int, hi int, rank int, quota long")
        width = -(-width // FAN)
        if width == 1:
            return nodes.select("rank", F.col("lo").alias("shard"), "quota")


def _key(seed: int, *what: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *what)


def _block(seed: int, n_blocks: str) -> Column:
    return F.pmod(_key(seed, "doc_id"), F.col(n_blocks))


def _running(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column) -> DataFrame:
    """rows with `before`: the sum of value over the rows of the same keys that come earlier. bucket must grow with
    the order."""
    earlier = Window.unboundedPreceding, -1
    named = rows.withColumns({"__bucket": bucket, "__value": value})
    starts = named.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__all"))
    starts = starts.select(*keys, "__bucket", F.coalesce(F.sum("__all").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(*earlier)), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("__value").over(Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    return named.withColumn("__inside", inside).join(starts, [*keys, "__bucket"]).withColumn("before", F.col("__start") + F.col("__inside")).drop("__bucket", "__value", "__start", "__inside")


def _bucket(key: str, rows: int) -> Column:
    """The leading bits of a 64-bit hash: about BUCKET of the rows to each."""
    bits = max(0, rows // BUCKET).bit_length()
    return F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")


def draws(sized: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 17, **policy) -> tuple[DataFrame, DataFrame, int]:
    """(sources with their targets and block counts; for each source and block its draws: epoch, shard, and up to
    which document key, null for the whole block; the number of shards). Shards hold about SHARD_WORDS words, and
    there are BLOCKS_A_SHARD blocks for each, but no fewer than 64 and 4096."""
    t = targets(sized, **policy)
    if shards is None:
        shards = max(64, math.ceil((t.agg(F.sum("target")).first()[0] or 0) / SHARD_WORDS))
    blocks = blocks or max(4096, shards * BLOCKS_A_SHARD)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") * F.lit(float(blocks)) / F.greatest(F.lit(1), F.sum("source_size").over(Window.partitionBy()))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = keep(
        t.withColumns({"n_blocks": n_blocks.cast("long"), "passes": passes}).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources"
    )
    placed = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "size", "rank", "rest", "passes", _block(seed, "n_blocks").alias("block"))
    sums = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    sums = keep(sums.withColumn("perm", _key(seed + 1, "rank", "block")), "mix-words")
    by_block = keep(_running(sums, ["rank"], _bucket("perm", blocks), ["perm", "block"], F.col("words")), "mix-blocks")
    some = F.col("before") < F.col("rest")
    border = by_block.where(some & (F.col("before") + F.col("words") > F.col("rest"))).select(
        F.col("rank").alias("r"), F.col("block").alias("b"), (F.col("rest") - F.col("before")).alias("left")
    )
    along = Window.partitionBy("rank").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one block a source
    cuts = (
        placed.join(border, (F.col("rank") == F.col("r")) & (F.col("block") == F.col("b")))
        .select("rank", "block", "size", "left", _key(seed + 2, "doc_id").alias("key"))
        .withColumn("off", F.abs(F.sum("size").over(along) - F.col("left")))
        .groupBy("rank", "block", "left")
        .agg(F.min(F.struct("off", "key")).alias("best"))
        .select("rank", "block", F.when(F.col("best.off") < F.col("left"), F.col("best.key")).otherwise(F.lit(-(1 << 63))).alias("cut"))
    )
    n_draws = F.col("passes") + F.when(some, F.lit(1)).otherwise(F.lit(0))
    units = by_block.where(n_draws > 0).select("rank", "block", "passes", F.explode(F.sequence(F.lit(0), n_draws - 1)).alias("epoch"))
    units = units.withColumn("key", _key(seed + 3, "rank", "block", "epoch"))
    units = _running(units, ["rank"], _bucket("key", blocks), ["key", "block", "epoch"], F.lit(1)).withColumnRenamed("before", "at")
    units = units.join(cuts, ["rank", "block"], "left").withColumn("cut", F.when(F.col("epoch") == F.col("passes"), F.col("cut")))
    quotas = by_block.groupBy("rank").agg(F.sum(n_draws).cast("long").alias("quota"))
    split = keep(split_quotas(quotas, shards, seed), "mix-shards")
    starts = _running(split, ["rank"], F.floor(F.col("shard") / BUCKET), ["shard"], F.col("quota"))
    places = starts.where("quota > 0").select("rank", "shard", F.explode(F.sequence("before", F.col("before") + F.col("quota") - 1)).alias("at"))
    drawn = units.join(places, ["rank", "at"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "cut"))).alias("draws"))
    return sources, keep(drawn, "mix-draws"), shards


def _meet(docs: DataFrame, sources: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """docs (with doc_id and source) with __source_size and __target of their source and the draws that take them, as
    array __draws."""
    s = sources.select(F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in ("rank", "source_size", "target", "n_blocks")])
    named = docs.join(s, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__block", _block(seed, "__n_blocks"))
    b = drawn.select(F.col("rank").alias("__r"), F.col("block").alias("__b"), F.col("draws").alias("__all"))
    key = _key(seed + 2, "doc_id")
    mine = F.filter(F.coalesce("__all", F.array()), lambda d: d["cut"].isNull() | (key <= d["cut"]))
    met = named.join(b, (F.col("__rank") == F.col("__r")) & (F.col("__block") == F.col("__b")), "left").withColumn("__draws", mine)
    return met.drop("__source", "__rank", "__n_blocks", "__block", "__r", "__b", "__all")


def mix_documents(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 17, **policy) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted) and its draws."""
    sized = keep(sizes(docs), "mix-sizes")
    sources, drawn, _ = draws(sized, shards, blocks, seed, **policy)
    out = _meet(sized, sources, drawn, seed)
    out = out.withColumnsRenamed({"__source_size": "source_size", "__target": "target", "__draws": "draws"})
    return out.withColumn("taken", F.size("draws") * F.col("size"))


def mixture(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 17, **policy) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with its epoch and shard. Rows of a shard are in one
    partition, in shuffled order (place: ascending within the shard)."""
    sized = keep(sizes(docs), "mix-sizes")
    sources, drawn, shards = draws(sized, shards, blocks, seed, **policy)
    met = _meet(docs.drop("epoch", "shard", "place"), sources, drawn, seed)
    rows = met.drop("__source_size", "__target").withColumn("__draw", F.explode("__draws")).drop("__draws")
    rows = rows.withColumns({"epoch": F.col("__draw.epoch"), "shard": F.col("__draw.shard"), "place": _key(seed + 4, "doc_id", "__draw.epoch")}).drop("__draw")
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "place")
