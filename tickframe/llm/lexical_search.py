"""Ranked lexical search: for each query text the k best documents, by NRA (no random access).

A document's score is the sum, over the query's terms, of integer impacts: a term's weight (rare terms weigh more) times
its damped count in the document. The collection is read twice:

1. `index` cuts every whole text into terms and keeps, per document, its length and its counts of the terms that the
   queries hold. The index is written to the shared folder; the collection's statistics are counted from it.
2. `search` reads the index in shards of whole documents. A shard's postings form one list a term, sorted by impact.
   `nra` reads a query's lists from their heads, in blocks, and never looks a document up: it keeps for each document
   the sum of what was read (the least that it can score) and that sum plus the next impact of each list in which it has
   not been met (the most). Documents that can't reach the k-th best any more go; a list is read on as long as an
   interval hangs on it. It ends when no unmet document can enter and every document left has one exact score, so that
   membership, ties and scores are settled. A task carries its k best from shard to shard, so later shards end sooner.

Documents are never shuffled: a task gives at most k rows a query, and Spark ranks those, k rows a query and task.
Queries are a stated set, fetched in blocks of at most `block_chars` characters; a block is one pass over the documents.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Null
and empty texts have no terms: they are not counted and found by nothing, and a query without terms has no rows. A term
that a query repeats counts as often. Equal scores go by ascending id, a null id first. Rows that repeat an id are
documents of their own, equal query rows are one query, and one id with two texts is two queries, ranked apart. Ids can
be of any type that can be ordered. Other columns are not read. An empty collection or query table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import keep

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 bytes after A-Z went to a-z
SHARD = 4096  # documents to a shard
FIRST_READ = 256  # postings of a list's first block; each block after it is twice as long


def terms_of(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())  # bytes.lower() knows only A-Z


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of postings: the term's weight, its count in the document, the document's length. 64-bit integers throughout."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard: all that score at least the k-th best of the shard and at least `least`, which is
    1 or more. lists: for each term the numbers of the documents that hold it, and their impacts in falling order."""
    lower = np.zeros(n_docs, np.int64)
    met = np.zeros((n_docs, len(lists)), bool)
    read = np.zeros(len(lists), np.int64)
    rest = np.array([v[0] if len(v) else 0 for _, v in lists], np.int64)  # the most that the next posting can give
    active = [j for j in range(len(lists)) if rest[j] > 0]
    alive, unmet, size = np.empty(0, np.int64), True, FIRST_READ
    while active:
        for j in active:
            docs, values = lists[j]
            a, b = read[j], min(read[j] + size, len(docs))
            lower[docs[a:b]] += values[a:b]
            met[docs[a:b], j] = True
            read[j] = b
            rest[j] = values[b] if b < len(values) else 0
        size *= 2
        if unmet:
            alive = np.flatnonzero(lower)
        low = lower[alive]
        bar = max(least, int(np.partition(low, len(low) - k)[len(low) - k])) if len(low) >= k else least
        open_ = ~met[alive]
        upper = low + open_ @ rest
        keep_ = upper >= bar
        alive, open_ = alive[keep_], open_[keep_]
        unmet = unmet and int(rest.sum()) >= bar  # a document not met yet may still reach the bar
        active = [j for j in range(len(lists)) if rest[j] > 0 and (unmet or open_[:, j].any())]
    scores = lower[alive]
    return alive, scores


def _tokenize(vocabulary: dict[bytes, int], key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, ids, counts, at = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py() or b"")
                if not found:
                    continue
                keys.append(row)
                sizes.append(len(found))
                for term, n in Counter(found).items():
                    if (i := vocabulary.get(term)) is not None:
                        ids.append(i)
                        counts.append(n)
                at.append(len(ids))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keys, pa.int64())).cast(key_type),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                ["doc_id", "n", "terms", "tf"],
            )

    return run


def index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf (numbers of the vocabulary's terms and their counts) of each document
    with a term, kept in the shared folder."""
    key = docs.schema[doc_id].dataType
    shape = T.StructType([T.StructField("doc_id", key), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return keep(read.mapInArrow(_tokenize(vocabulary, to_arrow_type(key)), shape), "term-index")


def _rank(queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, key_type: pa.DataType):
    """queries: (term, how often) of each. Rows item, doc_id, score: the k best of all that a task reads."""

    def shard(batch: pa.RecordBatch, best: list[list[tuple]]) -> None:
        ids = batch.column(0)
        order = np.empty(len(ids), np.int64)  # place of each id in ascending order, null first
        order[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        n = batch.column(1).to_numpy()
        listed = batch.column(2)
        doc = np.repeat(np.arange(len(ids)), np.diff(listed.offsets.to_numpy()))
        term, tf = listed.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        value = impacts(weights[term], tf, n[doc], n_docs, n_terms)
        by = np.lexsort((doc, -value, term))
        doc, value = doc[by], value[by]
        ends = np.searchsorted(term[by], np.arange(len(weights) + 1))
        for q, wanted in enumerate(queries):
            lists = [(doc[ends[t] : ends[t + 1]], value[ends[t] : ends[t + 1]] * times) for t, times in wanted]
            known = best[q]
            least = known[-1][0] if len(known) == k else 1
            found, scores = nra(lists, len(ids), k, least)
            if len(found):
                top = np.lexsort((order[found], -scores))[:k]
                known += [(int(s), i) for s, i in zip(scores[top], ids.take(pa.array(found[top])).to_pylist())]
                known.sort(key=lambda x: (-x[0], x[1] is not None, x[1]) if x[1] is not None else (-x[0], False))
                del known[k:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for at in range(0, len(batch), SHARD):
                shard(batch.slice(at, SHARD), best)
        rows = [(q, i, s) for q, known in enumerate(best) for s, i in known]
        item, ids, scores = ([r[c] for r in rows] for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, key_type), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return run


def query_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """(id, terms) of the different query rows, block by block: dealt by hash to as many blocks as their characters need."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * total // block_chars) if total > block_chars else 1
    for b in range(n):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b) if n > 1 else rows
        own = [(r.id, found) for r in block.toLocalIterator() if (found := terms_of(r.text.encode("utf-8", "surrogatepass")))]
        if own:
            yield own


def _search(docs: DataFrame, block: list[tuple], item_type: T.DataType, doc_id: str, text: str, k: int) -> DataFrame:
    spark, key = docs.sparkSession, docs.schema[doc_id].dataType
    vocabulary: dict[bytes, int] = {}
    queries = []
    for _, found in block:
        queries.append([(vocabulary.setdefault(t, len(vocabulary)), times) for t, times in Counter(found).items()])
    indexed = index(docs, vocabulary, doc_id, text)
    n_docs, n_terms = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in indexed.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row a query term
        weights[term] = weight(n_docs, df)
    tops = indexed.mapInArrow(_rank(queries, weights, n_docs, n_terms, k, to_arrow_type(key)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", key), T.StructField("score", T.LongType())]))
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)]))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents with a score above 0, fewer where there are no more."""
    item_type = items.schema[item_id].dataType
    parts = [_search(docs, block, item_type, doc_id, text, k) for block in query_blocks(items, item_id, item_text, block_chars)]
    if not parts:
        shape = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], shape)
    return reduce(DataFrame.union, parts)
