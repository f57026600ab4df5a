"""Language identification by prediction by partial matching (PPM).

A language's model is a tree of byte contexts of up to `order` bytes with the counts of the bytes that followed. It says
how likely the next byte is after the longest context that it knows; if it never saw that byte there, it pays for an
escape and asks the context one byte shorter, leaving out the bytes that the longer one would have told (exclusion), down
to an even share of the bytes never seen at all. The escape of a context with n counts of d bytes has d of n + d parts
(method C). The counts are frozen: a text changes nothing, so the code length of a text is the sum over its bytes of
a fixed number of bits for each byte and its context, and the language with the shortest code is the answer.

`learn` fits the trees on at most `sample_rows` different texts a language, the first by hash, of at most `sample_bytes`
bytes together: the bound of what the driver puts together and sends to the tasks. Documents are then coded where they
are read, with no shuffle. Bits are whole numbers of 2^-16 bit, so sums don't hang on the order or the batches.

A text is lower-cased and begins after `order` line feeds, in learning and in coding. Texts are coded whole, in slices of
a bounded number of bytes. Null texts and texts without a letter are `und` with score 0, as is every text if nothing
could be learnt. Empty texts have no letter. score: the share of the answer among the languages, each weighed by two to
the minus its bits (equal shares at first). Equal code lengths go to the first language by name. Rows are coded each by
itself, so repeated rows and ids change nothing; ids, of any type, are carried along. Documents with a null language, a
null text or no id are not learnt from. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UNIT = 1 << 16  # parts of a bit
SLICE = 1 << 22  # bytes, times languages, that are coded at once
_SLOTS = 21  # bits of the table of known contexts


def padded(batch: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a binary array in one array of bytes, each after `order` line feeds, and where each begins; nulls are empty."""
    ends = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
    sizes = np.diff(ends)
    if batch.null_count:
        sizes = np.where(np.asarray(batch.is_valid()), sizes, 0)
    starts = np.concatenate([[0], np.cumsum(sizes + order)])
    out = np.full(starts[-1], 10, np.uint8)
    data = np.frombuffer(batch.buffers()[2], np.uint8) if batch.buffers()[2] else np.empty(0, np.uint8)
    for k in np.flatnonzero(sizes):
        out[starts[k] + order : starts[k + 1]] = data[ends[k] : ends[k] + sizes[k]]
    return out, starts


def grams(text: np.ndarray, order: int) -> np.ndarray:
    """For each byte after the first `order`, it and the bytes before it as one number, the earliest first."""
    out = np.zeros(max(0, len(text) - order), np.int64)
    for k in range(order + 1):
        out = (out << 8) | text[k : k + len(out)]
    return out


class Tree:
    """The frozen counts of one language."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels = order, []
        for k in range(order + 1):  # the context has k bytes
            mask = (1 << (8 * (k + 1))) - 1
            gram, where = np.unique(known & mask, return_inverse=True)
            count = np.bincount(where, counts, len(gram)).astype(np.int64)
            context, own = np.unique(gram >> 8, return_inverse=True)
            total, kinds = np.bincount(own, count, len(context)).astype(np.int64), np.bincount(own, minlength=len(context))
            self.levels.append({"gram": gram, "count": count, "context": context, "own": own, "total": total, "kinds": kinds})
        for k in range(order, 0, -1):  # what is left one context shorter, without the bytes that this one tells
            level, below = self.levels[k], self.levels[k - 1]
            shorter = (1 << (8 * (k - 1))) - 1
            to = np.searchsorted(below["context"], level["context"] & shorter)
            told = np.searchsorted(below["gram"], level["gram"] & ((1 << (8 * k)) - 1))
            level["left_total"] = below["total"][to] - np.bincount(level["own"], below["count"][told], len(level["context"])).astype(np.int64)
            level["left_kinds"] = below["kinds"][to] - level["kinds"]

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Bits, in units, of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        total = kinds = None  # of the present context with exclusions, for those who came by an escape
        escaped = np.zeros(len(gram), bool)
        left_total, left_kinds = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        for k in range(self.order, -1, -1):
            if not len(open_):
                break
            level = self.levels[k]
            here = gram[open_]
            context = (here >> 8) & ((1 << (8 * k)) - 1)
            at = np.minimum(np.searchsorted(level["context"], context), len(level["context"]) - 1)
            seen = level["context"][at] == context
            came = escaped[open_]
            total = np.where(came, left_total[open_], level["total"][at])
            kinds = np.where(came, left_kinds[open_], level["kinds"][at])
            symbol = here & ((1 << (8 * (k + 1))) - 1)
            place = np.minimum(np.searchsorted(level["gram"], symbol), len(level["gram"]) - 1)
            hit = seen & (level["gram"][place] == symbol)
            out[open_[hit]] += np.log2((total[hit] + kinds[hit]) / level["count"][place[hit]])
            miss = seen & ~hit & (kinds > 0)
            out[open_[miss]] += np.log2((total[miss] + kinds[miss]) / kinds[miss])
            gone = seen & ~hit
            escaped[open_[gone]] = True
            if k:
                left_total[open_[gone]], left_kinds[open_[gone]] = level["left_total"][at[gone]], level["left_kinds"][at[gone]]
            open_ = open_[~hit]
        out[open_] += np.log2(256 - self.levels[0]["kinds"][0])
        return np.rint(out * UNIT).astype(np.int64)


class Model:
    """Trees of several languages, with the bits of every gram that one of them knows in a table of all languages."""

    def __init__(self, langs: list[str], trees: list[Tree], order: int):
        self.langs, self.trees, self.order = langs, trees, order
        known = np.unique(np.concatenate([t.levels[order]["gram"] for t in trees])) if trees else np.empty(0, np.int64)
        self.known, self.table = known, self.cost(known)
        self.slots = np.zeros(1 << _SLOTS, np.int64)  # a gram for each slot; what shares one is looked up by search
        self.slots[self.slot(known)] = np.arange(len(known))

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)

    def cost(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(gram) for t in self.trees], 1).astype(np.int32) if self.trees else np.zeros((len(gram), 0), np.int32)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """A row a gram, a column a language."""
        at = self.slots[self.slot(gram)]
        out = self.table[at]
        other = np.flatnonzero(self.known[at] != gram)
        if len(other):
            odd, where = np.unique(gram[other], return_inverse=True)
            at = np.minimum(np.searchsorted(self.known, odd), len(self.known) - 1)
            rows, new = self.table[at], self.known[at] != odd
            rows[new] = self.cost(odd[new])
            out[other] = rows[where]
        return out

    def code_lengths(self, batch: pa.Array) -> np.ndarray:
        """Bits, in units, of each text in each language."""
        text, starts = padded(batch, self.order)
        out = np.zeros((len(batch), len(self.langs)), np.int64)
        step = max(1 << 12, SLICE // max(1, len(self.langs)))
        for a in range(self.order, len(text), step):
            b = min(a + step, len(text))
            bits = self.bits(grams(text[a - self.order : b], self.order))
            first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
            last = int(np.searchsorted(starts, b, "left"))
            body = starts[first:last] + self.order  # where the bytes of each text begin
            lo, hi = np.clip(body, a, b) - a, np.clip(starts[first + 1 : last + 1], a, b) - a
            some = np.flatnonzero(hi > lo)
            edges = np.stack([lo[some], hi[some]], 1).ravel()
            sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]), bits.dtype)]), edges, axis=0, dtype=np.int64)[::2] if len(some) else 0
            out[first + some] += sums
        return out


def _counted(order: int):
    """lang, gram and how often, over batches of lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, starts = padded(batch.column(1).cast(pa.binary()), order)
            lang = batch.column(0).to_pylist()
            for k, name in enumerate(lang):
                gram, count = np.unique(grams(text[starts[k] : starts[k + 1]], order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(count)], ["lang", "gram", "n"])

    return run


def sampled(docs: DataFrame, lang: str, text: str, sample_rows: int, sample_bytes: int) -> DataFrame:
    """lang and text of the first different texts of each language by hash. A hash bound that lets about twice the sample
    through comes first, so what is sorted is bounded too."""
    read = docs.select(F.col(lang).alias("lang"), F.lower(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = read.groupBy("lang").count().collect()  # a row a language, each of which gets a tree
    if not counts:
        return read.limit(0)
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(2**63 - 1, int(-(2**63) + 2.0 * sample_rows / r["count"] * 2**64)))])
    near = read.withColumn("key", F.xxhash64("text")).where(F.col("key") <= bounds[F.col("lang")])
    single = near.groupBy("lang", "key").agg(F.min("text").alias("text"))
    by = Window.partitionBy("lang").orderBy("key")
    placed = single.withColumns({"place": F.row_number().over(by), "so_far": F.sum(F.octet_length("text").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.where((F.col("place") <= sample_rows) & (F.col("so_far") <= sample_bytes)).select("lang", "text")


def learn(docs: DataFrame, order: int = 4, sample_rows: int = 1500, sample_bytes: int = 6_000_000, lang: str = "lang", text: str = "text") -> Model:
    """A model of the documents' languages."""
    own = sampled(docs, lang, text, sample_rows, sample_bytes).select("lang", F.col("text").cast("binary").alias("text"))
    counts = own.mapInArrow(_counted(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()
    langs = sorted(rows["lang"].unique())
    trees = []
    for name in langs:
        mine = rows[rows["lang"] == name]
        trees.append(Tree(mine["gram"].to_numpy(np.int64), mine["n"].to_numpy(np.int64), order))
    return Model(langs, trees, order)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of carry, lang_pred and score of every document."""
    fields = [docs.schema[c] for c in (doc_id, *carry)]
    shape = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    types = [to_arrow_type(f.dataType) for f in fields]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.lower(text)).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = batch.column(len(fields)).cast(pa.binary())
            names, score = ["und"] * len(batch), np.zeros(len(batch))
            if known.langs:
                bits = known.code_lengths(texts) / UNIT
                best = bits.argmin(1)
                share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                there = np.asarray(texts.is_valid())
                score = np.where(there, share, 0.0)
                names = [known.langs[b] if t else "und" for b, t in zip(best, there)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(t) for k, t in enumerate(types)], pa.array(names, pa.string()), pa.array(score)], shape.names)

    return docs.select(*[f.name for f in fields], lettered.alias("__text")).mapInArrow(run, shape)


def held_out(doc_id: str = "doc_id") -> Column:
    """Of three parts by crc32 of the id as text, the second. A document without an id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def evaluate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model of those that have an id and are not held out."""
    model = learn(docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)), lang=lang, text=text, **how)
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    return identify(marked, model, carry=("held_out",))
