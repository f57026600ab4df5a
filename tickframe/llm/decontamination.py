"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and cut into words of letters and digits. An item of n words is found in a document
if some stretch of the document is within `budget(n)` word edits (insert, delete, replace) of it. Cut into one piece
more than the budget, such an item has a piece that no edit touches, so that piece stands in the document word for
word: an automaton over all pieces finds the exact hits in one run over the text, and each hit gives a diagonal along
which the item is verified with Myers' bit-parallel distance. Nothing within the budget is lost.

The items are a query set run against all documents, in blocks of bounded size: a block of at most `block_chars`
characters is sent to the tasks and each block is one pass, whose matches are written before the next block is
fetched. `contamination` doesn't shuffle the documents.

Items with fewer than `least_words` words are matched exactly (budget 0), word for word; in scripts that put no spaces
between words (Han, kana, Thai and others) each character is a word, and two of them count as one for that bound. Ids may be of any type. Items without words match nothing. Null and empty texts match nothing. Null ids, of documents and of items,
are carried along; a document with a null id, or one of several rows with an id, is told by its text as well when found
documents are taken out. Repeated rows and repeated items each give their own rows. Other columns are not read by
`contamination` and pass through `decontaminate`. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep

# Characters of scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han), each a word of its own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SINGLE = re.compile(rf"[{_UNSPACED}]")
_WORDS = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
MATCHES = "doc_id string, row long, item_id string, distance int, budget int, first_word int, n_words int"


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def budget(n: int, rate: float = 0.15) -> int:
    """Word edits allowed for an item of n words."""
    return max(1, int(n * rate))


def allowed(n: int, rate: float, least_words: int) -> int:
    """budget(n), or none for items of fewer than least_words words."""
    return budget(n, rate) if n >= least_words else 0


def errors(ws: list[str], rate: float, least_words: int) -> int:
    """The edits allowed for an item of these words. For the bound two characters of a script without spaces are one word."""
    singles = sum(len(w) == 1 and bool(_SINGLE.match(w)) for w in ws)
    return allowed(len(ws), rate, least_words) if len(ws) - singles / 2 >= least_words else 0


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 stretches of nearly equal length that cover n words."""
    cuts = [n * k // (errors + 1) for k in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(smallest edit distance of the pattern to a stretch of the text, index after its end), bit-parallel: bit i of
    the vertical deltas belongs to row i of the matrix, and a column costs a few word-wide operations."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | (1 << i)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = ones, 0, m, m, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = (minus | ~(xh | plus)) & ones, plus & xh
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1) & ones, (hm << 1) & ones
        plus, minus = (hm | ~(xv | hp)) & ones, hp & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _matcher(items: list[tuple[str | None, list[str]]], rate: float, least_words: int):
    """items: (id, words). Rows of MATCHES for batches of doc_id, row, text."""
    names = [x.split()[0] for x in MATCHES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine, at = ahocorasick.Automaton(), {}
        for k, (_, ws) in enumerate(items):
            for a, b in pieces(len(ws), errors(ws, rate, least_words)):
                at.setdefault(" " + " ".join(ws[a:b]) + " ", []).append((k, a))
        for piece, places in at.items():
            machine.add_word(piece, (len(piece), places))
        if at:
            machine.make_automaton()
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch["doc_id"], batch["row"], batch["text"]) if at else ():
                ws = words_of(text)
                line = " " + " ".join(ws) + " "
                hits: dict[int, set[int]] = {}
                seen, done = 0, 0  # words before the character `done` of the line
                for end, (size, places) in machine.iter(line):
                    start = end - size + 1
                    if start >= done:
                        seen, done = seen + line.count(" ", done, start), start
                        first = seen
                    else:
                        first = seen - line.count(" ", start, done)
                    for k, a in places:
                        hits.setdefault(k, set()).add(first - a)
                for k, diagonals in hits.items():
                    item, pattern = items[k]
                    e = errors(pattern, rate, least_words)
                    best = None
                    for lo, hi in _joined(sorted(diagonals), len(pattern) + 2 * e):
                        lo, hi = max(0, lo - e), min(len(ws), hi + len(pattern) + e)
                        d, stop = myers(pattern, ws[lo:hi])
                        if d <= e and (best is None or d < best[0]):
                            best = (d, max(0, lo + stop - len(pattern)))
                    if best:
                        rows.append((doc, row, item, best[0], e, best[1], len(pattern)))
            yield pd.DataFrame(rows, columns=names)

    return run


def _joined(diagonals: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Runs of diagonals closer than gap, as (first, last): one verification each."""
    lo = hi = diagonals[0]
    for d in diagonals[1:]:
        if d - hi > gap:
            yield lo, hi
            lo = d
        hi = d
    yield lo, hi


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = 8_000_000) -> Iterator[list[tuple[str | None, list[str]]]]:
    """The query set, block by block. Items are dealt by hash to as many blocks as their characters need; an item is
    never cut, so a block exceeds the bound only by what the hash deals unevenly."""
    named = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    for k in range(n):
        block = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else named
        rows = ((r.item_id, words_of(r.text)) for r in block.toLocalIterator())
        if own := [(i, ws) for i, ws in rows if ws]:
            yield own


def _matches(docs: DataFrame, items: DataFrame, doc_id: str, text: str = "text", rate: float = 0.15, least_words: int = 8, block_chars: int = 8_000_000) -> DataFrame:
    """MATCHES of all blocks; row is a hash of the text."""
    read = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    parts = [keep(read.mapInPandas(_matcher(block, rate, least_words), MATCHES), "matches") for block in item_blocks(items, block_chars=block_chars)]
    return reduce(DataFrame.union, parts) if parts else read.sparkSession.createDataFrame([], MATCHES)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row for each document and item found in it: its smallest distance, the budget, and where it begins (about:
    the match's end less the item's length). how: rate (of edits), least_words, block_chars."""
    found = _matches(docs, items, doc_id, text, **how)
    types = {"doc_id": docs.schema[doc_id].dataType, "item_id": items.schema["item_id"].dataType}  # strings on the way: a long with nulls is a float in pandas
    return found.withColumns({c: F.col(c).cast(t) for c, t in types.items()}).drop("row")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents in which no item is found, with their own columns. The found ids are written first, so Spark
    knows their size when it picks the join."""
    found_id, found_row = fresh(docs, "found", "row")
    found = _matches(docs, items, doc_id, text, **how).select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias(found_id), F.col("row").alias(found_row)).distinct()
    found = keep(found, "contaminated")
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(found_id)) & (F.xxhash64(text) == F.col(found_row)), "left_anti")
