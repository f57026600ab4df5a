"""Line dedup: a line that several documents hold stays only in the document with the smallest id.

Texts are split at \\n. A line's key is the line stripped of `[\\x20\\x09-\\x0D]` with A-Z lower-cased. Keys are
hashed to 128 bits; documents are counted distinctly per hash; lines of hashes over the threshold go, but for those
of the smallest document holding them; what is left is put together by position.

Only hashes and positions are shuffled with the lines; the texts move once, to meet the positions to drop. A line
that a third of all documents hold is one key of the join back, which AQE splits (the other side has one row a key).

Null and empty texts are one empty line. Rows with a null id keep all their lines and count for nobody. Rows that
share an id are one document for the counting; each loses its own lines. Other columns pass through. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, fresh, keep, let


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> tuple[DataFrame, DataFrame]:
    """(line places, hashes over the threshold with the document that keeps them)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("row"), F.posexplode(F.split(ascii_lower(t), "\n", -1)).alias("pos", "line"))
        .withColumn("key", F.btrim("line", F.lit(WS)))
        .where(F.char_length("key") >= min_chars)
        .select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    lines = keep(lines, "lines")  # read twice: cutting and hashing the texts again costs more
    over = (
        lines.groupBy("h1", "h2")
        .agg(F.min("id").alias("keeper"), F.count_distinct("id").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    return lines, keep(over, "repeated-lines")  # a written side has no aggregate in the join's stage, so Spark can split a hot line


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the repeated lines gone from the text, plus n_lines (before) and n_dropped."""
    lines, over = repeated_lines(docs, doc_id, text, min_chars, min_docs)
    drop_id, drop_row, drop, own = fresh(docs, "id", "row", "drop", "own")
    drops = (
        lines.join(over, ["h1", "h2"])
        .where(F.col("id") != F.col("keeper"))
        .groupBy(F.col("id").alias(drop_id), F.col("row").alias(drop_row))
        .agg(F.collect_set("pos").alias(drop))
    )
    t = F.coalesce(F.col(text), F.lit(""))
    n_dropped = F.coalesce(F.size(drop), F.lit(0))

    def left(ls):
        places = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop))
        return F.array_join(F.transform(places, lambda i: F.get(ls, i)), "\n")

    rest = F.when(F.col(drop).isNull(), t).otherwise(let(F.split(t, "\n", -1), left))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*names).withColumn(own, F.xxhash64(t)).join(drops, (F.col(doc_id) == F.col(drop_id)) & (F.col(own) == F.col(drop_row)), "left")
    n_lines = F.char_length(t) - F.char_length(F.translate(t, "\n", "")) + 1
    return joined.select(
        *[rest.alias(c) if c == text else F.col(c) for c in names],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped"),
    )
