"""Quality rules as a ledger of bits: every rule is evaluated once a document, policies are masks over the bits.

`ledger` measures each text and sets bit k of `fail_bits` where rule k fails. `apply_policy` keeps the documents
that fail no rule of a policy's mask, so a new policy version needs no new pass over the texts. `ablations` tells
from grouped bits alone how many documents each rule costs by itself.

All of it is DataFrame functions. Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words and fail
`few_words`. Repeated rows are measured one by one; other columns pass through, but those named like a
measurement are replaced. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, let

# The rules in bit order, each with the condition under which it fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 15 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_text": "n_words > 1000000",
}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "word_length"),
    "v3": ("few_words", "repeated_words", "symbols", "word_length", "dup_lines", "long_text"),
}
_PLACE_BITS = 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str | tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    names = list(rules)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _covered(at: Column) -> Column:
    """Words under three-word windows at sorted places: each covers three, or as many as lie before the next."""
    return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)


def _places_by_hash(words: Column) -> Column:
    """Sorted places of the windows that occur twice or more, by their full hashes; for any length."""
    window = lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    twin = lambda s: F.filter(s, lambda p, k: F.get(s, k + 1)["h"].eqNullSafe(p["h"]) | F.get(s, k - 1)["h"].eqNullSafe(p["h"]))
    pairs = F.sort_array(F.transform(F.slice(words, 1, F.size(words) - 2), window))
    return F.sort_array(F.transform(let(pairs, twin), lambda p: p["i"]))


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text has twice or more. A window becomes one number, 44 bits of
    hash over 20 bits of place; sorted, equal windows are neighbours, and their words are compared. A text with
    colliding hashes, or with more windows than places, goes the longer way by full hashes."""
    place, size = F.lit((1 << _PLACE_BITS) - 1).cast("long"), F.size(words)
    packed = F.transform(
        F.slice(words, 1, size - 2),
        lambda x, i: F.shiftleft(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)), _PLACE_BITS).bitwiseOR(i.cast("long")),
    )

    def count(s: Column) -> Column:
        at = lambda k: F.get(s, k).bitwiseAND(place).cast("int")
        alike = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda k: F.shiftright(F.get(s, k).bitwiseXOR(F.get(s, k + 1)), _PLACE_BITS) == 0)
        same = lambda k: F.forall(F.array(*map(F.lit, range(3))), lambda o: F.get(words, at(k) + o) == F.get(words, at(k + 1) + o))
        places = lambda ks: F.sort_array(F.array_union(F.transform(ks, at), F.transform(ks, lambda k: at(k + 1))))
        return let(
            alike,
            lambda ks: F.when(F.size(ks) == 0, F.lit(0)).when(F.forall(ks, same), let(places(ks), _covered)).otherwise(let(_places_by_hash(words), _covered)),
        )

    short = let(F.sort_array(packed), count)
    return F.when(size < 4, F.lit(0)).when(size <= 1 << _PLACE_BITS, short).otherwise(let(_places_by_hash(words), _covered)).cast("long")


def ledger(df: DataFrame, text: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """df with the measurements and `fail_bits`."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    trimmed = F.btrim(t, F.lit(WS))
    words = F.split(trimmed, WS_CLASS + "+", -1)
    per_text = let(
        words,
        lambda w: F.struct(
            F.when(trimmed == "", F.lit(0)).otherwise(F.size(w)).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    per_line = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    measured = df.drop(*MEASURES, "fail_bits").withColumns({"__w": per_text, "__l": per_line, "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")})
    measured = measured.withColumns({m: F.col(f"{'__l' if 'lines' in m else '__w'}.{m}") for m in MEASURES if m != "n_symbols"}).drop("__w", "__l")
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(kept_ledger: DataFrame, policy: str | tuple[str, ...] = "v2", rules: dict[str, str] = RULES) -> DataFrame:
    """The ledger with `failed` (the policy's failing bits) and `kept`."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    return kept_ledger.withColumns({"failed": failed, "kept": failed == 0})


def ablations(kept_ledger: DataFrame, policy: str | tuple[str, ...] = "v2", rules: dict[str, str] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, those that fail only it (kept again without it), and
    documents kept by the policy without it. Documents are first counted by their bits: at most 2^rules rows."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    names = POLICIES[policy] if isinstance(policy, str) else policy
    by_bits = kept_ledger.groupBy(failed.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(rules).index(r)).cast("long").alias("bit")) for r in names]))
    rows = by_bits.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        total(F.col("bits") == F.col("bit")).alias("fails_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


def quality_filter(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with their own columns only; those named like a measurement stand aside while
    it is made. The ledger is one struct, so that the filter reads it and doesn't measure again."""
    aside = {c: f"__{c}" for c in docs.columns if c in (*MEASURES, "fail_bits", "failed", "kept")}
    verdict = apply_policy(ledger(docs.withColumnsRenamed(aside)), policy)
    own = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return verdict.select(F.col("kept").alias("__keep"), *own).where("__keep").select(*docs.columns)
