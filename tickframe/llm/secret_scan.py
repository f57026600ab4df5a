"""Secret scans: candidates by pattern, a random forest to remove false positives.

Candidates are runs of 16 or more characters of `[A-Za-z0-9+/=_.@-]` that hold a digit or whose characters follow each
other more rarely than letters do in the corpus, by 2 bits a character; tokens of known issuers; private key blocks; the
password of a web address; and whatever is assigned to a credential word, of any length and with or without digits: a
quoted value whole, another up to white space or the next name. Texts are read in time that grows with their length. Where a run is a name, an assignment sign and a value, only the value is the candidate. Features of each:

* length; share of digits and capitals; entropy;
* character transitions: how often the character class changes, and the mean log2 probability of each character after
  the one before it, under a table of all characters of all documents (ASCII letters, digits, white space, the rest);
* dictionary coverage: the share of characters under words of 4 to 12 letters, found anywhere in the letter runs; a
  word is in the dictionary if `least_docs` documents of the corpus have it;
* path: depth, and words such as test or example in it;
* neighbouring words: credential words, an assignment, an opening quote, the form of an environment setting, and words
  that name a reference (commit, checksum, version) before the candidate.

The forest is Spark ML's, trained on labelled findings (`labels`: doc_id, start, label). `seed_labels` gives labels
where none are at hand, by rule: an assignment of a credential word to a quoted value is a finding, and so is an
unquoted value with a digit or in the form of an environment setting; an address, a web place, code, a lone unquoted
word or a value made of dictionary words is not; the rest stays unlabelled. A forest trained on those can only spread
that rule. The fit uses at most `sample` labelled findings, the first by hash.

The transition table has a fixed number of rows, so it is sent to the tasks; the dictionary grows with the corpus and
meets the candidates in a join.

Null and empty texts have no candidates; a null path is an empty one. Repeated rows give their rows again. Ids are
carried along, null or not. Other columns are not read. Without findings of both labels no forest can be trained, and
the labels stand (unlabelled ones are no secrets). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

FEATURES = ("length", "digits", "capitals", "entropy", "changes", "transitions", "covered", "path_depth", "path_sample", "credential", "assigned", "quoted", "setting", "reference")
_FOUND = tuple(f for f in FEATURES if f != "covered")  # known without the dictionary
FINDINGS = "doc_id string, start int, length int, value_sha256 string, kind string, runs array<string>, " + ", ".join(f"f_{f} double" for f in _FOUND)
_RUN = re.compile(r"[A-Za-z0-9+/=_.@-]{16,}")
_NAMED = re.compile(r"(?:-*[A-Za-z_][\w.-]*)?={1,3}(?=[^=])")  # of a run, what stands before its value
_ALPHA = re.compile(r"[^\W\d_]{4,}")
_WORD_LETTERS = (4, 12)
# 38 classes of a byte: letters without case, digits, white space, anything else (also in bytes of other scripts).
_CODES = np.full(256, 37, dtype=np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODES[[ord(_c), ord(_c.upper())]] = _k
_CODES[[9, 10, 11, 12, 13, 32]] = 36
# Credential words, and words of paths that hold samples.
_WORDS = "token|secret|passw|pwd|api_?key|auth|bearer|credential|private"
_CREDENTIAL = re.compile(rf"(?i)({_WORDS})\w*\W*$")
# a name with a credential word, its closing quote, a type, the sign, a scheme, and the value: quoted, or up to white space
# or a quote. A name is tried once, at its begin and with its first credential word, so a long one costs its length.
_ASSIGNED = re.compile(
    rf"""(?i)(?<!\w)(?>\w*?(?P<word>{_WORDS}))\w*+[\\"'`\])]{{0,4}}[ \t]*(?P<sign>:[ \t]*[\w.\[\]|]{{1,40}}[ \t]*=(?!=)|:=|=>|={{1,3}}|:)[ \t]*"""
    r"""(?:(?:bearer|basic)[ \t]+)?(?:"(?P<double>(?:[^"\\\n]|\\.)+)"|'(?P<single>(?:[^'\\\n]|\\.)+)'|[\\"'`]*(?P<bare>[^\s"'`]+))"""
)
# Beginnings of tokens of known issuers, with what follows them.
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abprs]-[\w-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35})(?![A-Za-z0-9])")
_PEM = re.compile(r"-----(?P<side>BEGIN|END) (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{0,200}:(?P<password>[^\s/@]{1,400})@")
_NEXT = re.compile(r"[,;&][\w.-]+=")
_CODE = re.compile(r"(?i)[(\[{<$%]|^[a-z_]\w*(?:\.[a-z_]\w*)+$|^(?:true|false|none|null|nil|undefined|bearer|basic)$")
_SETTING = re.compile(r"^\s*(?:export |set |env |-e |- )?[\w.-]*$")
_REFERENCE = re.compile(r"(?i)(?:commit|revision|rev|sha\d*|md5|hash|checksum|digest|etag|uuid|guid|version|build|integrity)\W*$")
_SAMPLE = re.compile(r"(?i)test|example|sample|mock|fixture|demo")


def _kind(run: str, assigned: bool = False, quoted: bool = False, setting: bool = False) -> str:
    """assigned: to a credential word; of such, code and lone words are told apart."""
    if _ISSUED.fullmatch(run):
        return "issued"
    if run.startswith("-----BEGIN "):
        return "key"
    if re.search(r"@[\w-]+\.", run):
        return "address"
    if re.fullmatch(r"(?:[0-9a-f]+|[0-9A-F]+)", run):
        return "hex"
    if re.search(r"[a-z]\.[a-z]{2,}/|^www\.", run):
        return "place"
    if assigned and not quoted and not any(c.isdigit() for c in run):
        if _CODE.search(run):
            return "code"
        if not setting:
            return "word"
    return "mixed"


def _entropy(run: str) -> float:
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in (run.count(x) for x in set(run)))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _coded(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]


def _count_transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(38 * 38, dtype=np.int64)
    for batch in batches:
        for text in batch["text"]:
            if text:
                c = _coded(text)
                counts += np.bincount(c[:-1] * 38 + c[1:], minlength=38 * 38)
    yield pd.DataFrame({"pair": np.flatnonzero(counts), "n": counts[counts > 0]})


def transitions(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log2 P(class | class before), of all documents, each pair counted once more. 38 rows and columns."""
    counted = docs.select(F.col(text).alias("text")).mapInPandas(_count_transitions, "pair long, n long")
    table = np.ones(38 * 38)
    for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 1,444 rows at most
        table[r.pair] += r.n
    table = table.reshape(38, 38)
    return np.log2(table / table.sum(axis=1, keepdims=True))


def dictionary(docs: DataFrame, text: str = "text", least_docs: int = 3) -> DataFrame:
    """word: words of 4 to 12 letters, lower-cased, that stand alone in least_docs documents or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])\p{L}{%d,%d}(?![\p{L}\p{N}])" % _WORD_LETTERS), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("word")


def features(text: str, path: str, start: int, run: str, table: np.ndarray, assigned: bool = False, quoted: bool = False, setting: bool = False) -> tuple[float, ...]:
    """The features of _FOUND."""
    n, before, coded = len(run), text[max(0, start - 40) : start], _coded(run)
    return (
        float(n),
        sum(c.isdigit() for c in run) / n,
        sum(c.isupper() for c in run) / n,
        _entropy(run),
        sum(_class(a) != _class(b) for a, b in zip(run, run[1:])) / max(n - 1, 1),
        float(table[coded[:-1], coded[1:]].mean()) if len(coded) > 1 else 0.0,
        float(path.count("/")),
        float(bool(_SAMPLE.search(path))),
        float(assigned or bool(_CREDENTIAL.search(before))),
        float(assigned or bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(quoted or (before[-1:] in ("\"", "'") and text[start + n : start + n + 1] == before[-1:])),
        float(setting),
        float(bool(_REFERENCE.search(before))),
    )


def _rare(table: np.ndarray, by: float = 2.0) -> float:
    """`by` bits a character under what letters after letters have on average, each as frequent as the table makes it."""
    each, often = np.exp2(table), np.full(len(table), 1 / len(table))
    for _ in range(200):
        often = often @ each
    pairs = often[:26, None] * each[:26, :26]
    return float((pairs * table[:26, :26]).sum() / pairs.sum()) - by


def _unlikely(run: str, table: np.ndarray, bar: float) -> bool:
    """Whether the run's characters follow each other more rarely than the bar says."""
    c = _coded(run)
    return len(c) > 1 and float(table[c[:-1], c[1:]].mean()) < bar


def _spans(text: str, table: np.ndarray | None = None, bar: float = -np.inf) -> dict[tuple[int, int], tuple[bool, bool, bool]]:
    """(start, end) of the candidates, each with: assigned to a credential word, quoted, in the form of a setting."""
    out = {}
    begun = None
    for m in _PEM.finditer(text):
        if m["side"] == "BEGIN":
            begun = m
            out[m.span()] = (True, False, False)
        elif begun:  # the block whole
            del out[begun.span()]
            out[begun.start(), m.end()] = (True, False, False)
            begun = None
    for m in _URL.finditer(text):
        out[m.span("password")] = (True, False, False)
    for m in _ISSUED.finditer(text):
        out[m.span()] = (False, False, False)
    for m in _ASSIGNED.finditer(text):
        name = m.lastgroup
        start, value = m.start(name), m[name]
        if name == "bare":
            value = _NEXT.split(value, maxsplit=1)[0].rstrip(",;)]}\\")
        if value.strip():
            # NAME=value in capitals, or alone at the start of a line
            stuck = m["sign"] == "=" and name == "bare" and m.end("sign") == start and not text[m.start("sign") - 1].isspace()
            at = max(0, m.start("word") - 80)
            line = text[max(text.rfind("\n", at, m.start("word")) + 1, at) : m.start("sign")]
            setting = stuck and (bool(_SETTING.search(line)) or bool(re.search(r"(?<![\w.])[A-Z][A-Z0-9_]*$", line)))
            out[start, start + len(value)] = (True, name != "bare", setting)
    for m in _RUN.finditer(text):
        if any(c.isdigit() for c in m.group()) or (table is not None and _unlikely(m.group(), table, bar)):
            named = _NAMED.match(m.group())
            out.setdefault((m.start() + (named.end() if named else 0), m.end()), (False, False, False))
    return out


def _finder(table: np.ndarray):
    names, bar = [x.split()[0] for x in FINDINGS.split(", ")], _rare(table)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, path in zip(batch["doc_id"], batch["text"], batch["path"]):
                for (a, b), how in sorted(_spans(text or "", table, bar).items()):
                    run = text[a:b]
                    sha = hashlib.sha256(run.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc, a, b - a, sha, _kind(run, *how), _ALPHA.findall(run.lower()), *features(text, path or "", a, run, table, *how)))
            yield pd.DataFrame(rows, columns=names)

    return find


def _coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """found (with place, a key of its own) with f_covered in place of runs: words are looked for at every place of
    every letter run, and the characters under any of them are counted once."""
    least, most = _WORD_LETTERS
    runs = found.select("place", F.posexplode("runs").alias("k", "run"))
    at = runs.select("place", "k", "run", F.explode(F.sequence(F.lit(1), F.length("run") - least + 1)).alias("p"))
    some = at.select("place", "k", "p", F.explode(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length("run") - F.col("p") + 1)), lambda n: F.substr("run", "p", n))).alias("word"))
    hits = some.join(words, "word").groupBy("place", "k", "p").agg(F.max(F.length("word")).alias("n"))
    none = F.struct(F.lit(0).alias("to"), F.lit(0).alias("sum"))

    def step(done, x):
        end = x["p"] + x["n"]
        return F.struct(F.greatest(done["to"], end).alias("to"), (done["sum"] + F.greatest(F.lit(0), end - F.greatest(done["to"], x["p"]))).alias("sum"))

    spans = hits.groupBy("place", "k").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("s"))
    letters = spans.select("place", F.aggregate("s", none, step, lambda d: d["sum"]).alias("sum")).groupBy("place").agg(F.sum("sum").alias("letters"))
    covered = F.coalesce(F.col("letters") / F.col("length"), F.lit(0.0))
    return found.join(letters, "place", "left").withColumn("f_covered", covered).drop("place", "runs", "letters")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", least_docs: int = 3) -> DataFrame:
    """A row for each candidate: doc_id, start, length, value_sha256 (the value itself isn't copied), kind, features."""
    read = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.col(path).alias("path"))
    found = read.mapInPandas(_finder(transitions(docs, text)), FINDINGS).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
    found = keep(found.withColumn("place", F.monotonically_increasing_id()), "candidates")
    return _coverage(found, dictionary(docs, text, least_docs))


def seed_labels(found: DataFrame) -> DataFrame:
    """found with `label`: 1 for a finding, 0 for a false positive, null where neither is plain."""
    typed = (F.col("f_quoted") == 1) | (F.col("f_setting") == 1) | (F.col("f_digits") > 0)
    yes = ((F.col("f_credential") == 1) & (F.col("f_assigned") == 1) & typed) | F.col("kind").isin("issued", "key")
    no = F.col("kind").isin("address", "place", "code", "word") | (F.col("f_covered") >= 0.5)
    return found.withColumn("label", F.when(yes & ~no, F.lit(1.0)).when(no, F.lit(0.0)))


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(found)


def train(labelled: DataFrame, trees: int = 20, depth: int = 5, sample: int = 20_000, seed: int = 11) -> PipelineModel | None:
    """A forest from findings with `label`, or None where only one label is there."""
    named = labelled.where("label IS NOT NULL").select("label", *[f"f_{f}" for f in FEATURES], "value_sha256", "start")
    some = keep(named.orderBy(F.xxhash64("value_sha256", "start")).limit(sample), "secret-sample")
    if some.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    return forest.fit(_vectors(some))


def score(found: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The findings with `score` and `is_secret`."""
    if model is None:
        return found.withColumn("score", F.coalesce(F.col("label"), F.lit(0.0))).withColumn("is_secret", F.col("score") >= threshold)
    out = model.transform(_vectors(found)).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("score") >= threshold).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", labels: DataFrame | None = None, least_docs: int = 3, **fit) -> DataFrame:
    """Candidates of all documents with labels (given ones, or else seed labels), scores of a forest trained on them,
    and verdicts. labels: doc_id, start and label (1 a secret, 0 not) of some candidates; of several rows for one, the
    largest label holds."""
    found = candidates(docs, doc_id, text, path, least_docs)
    if labels is None:
        found = seed_labels(found)
    else:
        known = labels.groupBy(F.col("doc_id").alias("__id"), F.col("start").alias("__start")).agg(F.max(F.col("label").cast("double")).alias("label"))
        found = found.join(known, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("start") == F.col("__start")), "left").drop("__id", "__start")
    found = keep(found, "findings")
    return score(found, train(found, **fit))
