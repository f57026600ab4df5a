"""Quality classifier by hierarchical empirical Bayes.

1. Evidence: two sparse (L1) logistic regressions (good quality, toxic) over hashed words, the hashed beginnings of
   words (their share of the text, scaled by how it varies, so that forms of one stem add up) and shape features give each document its
   log-odds. They are fitted on at most `sample` labelled documents, the first by hash; that many rows are the bound
   of what is broadcast to meet the texts.
2. Sites: a document's host and path. Sums of the documents' probabilities are grouped by path and by host. At each
   level the variance between sites, less what sampling alone gives (analysis of variance, from grouped sums), and the
   variance within them give the strength of a Beta prior, in documents. A host is shrunk toward the global share, a
   path toward its host's posterior, so a sparse site says little of its own. A document is left out of its own site's
   sums: it is no evidence for itself, and the only document of a site has the prior of the level above.
3. A document's posterior log-odds are its evidence with the global share taken out and its path's posterior put in,
   for quality and for toxicity.

The texts are read once for the scores, which are written with ids and sites; all grouping is on those. Sites with a
third of all rows are pre-aggregated, and their join back is one row a site against many, which AQE can split.

Null and empty texts have no words and only the intercept as evidence. Null hosts and paths are sites too. Rows that
share an id are scored each. Where no documents with both labels are at hand, evidence is 0 (quality unknown: kept).
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# The shape features, as SQL over `words` (array) and `t` (text).
_SHAPES = {
    "s_words": "log1p(size(words))",
    "s_length": "char_length(t) / (1 + size(words))",
    "s_distinct": "size(array_distinct(words)) / (1 + size(words))",
    "s_signs": "regexp_count(t, '[#*$%&|<>!]') / (1 + size(words))",
    "s_lines": "regexp_count(t, '\\\\n') / (1 + size(words))",
    "s_capitals": "regexp_count(t, '[A-Z]') / (1 + char_length(t))",
}
STEM = 5  # letters of a word's beginning


def _features(buckets: int) -> list:
    columns = ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in _SHAPES.items())
    return [
        SQLTransformer(statement=f"SELECT *, transform(words, w -> left(w, {STEM})) AS stems, {columns} FROM __THIS__"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=buckets, binary=True),
        HashingTF(inputCol="stems", outputCol="stem_tf", numFeatures=buckets),
        Normalizer(inputCol="stem_tf", outputCol="stem_share"),
        StandardScaler(inputCol="stem_share", outputCol="stem_scaled"),
        VectorAssembler(inputCols=list(_SHAPES), outputCol="shapes"),
        StandardScaler(inputCol="shapes", outputCol="scaled", withMean=True),
        VectorAssembler(inputCols=["tf", "stem_scaled", "scaled"], outputCol="features"),
    ]


def _words(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("t", t).withColumn("words", F.split(F.lower("t"), r"[\p{Punct}\x20\x09-\x0D]+"))


def train(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, sample: int = 6_000, seed: int = 5, penalty: tuple[float, float] = (0.002, 0.005)) -> dict[str, PipelineModel]:
    """Models by label name, those labels only that have both values. docs: doc_id, text; labels: doc_id, quality, toxic."""
    named = labels.where("doc_id IS NOT NULL").select("doc_id", "quality", "toxic")
    some = keep(named.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality", "toxic").limit(sample), "label-sample")
    rows = keep(_words(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).select("t", "words", "quality", "toxic"), "labelled")
    out, shared = {}, None
    for name, reg in zip(("quality", "toxic"), penalty):
        known = rows.where(F.col(name).isNotNull())
        if known.select(name).distinct().count() < 2:
            continue
        shared = shared or Pipeline(stages=_features(buckets)).fit(known)
        fit = LogisticRegression(featuresCol="features", labelCol=name, regParam=reg, elasticNetParam=1.0, maxIter=30, tol=1e-4, standardization=False, rawPredictionCol=f"raw_{name}", probabilityCol=f"p_{name}", predictionCol=f"is_{name}")
        out[name] = PipelineModel(stages=[shared, fit.fit(shared.transform(known))])
    return out


def evidence(docs: DataFrame, models: dict[str, PipelineModel], host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, log-odds `quality` and `toxic`; 0 and null where there is no model."""
    rows = _words(docs.select("doc_id", "text", host.alias("host"), path.alias("path")))
    if models:
        first = next(iter(models.values()))
        rows = first.stages[0].transform(rows)
        for model in models.values():
            rows = model.stages[1].transform(rows)
    raw = lambda n, other: vector_to_array(f"raw_{n}")[1] if n in models else F.lit(other).cast("double")
    return rows.select("doc_id", "host", "path", raw("quality", 0.0).alias("quality"), raw("toxic", None).alias("toxic"))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(q / (1 - q))


def _strength(within: float, between: float) -> float:
    """The prior's weight in documents: the variance within sites over the one between them, between 1 and 1e6."""
    return min(1e6, max(1.0, within / between)) if between > 0 and within > 0 else 1e6


def sites(scored: DataFrame, score: str = "quality") -> tuple[DataFrame, dict[str, float]]:
    """(a row for each host and path: n, s and the host's hn, hs; the global share and the strengths of the priors of
    hosts and paths). score: a column of log-odds; s and hs are sums of probabilities."""
    p = _sigmoid(F.col(score))
    by_path = keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss")), "paths")
    by_host = by_path.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    by_host = keep(by_host, "hosts")
    squares = lambda s, n: F.sum(F.col(s) * F.col(s) / F.col(n))
    total = by_path.agg(F.count(F.lit(1)), F.sum("n"), F.sum("s"), F.sum("ss"), squares("s", "n")).first()
    k_paths, n, s, ss, paths = (float(x or 0) for x in total)
    k_hosts, hosts, n_paths, n_hosts = (float(x or 0) for x in by_host.agg(F.count(F.lit(1)), squares("hs", "hn"), F.sum(F.col("nn") / F.col("hn")), F.sum(F.col("hn") * F.col("hn"))).first())
    mean = s / n if n else 0.5
    prior = {"mean": mean}
    # sums of squares of documents, paths and hosts, with the documents that a site has on average
    for level, below, above, k_below, k_above, a_site in (("host", hosts, s * mean, k_hosts, 1.0, n - n_hosts / max(n, 1)), ("path", paths, hosts, k_paths, k_hosts, n - n_paths)):
        within = (ss - below) / (n - k_below) if n > k_below else mean * (1 - mean)
        between = (below - above) / (k_below - k_above) - within if k_below > k_above else 0.0
        prior[level] = _strength(within, between * (k_below - k_above) / a_site if a_site > 0 else 0.0)
    return by_path.join(by_host.drop("nn"), F.col("host").eqNullSafe(F.col("h"))).drop("h", "ss"), prior


def posterior(prior: dict[str, float], p: Column, n: str = "n", s: str = "s", hn: str = "hn", hs: str = "hs") -> tuple[Column, Column]:
    """(host's, path's posterior share) for a document of probability p that is left out of the sums."""
    host = (F.col(hs) - p + prior["host"] * prior["mean"]) / (F.col(hn) - 1 + prior["host"])
    return host, (F.col(s) - p + prior["path"] * host) / (F.col(n) - 1 + prior["path"])


def _with_sites(scored: DataFrame, score: str) -> DataFrame:
    """scored with p_<score> (evidence alone), host_<score>, path_<score> and post_<score>."""
    at, prior = sites(scored, score)
    named = at.select(F.col("host").alias("__h"), F.col("path").alias("__p"), *[F.col(c).alias(f"__{c}") for c in ("n", "s", "hn", "hs")])
    joined = scored.join(named, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    p = _sigmoid(F.col(score))
    host, path = posterior(prior, p, "__n", "__s", "__hn", "__hs")
    post = _sigmoid(F.col(score) - _logit(F.lit(prior["mean"])) + _logit(path))
    added = {f"p_{score}": p, f"host_{score}": host, f"path_{score}": path, f"post_{score}": post}
    return joined.withColumns(added).drop("__h", "__p", "__n", "__s", "__hn", "__hs")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, toxic_threshold: float = 0.5, **fit) -> DataFrame:
    """Per document: doc_id, host, path, p_doc (evidence alone), path_p, p_quality (posterior), p_toxic (posterior),
    keep."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    models = train(docs, labels, **fit)
    scored = keep(evidence(docs, models, host, path), "evidence")
    out = _with_sites(scored, "quality")
    out = _with_sites(out, "toxic") if "toxic" in models else out.withColumn("post_toxic", F.lit(0.0))
    good = (F.col("post_quality") >= threshold - 1e-9) & (F.col("post_toxic") < toxic_threshold)
    return out.select(
        "doc_id", "host", "path", F.col("p_quality").alias("p_doc"), F.col("path_quality").alias("path_p"), F.col("post_quality").alias("p_quality"), F.col("post_toxic").alias("p_toxic"), good.alias("keep")
    )
