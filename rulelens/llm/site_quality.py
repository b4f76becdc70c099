"""Quality classifier with hierarchical empirical Bayes.

Two logistic models, fitted on a bounded sample of labelled documents, give each document its evidence of quality
and of toxicity from telling words and from the shape of its text. Quality evidence is summed by host and by path
(a host's language section); each site's posterior is a beta mean, a path's shrunk toward its host's and a host's
toward the corpus's, by strengths estimated from the spread between sites. A document's probability adds to its own
evidence what its path says without it: the document is left out of its path, its host and the corpus alike, so a
site of one document says nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save

#: Labelled documents the models are fitted on, at most (those with the least hashes), and telling words kept.
FIT_ROWS, TELLING_WORDS = 6_000, 600
#: How far the site's posterior may move a document's log odds, as a share of the site's own log odds.
SITE_WEIGHT = 0.5
BINS = 8
#: Lengths of the word beginnings that may tell.
PREFIXES = (3, 4, 5, 6, 7)
_TRIM = ".,;:!?\"'()#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>!]")


def terms_of(text: str) -> set[str]:
    """Distinct words, the beginnings of their words (``^``), and beginnings that three words or more share (``^^``)."""
    words = {x.strip(_TRIM) for x in text.lower().split()} - {""}
    starts = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
    return words | {f"^{p}" for p in starts} | {f"^^{p}" for p, n in starts.items() if n > 2}


def shape(text: str) -> list[int]:
    """Binned shares that tell junk: marked words, capitals, repeated words, mean word length, words, bars."""
    raw = text.split()
    n = len(raw) or 1
    letters = sum(map(str.isalpha, text)) or 1
    shares = [
        sum(1 for w in raw if _SYMBOL.search(w)) / n,
        sum(map(str.isupper, text)) / letters,
        1 - len(set(raw)) / n if n < 400 else 1 - (len(set(raw)) / n) * (n / 400) ** 0.4,
        min(1.0, sum(map(len, raw)) / n / 16),
        min(1.0, np.log2(n + 1) / 16),
        raw.count("|") / n,
    ]
    return [min(BINS - 1, int(max(0.0, s) * BINS)) + k * BINS for k, s in enumerate(shares)]


SHAPES = 6 * BINS


def telling_words(sample: DataFrame, label: str, limit: int) -> list[str]:
    """Words whose presence differs most between the labels, by z-score; ties by word."""
    each = sample.select(label, F.explode("words").alias("word"))
    size = sample.groupBy().agg(F.count("*").alias("n"), F.sum(label).alias("n1")).first()
    n, n1 = size["n"] or 1, size["n1"] or 0
    counts = each.groupBy("word").agg(F.count("*").alias("c"), F.sum(label).alias("c1")).where("c >= 8")
    expected = F.col("c") * (n1 / n)
    z = F.abs(F.col("c1") - expected) / F.sqrt(expected * (1 - n1 / n) + 1e-9)
    return [r.word for r in counts.select("word", z.alias("z")).where("z > 4").orderBy(F.desc("z"), "word").limit(limit).collect()]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 400) -> np.ndarray:
    """Logistic regression with an intercept, by gradient steps with momentum."""
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w, v, m = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), np.zeros(x1.shape[1])
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) / max(1, len(y)) + penalty / 10 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _features(text: str, index: dict[str, int]) -> list[int]:
    """Places of a text's features: its shape bins, then its telling words."""
    return shape(text) + sorted(SHAPES + index[w] for w in terms_of(text) & index.keys())


class Models:
    """Telling words and weights of the quality and the toxicity model."""

    def __init__(self, words: list[str], quality: np.ndarray, toxic: np.ndarray):
        self.index = {w: k for k, w in enumerate(words)}
        self.weights = np.stack([quality, toxic])

    def evidence(self, text: str) -> tuple[float, float]:
        at = _features(text, self.index)
        a, b = self.weights[:, at].sum(axis=1) + self.weights[:, -1]
        return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, n_words: int = TELLING_WORDS) -> Models:
    """Models fitted on the ``fit_rows`` labelled documents with the least hashes of doc_id."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))  # fit_rows bounds it

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pylist()
                for r in rows:
                    r["words"], r["shape"] = sorted(terms_of(r["text"])), shape(r.pop("text"))
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("words", pa.list_(pa.string())), ("shape", pa.list_(pa.int32()))]))

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    joined = joined.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"), "text")
    sample = save(joined.mapInArrow(split, "doc_id long, quality int, toxic int, words array<string>, shape array<int>"), "site-sample")
    words = sorted({*telling_words(sample, "toxic", n_words // 2), *telling_words(sample, "quality", n_words // 2)})
    index = {w: k for k, w in enumerate(words)}
    told = F.array_intersect("words", F.array(*map(F.lit, words)).cast("array<string>")) if words else F.array().cast("array<string>")
    rows = sample.select("doc_id", "quality", "toxic", told.alias("told"), "shape").orderBy("doc_id", "quality", "toxic", "told").collect()  # at most fit_rows, few words each
    x = np.zeros((len(rows), SHAPES + len(words)), np.float32)
    for k, r in enumerate(rows):
        x[k, r.shape + [SHAPES + index[w] for w in r.told]] = 1
    return Models(words, fit(x, np.array([r.quality for r in rows], float)), fit(x, np.array([r.toxic for r in rows], float)))


def _strength(groups: DataFrame, prior: Column) -> float:
    """Beta strength by moments: how much of the spread of group means is more than chance."""
    mean = F.col("s") / F.col("n")
    r = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (mean - prior) ** 2).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"), F.sum(F.col("n") * prior * (1 - prior)).alias("most"),
    ).first()
    if not r["n"]:
        return 1.0
    between = (r["spread"] - r["chance"]) / r["n"]
    return float(min(1e6, max(1.0, r["most"] / r["n"] / between - 1))) if between > 0 else 1e6


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def classify(docs: DataFrame, models: Models, host: str = "source", path: str = "lang", site_weight: float = SITE_WEIGHT) -> DataFrame:
    """One row per row of ``docs``: evidence, posteriors, quality and toxic probabilities, and ``kept``.

    A document is kept if its quality is at least one half and its toxicity is below. A null text is empty; null
    hosts and paths are sites of their own; repeated rows stay repeated; an empty table gives no rows; columns
    other than doc_id, text, host and path are ignored.
    """
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [models.evidence(x.as_py()) for x in batch.column("text")]
            columns = [batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array([t[k] for t in told], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "path", "evidence", "toxic"])

    scored = save(rows.mapInArrow(score, f"doc_id {kind}, host string, path string, evidence double, toxic double"), "site-scores")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    scored = scored.withColumns({"_host": name("host"), "_path": name("path"), "p": _sigmoid(F.col("evidence"))})
    paths = save(scored.groupBy("_host", "_path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "site-paths")
    hosts = save(paths.groupBy("_host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "site-hosts")
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = min(1 - 1e-6, max(1e-6, whole["s"] / whole["n"])) if whole["n"] else 0.5
    a = _strength(hosts, F.lit(prior))
    hosts = hosts.select("_host", F.col("s").alias("host_s"), F.col("n").alias("host_n"), ((F.col("s") + a * prior) / (F.col("n") + a)).alias("host_posterior"))
    sites = save(paths.join(hosts, "_host"), "site-sites")
    b = _strength(sites, F.col("host_posterior"))
    sites = save(sites.select("_host", "_path", "s", "n", "host_s", "host_n", "host_posterior", ((F.col("s") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior")), "site-posteriors")
    joined = checked_join(scored, sites, ["_host", "_path"])
    # What corpus, host and path say without the document itself.
    rest = lambda s, n, weight, prior: (s - F.col("p") + weight * prior) / (n - 1 + weight)
    corpus = (F.lit(whole["s"]) - F.col("p")) / (whole["n"] - 1) if (whole["n"] or 0) > 1 else F.lit(0.5)
    others = rest(F.col("s"), F.col("n"), b, rest(F.col("host_s"), F.col("host_n"), a, corpus))
    quality = _sigmoid(F.col("evidence") + site_weight * (_logit(others) - _logit(corpus)))
    return joined.select(
        "doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", quality.alias("quality"), _sigmoid(F.col("toxic")).alias("toxic"),
        ((quality >= 0.5) & (F.col("toxic") < 0)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = None
