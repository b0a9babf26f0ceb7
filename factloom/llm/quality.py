"""Quality by hierarchical empirical Bayes.

A document classifier gives the evidence of the text itself (low quality and
toxicity). Hosts and the paths below them have posterior rates: grouped sums of
that evidence over all documents, shrunk from path to host to the global rate,
the more the sparser the site. A document's log odds add both: the text's own,
and what its site's posterior, from the site's other documents, says beyond the
global rate. Shrinkage alone limits what a sparse site can say.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hidden, map_batches, strings
from factloom.session import cut

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents of each class that the document classifier is fitted on, on average.
SAMPLE = 10_000
#: A lexicon entry stands in this share of the toxic sample at least, so the
#: lexicon has at most (distinct words and prefixes of a document) / share
#: entries; its log odds are this high even a deviation below the estimate.
SHARE, LOG_ODDS = 0.004, 1.0
#: Words that share a stem count together by their first letters.
PREFIXES = (4, 5)
BINS = 12
TARGETS = ("low", "toxic")
FEATURES = ("lexicon", "strongest", "lexicon_share", "distinct", "punctuation", "upper", "digits", "spaces", "word_length", "top_word", "lines", "log_words", "other")


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Shape of the whole text, and its lexicon weight."""
    ws = WORD.findall(text.lower())
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    count = np.bincount(data, minlength=256)
    n = max(len(data), 1)
    own = Counter(ws)
    hit = own.keys() & lexicon.keys()
    if lexicon:
        for k in PREFIXES:
            hit |= {w[:k] + "*" for w in own if len(w) > k} & lexicon.keys()
    weight = sum(lexicon[w] for w in hit)
    m = max(len(ws), 1)
    top = max(own.values(), default=0) / m
    lines = [x for x in text.split("\n") if x]
    digits, upper, lower = count[48:58].sum(), count[65:91].sum(), count[97:123].sum()
    spaces = count[[9, 10, 11, 12, 13, 32]].sum()
    punctuation = count[33:127].sum() - digits - upper - lower
    return [
        weight, sum(sorted((lexicon[w] for w in hit), reverse=True)[:3]), weight / m, len(own) / m, punctuation / n, upper / max(upper + lower, 1), digits / n, spaces / n,
        sum(map(len, ws)) / m, top, len(set(lines)) / max(len(lines), 1), float(np.log1p(len(ws))), count[:32].sum() / n,
    ]


class Classifier:
    """Logistic regression over binned features, one set of weights per target."""

    def __init__(self, lexicon: dict[str, float], edges: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.lexicon, self.edges, self.weights, self.bias = lexicon, edges, weights, bias

    def design(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), x.shape[1] * (BINS + 1)), dtype=np.float32)
        for f in range(x.shape[1]):
            out[np.arange(len(x)), f * (BINS + 1) + np.searchsorted(self.edges[f], x[:, f], side="right")] = 1
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights + self.bias

    @classmethod
    def fit(cls, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 400) -> Classifier:
        """``y`` has a column per target, ``w`` weights the rows."""
        edges = np.stack([np.quantile(x[:, f], np.linspace(0, 1, BINS + 2)[1:-1]) for f in range(x.shape[1])])
        self = cls(lexicon, edges, np.zeros((x.shape[1] * (BINS + 1), y.shape[1])), np.zeros(y.shape[1]))
        a = self.design(x).astype(np.float64)
        w = w / w.sum()
        step = 4.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ self.weights + self.bias, -30, 30)))
            g = (p - y) * w[:, None]
            self.weights -= step * (a.T @ g + 1e-4 * self.weights)
            self.bias -= step * g.sum(axis=0)
        return self


def _longer(n: int):
    return lambda w: F.length(w) > n


def _stem(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


def toxic_lexicon(sample: DataFrame, share: float = SHARE, least: float = LOG_ODDS) -> dict[str, float]:
    """Words that stand in toxic texts far more often than in others, with log odds."""
    distinct = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = [F.transform(F.filter(distinct, _longer(n)), _stem(n)) for n in PREFIXES]
    words = sample.select("toxic", F.explode(F.array_distinct(F.concat(distinct, *stems))).alias("word")).filter("word <> ''")
    totals = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    t, c = totals.t or 0, totals.c or 0
    if not t or not c:
        return {}
    found = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter(F.col("t") >= max(5, share * t))
    own, others = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(own / (t + 1.0)) - F.log(others / (c + 1.0)) - F.sqrt(1 / own + 1 / others)
    return {r.word: r.odds for r in found.select("word", odds.alias("odds")).filter(F.col("odds") >= least).collect()}


def _features(rows: DataFrame, columns: list[str], lexicon: dict[str, float]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t, held.value) for t in strings(batch, "text")]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return map_batches(rows.select(*columns, "text"), run, f"{fields}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Classifier from labelled documents; None without labelled rows.

    A null label is 0 for toxicity and 1 for quality; labels of one document
    that contradict each other count as toxic and as low quality. About
    ``sample`` rows of each class are read, weighted back to all of them.
    """
    own = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), (1 - F.min(F.coalesce("quality", F.lit(1)))).alias("low"))
    sizes = own.groupBy("toxic", "low").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    picked = own.join(sizes, ["toxic", "low"]).filter(share * F.col("n") < sample).select("doc_id", "toxic", "low", F.greatest(F.lit(1.0), F.col("n") / sample).alias("w"))
    # Four classes of about ``sample`` small rows: a bound on what is broadcast.
    chosen = cut(docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id"))
    lexicon = toxic_lexicon(chosen)
    rows = _features(chosen, ["low", "toxic", "w"], lexicon).collect()
    if not rows:
        return None
    x = np.array([r.x for r in rows])
    order = np.lexsort(x.T[::-1])  # the order of arrival must not matter
    y = np.array([[r.low, r.toxic] for r in rows], dtype=np.float64)
    return Classifier.fit(lexicon, x[order], y[order], np.array([r.w for r in rows])[order])


def evidence(docs: DataFrame, model: Classifier | None, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, digest, host, path, low, toxic): log odds of each document's text."""
    rows = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text",
    )
    columns = ["doc_id", "digest", "host", "path"]
    if model is None:
        return rows.select(*columns, F.lit(0.0).alias("low"), F.lit(0.0).alias("toxic"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held.value
        texts = strings(batch, "text")
        odds = own.log_odds(np.array([features(t, own.lexicon) for t in texts]))
        empty = np.array([not t.strip() for t in texts])
        odds[empty] = (20.0, -20.0)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(np.round(odds[:, i], 6).astype(np.float64)) for i in range(2)]], [*columns, *TARGETS])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return map_batches(rows, run, f"{fields}, low double, toxic double")


def _rate(odds) -> F.Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))


def _logit(p) -> F.Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, and per target the path, host and global rates, with the sums and strengths behind them).

    The strength of each prior is the method of moments over the groups below
    it: p(1 - p) / between-group variance - 1, kept within 1 and 10,000.
    """
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(_rate(F.col(t))).alias(t) for t in TARGETS]]
    paths = cut(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS])
    world = hosts.agg(*[(F.sum(t) / F.sum("n")).alias(t) for t in TARGETS]).first().asDict()
    world = {t: F.lit(float(world[t] or 0.0)) for t in TARGETS}

    def strength(groups: DataFrame, prior: dict) -> dict:
        moments = []
        for t in TARGETS:
            spread = F.sum(F.col("n") * F.pow(F.col(t) / F.col("n") - prior[t], 2)) / F.sum("n")
            level = F.sum(F.col("n") * prior[t] * (1 - prior[t])) / F.sum("n")
            moments.append(F.least(F.greatest(level / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e4)).alias(t))
        found = groups.agg(*moments).first().asDict()
        return {t: F.lit(float(found[t] or 1.0)) for t in TARGETS}

    shrunk = lambda t, k, prior: (F.col(t) + k[t] * prior[t]) / (F.col("n") + k[t])
    k_host = strength(hosts, world)
    host = hosts.select("host", F.col("n").alias("host_n"), *[F.col(t).alias(f"host_sum_{t}") for t in TARGETS], *[shrunk(t, k_host, world).alias(f"host_{t}") for t in TARGETS])
    at_path = paths.join(host, "host")
    above = {t: F.col(f"host_{t}") for t in TARGETS}
    k_path = strength(at_path, above)
    return at_path.select(
        "host", "path", "n", "host_n", *[F.col(t).alias(f"sum_{t}") for t in TARGETS], *[f"host_sum_{t}" for t in TARGETS], *[world[t].alias(f"world_{t}") for t in TARGETS], *above.values(),
        *[shrunk(t, k_path, above).alias(f"path_{t}") for t in TARGETS], *[k_host[t].alias(f"k_host_{t}") for t in TARGETS], *[k_path[t].alias(f"k_path_{t}") for t in TARGETS],
    )


def others_rate(t: str) -> F.Column:
    """Posterior rate of a row's path from all documents but the row itself, through host and global rate."""
    own = _rate(F.col(t))
    host = (F.greatest(F.col(f"host_sum_{t}") - own, F.lit(0.0)) + F.col(f"k_host_{t}") * F.col(f"world_{t}")) / (F.col("host_n") - 1 + F.col(f"k_host_{t}"))
    return (F.greatest(F.col(f"sum_{t}") - own, F.lit(0.0)) + F.col(f"k_path_{t}") * host) / (F.col("n") - 1 + F.col(f"k_path_{t}"))


def score_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, digest, low, toxic, site_low, site_toxic, p_low, p_toxic, keep) per row.

    ``low`` and ``toxic`` are the text's rates, ``site_*`` those of its path,
    ``p_*`` both together; ``keep`` wants both under a half. Empty and null
    texts are low quality. Null hosts and paths are sites of their own;
    repeated rows stay, and each is a document of its site; without labels every
    text counts as undecided and stays. Whole texts are read, however long; ties
    at a half are rejected. Other columns are not read or returned.
    """
    model = fit(docs, labels)
    scored = cut(evidence(docs, model, host, path))
    sites = site_posteriors(scored)
    joined = scored.join(sites, ["host", "path"])
    both = {t: _rate(F.col(t) + _logit(others_rate(t)) - _logit(F.col(f"world_{t}"))) for t in TARGETS}
    undecided = F.lit(model is None)
    return joined.select(
        "doc_id", "digest", *[F.round(_rate(F.col(t)), 6).alias(t) for t in TARGETS], *[F.round(f"path_{t}", 6).alias(f"site_{t}") for t in TARGETS],
        *[F.round(both[t], 6).alias(f"p_{t}") for t in TARGETS], (undecided | ((both["low"] < 0.5) & (both["toxic"] < 0.5))).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` without the rows that are rejected; all columns stay."""
    bad_id, bad_digest, digest = hidden("bad_id", "bad_digest", "digest")
    bad = score_documents(docs, labels, host, path).filter("not keep").select(F.col("doc_id").alias(bad_id), F.col("digest").alias(bad_digest)).distinct()
    own = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(bad, own["doc_id"].eqNullSafe(bad[bad_id]) & (own[digest] == bad[bad_digest]), "left_anti").drop(digest)
