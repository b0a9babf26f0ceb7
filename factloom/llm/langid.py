"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams. Every
language has several centroids (spherical k-means over a bounded sample of
labelled texts). A text takes the language of the nearest one by cosine, and is
rejected if that distance is larger than the language's own texts show.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import map_batches, strings
from factloom.session import cut

UNKNOWN = "und"
DIMENSIONS = 1 << 13
GRAMS = (1, 2, 3)
#: Distinct labelled texts of a language that the centroids are fitted on, at most.
SAMPLE = 400
CLUSTERS = 4
ROUNDS = 8
#: Share of a language's own texts that lies within its rejection distance.
WITHIN = 0.995
#: Code points whose n-grams are hashed at once.
BLOCK = 1 << 18


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams of the whole text; None without a letter.

    Letters are folded to lower case, every run of other characters to a space.
    """
    counts = np.zeros(DIMENSIONS, dtype=np.float64)
    lower = text.lower()
    if not any(c.isalpha() for c in lower):
        return None
    for at in range(0, len(lower), BLOCK):
        # Blocks overlap by the n-gram length, so none is lost; inner ones count once.
        part = lower[max(0, at - GRAMS[-1] + 1) : at + BLOCK]
        skip = at - max(0, at - GRAMS[-1] + 1)
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        codes = np.where((codes < 97) | ((codes > 122) & (codes < 170)), np.uint64(32), codes)
        run = codes.copy()
        for n in range(1, GRAMS[-1] + 1):
            if n > 1:
                run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            if n in GRAMS:
                mixed = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
                slots = ((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(51)).astype(np.int64)
                counts += np.bincount(slots[max(0, skip - n + 1) :], minlength=DIMENSIONS)
    return counts


def unit_rows(texts: list[str], idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows, and which texts have a letter."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    known = np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        counts = gram_counts(t)
        if counts is not None:
            known[i] = True
            row = np.log1p(counts) if idf is None else np.log1p(counts) * idf
            out[i] = row / max(np.sqrt((row * row).sum()), 1e-12)
    return out, known


def spherical_centroids(rows: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts at rows far from the ones chosen before."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = rows[own == c].sum(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


class Model:
    """Centroids by language, IDF weights and rejection cosines."""

    def __init__(self, langs: list[str], centres: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.langs, self.centres, self.floors, self.idf = langs, centres, floors, idf

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest language, cosine, and whether it is within the distance."""
        rows, known = unit_rows(texts, self.idf)
        if not len(self.langs):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        cosine = rows @ self.centres.T
        best = np.argmax(cosine, axis=1)
        score = np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0).astype(np.float64)
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return langs, score, known & (score >= self.floors[best])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from labelled(text, lang); rows without either are left out.

    A language gives the ``sample`` of its distinct texts whose hashes are
    smallest, all of them if it has fewer: copies of a text neither crowd others
    out nor weigh more, however many rows they have.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("hash"))
    ranked = rows.select("lang", "hash").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
    picked = cut(ranked.filter(F.col("rank") <= sample).select("lang", "hash"))
    chosen = cut(rows.join(picked, ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text")))

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(DIMENSIONS)
        n = 0
        for t in pdf["text"]:
            if (counts := gram_counts(t)) is not None:
                found += counts > 0
                n += 1
        return pd.DataFrame({"n": [n], "found": [found]})

    parts = chosen.groupBy("lang").applyInPandas(frequencies, "n bigint, found array<double>").collect()
    total = sum(r.n for r in parts)
    found = np.sum([r.found for r in parts], axis=0) if parts else np.zeros(DIMENSIONS)
    idf = np.log((1 + total) / (1 + found)) + 1

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, known = unit_rows(sorted(pdf["text"]), idf)
        rows = rows[known]
        if not len(rows):
            return pd.DataFrame({"lang": [], "floor": [], "centre": []})
        centres = spherical_centroids(rows)
        floor = float(np.quantile((rows @ centres.T).max(axis=1), 1 - WITHIN)) * 0.9
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "floor": floor, "centre": list(centres.astype(np.float64))})

    fitted = sorted(chosen.groupBy("lang").applyInPandas(centroids, "lang string, floor double, centre array<double>").collect(), key=lambda r: (r.lang, tuple(r.centre)))
    centres = np.array([r.centre for r in fitted], dtype=np.float32).reshape(-1, DIMENSIONS)
    return Model([r.lang for r in fitted], centres, np.array([r.floor for r in fitted]), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) per row of docs(doc_id, text).

    Null texts and texts without a letter are ``und`` with score 0; so are all
    texts when nothing was learned. Repeated rows are each answered; of equal
    cosines the language first in the alphabet wins. Texts of any length are
    read whole, in blocks. Other columns are not read or returned. ``accepted`` is false where the distance to
    the nearest centroid is larger than the language's own texts show.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.centres, model.floors, model.idf))
    step = 200

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Model(*held.value)
        langs: list[str] = []
        scores, inside = [], []
        texts = strings(batch, "text")
        for at in range(0, len(texts), step):
            a, b, c = own.predict(texts[at : at + step])
            langs += a
            scores.append(b)
            inside.append(c)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(inside))], ["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
