"""Vector top-k by groups of blocks, against brute force."""

import numpy as np
import pytest

from factloom.operators import vectors


@pytest.mark.parametrize("k,min_score", [(6, None), (6, 0.4), (None, 0.5)])
def test_top_k_of_groups_equals_brute_force(spark, k, min_score):
    """Many blocks and groups; nearly equal and equal scores, a zero vector, an entity of two vectors."""
    rng = np.random.default_rng(67)
    base = rng.standard_normal((700, 8)).astype(np.float32)
    base[400:] = base[:300]
    base[350:400] = base[350] * (1 + 1e-6 * rng.standard_normal((50, 1)))
    base[5] = 0
    rows = [("e", f"v{n:03d}", [float(x) for x in v]) for n, v in enumerate(base)] + [("f", f"v{n:03d}", [float(x) for x in base[n]]) for n in (7, 8)]
    df = spark.createDataFrame(rows, "entity_id string, chunk_id string, embedding array<float>")
    queries = df.withColumnRenamed("chunk_id", "query_id").selectExpr("concat(entity_id, query_id) AS query_id", "entity_id", "embedding")
    got = {}
    for r in vectors.vector_top_k(queries, df, k, min_score, block=16).collect():
        got.setdefault(r.query_id, set()).add((r.chunk_id, r.score))
    want = {}
    for entity, places in (("e", range(700)), ("f", (7, 8))):
        unit = base[list(places)].astype(float)
        norms = np.linalg.norm(unit, axis=1)
        unit /= np.where(norms == 0, np.inf, norms)[:, None]
        scores = np.round(unit @ unit.T, vectors.SCORE_DIGITS) + 0.0
        for i, n in enumerate(places):
            hits = sorted((-scores[i, j], f"v{m:03d}") for j, m in enumerate(places) if min_score is None or scores[i, j] >= min_score)[:k]
            if hits:
                want[f"{entity}v{n:03d}"] = {(name, -score) for score, name in hits}
    assert got == want


def test_a_block_is_not_sent_to_every_block(spark, monkeypatch):
    """Queries are held while vectors pass by: rows sent are blocks times groups of the other side."""
    rng = np.random.default_rng(71)
    rows = [("e", f"v{n:04d}", [float(x) for x in rng.standard_normal(4)]) for n in range(3000)]
    df = spark.createDataFrame(rows, "entity_id string, chunk_id string, embedding array<float>")
    sent, frame = [], type(df)
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(frame, name, lambda self, *a, real=getattr(frame, name), **b: (sent.append(self.count()), real(self, *a, **b))[1])
    assert vectors.vector_top_k(df.withColumnRenamed("chunk_id", "query_id"), df, 3, block=30).count() == 9000
    assert sum(sent) < 4000
