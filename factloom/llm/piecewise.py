"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece where it matches a mask; the
pieces' hashes, one character each, are the signature. A fingerprint holds the
signatures at a block size and at its double, so texts of similar length can be
compared by edit distance at a block size both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
CONTEXT = 7
MULTIPLIER = 0x01000193
PIECES = 64
#: Documents of one sorted run; the next document is found within it.
RUN = 2000
#: Runs at most, as their bounds stand in the plan; beyond RUN times that, runs grow. A run is read as a stream.
MOST_RUNS = 20_000


def rolling(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the last seven bytes at every position."""
    wide = data.astype(np.uint32)
    out = wide.copy()
    factor = 1
    for back in range(1, min(CONTEXT, len(data))):
        factor = factor * MULTIPLIER & 0xFFFFFFFF
        out[back:] += wide[:-back] * np.uint32(factor)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    out *= np.uint32(0x297A2D39)
    out ^= out >> np.uint32(15)
    return out


def fingerprint(text: str) -> str:
    """``block:signature:signature at the double block``; an empty text has none."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return "2::"
    roll = rolling(data)
    k = 1
    while PIECES << k < len(data):
        k += 1
    low = max(1, k - 2)
    ends = np.flatnonzero((roll & np.uint32((1 << low) - 1)) == (1 << low) - 1)
    at = lambda j: ends[(roll[ends] & np.uint32((1 << j) - 1)) == (1 << j) - 1]
    while k > low and len(at(k)) < PIECES // 2:
        k -= 1
    return f"{1 << k}:{_signature(roll, at(k))}:{_signature(roll, at(k + 1))}"


def _signature(roll: np.ndarray, ends: np.ndarray) -> str:
    starts = np.concatenate(([0], ends + 1))
    if starts[-1] == len(roll):
        starts = starts[:-1]
    sums = np.add.reduceat(roll, starts, dtype=np.uint32)
    return ALPHABET[(sums * np.uint32(0x9E3779B1)) >> np.uint32(26)].tobytes().decode()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a bit-parallel column at a time."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << len(a) - 1
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 for block sizes that have nothing in common."""
    if a == b:
        return 1.0
    (ka, fine_a, rough_a), (kb, fine_b, rough_b) = a.split(":"), b.split(":")
    if ka == kb:
        x, y = fine_a, fine_b
    elif int(ka) == 2 * int(kb):
        x, y = fine_a, rough_b
    elif int(kb) == 2 * int(ka):
        x, y = rough_a, fine_b
    else:
        return 0.0
    return 1.0 - edit_distance(x, y) / max(len(x), len(y), 1)


SCHEMA = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row of docs(doc_id, text); null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def runs_with_next(docs: DataFrame, size: int = RUN) -> DataFrame:
    """Rows (run, part, doc_id, text) in sorted runs by integer doc_id.

    Runs start at quantiles of doc_id. The document a run starts with also goes
    to the run before it (part 1), and the first document of all to the last
    run, so that every document's successor lies in its own run. Null ids come
    first, equal ids in the order of their texts' hashes. ``doc_id`` must be an
    integer column.
    """
    least = -(1 << 63)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("key"))
    stats = keyed.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).first()
    count = min(max(1, -(-stats.n // size)), MOST_RUNS)
    cuts = []
    if count > 1:
        at = [i / count for i in range(1, count)]
        found = keyed.agg(F.percentile_approx("key", at, max(10_000, 20 * count)).alias("cuts")).first().cuts
        cuts = sorted({c for c in found if c > stats.least})
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    # Binary search: the number of cuts at or below the key.
    narrow = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
        F.when(F.try_element_at(edges, (F.floor((acc["lo"] + acc["hi"]) / 2) + 1).cast("int")) <= F.col("key"), F.struct((F.floor((acc["lo"] + acc["hi"]) / 2) + 1).cast("int").alias("lo"), acc["hi"].alias("hi")))
        .otherwise(F.struct(acc["lo"].alias("lo"), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi")))
    )
    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    run = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), narrow)["lo"] if cuts else F.lit(0)
    placed = keyed.withColumn("run", run)
    place = lambda r, part: F.struct(r.cast("int").alias("run"), F.lit(part).alias("part"))
    opens = (F.col("run") > 0) & (F.try_element_at(edges, F.col("run")) == F.col("key")) if cuts else F.lit(False)
    places = F.filter(
        F.array(place(F.col("run"), 0), F.when(opens, place(F.col("run") - 1, 1)), F.when(F.col("key") == F.lit(stats.least if stats.least is not None else least), place(F.lit(len(cuts)), 2))),
        lambda p: p.isNotNull(),
    )
    dealt = placed.select(F.explode(places).alias("p"), "key", "doc_id", "text").select("p.run", "p.part", "key", "doc_id", "text")
    return dealt.repartition("run").sortWithinPartitions("run", "part", "key", F.xxhash64("text")).select("run", "part", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, size: int = RUN) -> DataFrame:
    """Per row: doc_id and ``SCHEMA``, the text against an edited copy and the next text.

    The edited copy has its last quarter of code points (rounded down) replaced
    by the first as many of the next document in the order of doc_id; the last
    document is followed by the first, a single one by itself. Null texts are
    empty; an empty table gives no rows. Repeated rows follow one another. Texts
    of any length are read whole, one at a time beside their successor. Other
    columns are not read or returned.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (run, doc_id, text, fingerprint) that waits for its successor
        for batch in batches:
            rows: list[tuple] = []
            for r, part, doc, text in zip(*[batch.column(c).to_pylist() for c in ("run", "part", "doc_id", "text")], strict=True):
                if part and (held is None or held[0] != r):
                    continue
                text = text or ""
                own = fingerprint(text)
                if held is not None and held[0] == r:
                    rows.append(_row(held, text, own))
                    held = None
                if not part:
                    held = (r, doc, text, own)
            if rows:
                cols = list(zip(*rows, strict=True))
                names = ["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]]
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return runs_with_next(docs, size).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def _row(held: tuple, text: str, next_fingerprint: str) -> tuple:
    _, doc, own, mark = held
    quarter = len(own) // 4
    edited = own[: len(own) - quarter] + text[:quarter]
    changed = fingerprint(edited)
    return doc, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, next_fingerprint)
