"""Near duplicates by SimHash and the generalised pigeonhole principle.

Correlated bits of a fingerprint share a part, every part gets a threshold of
its own, and two fingerprints within the whole distance must come within the
threshold in at least one part. Thresholds are allotted by dynamic programming
on candidate counts estimated from all fingerprints. Parts are probed with all
flip patterns up to their threshold; what meets is verified on all bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hidden, map_batches, settled, strings
from factloom.operators.graph import components
from factloom.session import cut

BITS = 64
SEED = 42
#: Fingerprints of a packed row; a bucket of any size is split into such rows.
PACK = 1024
#: Hashes that are unpacked into bits at once.
BLOCK = 1 << 16
#: Largest threshold of a part; its flip patterns are literals of the plan.
MOST_FLIPS = 3
#: Cost model in microseconds: a probe row through the shuffles, a comparison.
ROW_COST, PAIR_COST = 2.0, 0.01


def words(text: str) -> list[bytes]:
    """Words without ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes], k: int) -> list[bytes]:
    """Runs of k words, repeats included; a shorter text is one run."""
    if len(ws) <= k:
        return [b" ".join(ws)] if ws else []
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def vote(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """Bits set in over half of the (weighted) hashes; 0 without hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    total = 0
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if weights is None:
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(part)
        else:
            w = weights[at : at + BLOCK]
            counts += w @ bits.astype(np.int64)
            total += int(w.sum())
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _hashes(items: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in items), dtype=np.uint64, count=len(items))


def shingle_fingerprint(text: str, k: int, seed: int = SEED) -> int:
    return vote(_hashes(shingles(words(text), k), seed))


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp bigint) of every row of docs(doc_id, text); null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([shingle_fingerprint(t, shingle_words) for t in strings(batch, "text")], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint")


# --- plan of the index ------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Row count and the 64 x 64 counts of bits set together, over all rows.

    Each task adds up its rows; 4,097 sums leave it and meet by position.
    """

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        flat = np.concatenate((both.ravel(), [n]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["pos", "v"])

    rows = fps.select("fp").mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.pos] = r.v
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of near-equal size, each grown by its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(BITS)), []
    for i in range(parts):
        size = -(-len(left) // (parts - i))
        own = [max(sorted(left), key=lambda b: sum(corr[b, x] for x in left))]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(left), key=lambda b: sum(corr[b, x] for x in own))
            own.append(nxt)
            left.discard(nxt)
        out.append(sorted(own))
    return out


def allot(n: int, both: np.ndarray, parts: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with sum(t + 1) = distance + 1; t = -1 leaves a part out."""
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    need = distance + 1
    best = {0: (0.0, [])}
    for bits in parts:
        near = np.zeros(need + 1)
        near[0] = 1.0
        for b in bits:  # chance that a random pair differs in exactly d bits of the part
            near = near * agree[b] + np.concatenate(([0.0], near[:-1])) * (1 - agree[b])
        cost = [0.0]
        for t in range(min(need, MOST_FLIPS + 1)):
            probes = n * (1 + sum(comb(len(bits), i) for i in range(t + 1)))
            cost.append(ROW_COST * probes + PAIR_COST * n * n * float(near[: t + 1].sum()))
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for more, extra in enumerate(cost):
                if used + more <= need and (used + more not in nxt or c + extra < nxt[used + more][0]):
                    nxt[used + more] = (c + extra, [*ts, more - 1])
        best = nxt
    return best[need]


def plan(fps: DataFrame, distance: int) -> list[tuple[int, list[int]]]:
    """(mask of a part, flip patterns to probe) of the cheapest division."""
    n, both = bit_statistics(fps)
    choices = []
    # Fewer parts cannot hold the distance, more would leave some out anyway.
    for count in range(-(-(distance + 1) // (MOST_FLIPS + 1)), max(2, distance + 1) + 1):
        parts = group_bits(n, both, count)
        cost, ts = allot(n, both, parts, distance)
        choices.append((cost, parts, ts))
    _, parts, ts = min(choices, key=lambda x: x[0])
    signed = lambda bits: int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])
    return [(signed(bits), [signed(f) for r in range(t + 1) for f in combinations(bits, r)]) for bits, t in zip(parts, ts, strict=True) if t >= 0]


# --- links ------------------------------------------------------------------


def _spanning(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links with the connectivity of ``near`` (rows a, columns b)."""
    i, j = np.nonzero(near)
    if len(i) <= 2 * (len(a) + len(b)):
        return a[i], b[j]
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        new = label.copy()
        np.minimum.at(new, ia, np.where(near, lb[None, :], len(nodes)).min(axis=1, initial=len(nodes)))
        np.minimum.at(new, ib, np.where(near, la[:, None], len(nodes)).min(axis=0, initial=len(nodes)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = new


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): row numbers of fingerprints with the connectivity of all close pairs.

    ``fps`` has distinct rows (n bigint, fp bigint). A pair is close if ``fp``
    differs in at most ``distance`` bits. A bucket of any size is
    dealt into packed rows of about ``PACK``, which meet pair by pair; a dense
    meeting passes on spanning links instead of all its pairs.
    """
    parts = plan(fps, distance)
    item = F.struct(F.col("n"), F.col("fp"))
    sides = []
    for k, (mask, flips) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(mask))
        sides.append(fps.select(F.lit(k).alias("part"), own.alias("key"), F.lit(False).alias("probe"), item.alias("item")))
        flipped = F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip")
        # A pair meets from both ends; the end with the smaller key is enough.
        sides.append(
            fps.select(item.alias("item"), own.alias("own"), flipped)
            .select(F.lit(k).alias("part"), F.col("own").bitwiseXOR(F.col("flip")).alias("key"), F.lit(True).alias("probe"), "item", "own")
            .filter("key >= own").drop("own")
        )
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    sizes = rows.groupBy("part", "key").agg(
        F.count(F.when(~F.col("probe"), 1)).alias("held"), F.count(F.when(F.col("probe"), 1)).alias("asked")
    ).filter("held > 0 and asked > 0 and (held > 1 or asked > 1)")
    dealt = rows.join(sizes, ["part", "key"]).select(
        "part", "key", "probe", "item",
        F.pmod(F.xxhash64("item.n"), F.ceil(F.when(F.col("probe"), F.col("asked")).otherwise(F.col("held")) / PACK)).alias("chunk"),
    )
    packed = dealt.groupBy("part", "key", "probe", "chunk").agg(F.collect_list("item").alias("items"))
    held = packed.filter("not probe").select("part", "key", F.col("items").alias("held"))
    asked = packed.filter("probe").select("part", "key", F.col("items").alias("asked"))
    met = held.join(asked, ["part", "key"]).select("held", "asked")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out_a, out_b = [], []
        cols = {}
        for side in ("held", "asked"):
            col = batch.column(side)
            flat = col.flatten()
            cols[side] = (np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False)))), {c: flat.field(c).to_numpy() for c in ("n", "fp")})
        (ha, hv), (aa, av) = cols["held"], cols["asked"]
        for r in range(batch.num_rows):
            h, a = slice(ha[r], ha[r + 1]), slice(aa[r], aa[r + 1])
            near = np.bitwise_count(hv["fp"][h][:, None] ^ av["fp"][a][None, :]) <= distance
            near &= hv["n"][h][:, None] != av["n"][a][None, :]
            if near.any():
                x, y = _spanning(hv["n"][h], av["n"][a], near)
                out_a.append(np.minimum(x, y))
                out_b.append(np.maximum(x, y))
        none = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a or [none])), pa.array(np.concatenate(out_b or [none]))], ["a", "b"])

    return map_batches(met, run, "a bigint, b bigint").distinct()


def link_components(found: DataFrame) -> DataFrame:
    """(n, root): root is the smallest number reachable; only linked numbers."""
    pairs = found.select(F.lit(0).alias("entity_id"), "a", "b")
    return components(pairs).select(F.col("id").alias("n"), F.col("label").alias("root"))


def simhash_components(docs: DataFrame, shingle_words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text, ...).

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``distance`` bits. Null and empty texts have fingerprint 0, linked like any
    other; a null doc_id gets a component but never names one unless all are
    null; repeated rows stay; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle_words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = link_components(links(distinct.select(F.col("fp").alias("n"), "fp"), distance))
    labelled = distinct.join(roots, distinct.fp == roots.n, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# --- one document of each group --------------------------------------------

#: Bits in which SimHash fingerprints of near copies may differ to be candidates at once; the bands find those farther apart.
DISTANCE = 4
#: Near copies share NEAR of the distinct runs of NEAR_WORDS words they have together.
NEAR_WORDS, NEAR_PART, NEAR_WHOLE = 5, 4, 5
#: MinHash sketch of a document: a pair shares a band if its ROWS values agree. At a
#: similarity of 0.8 no band is shared once in 300,000 pairs, at 0.9 and above never.
BANDS, ROWS = 24, 4
#: Values of 96 that agree in pairs whose runs are compared: at 0.8 five deviations below the mean.
LEAST_AGREE = 57
#: Rounds in which each document meets one other of its buckets, before whole buckets meet.
HEAD_ROUNDS = 2
#: Runs of the documents of a packed row that is to be compared.
PACK_RUNS = 500_000
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of NEAR_WORDS words."""
    return np.unique(_hashes(shingles(words(text), NEAR_WORDS), 1))


def min_bands(own: np.ndarray) -> np.ndarray:
    """MinHash sketch of a set of hashes: BANDS numbers of ROWS values of 16 bits."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), 4096):
        low = np.minimum(low, (own[None, at : at + 4096] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    return (low & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)


def near_sets_agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sets of distinct numbers of NEAR or more."""
    less, more = sorted((len(a), len(b)))
    if NEAR_WHOLE * less < NEAR_PART * more:
        return False
    both = less + more - len(np.unique(np.concatenate((a, b))))
    return (NEAR_PART + NEAR_WHOLE) * both >= NEAR_PART * (less + more)


def worth_comparing(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Pairs of sketches (rows of BANDS numbers) that first meet in ``band`` and agree in enough values."""
    near = a[:, band][:, None] == b[:, band][None, :]
    for k in range(band):
        near &= a[:, k][:, None] != b[:, k][None, :]
    i, j = np.nonzero(near)
    va, vb = (np.ascontiguousarray(x).view(np.uint16).reshape(len(x), BANDS * ROWS) for x in (a, b))
    for at in range(0, len(i), BLOCK):
        x, y = i[at : at + BLOCK], j[at : at + BLOCK]
        near[x, y] = (va[x] == vb[y]).sum(axis=1) >= LEAST_AGREE
    return near


def near_sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, fp, runs, bands) of every row of docs(doc_id, text).

    n is the hash of the whole set of runs, fp its SimHash fingerprint.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, fps, sizes, bands = [], [], [], []
        for t in strings(batch, "text"):
            own = shingle_set(t)
            n.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            fps.append(vote(own))
            sizes.append(len(own))
            bands.append(min_bands(own))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), *[pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (n, fps)], pa.array(sizes, pa.int64()), lists],
            ["doc_id", "digest", "n", "fp", "runs", "bands"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(_with_digest(docs).select("doc_id", "digest", "text"), run, f"doc_id {kind}, digest bigint, n bigint, fp bigint, runs bigint, bands array<bigint>")


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))


def near_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n, own): the sets of runs of the documents in wanted(n, first)."""
    rows = _with_digest(docs).select("doc_id", "digest", "text")
    named = wanted.select("n", F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest"))
    met = rows.join(named, rows["doc_id"].eqNullSafe(named["_id"]) & (rows["digest"] == named["_digest"])).select("n", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t).view(np.int64) for t in strings(batch, "text")]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("n"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["n", "own"])

    return map_batches(met, run, "n bigint, own array<bigint>").dropDuplicates(["n"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets of runs are near."""
    left, right = sets.select(F.col("n").alias("a"), F.col("own").alias("left")), sets.select(F.col("n").alias("b"), F.col("own").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = [near_sets_agree(x, y) for x, y in zip(_lists(batch.column("left")), _lists(batch.column("right")), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(near))

    return map_batches(met, run, "a bigint, b bigint")


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, key, n, root) of members(band, key, n) in buckets that hold several components."""
    named = members.join(roots, "n", "left").select("band", "key", "n", F.coalesce("root", "n").alias("root"))
    several = named.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "key")
    return named.join(several, ["band", "key"])


def bucket_links(open_: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the components of each bucket of open_(band, key, n, root).

    A bucket of any size is dealt into packed rows which meet pair by pair, by
    their sketches. Where pairs are worth it, the documents' sets of runs meet in
    the same way. A pair is compared in the first band it shares, and not if the
    links found in its meeting join it already, so links stay linear in documents.
    """
    rows = open_.join(sketches.select("n", "runs", "bands"), "n")
    sizes = rows.groupBy("band", "key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PACK, F.sum("runs") / PACK_RUNS)).alias("chunks"))
    dealt = rows.join(sizes, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("n"), "chunks"))
    packed = dealt.groupBy("band", "key", "chunk").agg(F.collect_list(F.struct("n", "root", "bands")).alias("items"))
    left, right = packed.select("band", "key", F.col("chunk").alias("x"), F.col("items").alias("left")), packed.select("band", "key", F.col("chunk").alias("y"), F.col("items").alias("right"))
    met = left.join(right, ["band", "key"]).filter("x <= y").select("band", "key", "x", "y", "left", "right")

    def pairs(n, root, bands, m, other, sketch, band, same):
        near = worth_comparing(bands, sketch, band) & (root[:, None] != other[None, :])
        return np.nonzero(near & (n[:, None] < m[None, :]) if same else near)

    def side(column, r):
        items = column[r].values
        return items.field("n").to_numpy(), items.field("root").to_numpy(), items.field("bands").flatten().to_numpy().reshape(-1, BANDS)

    def propose(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(8)]
        for r in range(batch.num_rows):
            band, key, x, y = (batch.column(c)[r].as_py() for c in ("band", "key", "x", "y"))
            a, b = side(batch.column("left"), r), side(batch.column("right"), r)
            i, j = pairs(*a, *b, band, x == y)
            for right, (ids, roots, bands), own in ((False, a, np.union1d(i, j) if x == y else np.unique(i)), (True, b, np.unique(j[:0] if x == y else j))):
                for column, values in zip(out, ([band] * len(own), [key] * len(own), [x] * len(own), [y] * len(own), [right] * len(own), ids[own].tolist(), roots[own].tolist(), bands[own].tolist()), strict=True):
                    column += values
        kinds = [pa.int32(), *[pa.int64()] * 3, pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["band", "key", "x", "y", "right", "n", "root", "bands"])

    proposed = map_batches(met, propose, "band int, key bigint, x bigint, y bigint, right boolean, n bigint, root bigint, bands array<bigint>")
    meetings = proposed.join(sets, "n").groupBy("band", "key", "x", "y").agg(
        F.collect_list(F.when(~F.col("right"), F.struct("n", "root", "bands", "own"))).alias("left"), F.collect_list(F.when(F.col("right"), F.struct("n", "root", "bands", "own"))).alias("right")
    )

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        out_a, out_b = [], []
        for r in range(batch.num_rows):
            band, same = batch.column("band")[r].as_py(), batch.column("x")[r].as_py() == batch.column("y")[r].as_py()
            left, right = batch.column("left"), batch.column("left" if same else "right")
            a, b = side(left, r), side(right, r)
            own, others = _lists(left[r].values.field("own")), _lists(right[r].values.field("own"))
            upper: dict[int, int] = {}

            def top(x, upper=upper):
                while (above := upper.get(x, x)) != x:
                    upper[x] = upper.get(above, above)
                    x = above
                return x

            for i, j in zip(*(x.tolist() for x in pairs(*a, *b, band, same)), strict=True):
                one, two = top(int(a[1][i])), top(int(b[1][j]))
                if one != two and near_sets_agree(own[i], others[j]):
                    upper[two] = one
                    out_a.append(int(a[0][i]))
                    out_b.append(int(b[0][j]))
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return map_batches(meetings, compare, "a bigint, b bigint")


def near_links(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(n, root): components of near copies among sketches(n, first, fp, runs, bands); only linked numbers.

    Fingerprints that meet by the generalised pigeonhole principle are the first
    candidates. As near copies may differ in more bits, documents that share a
    band are the next: in a few rounds each meets one drawn head of its buckets in
    another component, which links most of a large group; what is still apart in
    a bucket is then compared pair by pair. Every link is a pair whose sets of
    runs were compared.
    """
    close = settled(links(sketches.select("n", "fp"), DISTANCE))
    every = sketches.select("n", F.posexplode("bands").alias("band", "key"))
    members = settled(every.join(every.groupBy("band", "key").count().filter("count > 1").select("band", "key"), ["band", "key"]).select("band", "key", "n"))
    wanted = members.select("n").unionByName(close.select(F.explode(F.array("a", "b")).alias("n"))).distinct()
    sets = settled(near_sets(docs, sketches.join(wanted, "n").select("n", "first")))
    found = cut(verified(close, sets))
    roots = link_components(found)
    for salt in range(HEAD_ROUNDS + 1):
        open_ = settled(open_members(members, roots))
        if open_.isEmpty():
            break
        if salt < HEAD_ROUNDS:
            heads = open_.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("n", F.lit(salt)).alias("drawn"), "n", "root")).alias("head"))
            asked = open_.join(heads, ["band", "key"]).filter("root <> head.root").groupBy("n").agg(F.min("head").alias("head"))
            more = verified(asked.select(F.col("n").alias("a"), F.col("head.n").alias("b")), sets)
        else:
            more = bucket_links(open_, sketches, sets)
        found = cut(found.unionByName(more))
        roots = link_components(found)
    return roots


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each group of near copies.

    Near copies have a Jaccard similarity of 0.8 or more of their distinct runs
    of five words; groups are connected by such pairs. The document with the
    smallest (doc_id, text hash) of a group stays; exact repeats of one row stay
    once. Null counts as an empty text, and texts without a word form one group.
    All columns of ``docs`` are kept.
    """
    prints = cut(near_sketches(docs))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    distinct = cut(prints.groupBy("n").agg(F.min(rank).alias("first"), F.first("fp").alias("fp"), F.first("runs").alias("runs"), F.first("bands").alias("bands")))
    roots = near_links(docs, distinct)
    rooted = distinct.join(roots, "n", "left").withColumn("root", F.coalesce("root", "n"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    times = prints.groupBy("doc_id", "digest").count()
    kept_id, kept_digest, often, digest = hidden("kept_id", "kept_digest", "often", "digest")
    kept = kept.join(times, F.col("first.doc_id").eqNullSafe(times["doc_id"]) & (F.col("first.digest") == times["digest"])).select(
        F.col("first.doc_id").alias(kept_id), F.col("first.digest").alias(kept_digest), (F.col("count") > 1).alias(often)
    ).distinct()
    own = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    stay = own.join(kept, own["doc_id"].eqNullSafe(kept[kept_id]) & (own[digest] == kept[kept_digest]))
    once = stay.filter(~F.col(often)).unionByName(stay.filter(often).dropDuplicates([kept_id, kept_digest]))
    return once.drop(digest, kept_id, kept_digest, often)
