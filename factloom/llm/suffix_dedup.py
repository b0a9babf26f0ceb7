"""Removal of byte strings that occurred before, by suffix sorting.

Every window of 100 bytes has an anchor: the leftmost smallest hash of the
24-byte strings in it. Equal windows have equal anchors, so

1. anchors that occur once are dropped: their windows repeat nothing;
2. windows with the same anchor place form a unit. Units with equal text
   collapse to the first one, the others are repeats as a whole;
3. where one anchor has different first units, their texts are suffix-sorted
   in blocks of bounded size and adjacent common prefixes of 100 bytes or more
   name the repeated windows;
4. an anchor whose units go on in another block passes the block's first
   windows on, eight neighbours as one row keyed by the bytes they share; rows
   with the same key in several blocks are compared by window, by hash and a
   grouped minimum.

No step gathers an anchor, a passage or a group of copies in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_batches, settled
from factloom.llm.suffix_array import SuffixArray
from factloom.operators.ordering import running_count

LENGTH = 100
#: Shorter anchors are fewer, longer ones repeat less often by chance.
GRAM = 24
#: Low bits that carry the place within a piece of a text while minima are taken.
PLACE_BITS = 20
PIECE = (1 << PLACE_BITS) - 2 * LENGTH
#: Bytes of text that are suffix-sorted together.
BLOCK = 2 << 20
#: Neighbouring windows that are passed on together.
TOGETHER = 8


def units(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows, anchor - first window) of the units of a text."""
    hashes, firsts, counts, anchors = [], [], [], []
    span = length - GRAM + 1  # anchors a window can have
    for at in range(0, max(len(data) - length + 1, 0), PIECE):
        piece = np.frombuffer(data[at : at + PIECE + length - 1], dtype=np.uint8).astype(np.uint64)
        if len(piece) < length:
            break
        h = np.zeros(len(piece) - GRAM + 1, dtype=np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0x100000001B3) + piece[k : k + len(h)]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:  # minimum over ``width`` places, doubled
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        hashes.append(h[place[first]])
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, len(place))))
        anchors.append(place[first] - first)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors)


def pack_place(first: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First window, anchor and number of windows of units as one number; the last two are below 1,024."""
    return first << PLACE_BITS | anchor << 10 | count


def first_and_count(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> PLACE_BITS, place & 1023


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) with ``doc``, a number in the order of documents: all rows, and one per document.

    It is doc_id itself where that is an integer, unique and never null.
    Otherwise equal rows are one document, and documents are numbered by
    doc_id (null first), then by the hash of their text.
    """
    rows = docs.select("doc_id", "text")
    integer = rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if integer and rows.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        numbered = rows.withColumn("doc", F.col("doc_id").cast("bigint"))
        return numbered, numbered
    hashed = rows.withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = hashed.select(F.lit(0).alias("all"), F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest").distinct()
    seq = running_count(order, ["all"], ["known", "doc_id", "digest"], F.lit(1), "doc").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "doc")
    numbered = hashed.join(seq, hashed["doc_id"].eqNullSafe(seq["_id"]) & (hashed["digest"] == seq["_digest"])).select("doc_id", "text", "doc")
    return numbered, numbered.dropDuplicates(["doc"])


def repeated_anchors(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(ah): anchor hashes that occur more than once; tasks count before the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [units(_bytes(t), length)[0] for t in batch.column("text").to_pylist()]
        ah, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["ah", "n"])

    return map_batches(rows.select("text"), run, "ah bigint, n tinyint").groupBy("ah").agg(F.sum("n").alias("n")).filter("n > 1").select("ah")


def unit_rows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(ah, uh, doc, place): units by anchor and text hash, with their packed place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ahs, uhs, docs, places = [], [], [], []
        digest = xxhash.xxh3_64_intdigest
        for t, doc in zip(batch.column("text").to_pylist(), batch.column("doc").to_pylist(), strict=True):
            data = _bytes(t)
            ah, first, count, anchor = units(data, length)
            if len(ah):
                ends = first + count + (length - 1)
                ahs.append(ah)
                uhs.append(np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(ah)))
                docs.append(np.full(len(ah), doc, dtype=np.int64))
                places.append(pack_place(first, count, anchor))
        if not ahs:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (ahs, uhs, docs, places)], ["ah", "uh", "doc", "place"])

    return map_batches(rows.select("doc", "text"), run, "ah bigint, uh bigint, doc bigint, place bigint")


def packed_texts(rows: DataFrame) -> DataFrame:
    """(doc, doc_id, packed): texts compressed, as they are shuffled twice."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), pa.array([press(_bytes(t)) for t in batch.column("text").to_pylist()], pa.binary())], ["doc", "doc_id", "packed"])

    return map_batches(rows.select("doc", "doc_id", "text"), run, f"doc bigint, doc_id {kind}, packed binary")


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def unit_texts(rows: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """(ah, doc, first, windows, anchor, body) of the units in wanted(doc, ah, place)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("ah", "place")).alias("own"))
    met = packed_texts(rows).join(lists, "doc").select("doc", "packed", F.col("own.ah").alias("ahs"), F.col("own.place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, packed, ahs, places in zip(*[batch.column(i) for i in range(4)], strict=True):
                data = _unpack(packed.as_py())
                place = np.asarray(places.values.to_numpy(zero_copy_only=False))
                first, count = first_and_count(place)
                anchor = place >> 10 & 1023
                for at in range(0, len(place), 20_000):  # a long text has many units
                    part = slice(at, at + 20_000)
                    bodies = [data[a : a + c + length - 1] for a, c in zip(first[part].tolist(), count[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        ahs.values.slice(at, 20_000), pa.array(np.full(len(bodies), doc.as_py(), dtype=np.int64)), pa.array(first[part]), pa.array(count[part]), pa.array(anchor[part]), pa.array(bodies, pa.binary()),
                    ], ["ah", "doc", "first", "windows", "anchor", "body"])

    return met.mapInArrow(run, "ah bigint, doc bigint, first bigint, windows bigint, anchor bigint, body binary")


def sorted_repeats(texts: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc, first, windows, h1, h2, body): repeated windows, and windows still to be compared.

    Units arrive in ranges of (ah, doc, first) and are suffix-sorted in blocks.
    Rows with hashes are the first windows of anchors that may go on in another
    block or range: ``TOGETHER`` neighbours at fixed distances from the anchor,
    marked by the bits of ``windows`` and keyed by the bytes all of them share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        opened = True  # the first anchor may have begun in the range before

        def flush(rows: list[tuple], open_first: bool, open_last: bool) -> pa.RecordBatch | None:
            array = SuffixArray([r[4] for r in rows], length)
            begin = array.starts
            windows = np.array([r[3] for r in rows])
            owner = np.repeat(np.arange(len(rows)), windows)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = begin[owner] + offset
            copies = array.later_copies(starts)
            out = [[], [], [], [], [], []]
            hit = np.isin(starts, copies, assume_unique=True)
            docs, firsts = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            place = np.flatnonzero(hit)
            if len(place):  # runs of repeated windows of a unit
                fresh = np.concatenate(([True], (np.diff(place) != 1) | (owner[place[1:]] != owner[place[:-1]])))
                heads = place[fresh]
                out[0] += docs[owner[heads]].tolist()
                out[1] += (firsts[owner[heads]] + offset[heads]).tolist()
                out[2] += np.diff(np.append(np.flatnonzero(fresh), len(place))).tolist()
                for column in out[3:]:
                    column += [None] * len(heads)
            ends = ({rows[0][0]} if open_first else set()) | ({rows[-1][0]} if open_last else set())
            begins = np.cumsum(windows) - windows
            for u in [u for u, r in enumerate(rows) if r[0] in ends]:
                _, doc, first, _, body, anchor = rows[u]
                left = np.flatnonzero(~hit[begins[u] : begins[u] + windows[u]])
                back = anchor - left  # bytes from a window's start to the anchor
                for k in np.unique(back // TOGETHER).tolist():
                    own = left[back // TOGETHER == k]
                    low = anchor - TOGETHER * k - (TOGETHER - 1)  # start of the leftmost of these windows
                    both = xxhash.xxh3_128_digest(body[low + TOGETHER - 1 : low + length], seed=k)
                    start = int(own[0])
                    out[0].append(doc)
                    out[1].append(first + start)
                    out[2].append(int(sum(1 << int(x - start) for x in own)))
                    out[3].append(int.from_bytes(both[:8], "little", signed=True))
                    out[4].append(int.from_bytes(both[8:], "little", signed=True))
                    out[5].append(body[start : int(own[-1]) + length])
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:5]], pa.array(out[5], pa.binary())], ["doc", "first", "windows", "h1", "h2", "body"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("ah", "doc", "first", "windows", "body", "anchor")], strict=True):
                new = bool(held) and row[0] != held[-1][0]
                if held and (size >= 2 * block or size >= block and new):
                    yield flush(held, opened, not new)
                    held, size, opened = [], 0, not new
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield flush(held, opened, True)

    ranged = texts.repartitionByRange("ah", "doc", "first").sortWithinPartitions("ah", "doc", "first")
    return ranged.mapInArrow(run, "doc bigint, first bigint, windows bigint, h1 bigint, h2 bigint, body binary")


def window_hashes(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, first, w1, w2): each marked window of rows(doc, first, windows, body) with its hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], []]
        for doc, first, marks, body in zip(*[batch.column(c).to_pylist() for c in ("doc", "first", "windows", "body")], strict=True):
            for k in range(TOGETHER):
                if marks >> k & 1:
                    both = xxhash.xxh3_128_digest(body[k : k + length])
                    for column, value in zip(out, (doc, first + k, int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)), strict=True):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc", "first", "w1", "w2"])

    return map_batches(rows, run, "doc bigint, first bigint, w1 bigint, w2 bigint")


def repeated_windows(rows: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc, first, windows): runs of windows that occurred before."""
    candidates = settled(unit_rows(rows, length).join(repeated_anchors(rows, length), "ah"))
    place = F.struct("doc", "place")
    texts = settled(candidates.groupBy("ah", "uh").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("times")))
    kinds = texts.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds"))
    copies = candidates.join(texts.filter("times > 1"), ["ah", "uh"]).filter(F.col("at") != place).select("doc", "place")
    whole = copies.select("doc", F.shiftright("place", PLACE_BITS).alias("first"), F.col("place").bitwiseAND(F.lit(1023)).alias("windows"))
    firsts = texts.join(kinds.filter("kinds > 1"), "ah").select(F.col("at.doc").alias("doc"), "ah", F.col("at.place").alias("place"))
    sorted_ = settled(sorted_repeats(settled(unit_texts(rows, firsts, length)), length, block))
    within = sorted_.filter("h1 IS NULL").select("doc", "first", "windows")
    open_ = sorted_.filter("h1 IS NOT NULL")
    shared = open_.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    hashed = settled(window_hashes(open_.join(shared, ["h1", "h2"]).select("doc", "first", "windows", "body"), length))
    start = F.struct("doc", "first")
    least = hashed.groupBy("w1", "w2").agg(F.min(start).alias("at"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    across = hashed.join(least, ["w1", "w2"]).filter(F.col("at") != start).select("doc", "first", F.lit(1).cast("bigint").alias("windows"))
    return whole.unionByName(within).unionByName(across)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of docs(doc_id, text).

    A byte is removed if a string of ``length`` bytes over it also starts
    earlier: in a smaller doc_id, or before in the same document. Null texts
    are empty; texts shorter than ``length`` stay whole; rows that are equal in
    doc_id and text are one document and get the same result.
    """
    rows, apart = keyed(docs)
    lists = repeated_windows(apart, length, block).groupBy("doc").agg(F.collect_list(F.struct("first", "windows")).alias("own"))
    met = packed_texts(rows).join(lists, "doc", "left").select("doc_id", "packed", F.col("own.first").alias("first"), F.col("own.windows").alias("windows"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], [], []]
        for packed, first, windows in zip(batch.column("packed"), batch.column("first"), batch.column("windows"), strict=True):
            data = _unpack(packed.as_py())
            kept, spans, at = [], 0, 0
            if first.is_valid:
                a = first.values.to_numpy(zero_copy_only=False)
                b = a + windows.values.to_numpy(zero_copy_only=False) + (length - 1)
                by = np.argsort(a, kind="stable")
                a, b = a[by], np.maximum.accumulate(b[by])
                fresh = np.concatenate(([True], a[1:] > b[:-1]))
                heads = np.flatnonzero(fresh)
                tails = b[np.append(heads[1:], len(b)) - 1]
                for x, y in zip(a[heads].tolist(), tails.tolist(), strict=True):
                    kept.append(data[at:x])
                    at, spans = y, spans + 1
            kept.append(data[at:])
            rest = b"".join(kept)
            for column, value in zip(out, (len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                column.append(value)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]]
        wide = 6 if with_text else 5
        return pa.RecordBatch.from_arrays(arrays[:wide], names[:wide])

    return map_batches(met, run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))
