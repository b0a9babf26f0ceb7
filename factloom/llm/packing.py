"""Hierarchical packing of documents into windows of several context sizes.

A document longer than the largest window gives whole windows of its own; the
rest goes to the tier of the smallest size that holds it. Tiers are packed from
the longest down: a rest opens a window of its tier, and the gap behind it is
filled from shorter tiers, whole rests first, then by cutting one. Every Spark
task packs its rows in pools of bounded size, and hands what does not fill a
window to the next pool, so at most one window of a task is padded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from factloom.llm.common import strings
from factloom.llm.tokens import encoder, vocabulary_path

SIZES = (64, 128, 256, 512, 1024)
#: Documents that a pool packs together; bounds what a task holds.
POOL = 1000
#: Full windows of a step group.
GROUP = 8
END = 0
SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"


def pack(rests: list[tuple[int, int, int]], sizes: tuple[int, ...] = SIZES, last: bool = True) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows (size, pieces) of the pieces (key, start, length), and what is left.

    A window is filled to a size of ``sizes`` exactly. With ``last``, the left
    pieces fill the largest sizes they can and one window is padded.
    """
    whole = sizes[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    tails: list[tuple[int, int, int]] = []  # (length, key, start), ascending
    for key, start, length in rests:
        while length >= whole:
            windows.append((whole, [(key, start, whole)]))
            start, length = start + whole, length - whole
        if length:
            tails.append((length, key, start))
    tails.sort()
    while sum_of(tails, whole):
        length, key, start = tails.pop()
        size = next(s for s in sizes if s >= length)
        # A rest of at least half of its tier stays in it when the gap can be filled.
        if not sum_of(tails, size - length):
            size = whole
        pieces, gap = [(key, start, length)], size - length
        while gap:
            at = bisect_right(tails, (gap, float("inf"), 0)) - 1
            if at >= 0:  # the longest rest that fits
                more, k, s = tails.pop(at)
                pieces.append((k, s, more))
                gap -= more
            else:  # every rest is longer than the gap: cut the shortest
                more, k, s = tails.pop(0)
                pieces.append((k, s, gap))
                insort(tails, (more - gap, k, s + gap))
                gap = 0
        windows.append((size, pieces))
    left = [(k, s, n) for n, k, s in reversed(tails)]
    if not last:
        return windows, left
    total = sum(n for *_, n in left)
    for size in reversed(sizes):
        if total >= size:
            total -= size
            pieces, gap = [], size
            while gap:
                k, s, n = left.pop(0)
                pieces.append((k, s, min(n, gap)))
                if n > gap:
                    left.insert(0, (k, s + gap, n - gap))
                gap -= min(n, gap)
            windows.append((size, pieces))
    if left:
        windows.append((whole, left))
    return windows, []


def sum_of(tails: list[tuple[int, int, int]], need: int) -> bool:
    """Whether the rests hold ``need`` tokens together."""
    total = 0
    for n, *_ in reversed(tails):
        total += n
        if total >= need:
            return True
    return need <= 0


def pack_documents(docs: DataFrame, path: str | None = None, columns: list[str] | None = None, sizes: tuple[int, ...] = SIZES, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id columns of its document and ``SCHEMA``.

    Null texts are empty: one piece, the end id alone. Repeated rows are packed
    each; an empty table gives no rows. ``sequence_id`` is unique over the
    table (task number in the high bits), ``step_group`` collects about as many
    tokens of every tier; ``with_ids`` adds the piece's ids.
    """
    columns = columns or ["doc_id"]
    path = path or vocabulary_path()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    schema = f"{fields}, {SCHEMA}" + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        base = TaskContext.get().partitionId() << 33
        made = 0
        filled = dict.fromkeys(sizes, 0)
        held: dict[int, tuple] = {}  # key: (row's columns, ids)
        rests: list[tuple[int, int, int]] = []
        count = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal made, rests, held
            windows, rests = pack(rests, sizes, last)
            rows: list[tuple] = []
            for size, pieces in windows:
                offset = 0
                group = base + filled[size] * size // (GROUP * sizes[-1])
                filled[size] += 1
                for key, start, length in pieces:
                    values, ids = held[key]
                    piece = ids[start : start + length]
                    rows.append((*values, start, length, zlib.crc32(piece), len(ids), base + made, offset, size, group, *([piece.tolist()] if with_ids else [])))
                    offset += length
                made += 1
            held = {k: held[k] for k, *_ in rests}
            return rows

        def out(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            names = [*columns, *[f.split()[0] for f in SCHEMA.split(", ")], *(["ids"] if with_ids else [])]
            kinds = [*[like.schema.field(c).type for c in columns], *[pa.int64()] * 8, *([pa.list_(pa.int64())] if with_ids else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        like = None
        for batch in batches:
            like = batch
            ids_of = [batch.column(c).to_pylist() for c in columns]
            for values, text in zip(zip(*ids_of, strict=True), strings(batch, "text"), strict=True):
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                held[count] = (values, ids)
                rests.append((count, 0, len(ids)))
                count += 1
            if len(rests) >= POOL and (rows := flush(False)):
                yield out(rows, like)
        if like is not None and (rows := flush(True)):
            yield out(rows, like)

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)
