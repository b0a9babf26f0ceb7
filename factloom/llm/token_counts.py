"""Token counts by section, from one encoding of the whole document.

Token byte spans partition the document; they meet the sections' spans in an
interval join of two sorted lists. A token that crosses a boundary belongs to
the section that holds most of its bytes, the earlier one at a tie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import map_batches, strings
from factloom.llm.tokens import encoder, vocabulary_path


def line_bounds(data: bytes) -> np.ndarray:
    """Section ends in bytes: a section is a line with its line break."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether the token crosses a boundary."""
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, side="right")
    final = np.searchsorted(section_ends, token_ends - 1, side="right")
    owner, crossing = first.copy(), final > first
    for t in np.flatnonzero(crossing):
        edges = np.concatenate(([starts[t]], section_ends[first[t] : final[t]], [token_ends[t]]))
        owner[t] = first[t] + int(np.argmax(np.diff(edges)))
    return owner, crossing


def section_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens, section_chars) per row.

    Sections are lines; both arrays hold one number per line, in order. Null
    and empty texts have no tokens and no sections; repeated rows stay.
    """
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path)
        n, crossed, counts, chars = [], [], [], []
        for t in strings(batch, "text"):
            data = t.encode("utf-8", "surrogatepass")
            ends = np.cumsum(coder.sizes[coder.encode(t)]) if t else np.zeros(0, dtype=np.int64)
            bounds = line_bounds(data) if t else np.zeros(0, dtype=np.int64)
            owner, crossing = allocate(ends, bounds) if t else (ends, ends > 0)
            n.append(len(ends))
            crossed.append(int(crossing.sum()))
            counts.append(np.bincount(owner, minlength=len(bounds)).tolist() if t else [])
            chars.append([len(x) for x in t.split("\n")] if t else [])
            if t:
                chars[-1] = [c + 1 for c in chars[-1][:-1]] + ([chars[-1][-1]] if chars[-1][-1] else [])
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(c) for c in counts], pa.int64()), pa.array(crossed, pa.int64()), pa.array(counts, longs), pa.array(chars, longs)],
            ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "section_chars"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>, section_chars array<bigint>")
