"""Benchmark decontamination by a generalised suffix automaton over words.

The words of all test items form one automaton. Training words stream through
it, the longest match that ends at each word is tracked, and every word inside
an occurrence of a window (ten consecutive item words, or a whole shorter
item) is hit. Spans over a length or documents over a coverage are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hidden, map_batches, strings
from factloom.session import cut

WINDOW = 10
#: Item words of one automaton (a few hundred MB at most in a worker); a larger
#: benchmark is dealt over several, and the training table passes each of them.
AUTOMATON_WORDS = 100_000
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SPARK_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with item marks."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: Items by the state of their windows, and of whole shorter items by length.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, ws in items:
            state = matched = 0
            for w in ws:
                state, matched = self.step(state, matched, w)
                if matched >= window:
                    self.full.setdefault(self._at(state, window), set()).add(item)
            if 0 < len(ws) < window:
                self.short.setdefault(self._at(state, len(ws)), {}).setdefault(len(ws), set()).add(item)
        self.first = self.next[0]

    def _new(self, length: int, nxt: dict[str, int], link: int) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return cur

    def step(self, state: int, matched: int, w: str) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            matched = self.len[state]
        nxt = self.next[state].get(w)
        return (0, 0) if nxt is None else (nxt, matched + 1)

    def _at(self, state: int, length: int) -> int:
        """State of the suffix of that length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, ws: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit runs (first word, word after the last) and items met."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        window, first = self.window, self.first
        for i, w in enumerate(ws):
            if not state:
                state = first.get(w, 0)
                matched = 1 if state else 0
                if not state:
                    continue
            else:
                state, matched = self.step(state, matched, w)
                if not state:
                    continue
            hit = 0
            if matched >= window:
                hit = window
                items |= self.full[self._at(state, window)]
            if self.short:
                s = state
                while s:
                    for length, found in self.short.get(s, {}).items():
                        if length <= matched:
                            items |= found
                            hit = max(hit, length)
                    s = self.link[s]
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


@lru_cache(maxsize=1)
def _automaton(items: tuple, window: int) -> SuffixAutomaton:
    return SuffixAutomaton([(i, list(ws)) for i, ws in items], window)


def item_words(items: DataFrame, window: int = WINDOW, size: int = AUTOMATON_WORDS) -> DataFrame:
    """(item_id, words, shard): items as word lists in pieces an automaton can hold.

    An item longer than a quarter of ``size`` is cut into pieces that share
    ``window - 1`` words, so no window is lost. Items without words, and null
    texts, drop out; a null item_id is kept as such.
    """
    step = max(size // 4, 1)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("_ws") - window) / step), F.lit(0)).cast("int")), lambda k: F.slice("_ws", k * step + 1, step + window - 1))
    ws = items.select(
        F.col("item_id").cast("string").alias("item_id"),
        F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(SPARK_WORD), F.lit(0)).alias("_ws"),
    ).filter("size(_ws) > 0")
    return ws.select("item_id", F.explode(pieces).alias("words"))


def shards(items: DataFrame, window: int = WINDOW, size: int = AUTOMATON_WORDS) -> Iterator[tuple]:
    """Items in groups of bounded size, one group in the driver at a time."""
    pieces = item_words(items, window, size)
    total = pieces.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    # Hashing deals pieces unevenly; at half of the size a group stays within it.
    count = 1 if total <= size else -(-2 * total // size)
    shard = F.pmod(F.xxhash64("item_id", "words"), F.lit(count))
    for k in range(count):
        rows = pieces.filter(shard == k).distinct().collect()
        yield tuple(sorted((r.item_id or "", tuple(r.words)) for r in rows))


def _key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")


def hit_spans(docs: DataFrame, group: tuple, window: int = WINDOW) -> DataFrame:
    """(doc_id, digest, n_words, first, after, items) per row, against one group of items.

    ``first`` and ``after`` list the maximal hit runs in words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(group)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = _automaton(held.value, window)
        n, first, after, met = [], [], [], []
        for t in strings(batch, "text"):
            ws = WORD.findall(t.translate(LOWER))
            spans, found = machine.scan(ws)
            n.append(len(ws))
            first.append([a for a, _ in spans])
            after.append([b for _, b in spans])
            met.append(sorted(found))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(first, longs), pa.array(after, longs), pa.array(met, pa.list_(pa.string()))],
            ["doc_id", "digest", "n_words", "first", "after", "items"],
        )

    return map_batches(_key(docs), run, f"doc_id {kind}, digest bigint, n_words bigint, first array<bigint>, after array<bigint>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs.

    Null and empty texts have no words and are never hit; an empty benchmark
    hits nothing; a null item_id counts as the empty string; repeated rows give
    repeated rows. A benchmark of several automatons is passed one by one and
    the findings of equal rows are merged.
    """
    groups = shards(items, window, size)
    group, more = next(groups), next(groups, None)
    rows = hit_spans(docs, group, window)
    if more is not None:
        # One automaton after the other: its findings are written and the next group is read.
        every = None
        for g in chain([group, more], groups):
            part = cut(hit_spans(docs, g, window).dropDuplicates(["doc_id", "digest"]))
            every = part if every is None else every.unionByName(part)
        gather = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  one row per automaton
        merged = every.groupBy("doc_id", "digest").agg(
            F.first("n_words").alias("n_words"), gather("first").alias("first"), gather("after").alias("after"), F.array_distinct(F.array_sort(gather("items"))).alias("items")
        )
        own = _key(docs).drop("text")
        rows = own.join(merged, own["doc_id"].eqNullSafe(merged["doc_id"]) & (own["digest"] == merged["digest"])).select(own["doc_id"], "n_words", "first", "after", "items")
    runs = F.array_sort(F.arrays_zip("first", "after"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    hit = F.aggregate(runs, start, lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("bigint"), r["after"] - F.greatest(r["first"], acc["end"]))).alias("n"), F.greatest(acc["end"], r["after"]).alias("end")
    ))["n"]
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("first") > 0).alias("contaminated"),
    )


def without_spans(text: str, places: list[tuple[int, int]], spans: list[tuple[int, int]], min_words: int, max_coverage: float) -> str | None:
    """Text without the hit runs (ordered, apart) of ``min_words`` or more; None above the coverage."""
    spans = [(a, b) for a, b in spans if b - a >= min_words]
    if not spans:
        return text
    if sum(b - a for a, b in spans) > max_coverage * len(places):
        return None
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text.translate(LOWER))]


def cleaned(text: str, machine: SuffixAutomaton, min_words: int, max_coverage: float) -> str | None:
    """Text without hit runs of ``min_words`` or more; None above the coverage."""
    places = word_places(text)
    spans, _ = machine.scan([text[a:b].translate(LOWER) for a, b in places])
    return without_spans(text, places, spans, min_words, max_coverage)


def merged_spans(first: list[int], after: list[int]) -> list[tuple[int, int]]:
    """Runs of several automatons as one automaton reports them: those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, after, strict=True)):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _with_texts(batch: pa.RecordBatch, texts: list, new: list) -> pa.RecordBatch:
    """``batch`` with new texts and their lengths, without rows whose text went."""
    keep = pa.array([n is not None or t is None for n, t in zip(new, texts, strict=True)])
    out = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(new, pa.string()))
    at = batch.schema.get_field_index("n_chars")
    if at >= 0:
        lengths = [o if n == t else len(n or "") for n, t, o in zip(new, texts, batch.column(at).to_pylist(), strict=True)]
        out = out.set_column(at, batch.schema.field(at), pa.array(lengths, batch.schema.field(at).type))
    return out.filter(keep)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_words: int = 5, max_coverage: float = 0.5, size: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` without benchmark passages; ``text`` and ``n_chars`` follow.

    Runs of ``min_words`` hit words or more are cut out of the text; a document
    whose runs cover more than ``max_coverage`` of its words is dropped. Rows
    without such runs, null texts included, pass unchanged with all columns. A
    benchmark of several automatons is passed one by one on the original texts;
    their runs are merged per document before anything is cut or counted.
    """
    groups = shards(items, window, size)
    group, more = next(groups), next(groups, None)
    if more is None:
        held = docs.sparkSession.sparkContext.broadcast(group)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            machine = _automaton(held.value, window)
            texts = batch.column("text").to_pylist()
            return _with_texts(batch, texts, [t and cleaned(t, machine, min_words, max_coverage) for t in texts])

        return map_batches(docs, run, docs.schema)
    found = None
    for g in chain([group, more], groups):
        hit = cut(hit_spans(docs, g, window).filter("size(first) > 0").select("doc_id", "digest", "first", "after").dropDuplicates(["doc_id", "digest"]))
        found = hit if found is None else found.unionByName(hit)
    gather = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  one row per automaton
    hit_id, hit_digest, digest, starts, ends = hidden("hit_id", "hit_digest", "digest", "first", "after")
    runs = found.groupBy("doc_id", "digest").agg(gather("first").alias(starts), gather("after").alias(ends)).withColumnsRenamed({"doc_id": hit_id, "digest": hit_digest})
    own = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    met = own.join(runs, own["doc_id"].eqNullSafe(runs[hit_id]) & (own[digest] == runs[hit_digest]), "left").select(*[own[c] for c in docs.columns], starts, ends)

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, first, after = (batch.column(c).to_pylist() for c in ("text", starts, ends))
        new = [without_spans(t, word_places(t), merged_spans(a, b), min_words, max_coverage) if t and a else t for t, a, b in zip(texts, first, after, strict=True)]
        return _with_texts(batch.select(docs_columns), texts, new)

    docs_columns = docs.columns
    return map_batches(met, cut_out, docs.schema)
