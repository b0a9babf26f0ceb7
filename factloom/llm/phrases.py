"""Phrase collocations by best-first branch and bound over prefixes.

A phrase is grown word by word from its first word. Whatever follows, its score
stays within floor(1000 * n / f(first word)): the cut behind the first word has
that denominator, and a phrase is never more frequent than its rest. First
words are therefore expanded from the best bound, the rarest, in rounds. A
round counts the phrases below its frontier, settles their scores, and gives
each language the score of its last wanted rank so far; the next frontier is
every first word whose bound reaches it. A language is settled when no bound
left does, so ties at the last rank are in. Parts that start with other words
are counted only for phrases whose bound from the cuts known so far still
reaches that score.

Counts are exact: tasks tally whole texts and Spark adds the tallies up. Bit
maps of a fixed size (``BITS``) tell the tasks which words and phrases matter;
a wrong yes only costs time. No text is shuffled, and no frequent word gathers
rows, because tallies meet by phrase.

Rows: null text is empty, a null language is ``und``. Every repeated row counts.
Ties in score fall to the larger count, then to the phrase by its bytes. An
empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import settled

#: Size of each bit map; 2 MB travel to every executor.
BITS = 1 << 24
#: Share of a language's frequent words that the first frontier stands for, and its growth while ranks are missing.
SHARE, GROWTH = 0.125, 4.0
#: Entries of a task's tally before it is handed on.
TALLY = 1 << 18
#: Words or phrases remembered with what is known of them.
REMEMBERED = 1 << 19
UPPER, BREAKS = bytes(range(65, 91)), b",;:!?\n\x0b\x0c\r"
#: A break is a full stop, which no word holds.
STOP = b"."
FOLD = bytes.maketrans(UPPER + BREAKS + b"\t", UPPER.lower() + STOP * len(BREAKS) + b" ")
SEED = 42
#: Places of start words with a frequent word behind them, in the bytes of word flags.
STARTS = re.compile(b"\2(?=[\1\2])")


class Bits:
    """A fixed-size superset of a set of keys."""

    def __init__(self, data: bytes):
        self.data = data
        self.mask = 8 * len(data) - 1

    def has(self, key: bytes) -> bool:
        slot = xxhash.xxh64_intdigest(key, SEED) & self.mask
        return bool(self.data[slot >> 3] >> (slot & 7) & 1)


class Known(dict):
    """Answers by key, worked out once; starts again when it is full."""

    def __init__(self, answer: Callable[[bytes], int]):
        super().__init__()
        self.answer = answer

    def __missing__(self, key: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[key] = self.answer(key)
        return found


class Flags:
    """Flags of a language's words (0: rare, 1: frequent, 2: frequent start), worked out once in bulk."""

    def __init__(self, head: bytes, wide: Bits, start: Bits):
        self.head, self.wide, self.start = head, wide, start
        self.known: dict[bytes, int] = {STOP: 0}

    def of(self, words: list[bytes]) -> bytes:
        known = self.known
        flags = list(map(known.get, words))
        if None in flags:
            if len(known) > REMEMBERED:
                known.clear()
                known[STOP] = 0
            head, data, mask, digest, starts = self.head, self.wide.data, self.wide.mask, xxhash.xxh64_intdigest, self.start.has
            for i, f in enumerate(flags):
                if f is None:
                    key = head + words[i]
                    slot = digest(key, SEED) & mask
                    found = 0
                    if data[slot >> 3] >> (slot & 7) & 1:
                        found = 2 if starts(key) else 1
                    flags[i] = known[words[i]] = found
            # A stop may have been forgotten and asked for again; it is never a word.
            known[STOP] = 0
        return bytes(flags)


def _key(lang: str, phrase: str, mark: str = "\0") -> Column:
    return F.concat(F.col(lang), F.lit(mark), F.col(phrase))


def bit_map(keys: DataFrame, bits: int | None = None) -> Bits:
    """Bits of the keys (one string column): built by Spark, at most ``bits`` reach the driver."""
    bits = bits or BITS
    slots = keys.select(F.xxhash64(F.col(keys.columns[0])).bitwiseAND(F.lit(bits - 1)).alias("slot"))
    parts = slots.groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    data = bytearray(max(bits // 8, 4096))
    for p in parts:
        data[p.part * 4096 : p.part * 4096 + 4096] = p.bits
    return Bits(bytes(data[: max(bits // 8, 1)]))


def _tally(docs: DataFrame, count: Callable, rows: Callable, schema: str) -> DataFrame:
    """One scan: ``count`` adds a text to its language's tally, ``rows`` turns a tally into columns."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, tally in tallies.items():
                found = rows(tally)
                if found:
                    columns = list(zip(*found, strict=True))
                    arrays = [pa.array([lang] * len(found), type=pa.string())]
                    for (_, kind), values in zip(fields[1:], columns, strict=True):
                        arrays.append(pa.array(values, type=pa.binary()).cast(pa.string()) if kind == "string" else pa.array(values, type=kinds[kind]))
                    yield pa.record_batch(arrays, names=[f[0] for f in fields])
            tallies.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    count(lang, text.encode().translate(FOLD), tallies.setdefault(lang, Counter()))
                    if len(tallies[lang]) > TALLY:
                        yield from out()
        yield from out()

    return docs.mapInArrow(run, schema)


def _count_words(lang: str, data: bytes, tally: Counter) -> None:
    tally.update(data.replace(STOP, b" ").split())


def _words(data: bytes) -> list[bytes]:
    """Words of a text, with a stop between pieces."""
    return data.replace(STOP, b" . ").split()


def _items(tally: dict) -> list[tuple]:
    return list(tally.items())


class Scan:
    """What one scan looks for, and per language what is known of words and phrases.

    ``wide``: bits of frequent words; ``start``: bits of the words a phrase may
    start with, and of the languages still open; ``inner``: bits of phrases.
    """

    def __init__(self, wide: Bits, start: Bits, inner: Bits | None = None, longest: int = 5):
        self.wide, self.start, self.inner, self.longest = wide, start, inner, longest
        self.langs: dict[str, tuple[Flags, Known] | None] = {}

    def __getstate__(self):
        return self.wide, self.start, self.inner, self.longest

    def __setstate__(self, state):
        self.__init__(*state)

    def of(self, lang: str) -> tuple[Flags, Known] | None:
        """Known words (0: rare, 1: frequent, 2: frequent start) and phrases of a language; None if it is settled."""
        if lang not in self.langs:
            raw, head = lang.encode(), lang.encode() + b"\0"
            word = Flags(head, self.wide, self.start)
            phrase = Known(lambda p: self.inner.has(head + p) | 2 * self.inner.has(raw + b"\1" + p))
            self.langs[lang] = (word, phrase) if self.start.has(raw + b"\2") else None
        return self.langs[lang]


def _count_pairs(scan: Scan) -> Callable:
    """Two-word phrases of start words."""

    def count(lang: str, data: bytes, tally: dict) -> None:
        known = scan.of(lang)
        if known is None:
            return
        words = _words(data)
        flags = known[0].of(words)
        tally.update([words[i := at.start()] + b" " + words[i + 1] for at in STARTS.finditer(flags)])

    return count


def _count_windows(scan: Scan) -> Callable:
    """Windows of up to ``longest`` frequent words behind the word to their left, where a kept pair starts."""

    def count(lang: str, data: bytes, tally: dict) -> None:
        known = scan.of(lang)
        if known is None:
            return
        get, longest, head, bits, mask = tally.get, scan.longest, lang.encode() + b"\0", scan.inner.data, scan.inner.mask
        words = _words(data)
        flags = known[0].of(words) + b"\0"
        for at in STARTS.finditer(flags):
            i = at.start()
            # Most pairs are rare and differ, so each is looked up in the bits, not remembered.
            slot = xxhash.xxh64_intdigest(b"%b%b %b" % (head, words[i], words[i + 1]), SEED) & mask
            if bits[slot >> 3] >> (slot & 7) & 1:
                end = flags.find(0, i + 2, i + longest)
                left = words[i - 1] if i else STOP
                key = (b"" if left == STOP else left) + b"\n" + b" ".join(words[i : end if end >= 0 else i + longest])
                tally[key] = get(key, 0) + 1

    return count


def _prefix_rows(tally: dict) -> list[tuple]:
    """(phrase, length, count, least and greatest word to the left, whether one has none) of all prefixes."""
    found: dict[bytes, list] = {}
    for key, count in tally.items():
        left, window = key.split(b"\n")
        at = window.index(b" ")
        length = 2
        while at >= 0:
            at = window.find(b" ", at + 1)
            phrase = window[:at] if at >= 0 else window
            seen = found.get(phrase)
            if seen is None:
                found[phrase] = [length, count, left or None, left or None, not left]
            else:
                seen[1] += count
                if not left:
                    seen[4] = True
                elif seen[2] is None:
                    seen[2] = seen[3] = left
                else:
                    seen[2], seen[3] = min(seen[2], left), max(seen[3], left)
            length += 1
    return [(phrase, *seen) for phrase, seen in found.items()]


def _count_parts(scan: Scan) -> Callable:
    """The wanted phrases alone; phrases with a longer one wanted are marked by their first two words."""

    def count(lang: str, data: bytes, tally: dict) -> None:
        known = scan.of(lang)
        if known is None:
            return
        (word, phrase), get, longest = known, tally.get, scan.longest
        words = _words(data)
        flags = word.of(words) + b"\0"
        for at in STARTS.finditer(flags):
            i = at.start()
            part = words[i] + b" " + words[i + 1]
            wanted = phrase[part]
            if wanted & 1:
                tally[part] = get(part, 0) + 1
            if wanted & 2:
                end = i + 2
                while flags[end] and end < i + longest - 1:
                    part = part + b" " + words[end]
                    end += 1
                    if phrase[part] & 1:
                        tally[part] = get(part, 0) + 1

    return count


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)); null where a part is unknown."""
    top = F.col(n).cast("decimal(18,0)") * F.lit(1000).cast("decimal(4,0)") * F.col(a).cast("decimal(14,0)")
    return F.call_function("div", top, F.col(left).cast("decimal(18,0)") * F.col(right).cast("decimal(18,0)"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, least: int = 100, longest: int = 5) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words that occur ``least`` times.

    Returns lang, rank, phrase, a, l, r, n, score. A phrase inside a longer one
    of the same count is left out. Each round reads the texts three times: pairs
    of start words, windows behind kept pairs, and parts that start elsewhere.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")
    words = settled(_tally(docs, _count_words, _items, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = settled(words.filter(F.col("f") >= least).join(sizes, "lang"))
    wide = bit_map(frequent.select(_key("lang", "phrase")))
    by_count = frequent.groupBy("lang", "n", "f").agg(F.sum("f").alias("mass"))
    up = Window.partitionBy("lang").orderBy("f")
    masses = settled(by_count.select("lang", "n", "f", (F.sum("mass").over(up) / F.sum("mass").over(Window.partitionBy("lang"))).alias("share")))

    #: lang, n, below (first words up to this count are expanded), reach (those up to this one are next).
    share = SHARE
    least_f = F.min("f")
    limits = settled(masses.groupBy("lang", "n").agg(F.lit(0).cast("long").alias("below"), F.coalesce(F.max(F.when(F.col("share") <= share, F.col("f"))), least_f).alias("reach"), F.lit(None).cast("long").alias("floor")))
    known = frequent.select("lang", "phrase", "f")
    scored: DataFrame | None = None
    while limits.filter("reach > below").limit(1).count():
        open_langs = limits.filter("reach > below")
        frontier = frequent.join(open_langs.drop("n"), "lang").filter("f > below AND f <= reach")
        grown = _grow(docs, wide, frontier, open_langs, least, longest)
        known = known.unionByName(grown.select("lang", "phrase", F.col("a").alias("f")))
        fresh, parts = _settle(docs, wide, grown.join(limits, "lang"), known, longest, top)
        known = known.unionByName(parts)
        scored = fresh if scored is None else scored.unionByName(fresh)
        ranked = _ranked(scored, top)
        floors = ranked.filter(F.col("rank") == top).select("lang", F.col("score").alias("floor"))
        share *= GROWTH
        # Every first word whose bound reaches the floor; without one, more of the language.
        wanted = F.when(F.col("floor") > 0, F.call_function("div", F.col("n").cast("decimal(18,0)") * F.lit(1000).cast("decimal(4,0)"), F.col("floor").cast("decimal(18,0)")))
        largest = masses.groupBy("lang").agg(F.max("f").alias("largest"), F.coalesce(F.max(F.when(F.col("share") <= share, F.col("f"))), F.lit(0)).alias("more"))
        step = limits.drop("floor").withColumnRenamed("reach", "done").join(floors, "lang", "left").join(largest, "lang")
        reach = F.when(F.col("floor").isNull(), F.when(F.lit(share >= 1) | (F.col("more") <= F.col("done")), F.col("largest")).otherwise(F.col("more"))).otherwise(F.coalesce(wanted, F.col("largest")))
        limits = settled(step.select("lang", "n", F.col("done").alias("below"), F.greatest("done", F.least(reach, F.col("largest"))).alias("reach"), "floor"))
    if scored is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return _ranked(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def _open_marks(langs: DataFrame) -> DataFrame:
    return langs.select(F.concat("lang", F.lit("\2")))


def _grow(docs: DataFrame, wide: Bits, frontier: DataFrame, langs: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, m, a, inside) of all frequent phrases that start in the frontier."""
    spark = docs.sparkSession
    start = bit_map(frontier.select(_key("lang", "phrase")).union(_open_marks(langs)))
    first = spark.sparkContext.broadcast(Scan(wide, start))
    pairs = _tally(docs, lambda *a: _count_pairs(first.value)(*a), _items, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    kept = bit_map(pairs.select(_key("lang", "phrase")))
    second = spark.sparkContext.broadcast(Scan(wide, start, kept, longest))
    rows = _tally(docs, lambda *a: _count_windows(second.value)(*a), _prefix_rows, "lang string, phrase string, m int, n long, lo string, hi string, bare boolean")
    found = rows.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("a"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("bare").alias("bare")).filter(F.col("a") >= least)
    # The bits of start words may name others: their phrases are left to their own round.
    head = F.substring_index("phrase", " ", 1)
    found = found.withColumn("head", head).join(frontier.select("lang", F.col("phrase").alias("head"), F.col("f").alias("head_f")), ["lang", "head"])
    found = settled(found)
    last = F.length(F.substring_index("phrase", " ", -1)) + 1
    parents = found.filter("m > 2").select("lang", F.col("phrase").substr(F.lit(1), F.length("phrase") - last).alias("phrase"), F.col("a").alias("child"))
    parents = parents.groupBy("lang", "phrase").agg(F.max("child").alias("child"))
    left = ~F.col("bare") & (F.col("lo") == F.col("hi"))
    inside = (F.col("m") < longest) & (F.coalesce(left, F.lit(False)) | F.coalesce(F.col("child") == F.col("a"), F.lit(False)))
    return settled(found.join(parents, ["lang", "phrase"], "left").select("lang", "phrase", "m", "a", "head_f", inside.alias("inside")))


def _cuts(phrases: DataFrame) -> DataFrame:
    """One row per phrase and cut: the first k words and the rest."""
    words = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    return cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")), " "))


def _settle(docs: DataFrame, wide: Bits, grown: DataFrame, known: DataFrame, longest: int, ranks: int) -> tuple[DataFrame, DataFrame]:
    """Scores of the phrases that may still rank, and the parts counted for them."""
    spark = docs.sparkSession
    lefts = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = settled(_cuts(grown.filter("NOT inside")).join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"], "left"))
    top = F.call_function("div", F.col("n").cast("decimal(18,0)") * F.lit(1000).cast("decimal(4,0)"), F.col("head_f").cast("decimal(18,0)"))
    bounds = settled(cuts.groupBy("lang", "phrase", "a", "floor").agg(F.least(F.min(_score("a", "n", "l", "r")), F.min(top)).alias("score"), F.count("r").alias("seen"), F.count(F.lit(1)).alias("all")))
    # Phrases whose cuts are all known have their score, which may already raise the floor.
    raised = _ranked(bounds.filter("seen = all"), ranks).filter(F.col("rank") == ranks).select("lang", F.col("score").alias("raised"))
    may = bounds.join(raised, "lang", "left").filter("score >= coalesce(greatest(floor, raised), 0)")
    cuts = settled(cuts.join(may.select("lang", "phrase"), ["lang", "phrase"]))
    wanted = settled(cuts.filter("r IS NULL").select("lang", F.col("rest").alias("phrase")).distinct())
    heads = wanted.select("lang", F.substring_index("phrase", " ", 1).alias("head")).distinct()
    start = bit_map(heads.select(_key("lang", "head")).union(_open_marks(wanted.select("lang").distinct())))
    longer = wanted.select("lang", F.substring_index("phrase", " ", 2).alias("head"), "phrase").filter("head <> phrase")
    inner = bit_map(wanted.select(_key("lang", "phrase")).union(longer.select(_key("lang", "head", "\1"))))
    scan = spark.sparkContext.broadcast(Scan(wide, start, inner, longest))
    counted = _tally(docs, lambda *a: _count_parts(scan.value)(*a), _items, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    parts = settled(counted.join(wanted, ["lang", "phrase"]))
    more = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("more"))
    whole = cuts.join(more, ["lang", "rest"], "left").withColumn("r", F.coalesce("r", "more")).withColumn("score", _score("a", "n", "l", "r"))
    best = whole.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return settled(best.select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r")), parts
