"""Relation inference between memories of one entity, for all entities at once.

A memory is retired by the first later one that updates it while it is valid.
Nothing else decides that, so every memory looks ahead on its own, in ranges of
positions that grow eightfold, block by block over the memories that can update at
all; it leaves as soon as a range holds its superseder. Lifetimes are then
known, and the other edges are pairs within them.

With ``limit`` a new memory is compared with the newest memories only that are
live and valid when it arrives (``limit`` counting the new one). Liveness then
depends on earlier supersessions. The job starts from the arrival window, in
which every supersession found is final, and then only revisits memories whose
window holds retired ones, until no new supersession appears. Believing too
many memories alive never yields a wrong pair, so the rounds end at exactly
the result of processing memories one by one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators.holders import newest_holders
from factloom.operators.ordering import arrival_sequence, newest_alive, running_count
from factloom.operators.overlap import Blocks, Containment
from factloom.session import cut

BUCKET = 32
#: Positions a memory first looks ahead, and how much farther each next range reaches.
AHEAD, GROWTH = 256, 8
#: Positions of a range of the index when all of a lifetime is asked for.
RANGE = 4096
#: Rows of an entity among which leaders are sought first.
HEAD = 256
_SIDE = ["codes", "subjects", "singles", "pairs", "template", "fill", "units", "values", "future", "completion", "change", "negation", "body"]


def text_features(df: DataFrame, text: str = "content") -> DataFrame:
    """Add every column the pair rules read; each text is analysed once."""
    t = F.col(text)
    df = df.withColumn("subjects", X.subject_words(t)).withColumn("_q", X.quantities(t))
    longer = F.filter("subjects", lambda w: F.length(w) >= 2)
    return df.withColumns({
        "codes": X.bigram_codes(t),
        "singles": F.transform(F.filter("subjects", lambda w: F.length(w) == 1), lambda w: F.ascii(w).cast("bigint")),
        "pairs": F.flatten(F.transform(longer, X.bigram_codes)),
        "template": X.structure_template(t),
        "fill": X.fillers(t),
        "units": X.unit_names(F.col("_q")),
        "values": X.unit_signatures(F.col("_q")),
        "future": X.has_future(t),
        "completion": X.has_completion(t),
        "change": X.contains_any(t, X.CHANGE_WORDS),
        "negation": X.contains_any(t, X.NEGATION_WORDS),
        "body": F.regexp_replace(t, r"(?U)^\s+|\s+$", ""),
    }).drop("_q")


def _overlap() -> Column:
    both = (F.size("n_codes") > 0) & (F.size("o_codes") > 0)
    return both & ((F.size("shared") >= 2) | F.arrays_overlap("n_subjects", "o_subjects"))


def _updates(overlap_for_all: bool) -> Column:
    overlap = F.col("overlap")
    temporal = F.col("o_future") & F.col("n_completion") & overlap
    numeric = (F.size(F.array_intersect("n_units", "o_units")) > F.size(F.array_intersect("n_values", "o_values"))) & overlap
    structure = (
        (F.col("n_template") == F.col("o_template")) & (F.size("n_fill") > 0) & (F.size("o_fill") > 0) & (F.col("n_fill") != F.col("o_fill"))
    )
    if overlap_for_all:
        structure = structure & overlap
    blocked = F.array_union("n_pairs", "o_pairs")
    single = F.array_union("n_singles", "o_singles")
    base = F.lit(X.CODE_BASE)
    substantive = F.filter(
        "shared",
        lambda b: ~F.array_contains(blocked, b) & ~F.array_contains(single, F.floor(b / base)) & ~F.array_contains(single, b % base),
    )
    contradiction = overlap & (F.col("n_change") | (F.col("n_negation") & (F.size(substantive) >= 2)))
    return F.coalesce(temporal | numeric, F.lit(False)) | F.coalesce(structure, F.lit(False)) | contradiction


def classify(pairs: DataFrame) -> DataFrame:
    """Add ``shared``, ``overlap`` and ``relation`` to rows with n_ and o_ features."""
    pairs = pairs.withColumn("shared", F.array_intersect("n_codes", "o_codes")).withColumn("overlap", _overlap())
    extends = (F.size("shared") > 0) & (F.size("shared") < F.size("n_codes"))
    relation = (
        F.when((F.col("n_body") == F.col("o_body")) | ~F.col("overlap"), "NONE")
        .when(_updates(True), "UPDATES").when(extends, "EXTENDS").otherwise("NONE")
    )
    return pairs.withColumn("relation", relation)


def contradicts(pairs: DataFrame, out: str) -> DataFrame:
    """Add whether the rules alone call the pair an update, as the merge veto asks."""
    pairs = pairs.withColumn("shared", F.array_intersect("n_codes", "o_codes")).withColumn("overlap", _overlap())
    return pairs.withColumn(out, _updates(False)).drop("shared", "overlap")


def _sided(df: DataFrame, side: str, keep: list[str]) -> DataFrame:
    return df.select("entity_id", *[F.col(c).alias(f"{side}_{c}") for c in keep])


def arrival_pairs(features: DataFrame, window: int, columns: list[str]) -> DataFrame:
    """Every memory with the ``window`` memories that arrived just before it.

    An equi-join on (entity, bucket of 32 positions): memories near the end of
    a bucket are also sent to the next one. Work is linear in the number of
    memories whatever an entity holds.
    """
    keep = ["seq", "id", *columns]
    bucket = F.floor(F.col("seq") / BUCKET)
    new = _sided(features, "n", keep).withColumn("bucket", F.floor(F.col("n_seq") / BUCKET))
    reach = F.floor((F.col("seq") + window) / BUCKET)
    old = features.withColumn("bucket", F.explode(F.sequence(bucket, reach)))
    old = old.select("entity_id", "bucket", *[F.col(c).alias(f"o_{c}") for c in keep])
    near = (F.col("o_seq") < F.col("n_seq")) & (F.col("o_seq") >= F.col("n_seq") - window)
    return new.join(old, ["entity_id", "bucket"]).filter(near).drop("bucket")


def listed_pairs(features: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Features joined to given (entity_id, n_seq, o_seq) pairs."""
    keep = ["seq", "id", *columns]
    return pairs.join(_sided(features, "n", keep), ["entity_id", "n_seq"]).join(_sided(features, "o", keep), ["entity_id", "o_seq"])


class Relations:
    """Result tables of one inference run.

    Supersession is known when the rounds end; edges and pending conflicts are
    worked out on first use.
    """

    def __init__(self, features: DataFrame, found: DataFrame):
        self.features, self._found = features, found

    @cached_property
    def superseded(self) -> DataFrame:
        """(entity_id, id, replaced_by): each retired memory and its first superseder."""
        return self._replaced.drop("created_at")

    @cached_property
    def _replaced(self) -> DataFrame:
        first = self._found.filter("NOT aside").groupBy("entity_id", "o_seq").agg(F.min("n_seq").alias("n_seq"))
        who = self.features.select("entity_id", "seq", "id", "created_at")
        old = who.select("entity_id", F.col("seq").alias("o_seq"), "id")
        new = who.select("entity_id", F.col("seq").alias("n_seq"), F.col("id").alias("replaced_by"), "created_at")
        return first.join(old, ["entity_id", "o_seq"]).join(new, ["entity_id", "n_seq"]).select("entity_id", "id", "replaced_by", "created_at")

    @cached_property
    def candidates(self) -> DataFrame:
        """Every final candidate pair with its class that is an extension or was set aside."""
        raise NotImplementedError

    @cached_property
    def derives(self) -> DataFrame:
        raise NotImplementedError

    @cached_property
    def extends(self) -> DataFrame:
        rows = self.candidates.filter("relation = 'EXTENDS'")
        return rows.select("entity_id", F.col("n_id").alias("from_id"), F.col("o_id").alias("to_id"), F.lit("EXTENDS").alias("rel_type"), F.col("n_created_at").alias("created_at"))

    @cached_property
    def singles(self) -> DataFrame:
        """Edges without the extensions: a few per memory."""
        updates = self._replaced.select(
            "entity_id", F.col("replaced_by").alias("from_id"), F.col("id").alias("to_id"), F.lit("UPDATES").alias("rel_type"), "created_at"
        )
        return updates.unionByName(self.derives)

    @cached_property
    def edges(self) -> DataFrame:
        return self.singles.unionByName(self.extends)

    @cached_property
    def pending(self) -> DataFrame:
        """Updates set aside for confirmation."""
        return self._aside.select(
            "entity_id", F.sha2(F.concat_ws("\x1f", "entity_id", "n_id", "o_id"), 256).alias("conflict_id"),
            F.col("n_id").alias("new_id"), F.col("o_id").alias("old_id"), "impact",
        )

    @property
    def _aside(self) -> DataFrame:
        return self.candidates.filter("aside")


class WindowRelations(Relations):
    """Results of a run with a window: the final candidate pairs are judged again."""

    def __init__(self, features: DataFrame, found: DataFrame, judged: DataFrame, confirm: bool):
        super().__init__(features, found)
        self._judged, self._confirm = judged, confirm

    @cached_property
    def candidates(self) -> DataFrame:
        aside = F.lit(False)
        if self._confirm:
            aside = (F.col("relation") == "UPDATES") & X.requires_confirmation("n", "o")
        return cut(self._judged.select(
            "entity_id", "n_seq", "n_id", "n_created_at", "o_seq", "o_id", "relation", F.size("shared").alias("shared_bigrams"), "overlap",
            aside.alias("aside"), X.impact("n", "o").alias("impact"),
        ))

    @cached_property
    def derives(self) -> DataFrame:
        return _derives(self._judged)


class WholeRelations(Relations):
    """Results of a run without a window; ``ends`` has the last position each memory is a candidate at.

    Extensions and updates set aside are as many as pairs; they come out of the
    blocks they are found in, and nothing on the way holds them all.
    """

    def __init__(self, features: DataFrame, found: DataFrame, signals: DataFrame, ends: DataFrame, blocks: Blocks):
        super().__init__(features, found)
        self._signals, self._ends, self._blocks = signals, ends, blocks

    @property
    def _fresh(self) -> DataFrame:
        return self._signals.filter("fresh").select("entity_id", "seq")

    @cached_property
    def _asks(self) -> DataFrame:
        return cut(_ranges(self._ends.withColumnRenamed("end", "upto"), self._signals, F.lit(0), None))

    @cached_property
    def candidates(self) -> DataFrame:
        found = self._blocks.pairs(self._asks, self._fresh, ["n_seq", "n_id", "n_created_at", "o_seq", "o_id"], "EXTENDS")
        return found.withColumn("relation", F.lit("EXTENDS"))

    @property
    def _aside(self) -> DataFrame:
        """Set aside while the older memory was still a candidate."""
        sure = self._signals.filter("fresh").filter(X.is_sure()).select("entity_id", "seq")
        sides = [f"{p}_{c}" for p in "no" for c in ("id", *_CONFLICT)]
        found = self._blocks.pairs(self._asks, sure, sides, "UPDATES").filter(X.requires_confirmation("n", "o"))
        return found.select("entity_id", "n_id", "o_id", X.impact("n", "o").alias("impact"))

    @cached_property
    def derives(self) -> DataFrame:
        """The three newest live memories that share a bigram, where those that do leave some bigram out."""
        found = newest_holders(self.features, self._ends, self._fresh, 3).filter(F.size("olds") >= 2)
        new = self._signals.select("entity_id", "seq", F.col("id").alias("from_id"), "size", "created_at")
        rows = found.join(new, ["entity_id", "seq"]).filter("covered <> size")
        olds = rows.select("entity_id", "from_id", "created_at", F.explode("olds").alias("o_seq"))
        names = self.features.select("entity_id", F.col("seq").alias("o_seq"), F.col("id").alias("to_id"))
        return olds.join(names, ["entity_id", "o_seq"]).select("entity_id", "from_id", "to_id", F.lit("DERIVES_FROM").alias("rel_type"), "created_at")


_CONFLICT = ["internal_type", "memory_type", "confidence"]


def prepare_features(memories: DataFrame) -> DataFrame:
    """Sequence and rule features of the live memories, written once."""
    live = memories.filter(F.coalesce("is_latest", F.lit(True)))
    seq = arrival_sequence(live)
    base = live.select("entity_id", "id", "content", "created_at", *_CONFLICT)
    return cut(text_features(base).drop("content").join(seq, ["entity_id", "id"]))


def _digests() -> list[Column]:
    """Long texts that are only asked to be equal."""
    digest = lambda c: F.sha2(c, 256)
    return [digest("template").alias("template"), F.when(F.size("fill") > 0, digest(F.to_json("fill"))).alias("fill"), digest("body").alias("body")]


def _signals(features: DataFrame) -> DataFrame:
    """What the rules read of a memory besides its bigrams, in small columns."""
    return cut(features.select(
        "entity_id", "seq", "id", "created_at", "until", "fresh", *_CONFLICT, F.size("codes").alias("size"), "units", "values", "future", "completion", "change", "negation", *_digests(),
    ))


def _in_blocks(features: DataFrame) -> Blocks:
    texts = features.select(
        "entity_id", "seq", "id", "created_at", *_CONFLICT, "codes", "singles", "pairs", "subjects", "units", "values", "future", "completion", "change", "negation", *_digests(),
    )
    return Blocks(texts, ["seq", "id", "created_at", *_CONFLICT], judged=True)


def _ranges(rows: DataFrame, signals: DataFrame, after: Column, length: int | None) -> DataFrame:
    """Positions seq+after+1.. of each row (entity_id, seq, upto), as far as it is valid and the entity goes."""
    tops = signals.groupBy("entity_id").agg(F.max("seq").alias("_top"))
    last = F.least(F.coalesce("upto", "_top"), F.col("_top"))
    if length is not None:
        last = F.least(last, F.col("seq") + after + length)
    rules = ["rules"] if "rules" in rows.columns else []
    return rows.join(tops, "entity_id").select("entity_id", "seq", "upto", *rules, (F.col("seq") + after + 1).alias("first"), last.alias("last")).filter("first <= last")


def _rules(newer: bool) -> Column:
    """By which rules a memory can update others, or be updated; a pair without a common one is no update."""
    some = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    words = some(F.col("change") | F.col("negation"), "words") if newer else F.array(F.lit("words"))
    units = F.coalesce(F.transform("units", lambda u: F.concat(F.lit("unit "), u.cast("string"))), F.array().cast("array<string>"))
    template = F.when(F.col("template").isNotNull() & F.col("fill").isNotNull(), F.array(F.concat(F.lit("template "), "template"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, some(F.col("completion" if newer else "future"), "done"), units, template))


def _look_ahead(features: DataFrame, confirm: bool) -> WholeRelations:
    """First superseder of every memory, in ranges of positions that grow eightfold."""
    blocks, signals = _in_blocks(features), _signals(features)
    updaters = cut(signals.filter("fresh").select("entity_id", "seq", _rules(True).alias("rules")).filter(F.size("rules") > 0))
    # An old memory only asks by rules that somebody of its entity updates by.
    used = updaters.select("entity_id", F.explode("rules").alias("rule")).distinct()
    asking = signals.select("entity_id", "seq", F.col("until").alias("upto"), F.explode(_rules(False)).alias("rule")).join(used, ["entity_id", "rule"])
    open_rows = cut(asking.groupBy("entity_id", "seq", "upto").agg(F.collect_set("rule").alias("rules")))
    found, after, length = None, 0, AHEAD
    while True:
        asks = cut(_ranges(open_rows, signals, F.lit(after), length))
        if asks.isEmpty():
            break
        hits = blocks.pairs(asks, updaters, [f"{p}_{c}" for p in "no" for c in ("seq", *(_CONFLICT if confirm else []))], "UPDATES")
        if confirm:
            hits = hits.filter(~X.requires_confirmation("n", "o"))
        hits = cut(hits.groupBy("entity_id", "o_seq").agg(F.min("n_seq").alias("n_seq"), F.lit(False).alias("aside")))
        found = hits if found is None else found.unionByName(hits)
        retired = hits.select("entity_id", F.col("o_seq").alias("seq"))
        open_rows = asks.select("entity_id", "seq", "upto", "rules").join(retired, ["entity_id", "seq"], "left_anti")
        after, length = after + length, length * GROWTH
    if found is None:
        found = features.sparkSession.createDataFrame([], f"entity_id {features.schema['entity_id'].dataType.simpleString()}, n_seq bigint, o_seq bigint, aside boolean")
    return WholeRelations(features, found, signals, cut(_ends(signals.select("entity_id", "seq", "until"), found)), blocks)


def infer(memories: DataFrame, limit: int | None = None, confirm_high_impact: bool = False, arrivals: DataFrame | None = None) -> Relations:
    """Infer UPDATES, EXTENDS and DERIVES_FROM among the live memories.

    ``limit`` compares a memory with the newest live ones only; without it, with
    all of them. With ``confirm_high_impact`` updates at stake are set aside as pending
    conflicts and supersede nothing. ``arrivals`` (entity_id, id) limits the
    run to newly stored memories, which are compared with all older ones.
    """
    features = prepare_features(memories)
    if arrivals is None:
        features = features.withColumn("fresh", F.lit(True))
    else:
        marked = arrivals.select("entity_id", "id").distinct().withColumn("_new", F.lit(True))
        features = features.join(marked, ["entity_id", "id"], "left").withColumn("fresh", F.coalesce("_new", F.lit(False))).drop("_new")
        features = cut(features)
    if limit is None:
        return _look_ahead(features, confirm_high_impact)
    window = limit - 1
    fresh_seq = features.filter("fresh").select("entity_id", "seq")
    columns = _SIDE + _CONFLICT + ["until", "created_at", "fresh"]

    def updates_in(pairs: DataFrame) -> DataFrame:
        valid = F.col("n_fresh") & (F.col("o_until").isNull() | (F.col("n_seq") <= F.col("o_until")))
        hits = classify(pairs.filter(valid)).filter("relation = 'UPDATES'")
        aside = X.requires_confirmation("n", "o") if confirm_high_impact else F.lit(False)
        return hits.select("entity_id", "n_seq", "o_seq", aside.alias("aside"), X.impact("n", "o").alias("impact"))

    found = cut(updates_in(arrival_pairs(features, window, columns)))
    life = features.select("entity_id", "seq", "until")
    extra = None
    while True:
        ends = _ends(life, found)
        affected = _affected(ends, window)
        if extra is not None:
            affected = affected.unionByName(extra.select("entity_id", F.col("n_seq").alias("seq"))).distinct()
        if arrivals is not None:
            affected = affected.join(fresh_seq, ["entity_id", "seq"], "left_semi")
        reached = cut(newest_alive(ends, affected, window))
        far = reached.filter(F.col("o_seq") < F.col("n_seq") - window)
        fresh = far if extra is None else far.join(extra, ["entity_id", "n_seq", "o_seq"], "left_anti")
        new_hits = cut(updates_in(listed_pairs(features, fresh, columns)))
        extra = far if extra is None else cut(extra.unionByName(fresh))
        if new_hits.isEmpty():
            break
        found = found.unionByName(new_hits)
    ends = cut(_ends(life, found))

    # The final window: arrivals still alive, and for the memories whose
    # arrival window holds retired ones the older memories that move up.
    aged = features.drop("until").join(ends.select("entity_id", "seq", F.col("end")), ["entity_id", "seq"])
    alive = F.col("o_end").isNull() | (F.col("n_seq") <= F.col("o_end"))
    final_columns = _SIDE + _CONFLICT + ["end", "created_at", "fresh"]
    near = arrival_pairs(aged, window, final_columns).filter(alive)
    moved = listed_pairs(aged, reached.filter(F.col("o_seq") < F.col("n_seq") - window), final_columns)
    judged = classify(near.unionByName(moved, allowMissingColumns=True).filter("n_fresh"))
    return WindowRelations(features, found, judged, confirm_high_impact)


def _ends(life: DataFrame, found: DataFrame) -> DataFrame:
    """Last position at which each memory is a candidate: superseded or expired."""
    sup = found.filter("NOT aside").groupBy("entity_id", F.col("o_seq").alias("seq")).agg(F.min("n_seq").alias("_sup"))
    joined = life.join(sup, ["entity_id", "seq"], "left")
    return joined.select("entity_id", "seq", F.least("_sup", "until").alias("end"))


def _affected(ends: DataFrame, window: int) -> DataFrame:
    """Positions whose arrival window holds a memory no longer alive there."""
    last = F.col("seq") + window
    gone = ends.filter(F.col("end").isNotNull() & (F.col("end") < last))
    first = F.greatest(F.col("end"), F.col("seq")) + 1
    hit = gone.select("entity_id", F.explode(F.sequence(first, last)).alias("seq")).distinct()
    return hit.join(ends.select("entity_id", "seq"), ["entity_id", "seq"], "left_semi")


def _derives(judged: DataFrame) -> DataFrame:
    """Three newest sources of memories that two or more together do not cover."""
    sources = judged.filter(F.size("shared") > 0).groupBy("entity_id", "n_seq", "n_id", "n_created_at").agg(
        F.first(F.size("n_codes")).alias("_all"),
        F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("_covered"),
        F.slice(F.sort_array(F.collect_list(F.struct("o_seq", "o_id")), asc=False), 1, 3).alias("_newest"),
        F.count(F.lit(1)).alias("_n"),
    )
    return sources.filter("_n >= 2 AND _covered <> _all").select(
        "entity_id", F.col("n_id").alias("from_id"), F.explode("_newest.o_id").alias("to_id"), F.lit("DERIVES_FROM").alias("rel_type"), F.col("n_created_at").alias("created_at")
    )


def supersede(memories: DataFrame, superseded: DataFrame) -> DataFrame:
    """Flip ``is_latest`` and record who replaced each retired memory."""
    side = superseded.select("entity_id", "id", F.col("replaced_by").alias("_by"))
    out = memories.join(side, ["entity_id", "id"], "left")
    out = out.withColumn("is_latest", F.coalesce("is_latest", F.lit(True)) & F.col("_by").isNull())
    if "replaced_by" in memories.columns:
        return out.withColumn("replaced_by", F.coalesce("_by", "replaced_by")).drop("_by")
    return out.withColumnRenamed("_by", "replaced_by")


# ---------------------------------------------------------------- leaders


def _overlap_ratio() -> Column:
    shared = F.size(F.array_intersect("n_codes", "o_codes"))
    return F.when(F.size("n_codes") > 0, shared / F.size("n_codes")).otherwise(F.lit(0.0))


def _leader_rounds(features: DataFrame, window: int, columns: list[str], matched) -> tuple[DataFrame, DataFrame]:
    """Followers and their matching leaders, as if rows came one by one.

    A row follows if a leader among the newest ``window`` leaders before it
    matches; else it leads. Rounds repeat until the set of followers stands
    still; the first rows are right from the start and right rows stay right.
    """
    near = cut(matched(arrival_pairs(features, window, columns)))
    life = features.select("entity_id", "seq", "until")
    followers = None
    known = None
    while True:
        if followers is None:
            hits = near
        else:
            dead = life.join(followers, ["entity_id", "seq"], "left_semi").select("entity_id", "seq", F.col("seq").alias("end"))
            alive = life.join(followers, ["entity_id", "seq"], "left_anti").select("entity_id", "seq", F.col("until").alias("end"))
            affected = _affected(dead.unionByName(alive), window)
            reached = cut(newest_alive(alive, affected, window))
            far = reached.filter(F.col("o_seq") < F.col("n_seq") - window)
            fresh = far if known is None else far.join(known[0], ["entity_id", "n_seq", "o_seq"], "left_anti")
            fresh = cut(fresh)
            fresh_hits = cut(matched(listed_pairs(features, fresh, columns)))
            known = (fresh, fresh_hits) if known is None else (known[0].unionByName(fresh), known[1].unionByName(fresh_hits))
            leading = alive.select("entity_id", F.col("seq").alias("o_seq"))
            hits = near.join(leading, ["entity_id", "o_seq"], "left_semi").unionByName(
                known[1].join(far.select("entity_id", "n_seq", "o_seq"), ["entity_id", "n_seq", "o_seq"], "left_semi"), allowMissingColumns=True
            )
        hits = cut(hits)
        now = cut(hits.select("entity_id", F.col("n_seq").alias("seq")).distinct())
        same = followers is not None and now.exceptAll(followers).isEmpty() and followers.exceptAll(now).isEmpty()
        if same or (followers is None and now.isEmpty()):
            return now, hits
        followers = now


def _valid_old() -> Column:
    return F.col("o_until").isNull() | (F.col("n_seq") <= F.col("o_until"))


def _possible_leaders(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows (entity_id, seq, until, key) that may lead at all.

    After a copy of a text, a leader that matches the text is there: the copy or
    the one it follows. A later copy can only lead if a row that matches it has
    expired in between, so of the copies between two such expiries the first
    one is enough, however many there are.
    """
    gone = rows.filter("until IS NOT NULL").select("entity_id", F.col("key").alias("o_key"), F.col("until").alias("at")).distinct()
    ends = matches.join(gone, ["entity_id", "o_key"]).select("entity_id", F.col("n_key").alias("key"), "at").distinct()
    copies = rows.select("entity_id", "key", F.col("seq").alias("at"), F.lit(0).alias("end"))
    counted = running_count(copies.unionByName(ends.withColumn("end", F.lit(1))), ["entity_id", "key"], ["at", "end"], F.col("end"), "epoch")
    first = counted.filter("end = 0").groupBy("entity_id", "key", "epoch").agg(F.min("at").alias("seq")).select("entity_id", "seq")
    return rows.join(first, ["entity_id", "seq"], "left_semi")


def _leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, seq) of the rows that lead: no earlier row that they match leads.

    ``edges`` (entity_id, n_seq, o_seq) point to earlier rows. A round settles
    rows without an open edge, and whole chains at once: a row with one open edge
    is the opposite of the row it points to, and pointers double along such rows.
    """
    leaders = None
    open_rows, edges = cut(nodes.select("entity_id", "seq")), cut(edges.select("entity_id", "n_seq", "o_seq"))
    while not open_rows.isEmpty():
        free = open_rows.join(edges.select("entity_id", F.col("n_seq").alias("seq")), ["entity_id", "seq"], "left_anti")
        single = edges.groupBy("entity_id", "n_seq").agg(F.count(F.lit(1)).alias("n"), F.min("o_seq").alias("to")).filter("n = 1")
        pointers = cut(single.select("entity_id", "n_seq", "to", F.lit(True).alias("odd")))
        while True:
            ahead = pointers.select("entity_id", F.col("n_seq").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
            moved = cut(pointers.join(ahead, ["entity_id", "to"], "left"))
            if moved.filter("next IS NOT NULL").isEmpty():
                break
            pointers = moved.select("entity_id", "n_seq", F.coalesce("next", "to").alias("to"), F.when(F.col("next").isNotNull(), F.col("odd") != F.col("more")).otherwise(F.col("odd")).alias("odd"))
        free = cut(free)
        chained = pointers.join(free.select("entity_id", F.col("seq").alias("to")), ["entity_id", "to"], "left_semi")
        leading = cut(free.unionByName(chained.filter("NOT odd").select("entity_id", F.col("n_seq").alias("seq"))))
        touched = edges.join(leading.select("entity_id", F.col("seq").alias("o_seq")), ["entity_id", "o_seq"], "left_semi").select("entity_id", F.col("n_seq").alias("seq"))
        following = cut(touched.unionByName(chained.filter("odd").select("entity_id", F.col("n_seq").alias("seq"))).distinct())
        leaders = leading if leaders is None else leaders.unionByName(leading)
        settled = leading.unionByName(following)
        open_rows = cut(open_rows.join(settled, ["entity_id", "seq"], "left_anti"))
        edges = edges.join(open_rows.withColumnRenamed("seq", "n_seq"), ["entity_id", "n_seq"], "left_semi")
        edges = cut(edges.join(open_rows.withColumnRenamed("seq", "o_seq"), ["entity_id", "o_seq"], "left_semi"))
    return open_rows if leaders is None else leaders


def _heads(rows: DataFrame, batch: int) -> DataFrame:
    """Rows marked ``head`` where they are about the first ``batch`` of their entity; counted in parts of it."""
    part = F.floor(F.col("seq") / F.lit(batch // 8))
    counts = rows.groupBy("entity_id", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("entity_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < batch)
    last = first.groupBy("entity_id").agg(F.max("_part").alias("_last"))
    return rows.join(last, "entity_id").withColumn("head", part <= F.col("_last")).drop("_last")


def _followed(rows: DataFrame, texts: DataFrame, share: float, strict: bool = False) -> DataFrame:
    """Followers with every leader that matches them and is valid: (entity_id, n_seq, n_id, o_seq, o_id, ratio).

    ``rows`` has (entity_id, seq, id, until, key), ``texts`` (entity_id, key, codes);
    a text matches itself. The first rows that follow nobody yet settle who leads
    among them, then all texts meet these leaders and what follows one is
    done: pairs of texts are listed with leaders only. The next such rows may be more.
    """
    close = Containment(texts, share)
    near_enough = F.col("ratio") > share if strict else F.col("ratio") >= share
    old = lambda df: df.select("entity_id", F.col("key").alias("o_key"), F.col("seq").alias("o_seq"), F.col("id").alias("o_id"), F.col("until").alias("o_until"))
    new = lambda df: df.select("entity_id", F.col("key").alias("n_key"), F.col("seq").alias("n_seq"), F.col("id").alias("n_id"))
    near = (F.col("o_seq") < F.col("n_seq")) & _valid_old()
    every, batch, leaders, by_text, open_rows = close.some(None), HEAD, None, None, rows
    while True:
        marked = cut(_heads(open_rows, batch))
        head, rest = marked.filter("head").drop("head"), marked.filter("NOT head").drop("head")
        if head.isEmpty():
            break
        own = close.some(head)
        matches = cut(close.pairs(own, own).filter(near_enough).unionByName(_itself(head)))
        possible = cut(_possible_leaders(head, matches))
        edges = new(possible).join(matches, ["entity_id", "n_key"]).join(old(possible), ["entity_id", "o_key"]).filter(near)
        leading = cut(head.join(_leaders(possible, edges), ["entity_id", "seq"], "left_semi"))
        met = close.pairs(every, close.some(leading)).filter(near_enough).unionByName(_itself(leading))
        met = cut(met.join(old(leading), ["entity_id", "o_key"]))
        leaders, by_text = (leading, met) if leaders is None else (leaders.unionByName(leading), by_text.unionByName(met))
        done = new(rest).join(met, ["entity_id", "n_key"]).filter(near).select("entity_id", F.col("n_seq").alias("seq"))
        open_rows = rest.join(done.distinct(), ["entity_id", "seq"], "left_anti")
        batch *= 8 if leading.count() * 8 > head.count() else 2
    if leaders is None:
        return new(rows).join(old(rows).limit(0), "entity_id").select("entity_id", "n_seq", "n_id", "o_seq", "o_id", F.lit(1.0).alias("ratio"))
    followers = new(rows.join(leaders, ["entity_id", "seq"], "left_anti"))
    return followers.join(by_text, ["entity_id", "n_key"]).filter(near).select("entity_id", "n_seq", "n_id", "o_seq", "o_id", "ratio")


def _texts(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their text, and the bigrams of every distinct text; a text has the position of its first row."""
    keyed = features.withColumn("body", F.sha2("body", 256)).filter("body IS NOT NULL")
    texts = cut(keyed.groupBy("entity_id", "body").agg(F.min("seq").alias("key"), F.first("codes").alias("codes")))
    rows = keyed.select("entity_id", "seq", "id", "until", "body").join(texts.select("entity_id", "body", "key"), ["entity_id", "body"])
    return cut(rows.drop("body")), texts.drop("body")


def _itself(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id", F.col("key").alias("n_key"), F.col("key").alias("o_key"), F.lit(1.0).alias("ratio")).distinct()


def duplicate_skips(memories: DataFrame, window: int | None = None, threshold: float = 0.95) -> DataFrame:
    """New memories not stored: equal to, or almost contained in, a kept one.

    ``window`` compares with the newest kept ones only; without it, with all.
    """
    features = prepare_features(memories)

    def matched(pairs: DataFrame) -> DataFrame:
        same = F.col("n_body") == F.col("o_body")
        hit = _valid_old() & (same | (_overlap_ratio() > threshold))
        return pairs.filter(hit).select("entity_id", "n_seq", "o_seq", "n_id", "o_id")

    if window is None:
        hits = _followed(*_texts(features), threshold, strict=True)
    else:
        _, hits = _leader_rounds(features, window, ["codes", "body", "until"], matched)
    blank = features.filter("body = ''").select("entity_id", "id").withColumn("kept_id", F.lit(None).cast("string"))
    skipped = hits.groupBy("entity_id", F.col("n_id").alias("id")).agg(F.max_by("o_id", "o_seq").alias("kept_id"))
    return skipped.unionByName(blank.join(skipped, ["entity_id", "id"], "left_anti"))


def strengthen_preferences(memories: DataFrame, window: int | None = None, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Repeated preferences retired into the closest earlier one, which gains trust.

    Returns (retired: id, replaced_by, overlap) and (boosted: id, confidence).
    ``window`` counts the memory itself; without it, all earlier ones are compared.
    """
    features = prepare_features(memories)

    def matched(pairs: DataFrame) -> DataFrame:
        both = (F.col("n_memory_type") == "preference") & (F.col("o_memory_type") == "preference")
        scored = pairs.filter(both & _valid_old()).withColumn("overlap", _overlap_ratio())
        return scored.filter(F.col("overlap") >= threshold).select("entity_id", "n_seq", "o_seq", "n_id", "o_id", "overlap")

    if window is None:
        # A text without a bigram matches nothing.
        hits = _followed(*_texts(features.filter("memory_type = 'preference' AND size(codes) > 0")), threshold).withColumnRenamed("ratio", "overlap")
    else:
        _, hits = _leader_rounds(features, window - 1, ["codes", "memory_type", "until"], matched)
    best = F.max_by(F.struct("o_id", "overlap"), F.struct("overlap", "o_seq"))
    retired = hits.groupBy("entity_id", F.col("n_id").alias("id")).agg(best.alias("_b")).select(
        "entity_id", "id", F.col("_b.o_id").alias("replaced_by"), F.col("_b.overlap").alias("overlap")
    )
    gains = retired.groupBy("entity_id", F.col("replaced_by").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    boosted = features.join(gains, ["entity_id", "id"]).select(
        "entity_id", "id", F.least(F.coalesce("confidence", F.lit(0.8)) + F.lit(0.05) * F.col("_n"), F.lit(0.95)).alias("confidence")
    )
    return retired, boosted


def resolve_conflicts(pending: DataFrame, decisions: DataFrame | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply keep_old, keep_new, keep_both or manual to pending conflicts.

    ``decisions`` has (conflict_id, action), or is the action as an expression over
    a conflict, which then meets nothing. Returns (status per conflict, memory changes, UPDATES edges).
    """
    joined = pending.withColumn("action", decisions) if isinstance(decisions, Column) else pending.join(decisions, "conflict_id")
    status = joined.select("conflict_id", F.when(F.col("action") == "manual", "manual").otherwise(F.concat(F.lit("resolved_"), "action")).alias("status"))
    old_wins = joined.filter("action = 'keep_old'").select("entity_id", F.col("new_id").alias("id"), F.col("old_id").alias("replaced_by"))
    new_wins = joined.filter("action = 'keep_new'")
    changes = old_wins.unionByName(new_wins.select("entity_id", F.col("old_id").alias("id"), F.col("new_id").alias("replaced_by"))).withColumn("is_latest", F.lit(False))
    edges = new_wins.select("entity_id", F.col("new_id").alias("from_id"), F.col("old_id").alias("to_id"), F.lit("UPDATES").alias("rel_type"))
    return status, changes, edges
