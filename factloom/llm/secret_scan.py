"""Secret scan in built-in expressions only.

Three fixed patterns give the base findings. The method adds spans: a window
slides over candidate strings, its symbol counts change by one character that
leaves and one that enters, and windows whose Shannon entropy passes the bound
of their character class are reported, unless an allow-list names the string.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.exprs import let
from factloom.llm.common import hidden

WINDOW = 20
#: Fixed values of the contract: base kinds and their patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
#: Class: candidate pattern, alphabet, bound in bits. A window of 20 holds 4.32 bits at most.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 3.05),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85),
}
#: Candidates that are known to be no secrets as a whole.
ALLOW = r"^[0-9]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|^sha(1|256|384|512)-"
#: Runs that are known to be none: a word that fills a segment between separators, or a plain sequence.
ALLOW_RUN = r"(?:^|[+/_=-])(?i:example|sample|dummy|placeholder|changeme|lorem|test)(?:[+/_=-]|$)|(?i:abcdefghij|0123456789|1234567890)"
SPAN = "struct<start:bigint,rank:int,end:bigint>"
REDACTED = "[REDACTED]"


def _long(c) -> Column:
    return F.lit(c).cast("bigint") if not isinstance(c, Column) else c.cast("bigint")


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found): leftmost matches in code points.

    The pieces between the matches give their places, so a text without a
    match is read once.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    place = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")

    def placed(m: Column) -> Column:
        step = lambda acc, x: let(
            acc["at"] + x["1"], lambda start: F.struct(
                (start + F.length(x["0"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(x["0"])).alias("end"), x["0"].alias("found")))).alias("out"),
            )
        )
        zipped = F.zip_with(m, F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), lambda g: F.length(g).cast("bigint")), lambda a, b: F.struct(a.alias("0"), b.alias("1")))
        return F.aggregate(zipped, F.struct(_long(0).alias("at"), place.alias("out")), step)["out"]

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(place))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, rank, end) of each base kind."""
    span = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), m["end"].alias("end"))
    long_value = lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 1)) >= 12
    return {
        "assign": F.transform(F.filter(matches(text, ASSIGN), long_value), span(0)),
        "access": F.transform(matches(text, ACCESS), span(1)),
        "hex": F.transform(matches(text, HEX), span(2)),
    }


def hot_windows(candidate: Column, alphabet: str, bound: float, window: int = WINDOW) -> Column:
    """Runs (start, end) inside a candidate that windows of high entropy cover.

    ``sum`` is the sum of c * log2(c) over the symbol counts c of the window;
    the entropy is log2(window) - sum / window. One symbol leaves and one enters
    at each step, and only their two counts change.
    """
    weight = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 1)])
    most = window * (log2(window) - bound)
    runs = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def change(state: Column, slot: Column, by: int) -> Column:
        old = F.element_at(state["counts"], slot)
        return F.struct(
            F.transform(state["counts"], lambda c, i: F.when(i + 1 == slot, c + by).otherwise(c)).alias("counts"),
            (state["sum"] + F.element_at(weight, old + 1 + by) - F.element_at(weight, old + 1)).alias("sum"), state["runs"].alias("runs"),
        )

    def walk(slots: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            left = F.when(i > window, change(acc, F.element_at(slots, F.greatest(i - window, F.lit(1))), -1)).otherwise(acc)
            entered = let(left, lambda s: change(s, F.element_at(slots, i), 1))

            def note(s: Column) -> Column:
                start, end = _long(i - window), _long(i)
                last = F.try_element_at(s["runs"], F.lit(-1))
                joined = F.concat(F.slice(s["runs"], 1, F.size(s["runs"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
                longer = F.when((F.size(s["runs"]) > 0) & (last["end"] >= start), joined).otherwise(F.concat(s["runs"], F.array(F.struct(start.alias("start"), end.alias("end")))))
                return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), F.when((i >= window) & (s["sum"] <= most), longer).otherwise(s["runs"]).alias("runs"))

            return let(entered, note)

        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), runs.alias("runs"))
        return F.aggregate(F.sequence(F.lit(1), F.size(slots)), zero, step)["runs"]

    return let(F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(alphabet), c)), walk)


def entropy_spans(text: Column) -> dict[str, Column]:
    def located(rank: int, alphabet: str, bound: float):
        def allowed(found: Column, r: Column) -> Column:
            """The run, out to the separators around it, is on the allow list."""
            before, after = F.substr(found, F.lit(1), r["start"].cast("int")), F.substr(found, r["end"].cast("int") + 1)
            inside = F.substr(found, r["start"].cast("int") + 1, (r["end"] - r["start"]).cast("int"))
            return F.concat(F.regexp_extract(before, "[A-Za-z0-9]*$", 0), inside, F.regexp_extract(after, "^[A-Za-z0-9]*", 0)).rlike(ALLOW_RUN)

        def spans(m: Column) -> Column:
            move = lambda r: F.struct((m["start"] + r["start"]).alias("start"), F.lit(rank).alias("rank"), (m["start"] + r["end"]).alias("end"))
            return F.transform(F.filter(hot_windows(m["found"], alphabet, bound), lambda r: ~allowed(m["found"], r)), move)

        return spans

    out = {}
    for k, (kind, (pattern, alphabet, bound)) in enumerate(CLASSES.items()):
        wanted = F.filter(matches(text, pattern), lambda m: ~m["found"].rlike(ALLOW))
        out[kind] = F.flatten(F.transform(wanted, located(len(BASE_KINDS) + k, alphabet, bound)))
    return out


def find_secrets(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """``docs`` with spans (start, rank, end) in code points, and the names of the new columns.

    Those are one per base kind, then all base spans and all spans, sorted.
    Ranks number the base kinds, then the entropy classes. An entropy span that
    lies within a base span adds nothing and is left out. Null texts are empty
    and have no spans; repeated rows stay; texts of any length are read whole.
    No column of the caller is touched, whatever its name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = {**base_spans(text), **entropy_spans(text)}
    *names, base, spans = hidden(*kinds, "base", "spans")
    rows = docs.select("*", *[c.alias(n) for n, c in zip(names, kinds.values(), strict=True)])
    own = names[: len(BASE_KINDS)]
    rows = rows.withColumn(base, F.array_sort(F.concat(*own)))
    inside = lambda s: F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    added = F.filter(F.concat(*names[len(own) :]), lambda s: ~inside(s))
    return rows.withColumn(spans, F.array_sort(F.concat(base, added))).drop(*names[len(own) :]), own, base, spans


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*BASE_KINDS, *CLASSES)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row."""
    found, kinds, base, spans = find_secrets(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(c).cast("bigint").alias(f"n_{k}") for k, c in zip(BASE_KINDS, kinds, strict=True)],
        F.sha2(span_text(F.col(base)), 256).alias("base_sha256"), span_text(F.col(spans)).alias("spans"),
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced; ``n_chars`` follows.

    Overlapping spans are replaced once. Texts without a span, nulls included,
    stay as they are, and so do all other columns.
    """
    found, _, _, spans = find_secrets(docs)
    zero = F.struct(F.array().cast("array<string>").alias("parts"), _long(0).alias("at"))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.concat(acc["parts"], F.when(s["start"] < acc["at"], F.array().cast("array<string>")).otherwise(
            F.array(F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(REDACTED)))).alias("parts"),
        s["end"].alias("at"),
    ))
    text = let(F.aggregate(spans, zero, step), lambda a: F.concat(F.array_join(a["parts"], ""), F.col("text").substr((a["at"] + 1).cast("int"), F.length("text"))))
    hit = F.size(spans) > 0
    out = found.withColumn("text", F.when(hit, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
