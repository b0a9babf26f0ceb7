"""Column builders: trust, importance, conflict impact, text features, vectors.

Everything here is a built-in Spark expression; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of each way a memory was obtained; others weigh 1.
PROVENANCE_WEIGHTS = {
    "explicit_statement": 1.0,
    "validated": 0.95,
    "corrected": 0.9,
    "observed": 0.85,
    "imported": 0.8,
    "inferred": 0.7,
}
# Memory types whose trust falls with age.
DECAYING_TYPES = ["preference", "observation", "episodic"]
# Weight of each memory type in importance; others weigh 0.5.
TYPE_WEIGHTS = {"preference": 1.0, "fact": 0.8, "episodic": 0.5, "noise": 0.2}
# Internal types by how much replacing them matters.
HIGH_IMPACT = ["decision", "commitment", "goal"]
MEDIUM_IMPACT = ["preference", "relationship", "error"]
# The closed set of mention types and the accepted synonyms.
MENTION_TYPES = ["person", "organization", "location", "technology", "datetime", "role", "concept"]
MENTION_TYPE_ALIASES = {"product": "technology", "title": "role", "other": "concept"}
# Words that announce a future event, words that end one,
# words that state a change, bare negations, and units of measure.
FUTURE_WORDS = r"明天|后天|大后天|\d+\s*天后|下周|下个月|明年|未来|tomorrow|\d+\s*days\s+later|next\s+week|next\s+month|next\s+year"
COMPLETION_WORDS = "考完|结束|取消|完成|过期|finished|cancelled|canceled|done|completed"
CHANGE_WORDS = ["刚", "现在", "换了", "搬到", "跳槽", "离职", "改用", "不再"]
NEGATION_WORDS = ["不", "不是", "没有", "别", "没"]
UNITS = "万|元|岁|%|kg|km|美元|欧元|rmb"
# Names a structure template replaces by a star.
TEMPLATE_NAMES = [
    "Google", "Stripe", "Apple", "Meta", "Amazon", "Microsoft", "腾讯", "阿里", "字节", "百度",
    "北京", "上海", "深圳", "杭州", "西雅图", "旧金山", "纽约", "伦敦", "东京",
    "Python", "TypeScript", "JavaScript", "Rust", "Go", "Java", "C++",
]
# Personal-data patterns in the order they are applied.
PII_PATTERNS = [
    ("CC", r"\b[3456]\d{3}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4,7}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("JWT", r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
    ("TOKEN", r"Bearer\s+[A-Za-z0-9\-._~+/]+=*"),
    ("API_KEY", r"sk-[a-zA-Z0-9]{32,}"),
    ("API_KEY", r"\b[A-Za-z]{2,3}_[a-fA-F0-9]{32,}\b"),
    ("IP", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("PHONE", r"(?:\+[\d]{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}|\(\d{2,4}\)[-.\s]?\d{2,4}[-.\s]?\d{2,4})"),
]
# Column names whose content is always redacted.
SENSITIVE_NAMES = ["api_key", "apikey", "secret", "password", "passwd", "token", "credential", "private_key", "encryption_key"]
SENSITIVE_SUFFIXES = ["_secret", "_key", "_token", "_password"]

DAY_MICROS = 86_400_000_000
CODE_BASE = 2_097_152  # above the largest code point


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression named inside a lambda is computed again for each element;
    bound as the element of a one-item array it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def at(now) -> Column:
    """The moment a job runs for, as a timestamp column."""
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")


def fixed(value: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic, the same in every engine."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_MICROS))


def _lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def is_valid(now, inclusive: bool) -> Column:
    """Validity at ``now``; scans exclude the last instant, search keeps it."""
    until = F.col("valid_until")
    return until.isNull() | ((until >= at(now)) if inclusive else (until > at(now)))


def trust(now) -> Column:
    confidence = F.coalesce(F.col("confidence"), F.lit(0.8))
    age = F.floor(days_between(at(now), F.col("created_at")))
    decay = (
        F.when(F.col("memory_type").isin(DECAYING_TYPES) & (age > 90), F.lit(0.2))
        .when(F.col("memory_type").isin(DECAYING_TYPES) & (age > 30), F.lit(0.1))
        .otherwise(F.lit(0.0))
    )
    boost = F.least(F.lit(0.15), F.lit(0.03) * F.coalesce(F.col("validation_count"), F.lit(0)))
    base = confidence * _lookup(F.col("provenance"), PROVENANCE_WEIGHTS, 1.0) + boost - decay
    return (
        F.when(~F.coalesce(F.col("is_latest"), F.lit(True)), F.lit(0.0))
        .when(F.coalesce(F.col("contradiction_detected"), F.lit(False)), F.greatest(F.lit(0.1), confidence * F.lit(0.3)))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))
    )


def recency(days: Column) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), days) / F.lit(30.0))


def importance(now, trust_col: Column, rel_count: Column) -> Column:
    score = (
        F.lit(0.35) * trust_col
        + F.lit(0.25) * recency(days_between(at(now), F.col("created_at")))
        + F.lit(0.2) * _lookup(F.col("memory_type"), TYPE_WEIGHTS, 0.5)
        + F.lit(0.2) * F.least(F.coalesce(rel_count, F.lit(0)) / F.lit(10.0), F.lit(1.0))
    )
    return fixed(F.least(score, F.lit(1.0)), 4)


def impact(new: str = "n", old: str = "o") -> Column:
    """How much is at stake when ``new`` replaces ``old`` (column prefixes)."""
    def internal(side: str, high: float, medium: float) -> Column:
        kind = F.col(f"{side}_internal_type")
        return F.when(kind.isin(HIGH_IMPACT), F.lit(high)).when(kind.isin(MEDIUM_IMPACT), F.lit(medium)).otherwise(F.lit(0.0))

    def public(side: str) -> Column:
        return F.when(F.col(f"{side}_memory_type").isin("fact", "preference"), F.lit(0.1)).otherwise(F.lit(0.0))

    confidence = F.coalesce(F.col(f"{new}_confidence"), F.lit(0.8))
    total = (
        internal(new, 0.4, 0.25) + internal(old, 0.3, 0.15) + public(new) + public(old)
        + F.least(confidence * F.lit(0.2), F.lit(0.2))
    )
    return F.least(total, F.lit(1.0))


def is_sure(confidence: str = "confidence", least: float = 0.9) -> Column:
    """Whether a memory is sure enough for its updates to need confirmation."""
    return F.coalesce(F.col(confidence), F.lit(0.8)) >= least


def requires_confirmation(new: str = "n", old: str = "o", threshold: float = 0.7, min_confidence: float = 0.9) -> Column:
    return (impact(new, old) >= threshold) & is_sure(f"{new}_confidence", min_confidence)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays for single pairs; 0 where a norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


# ---------------------------------------------------------------- text features


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def bigram_codes(text: Column) -> Column:
    """Distinct character bigrams of the text without white space, as numbers."""
    codes = F.transform(F.split(squeezed(text), ""), lambda ch: F.ascii(ch).cast("bigint"))

    def pairs(c: Column) -> Column:
        n = F.size(c)
        zipped = F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: a * F.lit(CODE_BASE) + b)
        return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.array_distinct(zipped))

    return let(codes, pairs)


def subject_words(text: Column) -> Column:
    """Leading CJK character and pair, or the leading capitalised word."""
    run = F.regexp_extract(text, r"^[一-鿿]+", 0)
    word = F.regexp_extract(text, r"^[A-Z][a-zA-Z]+", 0)
    return F.filter(
        F.array(
            F.substring(run, 1, 1),
            F.when(F.length(run) >= 2, F.substring(run, 1, 2)).otherwise(F.lit("")),
            word,
        ),
        lambda w: w != "",
    )


def _escape(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)


def structure_template(text: Column, names: list[str] | None = None) -> Column:
    pattern = "|".join(_escape(n) for n in (names or TEMPLATE_NAMES))
    starred = F.regexp_replace(text, f"({pattern})", "*")
    return F.when(starred != text, F.regexp_replace(starred, r"(?U)\s*\*\s*", "*"))


def fillers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([一-鿿]+|[A-Z][a-z]+(?:\+{2})?|[A-Z]{2,})"), 1)


def quantities(text: Column) -> Column:
    """Array of (number, unit) found in the text."""
    pattern = rf"(?i)(\d+(?:\.\d+)?)\s*({UNITS})"
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), 1),
        F.regexp_extract_all(text, F.lit(pattern), 2),
        lambda num, unit: F.struct(num.alias("num"), unit.alias("unit")),
    )


def unit_names(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda p: p["unit"]))


def unit_signatures(pairs: Column) -> Column:
    """One entry per unit: the unit and its sorted distinct values."""
    return F.transform(
        unit_names(pairs),
        lambda u: F.concat_ws(
            "|", u, F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["unit"] == u), lambda p: p["num"])))
        ),
    )


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def has_future(text: Column) -> Column:
    return text.rlike(f"(?i)(?:{FUTURE_WORDS})")


def has_completion(text: Column) -> Column:
    return text.rlike(f"(?i)(?:{COMPLETION_WORDS})")


def tokens(text: Column) -> Column:
    """Lower-case Latin words and numbers, then single CJK characters."""
    return F.concat(
        F.regexp_extract_all(F.lower(text), F.lit(r"([a-zA-Z0-9]+)"), 1),
        F.regexp_extract_all(text, F.lit(r"([一-鿿])"), 1),
    )


def trigrams(text: Column) -> Column:
    """Distinct trigrams of words padded by two blanks before and one after."""
    apart = F.concat(F.lit("   "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   "), F.lit("   "))
    return F.array_distinct(F.regexp_extract_all(apart, F.lit("(?=(  [^ ]| [^ ]{2}| [^ ] |[^ ]{2}.))"), 1))


def set_similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def mention_type(value: Column) -> Column:
    key = F.lower(F.trim(value))
    out = F.lit("concept")
    for alias, kind in MENTION_TYPE_ALIASES.items():
        out = F.when(key == alias, F.lit(kind)).otherwise(out)
    return F.when(key.isin(MENTION_TYPES), key).otherwise(out)


def clamp_confidence(value: Column, default: float = 0.9) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def expand_query(q: Column) -> Column:
    text = F.trim(q)
    return (
        F.when(text == "", text)
        .when(text.startswith("如何"), F.concat(text, F.lit(" 方法 步骤")))
        .when(text.startswith("什么是") | text.startswith("啥是"), F.concat(text, F.lit(" 定义 说明")))
        .when(F.length(text) <= 10, F.concat(text, F.lit(" 相关信息")))
        .otherwise(text)
    )


def hash_embedding(text: Column, dims: int) -> Column:
    """Deterministic vector of a text: byte pairs of its SHA-256 on [-1, 1].

    The digest has 16 byte pairs, so the vector repeats with period 16.
    """
    def vector(digest: Column) -> Column:
        period = [
            F.conv(F.substring(digest, 4 * j + 1, 4), 16, 10).cast("double") / F.lit(65535.0) * F.lit(2.0) - F.lit(1.0)
            for j in range(16)
        ]
        return F.slice(F.flatten(F.array_repeat(F.array(*period), -(-dims // 16))), 1, dims).cast("array<float>")

    return let(F.sha2(text.cast("binary"), 256), vector)


# ---------------------------------------------------------------- deadlines


def _end_of_day(day: Column) -> Column:
    return F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 23:59:59")))


#: More days or months than the calendar holds.
BEYOND = 3_000_000


def _number(text: Column, pattern: str) -> Column:
    # Numbers beyond the calendar stand for its end.
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", F.least(F.coalesce(found.try_cast("bigint"), F.lit(BEYOND)), F.lit(BEYOND)).cast("int"))


def _within_calendar(day: Column) -> Column:
    return F.least(day, F.lit("9999-12-31").cast("date"))


def deadline(text: Column, reference: Column) -> Column:
    """First future deadline the text names, by pattern priority, or null."""
    day = F.to_date(reference)
    iso = F.replace(F.regexp_extract(text, r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", 0), F.lit("/"), F.lit("-")).try_cast("date")
    month = F.concat(F.replace(F.regexp_extract(text, r"\d{4}[-/]\d{1,2}", 0), F.lit("/"), F.lit("-")), F.lit("-1")).try_cast("date")
    days_zh = _number(text, r"(\d+)天后")
    days_en = _number(text, r"(\d+) days later")
    months_zh = _number(text, r"(\d+)个月后")
    months_en = _number(text, r"(\d+) months later")
    monday_based = F.weekday(day) + 1
    found = F.coalesce(
        F.when(iso > day, iso),
        F.when(month > F.last_day(day), F.last_day(month)),
        F.when(text.contains("大后天"), F.date_add(day, 3)),
        F.when(text.contains("后天"), F.date_add(day, 2)),
        F.when(text.rlike("明天|明日"), F.date_add(day, 1)),
        F.when(days_zh > 0, _within_calendar(F.date_add(day, days_zh))),
        F.when(text.contains("tomorrow"), F.date_add(day, 1)),
        F.when(days_en > 0, _within_calendar(F.date_add(day, days_en))),
        F.when(text.rlike("下周|next week"), F.date_add(day, F.lit(14) - monday_based)),
        F.when(text.rlike("下个月|next month"), F.last_day(F.add_months(day, 1))),
        F.when(months_zh.isNotNull(), _within_calendar(F.add_months(day, months_zh))),
        F.when(months_en.isNotNull(), _within_calendar(F.add_months(day, months_en))),
        F.when(text.rlike("明年|next year"), F.make_date(F.year(day) + 1, F.lit(12), F.lit(31))),
    )
    return _end_of_day(found)


# ---------------------------------------------------------------- personal data


def mask_pii(text: Column) -> Column:
    for kind, pattern in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def is_sensitive_name(name: str) -> bool:
    low = name.lower()
    return low in SENSITIVE_NAMES or any(low.endswith(s) for s in SENSITIVE_SUFFIXES)


def _count(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def pii_hits(text: Column) -> Column:
    """Map from kind of personal data to how often masking replaced it."""
    kinds = list(dict.fromkeys(kind for kind, _ in PII_PATTERNS))

    def counted(masked: Column) -> Column:
        entries = []
        for kind in kinds:
            entries += [F.lit(kind), _count(masked, f"[{kind}]") - _count(text, f"[{kind}]")]
        return F.create_map(*entries)

    return let(mask_pii(text), counted)
