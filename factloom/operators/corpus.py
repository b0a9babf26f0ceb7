"""Corpus jobs: chunking, transcripts, masking, page text, all per text row.

Each splitter turns one text column into an array of chunks by built-in
functions; ``chunk_table`` unnests it. Texts are read whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.functions.exprs import let

TARGET_CHARS = 2048
MIN_CHARS = 400
FAST_LANE_CHARS = 1024
MARK = "\x01"
# Speaker names that start a turn, and words that start a definition.
SPEAKERS = "User|Assistant|System|AI|Human|Bot"
DEFINITIONS = "def |class |async def |function |func |fn "


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _holds_text(part: Column) -> Column:
    """Whether ``strip`` leaves something."""
    return part.rlike(r"(?U)\S")


def _not_blank(parts: Column) -> Column:
    return F.filter(parts, _holds_text)


def greedy_pack(parts: Column, fits: Callable[[Column, Column], Column], separator: str) -> Column:
    """Append parts to the open chunk while they fit, else close it.

    ``fits`` compares lengths, of the open chunk and the part. The fold carries
    places and lengths only, so each part's text is copied once, into its chunk.
    """
    run = "struct<first:int,n:int>"

    def runs(held: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{run}>").alias("done"), *[F.lit(0).alias(c) for c in ("first", "n", "size")])

        def step(acc: Column, size: Column) -> Column:
            goes_in = (acc["n"] == 0) | fits(acc["size"], size)
            return F.struct(
                F.when(goes_in, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"))))).alias("done"),
                F.when(goes_in, acc["first"]).otherwise(acc["first"] + acc["n"]).alias("first"), F.when(goes_in, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
                F.when(acc["n"] == 0, size).when(goes_in, acc["size"] + F.lit(len(separator)) + size).otherwise(size).alias("size"),
            )

        def finish(acc: Column) -> Column:
            return F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n")))))

        return F.aggregate(F.transform(held, F.length), start, step, finish)

    return let(parts, lambda held: F.transform(runs(held), lambda r: F.array_join(F.slice(held, r["first"] + 1, r["n"]), separator)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Cut after sentence ends and line ends that white space follows."""
    return _not_blank(F.split(F.regexp_replace(text, r"(?U)([.!?。！？\n])\s+", "$1" + MARK), MARK))


def text_chunks(text: Column, target: int = TARGET_CHARS, minimum: int = MIN_CHARS) -> Column:
    """Paragraphs, long ones packed from sentences, short neighbours merged."""
    packed = lambda p: F.transform(
        greedy_pack(sentences(p), lambda buf, s: buf + s <= target, " "), strip
    )
    pieces = F.flatten(F.transform(paragraphs(text), lambda p: F.when(F.length(p) > target, packed(p)).otherwise(F.array(p))))
    return greedy_pack(pieces, lambda buf, c: (buf < minimum) & (buf + c <= target), "\n\n")


def paragraph_chunks(text: Column, target: int = TARGET_CHARS) -> Column:
    """Paragraphs packed up to the target, as for extracted page layouts."""
    return greedy_pack(paragraphs(text), lambda buf, p: buf + p <= target, "\n\n")


def chunk_table(df: DataFrame, chunks: Column, keys: list[str]) -> DataFrame:
    """One row per chunk: keys, index, text, token_count."""
    out = df.select(*keys, F.posexplode(chunks).alias("index", "text"))
    return out.withColumn("token_count", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int"))


def chunk_stats(chunks: DataFrame, source: str) -> DataFrame:
    """Chunks, tokens, size percentiles and repeated chunks per source."""
    per = chunks.groupBy(source).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"),
        F.max("token_count").alias("largest"), F.approx_percentile("token_count", 0.5, 10000).alias("median"),
    )
    copies = chunks.groupBy(source, F.sha2("text", 256).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return per.join(copies.groupBy(source).agg(F.sum(F.col("_n") - 1).alias("repeated")), source)


# ---------------------------------------------------------------- transcripts


def transcript_turns(text: Column) -> Column:
    """Array of (speaker, text) for labelled turns; empty without labels."""
    label = rf"(?im)^(?:\*\*)?({SPEAKERS})(?:\*\*)?\s*:\s*"
    pieces = F.split(F.regexp_replace(text, label, MARK + "$1\x02"), MARK)
    turns = F.filter(pieces, lambda p: F.contains(p, F.lit("\x02")))
    return F.transform(turns, lambda p: F.struct(
        F.substring_index(p, "\x02", 1).alias("speaker"), strip(F.substring_index(p, "\x02", -1)).alias("text")))


def size_chunks(text: Column, target: int = TARGET_CHARS) -> Column:
    """Sentences packed by size, for transcripts without speaker labels."""
    parts = _not_blank(F.split(F.regexp_replace(text, r"(?U)(?<=[.!?。！？\n])\s*", MARK), MARK))
    packed = greedy_pack(parts, lambda buf, s: buf + 1 + s <= target, " ")
    return F.filter(F.transform(packed, strip), lambda c: c != "")


def conversation_chunks(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Chunk per turn as "Speaker: text"; by size where nobody is named."""
    turns = transcript_turns(F.col(text))
    lines = F.transform(turns, lambda t: F.concat(t["speaker"], F.lit(": "), t["text"]))
    return chunk_table(df, F.when(F.size(turns) > 0, lines).otherwise(size_chunks(F.col(text))), keys)


def turn_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows; an equi-join on position."""
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answers, ["conv_id", "turn"])


# ---------------------------------------------------------------- markdown, code


def markdown_sections(text: Column) -> Column:
    """Array of (path, text, is_code): sections under their headings, fences apart."""
    fenced = F.regexp_replace(text, r"(```[\s\S]*?```)", MARK + "$1" + MARK)
    segments = _not_blank(F.split(fenced, MARK))
    heading = r"(?md)^(#{1,6})\s+(.+)$"

    def sections(segment: Column) -> Column:
        pieces = F.filter(F.split(F.regexp_replace(strip(segment), heading, "\x02$0"), "\x02"), lambda p: strip(p) != "")
        start = F.struct(
            F.array().cast("array<struct<level:int,title:string>>").alias("stack"),
            F.array().cast("array<struct<path:array<string>,text:string,is_code:boolean>>").alias("done"),
        )

        def step(acc: Column, piece: Column) -> Column:
            level = F.length(F.regexp_extract(piece, r"(?d)\A(#{1,6})\s+.", 1))
            title = F.regexp_extract(piece, r"(?d)\A#{1,6}\s+(.+)", 1)
            deeper = F.concat(F.filter(acc["stack"], lambda h: h["level"] < level), F.array(F.struct(level.alias("level"), title.alias("title"))))
            stack = F.when(level > 0, deeper).otherwise(acc["stack"])
            path = F.when(level > 0, F.transform(stack, lambda h: h["title"])).otherwise(F.array().cast("array<string>"))
            row = F.struct(path.alias("path"), strip(piece).alias("text"), F.lit(False).alias("is_code"))
            return F.struct(stack.alias("stack"), F.concat(acc["done"], F.array(row)).alias("done"))

        return F.aggregate(pieces, start, step, lambda acc: acc["done"])

    code = lambda s: F.array(F.struct(F.array().cast("array<string>").alias("path"), s.alias("text"), F.lit(True).alias("is_code")))
    return F.flatten(F.transform(segments, lambda s: F.when(s.startswith("```"), code(s)).otherwise(sections(s))))


def clean_code(text: Column) -> Column:
    return F.regexp_replace(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))), r"\n{3,}", "\n\n")


# What the first line of a code block starts with, in order of test.
LANGUAGE_STARTS = [
    ("python", ["def ", "class "]), ("javascript", ["function ", "const "]), ("go", ["package ", "import ("]), ("rust", ["fn ", "use "]),
]


def code_language(text: Column) -> Column:
    def named(line: Column) -> Column:
        starts = [(name, reduce(or_, [line.startswith(p) for p in prefixes])) for name, prefixes in LANGUAGE_STARTS]
        return F.coalesce(*[F.when(hit, name) for name, hit in starts], F.when(line.startswith("import ") & line.contains("from "), "python"), F.lit("unknown"))

    return let(F.substring_index(strip(text), "\n", 1), named)


def code_blocks(text: Column) -> Column:
    """Array of (index, text, name, lines): blocks between blank lines."""
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda b, i: F.struct(i.alias("index"), strip(b).alias("text")))

    def called(first: Column) -> Column:
        word = F.regexp_replace(F.regexp_extract(F.substring_index(first, "(", 1), r"(?U)(\S+)\s*\z", 1), ":+$", "")
        return let(word, lambda w: F.when(w == "", F.substring(first, 1, 40)).otherwise(w))

    def describe(b: Column) -> Column:
        name = F.when(~b["text"].rlike(rf"(?m)^\s*({DEFINITIONS})"), "module").otherwise(let(strip(F.substring_index(b["text"], "\n", 1)), called))
        return F.struct(b["index"].alias("index"), b["text"].alias("text"), name.alias("name"), F.size(F.split(b["text"], "\n")).alias("lines"))

    return F.transform(F.filter(blocks, lambda b: b["text"] != ""), describe)


def code_table(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per block: keys, text, name, lines, language of its document.

    The language is found before blocks are unnested; beside the generator the
    whole text would be read once per block.
    """
    found = df.select(*keys, F.col(text).alias("_code"), code_language(F.col(text)).alias("language"))
    return found.select(*keys, "language", F.explode(code_blocks(F.col("_code"))).alias("_b")).select(*keys, "_b.text", "_b.name", "_b.lines", "language")


# ---------------------------------------------------------------- tables in text


def _lines(text: Column) -> Column:
    """Parts between line ends of any kind."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def csv_batches(text: Column, budget: int = TARGET_CHARS) -> Column:
    """Rows packed under a repeated header; text chunks where fields differ."""
    unquoted = F.filter(_lines(F.regexp_replace(text, r'"[^"]*+(?:""[^"]*+)*"', "q")), lambda ln: ln != "")
    widths = F.array_distinct(F.transform(unquoted, lambda ln: F.length(ln) - F.length(F.replace(ln, F.lit(","), F.lit("")))))

    def packed(lines: Column) -> Column:
        def under(header: Column) -> Column:
            room = lambda buf, r: F.length(header) + buf + r + 2 <= budget
            batches = greedy_pack(F.slice(lines, F.lit(2), F.size(lines)), room, "\n")
            return F.when(F.size(lines) == 1, F.array(header)).otherwise(F.transform(batches, lambda b: F.concat(header, F.lit("\n"), b)))

        return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(let(F.get(lines, F.lit(0)), under))

    rows = let(_not_blank(_lines(text)), packed)
    return F.when(F.size(widths) > 1, text_chunks(text)).otherwise(rows)


def _spaced(json: Column) -> Column:
    """Compact JSON with a blank after commas and colons outside strings."""
    # From separator to separator, strings passed over whole; possessive, so no long string deepens the stack.
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    return F.regexp_replace(json, rf'\G([^",:]*+(?:{string}[^",:]*+)*+)([,:])', "$1$2 ")


def _element(raw: Column, value: Column) -> Column:
    """JSON text of an element: strings are quoted again, nulls are written."""
    return F.when(raw.isNull(), "null").when(F.schema_of_variant(value) == "STRING", F.to_json(value)).otherwise(_spaced(raw))


def json_batches(text: Column, budget: int = TARGET_CHARS) -> Column:
    """Array records in bounded batches, objects one chunk per key, else text chunks."""
    def listed(body: Column, parsed: Column) -> Column:
        items = F.zip_with(F.from_json(body, "array<string>"), parsed.cast("array<variant>"), _element)
        packed = greedy_pack(items, lambda buf, x: buf + 2 + x + 2 <= budget, ", ")
        return F.transform(packed, lambda b: F.concat(F.lit("["), b, F.lit("]")))

    def keyed(body: Column, parsed: Column) -> Column:
        pairs = F.map_entries(F.from_json(body, "map<string,string>"))
        chunk = lambda values: F.transform(
            pairs, lambda e: F.concat(F.lit('{"'), e["key"], F.lit('": '), _element(e["value"], F.element_at(values, e["key"])), F.lit("}"))
        )
        return let(parsed.cast("map<string,variant>"), chunk)

    def split(body: Column, parsed: Column) -> Column:
        return (
            F.when(parsed.isNotNull() & body.startswith("["), listed(body, parsed))
            .when(parsed.isNotNull() & body.startswith("{"), keyed(body, parsed))
            .otherwise(text_chunks(text))
        )

    return let(strip(text), lambda body: let(F.try_parse_json(body), lambda parsed: split(body, parsed)))


# ---------------------------------------------------------------- fast lane


def fast_lane_pieces(text: Column, most: int = FAST_LANE_CHARS) -> Column:
    """Blank-line parts; long ones cut at the last sentence end of their second half."""
    half = most // 2
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")

    def last_stop(head: Column, stop: str) -> Column:
        at = F.length(head) - F.instr(F.reverse(head), stop)
        return F.when(F.contains(head, F.lit(stop)) & (at >= half), at)

    def cut_once(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.substring(rest, 1, most)
        place = F.coalesce(last_stop(head, "。"), last_stop(head, "."), F.lit(most))

        def taken(at: Column) -> Column:
            piece = strip(F.substring(rest, F.lit(1), at))
            return F.struct(
                F.when(piece != "", F.concat(acc["done"], F.array(piece))).otherwise(acc["done"]).alias("done"),
                strip(F.substring(rest, at + 1, F.length(rest))).alias("rest"),
            )

        return F.when(F.length(rest) > most, let(place, taken)).otherwise(acc)

    def pieces(part: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), part.alias("rest"))
        rounds = F.sequence(F.lit(0), F.floor(F.length(part) / half).cast("int"))
        done = lambda acc: F.when(acc["rest"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["rest"])))
        return F.aggregate(rounds, start, cut_once, done)

    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > most, pieces(p)).otherwise(F.array(p))))


# ---------------------------------------------------------------- masking, pages


def masked(df: DataFrame, text: str) -> DataFrame:
    """Texts with personal data masked, and hits by kind."""
    return df.withColumn("masked", X.mask_pii(F.col(text))).withColumn("hits", X.pii_hits(F.col(text)))


def pii_report(df: DataFrame, text: str, by: str) -> DataFrame:
    """Hits per group and kind."""
    hits = df.select(by, F.explode(X.pii_hits(F.col(text))).alias("kind", "n")).filter("n > 0")
    return hits.groupBy(by, "kind").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("texts"))


def redact_columns(df: DataFrame) -> DataFrame:
    """Replace sensitive columns and mask personal data in the other strings."""
    out = []
    for name, dtype in df.dtypes:
        if X.is_sensitive_name(name):
            out.append(F.lit("[REDACTED]").alias(name))
        else:
            out.append(X.mask_pii(F.col(name)).alias(name) if dtype == "string" else F.col(name))
    return df.select(*out)


# Patterns of page parts; the removed ones are replaced by a space in this order.
PAGE_REMOVED = [r"(?i)<script[^>]*>[\s\S]*?</script>", r"(?i)<style[^>]*>[\s\S]*?</style>", r"<[^>]+>", r"(?U)\s+"]
PAGE_META = r"""(?i)<meta[^>]+{attribute}=["']{name}["'][^>]+content=["']([^"']+)["']"""
PAGE_TITLE = r"(?is)<title[^>]*>([^<]+)</title>"
PAGE_ICON = r"""(?i)<link[^>]+rel=["'](?:shortcut )?icon["'][^>]+href=["']([^"']+)["']"""


def page_text(html: Column) -> Column:
    for pattern in PAGE_REMOVED:
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(html)


def _meta(html: Column, attribute: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, PAGE_META.format(attribute=attribute, name=name), 1), F.lit(""))


def page_metadata(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Clean text, title, description, image, site and icon of stored pages."""
    h, u = F.col(html), F.col(url)
    title = F.nullif(F.regexp_extract(h, PAGE_TITLE, 1), F.lit(""))
    icon = strip(F.regexp_extract(h, PAGE_ICON, 1))
    root = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    text = lambda *options: strip(F.coalesce(*options, F.lit("")))
    return df.select(
        "*", page_text(h).alias("text"), text(_meta(h, "property", "og:title"), title).alias("title"),
        text(_meta(h, "property", "og:description"), _meta(h, "name", "description")).alias("description"),
        text(_meta(h, "property", "og:image")).alias("image"), text(_meta(h, "property", "og:site_name")).alias("site_name"),
        F.when(icon.startswith("//"), F.concat(F.lit("https:"), icon)).when(icon.startswith("/"), F.concat(root, icon)).otherwise(icon).alias("favicon"),
        F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("host"),
    )
