"""Retrieval for tables of queries: vector, keyword, about, hybrid, re-rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.functions.filters import compile_filter
from factloom.operators import graph
from factloom.operators.mentions import memories_mentioning
from factloom.operators.scans import top_per
from factloom.operators.vectors import vector_top_k
from factloom.session import cut

DEFAULT_TOP_K = 30
MAX_TOP_K = 100
HOP_FACTOR = 0.85
FAST_LANE_FACTOR = 0.9
SCORE_GAP = 0.15
RESULT = ["query_id", "entity_id", "id", "content", "score", "source", "depth", "is_latest", "path"]
PATH_TYPE = "array<struct<kind:string,id:string>>"


def clamp_top_k(queries: DataFrame, column: str = "top_k") -> DataFrame:
    """Add ``k``: asked size, 30 where none is asked, never above 100."""
    return queries.withColumn("k", F.least(F.coalesce(column, F.lit(DEFAULT_TOP_K)), F.lit(MAX_TOP_K)))


def first_k(df: DataFrame, order: list[Column], k: str = "k", most: int = 5 * MAX_TOP_K) -> DataFrame:
    """First ``k`` rows per query, k being a column; ``most`` bounds the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return df.withColumn("_rank", rank).filter((F.col("_rank") <= most) & (F.col("_rank") <= F.col(k))).drop("_rank")


def _no_path() -> Column:
    return F.array().cast(PATH_TYPE)


def _shape(df: DataFrame, score: Column, source: str) -> DataFrame:
    return df.select(
        "query_id", "entity_id", "id", "content", score.alias("score"), F.lit(source).alias("source"), F.lit(0).alias("depth"),
        F.coalesce("is_latest", F.lit(True)).alias("is_latest"), _no_path().alias("path"),
    )


def _searchable(memories: DataFrame, now, filters: dict | None, min_confidence: float | None) -> DataFrame:
    live = memories.filter(F.coalesce("is_latest", F.lit(True)) & X.is_valid(now, inclusive=True))
    if filters:
        live = live.filter(compile_filter(filters, memories.columns))
    if min_confidence is not None:
        live = live.filter(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    return live.select("entity_id", "id", "content", "is_latest", X.trust(now).alias("trust"))


def vector_search(queries: DataFrame, memories: DataFrame, embeddings: DataFrame, now, filters: dict | None = None,
                  min_confidence: float | None = None, candidate_scope: str = "memory") -> DataFrame:
    """Nearest five times k vectors, then cosine times trust, then k per query.

    ``candidate_scope='all'`` lets document chunks use up candidate places.
    """
    vectors = embeddings if candidate_scope == "all" else embeddings.filter(F.col("document_id").isNull())
    near = vector_top_k(queries, vectors, 200)
    sized = near.join(queries.select("query_id", F.least(F.col("k") * 5, F.lit(200)).alias("_most")), "query_id")
    cands = first_k(sized, [F.desc("score"), F.asc("chunk_id")], "_most", 200)
    rows = cands.withColumnRenamed("chunk_id", "id").join(_searchable(memories, now, filters, min_confidence), ["entity_id", "id"])
    scored = _shape(rows.withColumn("_s", F.col("score") * F.col("trust")).drop("score"), F.col("_s"), "memory")
    return first_k(scored.join(queries.select("query_id", "k"), "query_id"), [F.desc("score"), F.asc("id")]).select(*RESULT)


#: Runs of up to so many letters or digits are short terms, of which there are 1,332.
SHORT = 2


def _pieces(word: Column) -> Column:
    """Every three characters in a row of a word, a shorter word as it is."""
    threes = F.transform(F.sequence(F.lit(1), F.length(word) - SHORT), lambda i: F.substring(word, i, F.lit(SHORT + 1)))
    return F.when(F.length(word) <= SHORT, F.array(word)).otherwise(F.array_distinct(threes))


def _term_hits(terms: DataFrame, memories: DataFrame) -> DataFrame:
    """(entity_id, term, id): memories whose lower-case text contains the term.

    A term is one run of letters and digits or one CJK character, so it lies
    inside one word of the text. Terms meet the distinct words of the entity
    on a shared piece, and words lead to memories; no text meets a query. Short
    runs lie in nearly every word, but are few: a text is asked for each of them.
    """
    asked = terms.select("entity_id", "term").distinct().withColumn("short", (F.length("term") <= SHORT) & F.col("term").rlike("^[a-z0-9]+$"))
    asked = cut(asked)
    words = memories.select("entity_id", "id", F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("word"))
    vocabulary = words.select("entity_id", "word").distinct().select("entity_id", "word", F.explode(_pieces(F.col("word"))).alias("piece"))
    long = asked.filter("NOT short").select("entity_id", "term", F.substring("term", 1, SHORT + 1).alias("piece"))
    holding = long.join(vocabulary, ["entity_id", "piece"]).filter(F.contains("word", "term")).select("entity_id", "term", "word")
    by_word = holding.join(words, ["entity_id", "word"]).select("entity_id", "term", "id").distinct()
    # Written down, so that a few terms have a known size and meet the texts where they are read.
    short = cut(asked.filter("short").groupBy("entity_id").agg(F.collect_list("term").alias("terms")))
    texts = memories.join(short, "entity_id").select("entity_id", "id", F.lower("content").alias("text"), F.explode("terms").alias("term"))
    return by_word.unionByName(texts.filter(F.contains("text", "term")).select("entity_id", "term", "id"))


def keyword_search(queries: DataFrame, memories: DataFrame, now, filters: dict | None = None, min_confidence: float | None = None,
                   similarity: float | None = None) -> DataFrame:
    """Share of query terms contained in a memory, times trust; k per query.

    A memory is a hit if it contains a term; with ``similarity`` also if its
    trigrams are that close, which then may decide the score. Both go through
    inverted indexes; scores add up per (query, memory) before the shuffle.
    """
    live = _searchable(memories, now, filters, min_confidence)
    terms = queries.select("query_id", "entity_id", F.explode(X.tokens(F.col("q"))).alias("term"))
    weights = terms.groupBy("query_id", "entity_id", "term").agg(F.count(F.lit(1)).alias("w"))
    sizes = queries.select("query_id", "k", F.size(X.tokens(F.col("q"))).alias("n_terms"))
    hits = weights.join(_term_hits(terms, live), ["entity_id", "term"]).groupBy("query_id", "entity_id", "id").agg(F.sum("w").alias("_w"))
    scored = hits.join(sizes, "query_id").select("query_id", "entity_id", "id", (F.col("_w") / F.col("n_terms")).alias("_m"))
    if similarity is not None:
        asked = queries.select("query_id", "entity_id", X.trigrams(F.col("q")).alias("g")).select("query_id", "entity_id", F.size("g").alias("_a"), F.explode("g").alias("gram"))
        # Of sets that are that close, the smaller has at least that part of the larger one.
        part = F.lit(similarity - 1e-9)
        bounds = cut(asked.groupBy("entity_id").agg((F.min("_a") * part).alias("least"), (F.max("_a") / part).alias("most")))
        # What a generator returns is not computed again by those that read it.
        held = live.select("entity_id", "id", F.explode(F.array(X.trigrams(F.col("content")))).alias("g")).withColumn("_b", F.size("g"))
        held = held.join(bounds, "entity_id").filter("_b BETWEEN least AND most").select("entity_id", "id", "_b", F.explode("g").alias("gram"))
        fits = F.col("_b").between(F.col("_a") * part, F.col("_a") / part)
        close = asked.join(held, ["entity_id", "gram"]).filter(fits).groupBy("query_id", "entity_id", "id").agg(
            F.count(F.lit(1)).alias("_s"), F.first("_a").alias("_a"), F.first("_b").alias("_b")
        )
        close = close.withColumn("_m", F.col("_s") / (F.col("_a") + F.col("_b") - F.col("_s"))).filter(F.col("_m") >= similarity)
        scored = scored.unionByName(close.select("query_id", "entity_id", "id", "_m")).groupBy("query_id", "entity_id", "id").agg(F.max("_m").alias("_m"))
    weighed = scored.join(live.select("entity_id", "id", "trust"), ["entity_id", "id"]).join(sizes.select("query_id", "k"), "query_id")
    weighed = weighed.withColumn("score", F.col("_m") * F.col("trust"))
    top = first_k(weighed, [F.desc("score"), F.asc("id")], most=MAX_TOP_K)
    texts = live.select("entity_id", "id", "content")
    return top.join(texts, ["entity_id", "id"]).select(
        "query_id", "entity_id", "id", "content", "score", F.lit("memory").alias("source"), F.lit(0).alias("depth"), F.lit(True).alias("is_latest"), _no_path().alias("path")
    )


def about_search(asks: DataFrame, memories: DataFrame, mention_edges: DataFrame, now, filters: dict | None = None, min_confidence: float | None = None) -> DataFrame:
    """Memories that mention the asked thing, by trust, newest first on ties."""
    good = memories_mentioning(memories, mention_edges, asks).join(asks.select("query_id", "k"), "query_id").filter(X.is_valid(now, inclusive=True))
    if filters:
        good = good.filter(compile_filter(filters, memories.columns))
    if min_confidence is not None:
        good = good.filter(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    scored = good.withColumn("_s", X.trust(now))
    top = first_k(scored, [F.desc("_s"), F.desc("created_at"), F.asc("id")])
    return _shape(top, F.col("_s"), "memory")


def document_search(queries: DataFrame, embeddings: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Nearest document chunks."""
    vectors = embeddings.filter(F.col("document_id").isNotNull())
    near = vector_top_k(queries, vectors, MAX_TOP_K, min_score).join(queries.select("query_id", "k"), "query_id")
    hits = first_k(near, [F.desc("score"), F.asc("chunk_id")], most=MAX_TOP_K)
    texts = vectors.select("entity_id", "chunk_id", F.col("text").alias("content"))
    rows = hits.join(texts, ["entity_id", "chunk_id"]).withColumnRenamed("chunk_id", "id").withColumn("is_latest", F.lit(True))
    return _shape(rows.withColumn("_s", F.col("score")).drop("score"), F.col("_s"), "rag")


def fast_lane_search(queries: DataFrame, fast_lane: DataFrame, now, max_age_hours: int = 24) -> DataFrame:
    """Raw chunks not yet indexed and younger than a day, at nine tenths of their cosine."""
    since = X.at(now) - F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
    live = fast_lane.filter((F.col("stage") == "fast_lane") & (F.col("created_at") >= since))
    near = vector_top_k(queries, live.select("entity_id", F.col("id").alias("chunk_id"), "embedding"), MAX_TOP_K).join(queries.select("query_id", "k"), "query_id")
    hits = first_k(near, [F.desc("score"), F.asc("chunk_id")], most=MAX_TOP_K)
    rows = hits.withColumnRenamed("chunk_id", "id").join(live.select("entity_id", "id", F.col("text").alias("content")), ["entity_id", "id"])
    return _shape(rows.withColumn("is_latest", F.lit(True)).withColumn("_s", F.col("score") * FAST_LANE_FACTOR).drop("score"), F.col("_s"), "fast_lane")


def expand_relations(results: DataFrame, memories: DataFrame, edges: DataFrame, queries: DataFrame, now, filters: dict | None = None) -> DataFrame:
    """Add one-hop EXTENDS and DERIVES_FROM neighbours at 0.85 of their source times trust.

    A neighbour belongs to the best-ranked result that reaches it; results and
    neighbours together are trimmed to twice k.
    """
    near = graph.neighbours(edges, memories, ["EXTENDS", "DERIVES_FROM"]).filter("other_latest")
    first = F.min(F.struct((-F.col("score")).alias("a"), F.col("id").alias("b"), F.col("created_at").alias("c"), F.col("rel_type").alias("d"))).alias("_f")
    reach = results.select("query_id", "entity_id", "id", "score").join(near, ["entity_id", "id"])
    reach = reach.groupBy("query_id", "entity_id", "other").agg(first)
    reach = reach.select("query_id", "entity_id", F.col("other").alias("id"), "_f").join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    pool = memories.filter(compile_filter(filters, memories.columns)) if filters else memories
    facts = pool.select("entity_id", "id", "content", X.trust(now).alias("trust"))
    step = lambda kind, ident: F.struct(kind.alias("kind"), ident.alias("id"))
    added = reach.join(facts, ["entity_id", "id"]).select(
        "query_id", "entity_id", "id", "content", (-F.col("_f.a") * HOP_FACTOR * F.col("trust")).alias("score"), F.lit("memory_expanded").alias("source"),
        F.lit(1).alias("depth"), F.lit(True).alias("is_latest"),
        F.array(step(F.lit("memory"), F.col("_f.b")), step(F.col("_f.d"), F.col("id"))).cast(PATH_TYPE).alias("path"),
    )
    both = results.select(*RESULT).unionByName(added).join(queries.select("query_id", (F.col("k") * 2).alias("_k2")), "query_id")
    return first_k(both, [F.desc("score"), F.asc("depth"), F.asc("id")], "_k2", 2 * MAX_TOP_K).select(*RESULT)


def expand_hops(results: DataFrame, memories: DataFrame, edges: DataFrame, mention_edges: DataFrame, now, depth: int, filters: dict | None = None) -> DataFrame:
    """Add memories within ``depth`` hops of the results, at trust times 0.85 per hop."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("depth"), F.asc("id"))
    seeds = results.select("query_id", "entity_id", "id", F.row_number().over(order).alias("position"))
    hops = graph.walk(seeds, memories, edges, mention_edges, depth)
    pool = memories.filter(compile_filter(filters, memories.columns)) if filters else memories
    facts = pool.select("entity_id", "id", "content", X.trust(now).alias("trust"))
    added = hops.join(facts, ["entity_id", "id"]).select(
        "query_id", "entity_id", "id", "content", (F.col("trust") * F.pow(F.lit(HOP_FACTOR), F.col("depth"))).alias("score"),
        F.lit("memory_expanded").alias("source"), "depth", (~F.col("historical")).alias("is_latest"), F.col("path").cast(PATH_TYPE).alias("path"),
    )
    return results.select(*RESULT).unionByName(added)


def merge_results(results: DataFrame, queries: DataFrame, truncate: bool = True) -> DataFrame:
    """One ranked list per query from all sources.

    Best score first, shallower first, then id. A repeated id is dropped, and
    so is a text already kept from another source. The list ends before the
    first live row that lies more than 0.15 below the one before it, once a
    floor of rows is kept, and in any case after k rows.
    """
    order = [F.desc("score"), F.asc("depth"), F.asc("id"), F.asc("source")]
    text = F.lower(F.regexp_replace("content", r"(?U)\A\s+|\s+\z", ""))
    ranked = results.withColumn("_key", F.sha2(text, 256))
    ranked = top_per(ranked, ["query_id", "id"], order, 1)
    by_text = Window.partitionBy("query_id", "_key").orderBy(*order)
    ranked = ranked.withColumn("_owner", F.first("source").over(by_text)).filter("source = _owner")
    ranked = ranked.join(queries.select("query_id", "k"), "query_id")
    by_rank = Window.partitionBy("query_id").orderBy(*order)
    floor = F.least(F.col("k"), F.when(F.col("k") <= 5, 3).otherwise(2))
    ranked = ranked.withColumn("rank", F.row_number().over(by_rank))
    gap = F.lag("score").over(by_rank) - F.col("score")
    stop = F.lit(False)
    if truncate:
        stop = F.coalesce((F.col("rank") > floor) & (gap > SCORE_GAP) & F.col("is_latest"), F.lit(False))
    ranked = ranked.withColumn("_stop", stop.cast("int"))
    ranked = ranked.withColumn("_stopped", F.max("_stop").over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter((F.col("_stopped") == 0) & (F.col("rank") <= F.col("k"))).select(*RESULT, "rank")


def hybrid_search(queries: DataFrame, memories: DataFrame, embeddings: DataFrame | None, edges: DataFrame, mention_edges: DataFrame, fast_lane: DataFrame, now, *,
                  mode: str = "hybrid", depth: int = 0, filters: dict | None = None, min_confidence: float | None = None, truncate: bool = True,
                  about: bool = False, rewrite: bool = False, rerank: bool = False, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The whole retrieval for a table of queries in one go.

    Modes are hybrid, memory and rag. With ``about`` queries carry an
    ``about`` column and only memories mentioning it are returned. Without
    ``embeddings`` memories are found by keywords, documents and the fast lane
    give nothing, and the list is not cut at a gap. ``rewrite`` expands the query
    text by its patterns first, which needs ``embed`` (a text column to a vector
    column) where vectors are searched. ``rerank`` orders the result anew, by
    embedding where there is one, else by shared terms.
    """
    if mode not in ("hybrid", "memory", "rag"):
        raise ValueError(f"unknown mode {mode}")
    by_keywords = embeddings is None
    if rewrite:
        queries = queries.withColumn("q", X.expand_query(F.col("q")))
        if not by_keywords:
            if embed is None:
                raise ValueError("rewritten queries need an embedding of their own")
            queries = queries.withColumn("embedding", embed(F.col("q")))
    parts = []
    if about:
        memory = about_search(queries, memories, mention_edges, now, filters, min_confidence)
    elif mode in ("hybrid", "memory"):
        memory = keyword_search(queries, memories, now, filters, min_confidence) if by_keywords else vector_search(queries, memories, embeddings, now, filters, min_confidence)
        memory = expand_relations(cut(memory), memories, edges, queries, now, filters)
    else:
        memory = None
    if memory is not None:
        if depth > 0:
            memory = expand_hops(cut(memory), memories, edges, mention_edges, now, depth, filters)
        parts.append(memory)
    if not about and not by_keywords and mode in ("hybrid", "rag"):
        parts.append(document_search(queries, embeddings))
    if not about and not by_keywords and mode in ("hybrid", "memory"):
        parts.append(fast_lane_search(queries, fast_lane, now))
    if not parts:
        parts.append(keyword_search(queries, memories, now).limit(0))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merge_results(merged, queries, truncate and not about and not by_keywords)
    if not rerank:
        return merged
    if embed is not None and not by_keywords:
        return rerank_by_embedding(merged.drop("rank"), queries, embed)
    return rerank_by_keywords(merged.drop("rank"), queries)


def rerank_by_embedding(results: DataFrame, queries: DataFrame, embed) -> DataFrame:
    """Blend 0.7 of the cosine to the query text with 0.3 of the score.

    ``embed`` maps a text column to a vector column.
    """
    q = queries.select("query_id", embed(F.col("q")).alias("_qv"))
    rows = results.withColumn("_rv", embed(F.col("content"))).join(q, "query_id")
    score = F.lit(0.7) * X.cosine(F.col("_qv"), F.col("_rv")) + F.lit(0.3) * F.col("score")
    rows = rows.withColumn("score", score).drop("_qv", "_rv")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))


def rerank_by_keywords(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Order by score raised up to 15 percent by shared terms; scores stay."""
    q = queries.select("query_id", F.array_distinct(X.tokens(F.col("q"))).alias("_t"))
    rows = results.join(q, "query_id")
    shared = F.size(F.array_intersect("_t", F.array_distinct(X.tokens(F.col("content")))))
    boost = F.when(F.size("_t") == 0, F.col("score")).otherwise(F.col("score") * (F.lit(1.0) + F.lit(0.15) * shared / F.size("_t")))
    rows = rows.withColumn("_b", boost)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_b"), F.asc("id")))).drop("_t", "_b")


def context_block(profile: DataFrame, results: DataFrame, queries: DataFrame, max_facts: int = 10, max_chars: int = 1500) -> DataFrame:
    """One text per query: the entity's best facts up to a length, then the hits."""
    facts = profile.filter("kind = 'static'").filter(F.col("rank") <= max_facts)
    line = F.concat(F.lit("- "), "content")
    running = F.sum(F.length(line)).over(Window.partitionBy("entity_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    facts = facts.withColumn("_len", running).filter(F.col("_len") <= max_chars)
    head = facts.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("_head"))
    hits = results.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("* "), "content").alias("line")))), lambda s: s["line"]), "\n").alias("_tail")
    )
    out = queries.select("query_id", "entity_id").join(head, "entity_id", "left").join(hits, "query_id", "left")
    return out.select("query_id", "entity_id", F.concat_ws("\n\n", "_head", "_tail").alias("context"))
