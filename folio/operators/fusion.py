"""Hybrid retrieval for a table of queries: variants, candidate lists, fusion, rerank.

``queries → variants → {BM25 ∥ cosine} candidate lists → reciprocal-rank fusion → rerank →
top_k → late join of page content``.  Only ids and scores travel through fusion; page text
is joined once, for the (bounded) fused candidates, to rerank and to project the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.embed import DEFAULT_DIM, HASHED, Embedder
from folio.functions.text import WHITESPACE, tokens
from folio.operators.bm25 import TextIndex, bm25_topk
from folio.operators.vectors import DENSE, payload_filter, sparse, vector_topk
from folio.session import bounded_broadcast, materialize

# Over-fetch factor of each candidate list and fusion constant factor
# (lists hold top_k * 5 entries; the fusion constant is top_k * 3).
CANDIDATE_FACTOR = 5
FUSION_FACTOR = 3
MIN_KEYWORD_LENGTH = 4

MAX_BROADCAST_CANDIDATES = 1_000_000
#: Candidates that are broadcast with their question, at most.
MAX_BROADCAST_PAIRS = 20_000


def default_variant_response(text: Column) -> Column:
    """Deterministic stand-in for the model that writes search phrasings, one per line:
    a keyword line (distinct tokens of 4+ characters), the lower-cased question and the
    question with whitespace collapsed (a repeat of the question when it has no line breaks,
    which the order-preserving dedupe removes)."""
    keywords = F.array_join(F.filter(F.array_distinct(tokens(text)), lambda t: F.length(t) >= MIN_KEYWORD_LENGTH), " ")
    collapsed = F.regexp_replace(text, WHITESPACE, " ")
    return F.concat_ws("\n", keywords, F.lower(collapsed), collapsed)


def query_variants(queries: DataFrame, key: str = "query_id", text_col: str = "text",
                   response: Column | None = None, extra: list[str] = ()) -> DataFrame:
    """``(key, variant_no, variant_text, extra...)``: the question first, then each non-blank
    trimmed line of the generator's response, duplicates removed keeping the first one.
    A null response leaves only the question (the generator failed)."""
    resp = response if response is not None else default_variant_response(F.col(text_col))
    lines = F.filter(F.transform(F.split(resp, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    allv = F.array_distinct(F.concat(F.array(F.col(text_col)), F.coalesce(lines, F.array().cast("array<string>"))))
    return queries.where(F.col(text_col).isNotNull()).select(
        key, *extra, F.posexplode(allv).alias("variant_no", "variant_text")
    ).select(key, F.col("variant_no").cast("int").alias("variant_no"), "variant_text", *extra)


def _vec_cols(df: DataFrame, dim: int):
    return DENSE if "vector" in df.columns else sparse(dim)


def candidate_lists(variants: DataFrame, index: TextIndex, points: DataFrame, top_k: int,
                    year_col: str | None = None, dim: int = DEFAULT_DIM, key: str = "query_id",
                    embed=HASHED) -> DataFrame:
    """Every variant × {bm25, vector} ranked list of ``top_k * 5`` pages:
    ``(key, variant_no, source, rank0, corpus_id, score)``.

    ``embed`` is an ``Embedder``, of which the query mode is used, or a function ``(rows, keys,
    text_col, dim)``; vectors are dense (``vector``) or sparse (``v_idx``/``v_val``), and the points
    table must use the same model (its document mode).  A variant without a
    vector (failed embedding) is dropped from both searches.
    """
    keys = [key, "variant_no"]
    limit = top_k * CANDIDATE_FACTOR
    qv = (embed.query if isinstance(embed, Embedder) else embed)(variants, keys, "variant_text", dim)
    live = materialize(variants.join(qv, keys), "variants")
    # Variants with the same token set (and year) have the same BM25 list: each set is searched
    # once, under the keys of its first variant (short keys, not the text, travel through the
    # postings join), and the list is joined back to every variant of the set.
    tkey = F.array_join(F.array_sort(F.array_distinct(tokens(F.col("variant_text")))), " ")
    years = [year_col] if year_col else []
    keyed = live.select(*keys, *years, tkey.alias("_tk"))
    reps = keyed.groupBy("_tk", *years).agg(F.min(F.struct(*keys)).alias("_rep")).select(
        "_tk", *years, *[F.col("_rep")[k].alias(f"_r{i}") for i, k in enumerate(keys)])
    rep_keys = [f"_r{i}" for i in range(len(keys))]
    ranked = bm25_topk(index, reps, rep_keys, "_tk", limit, year_col).select(*rep_keys, "rank", "corpus_id", "score")
    cond = keyed["_tk"] == reps["_tk"]
    if year_col:
        cond = cond & keyed[year_col].eqNullSafe(reps[year_col])
    mapping = keyed.join(reps, cond).select(*[keyed[k] for k in keys], *rep_keys)
    text_hits = mapping.join(ranked, rep_keys).select(
        *keys, F.lit("bm25").alias("source"), (F.col("rank") - 1).alias("rank0"), "corpus_id", "score")
    vec_hits = vector_topk(
        live, points, keys, limit, query_vec=_vec_cols(qv, dim), point_vec=_vec_cols(points, dim),
        query_year_col=year_col, point_years_col="years" if year_col else None,
    ).select(*keys, F.lit("vector").alias("source"), (F.col("rank") - 1).alias("rank0"),
             F.col("id").alias("corpus_id"), "score")
    return text_hits.unionByName(vec_hits)


def rrf_fuse(hits: DataFrame, k: float, key: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion: ``Σ 1 / (k + rank0 + 1)`` per (query, page) over all lists.

    ``k`` smooths, it does not cut: every fused page is returned, with ``fused_rank`` by score
    desc (rounded to 9 decimals) then id.  A null id is skipped but has used its rank.
    """
    fused = hits.where(F.col("corpus_id").isNotNull()).groupBy(key, "corpus_id").agg(
        F.sum(1.0 / (F.lit(float(k)) + F.col("rank0") + 1)).alias("rrf_score"))
    w = Window.partitionBy(key).orderBy(F.round("rrf_score", 9).desc(), F.col("corpus_id").asc())
    return fused.withColumn("fused_rank", F.row_number().over(w))


def coverage_score(query_text: Column, page_text: Column) -> Column:
    """Default pair scorer (a stand-in for a cross-encoder): the share of the query's
    distinct tokens that occur in the page."""
    return token_share(distinct_tokens(query_text), distinct_tokens(page_text))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def token_share(query_tokens: Column, page_tokens: Column) -> Column:
    """``coverage_score`` of distinct tokens."""
    return F.try_divide(F.size(F.array_intersect(query_tokens, page_tokens)).cast("double"), F.size(query_tokens).cast("double"))


#: Buckets of a page store by a hash of the page id.
PAGE_BUCKETS = 16


def page_bucket(page_id: Column, buckets: int = PAGE_BUCKETS) -> Column:
    """The bucket of a page in a store that is partitioned by ``_bucket``."""
    return F.pmod(F.xxhash64(page_id.cast("bigint")), F.lit(buckets)).cast("int")


def rerank(fused: DataFrame, queries: DataFrame, pages: DataFrame, top_k: int, key: str = "query_id",
           text_col: str = "text", content_col: str = "markdown_content", scorer=None, buckets: int = PAGE_BUCKETS) -> DataFrame:
    """Score (original question, page content) pairs, keep ``top_k`` per question; ties keep
    the fusion order.  Adds the page content and its file name as ``source``.

    ``scorer(question, content) -> Column`` replaces the default token-coverage score.  A page
    store with a ``_bucket`` column (``page_bucket``) is read in the candidates' buckets only.  A page
    is split into tokens and shuffled once, however many questions it is a candidate of."""
    fused = materialize(fused, "rerank-input")  # counted and joined: the search before it runs once
    if "_bucket" in pages.columns:
        wanted = [r[0] for r in fused.select(page_bucket(F.col("corpus_id"), buckets)).distinct().collect()]  # at most ``buckets``
        pages = pages.where(F.col("_bucket").isin(wanted))
    store = pages.select("corpus_id", content_col, F.col("exact_filename").alias("source"))
    store = store.withColumn("_row", F.xxhash64(content_col, "source"))
    prepared, score = (distinct_tokens, token_share) if scorer is None else (lambda text: text, scorer)
    ids = bounded_broadcast(fused.select("corpus_id").distinct(), MAX_BROADCAST_CANDIDATES, bound_by=fused)
    held = store.join(ids, "corpus_id", "left_semi").select("corpus_id", "_row", prepared(F.col(content_col)).alias("_page"))
    asked = queries.select(key, prepared(F.col(text_col)).alias("_asked"))
    pairs = bounded_broadcast(fused.join(asked, key), MAX_BROADCAST_PAIRS)
    scored = held.join(pairs, "corpus_id").withColumn("rerank_score", score(F.col("_asked"), F.col("_page")))
    w = Window.partitionBy(key).orderBy(F.round("rerank_score", 6).desc_nulls_last(), F.col("fused_rank").asc())
    # the content of the pages that are kept is joined afterwards: no page text goes through the window
    ranked = scored.select(key, "corpus_id", "_row", "rerank_score", "rrf_score", "fused_rank").withColumn("rank", F.row_number().over(w))
    top = materialize(ranked.where(F.col("rank") <= top_k), "reranked")
    wanted = bounded_broadcast(top.select("corpus_id", "_row").distinct(), MAX_BROADCAST_CANDIDATES, bound_by=top)
    texts = store.join(wanted, ["corpus_id", "_row"], "left_semi").dropDuplicates(["corpus_id", "_row"])
    return texts.join(top, ["corpus_id", "_row"]).select(
        key, "rank", "corpus_id", "source", content_col, "rerank_score", "rrf_score", "fused_rank")


YEAR_KEY = "probable_referenced_years"


def filtered_points(points: DataFrame, filters: dict | None) -> DataFrame:
    """Points that fit every payload filter; ``probable_referenced_years`` is the points'
    ``years`` and coerced to INT (empty or zero: no filter).  An unknown field is an error."""
    wanted = {}
    for field, value in (filters or {}).items():
        if field == YEAR_KEY:
            if value:
                wanted["years"] = int(value)
        else:
            wanted[field] = value
    unknown = sorted(set(wanted) - set(points.columns))
    if unknown:
        raise ValueError(f"no payload field named {', '.join(unknown)}")
    return points.where(payload_filter(points, wanted)) if wanted else points


def hybrid_retrieve(queries: DataFrame, index: TextIndex, points: DataFrame, pages: DataFrame,
                    top_k: int = 5, year_col: str | None = None, key: str = "query_id",
                    text_col: str = "text", response: Column | None = None,
                    filters: dict | None = None, embed=HASHED, scorer=None) -> DataFrame:
    """End-to-end retrieval for a table of queries.

    ``filters`` hold for all queries: the vector search honours every payload field, the text
    search the year alone.  A year per query is given by ``year_col`` instead; both searches
    apply it.  All filters come before the top-k.
    """
    points = filtered_points(points, filters)
    if filters and filters.get(YEAR_KEY) and year_col is None:
        queries = queries.withColumn("_year", F.lit(str(filters[YEAR_KEY])).try_cast("int"))
        year_col = "_year"
    extra = [year_col] if year_col else []
    variants = query_variants(queries, key, text_col, response, extra)
    hits = candidate_lists(variants, index, points, top_k, year_col, key=key, embed=embed)
    fused = rrf_fuse(hits, top_k * FUSION_FACTOR, key)
    return rerank(fused, queries, pages, top_k, key, text_col, scorer=scorer)
