"""Registered queries: one callable ``(spark, base) -> DataFrame`` per operator of the inventory.

Each runs over the whole input tables of ``base`` (or tables Spark derives from them).  The
matching DuckDB SQL lives in :mod:`folio.plans.oracle_queries` under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import clean_text
from folio.functions.embed import DEFAULT_DIM, hashed_embedding, sparse_entries
from folio.functions.enrich import enrich, ocr_stand_in
from folio.functions.text import mentioned_year
from folio.operators import answers, bm25, conversation, evaluation, fusion, ingest, metrics, testset, vectors
from folio.plans import catalog
from folio.session import materialize, new_path, spread
from folio.sources import fixtures
from folio.sources.tables import read_corpus, table

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------- scans, sources, sinks


@register("corpus_scan")
def corpus_scan(spark: SparkSession, base: str) -> DataFrame:
    """The corpus written as a named dataset split, read back by name and split."""
    root = new_path(spark, "datasets")
    fixtures.corpus(spark, base).drop("markdown_content").write.parquet(f"{root}/corpus/test")
    c = read_corpus(spark, root, "corpus", "test")
    return c.select("corpus_id", "doc_key", "image_filename",
                    F.length("image").cast("bigint").alias("image_bytes"))


@register("embeddable_pages")
def embeddable_pages(spark: SparkSession, base: str) -> DataFrame:
    """Page rows with content and id present."""
    rows = ingest.to_page_rows(fixtures.corpus(spark, base))
    return ingest.embeddable(rows).select("corpus_id", "exact_filename")


@register("append_pages")
def append_pages(spark: SparkSession, base: str) -> DataFrame:
    """S3: accepted new pages appended to a page table, read back."""
    path = new_path(spark, "page-store")
    validated = ingest.ingest(fixtures.corpus(spark, base), fixtures.stored_ids(spark, base))
    ingest.append(ingest.accepted(validated), path)
    return spark.read.parquet(path)


@register("insert_if_absent")
def insert_if_absent(spark: SparkSession, base: str) -> DataFrame:
    """Rows with no identical stored row (nulls match nulls)."""
    rows = ingest.to_page_rows(fixtures.corpus(spark, base)).drop("text_content")
    stored = rows.join(fixtures.stored_ids(spark, base), "corpus_id", "left_semi").withColumn(
        "page", F.when(F.col("corpus_id") % 2 == 0, F.col("page") + 1).otherwise(F.col("page"))
    )
    return ingest.insert_if_absent(rows, stored)


@register("skip_existing")
def skip_existing(spark: SparkSession, base: str) -> DataFrame:
    """Incoming corpus rows whose id is not stored yet."""
    fresh = ingest.skip_existing(fixtures.corpus(spark, base), fixtures.stored_ids(spark, base))
    return fresh.select("corpus_id", "image_filename")


# ---------------------------------------------------------------- projections and filters


@register("derive_years")
def derive_years(spark: SparkSession, base: str) -> DataFrame:
    """Referenced years from the key's suffix."""
    return ingest.derive_years(fixtures.corpus(spark, base)).select(
        "corpus_id", "doc_key", "probable_referenced_years")


@register("derive_page")
def derive_page(spark: SparkSession, base: str) -> DataFrame:
    """Page number from the file name."""
    return ingest.derive_page(fixtures.corpus(spark, base)).select("corpus_id", "image_filename", "page")


@register("first_n")
def first_n(spark: SparkSession, base: str) -> DataFrame:
    """The first 10 corpus rows by id (the cheap-run cut is the feature here)."""
    cut = ingest.first_n(fixtures.corpus(spark, base).select("corpus_id", "doc_key", "image_filename"), 10)
    return ingest.derive_page(ingest.derive_years(cut))


@register("clean_text")
def clean_text_q(spark: SparkSession, base: str) -> DataFrame:
    """Raw web pages → plain text."""
    pages = spread(table(spark, base, "pages"), "page_id")
    return pages.select("page_id", clean_text(F.col("html")).alias("text_content"))


@register("validate_pages")
def validate_pages(spark: SparkSession, base: str) -> DataFrame:
    """P5: every page row with its reject reason (empty when accepted)."""
    return catalog.validated_pages(spark, base).select(
        "corpus_id", "page", "probable_referenced_years", "reject_reason")


# ---------------------------------------------------------------- question set


@register("testset_join")
def testset_join(spark: SparkSession, base: str) -> DataFrame:
    """Answers ⋈ questions on the question id."""
    return testset.testset_join(catalog.answers(spark, base), fixtures.questions(spark, base))


@register("testset_unpivot")
def testset_unpivot(spark: SparkSession, base: str) -> DataFrame:
    """Four phrasings per answer row, nulls kept."""
    joined = testset.testset_join(catalog.answers(spark, base), fixtures.questions(spark, base))
    return testset.testset_unpivot(joined)


# ---------------------------------------------------------------- full-text index and BM25


@register("build_postings")
def build_postings(spark: SparkSession, base: str) -> DataFrame:
    """Postings of the stored pages."""
    return catalog.page_index(spark, base).postings.select("term", "corpus_id", "tf", "dl")


@register("term_stats")
def term_stats(spark: SparkSession, base: str) -> DataFrame:
    """A4: document frequency and idf per term, with N and avgdl."""
    idx = catalog.page_index(spark, base)
    return idx.terms.select(
        "term", "df", F.round("idf", 6).alias("idf"),
        F.lit(idx.n_docs).cast("bigint").alias("n_docs"), F.round(F.lit(idx.avgdl), 6).alias("avgdl"))


def _question_queries(spark: SparkSession, base: str) -> DataFrame:
    return fixtures.questions(spark, base).select("query_id", F.col("original").alias("text"), "year")


@register("bm25_topk")
def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    """BM25 top-10 of every question over the page store."""
    hits = bm25.bm25_topk(catalog.page_index(spark, base), _question_queries(spark, base), ["query_id"], limit=10)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "corpus_id",
                       F.round("score", 4).alias("score"))


@register("bm25_topk_year")
def bm25_topk_year(spark: SparkSession, base: str) -> DataFrame:
    """R1 + P10: BM25 top-10 with each question's year filter applied before ranking."""
    hits = bm25.bm25_topk(catalog.page_index(spark, base), _question_queries(spark, base), ["query_id"],
                          limit=10, year_col="year")
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "corpus_id",
                       F.round("score", 4).alias("score"))


@register("bm25_topk_appended")
def bm25_topk_appended(spark: SparkSession, base: str) -> DataFrame:
    """The same search over an index that was built from the pages stored before, got the new
    ones (and some stored ones again) as a second segment, and was reopened."""
    pages, path = catalog.stored_pages(spark, base), new_path(spark, "grown-index")
    stored = pages.join(fixtures.stored_ids(spark, base), "corpus_id", "left_semi")
    bm25.ensure_index(stored, path)
    fresh = pages.join(fixtures.stored_ids(spark, base), "corpus_id", "left_anti")
    again = stored.where(F.col("page") % 2 == 0)  # replaced by themselves
    bm25.append_pages(fresh.unionByName(again), path)
    hits = bm25.bm25_topk(bm25.ensure_index(pages, path), _question_queries(spark, base), ["query_id"], limit=10)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "corpus_id", F.round("score", 4).alias("score"))


# ---------------------------------------------------------------- vectors


def _vector_queries(spark: SparkSession, base: str) -> DataFrame:
    v = fixtures.vectors(spark, base)
    return v.select(F.col("id").alias("query_id"), "vector", F.col("id").alias("self_id"), "query_year")


@register("vector_topk")
def vector_topk(spark: SparkSession, base: str) -> DataFrame:
    """R2 + J5: cosine top-10 of every vector against all others (self excluded)."""
    hits = vectors.vector_topk(_vector_queries(spark, base), fixtures.vectors(spark, base), ["query_id"], 10,
                               exclude_self_col="self_id")
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 4).alias("score"))


@register("vector_topk_filtered")
def vector_topk_filtered(spark: SparkSession, base: str) -> DataFrame:
    """R2 + P9: cosine top-10 with each query's year filter applied before the cut."""
    hits = vectors.vector_topk(_vector_queries(spark, base), fixtures.vectors(spark, base), ["query_id"], 10,
                               exclude_self_col="self_id", query_year_col="query_year", point_years_col="years")
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 4).alias("score"))


# Hash tables and planes per table of the approximate search.
LSH_TABLES, LSH_BITS = 24, 4


@register("vector_topk_lsh")
def vector_topk_lsh(spark: SparkSession, base: str) -> DataFrame:
    """Approximate cosine top-10 of every vector by random hyperplanes."""
    hits = vectors.lsh_topk(_vector_queries(spark, base), fixtures.vectors(spark, base), ["query_id"], 10,
                            exclude_self_col="self_id", tables=LSH_TABLES, bits=LSH_BITS)
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 4).alias("score"))


# The payload filters exercised by the filter queries.
PAYLOAD_FILTER = {"label": 1, "years": 2010}
TEXT_FILTER = {"probable_referenced_years": "2013", "doc_id": "ignored by full-text search"}


@register("filter_any_field")
def filter_any_field(spark: SparkSession, base: str) -> DataFrame:
    """Equality filters ANDed over payload fields (array fields: contains)."""
    v = fixtures.vectors(spark, base)
    return v.where(vectors.payload_filter(v, PAYLOAD_FILTER)).select("id", "label", "years")


@register("filter_year")
def filter_year(spark: SparkSession, base: str) -> DataFrame:
    """P10: full-text filter honours only the year, coerced to INT."""
    pages = catalog.stored_pages(spark, base)
    return pages.where(vectors.year_only_filter(TEXT_FILTER)).select("corpus_id", "probable_referenced_years")


@register("embed_text")
def embed_text(spark: SparkSession, base: str) -> DataFrame:
    """Hashed bag-of-words vectors of the stored pages, as sparse entries."""
    pages = catalog.stored_pages(spark, base).select(F.col("corpus_id").alias("id"), "markdown_content")
    ent = sparse_entries(hashed_embedding(pages, ["id"], "markdown_content", DEFAULT_DIM), ["id"])
    return ent.select("id", "bucket", F.round("w", 6).alias("w"))


@register("build_points")
def build_points(spark: SparkSession, base: str) -> DataFrame:
    """P6 + E3: one point per stored page (vector + payload), flattened."""
    pages = catalog.stored_pages(spark, base)
    vecs = catalog.page_vectors(spark, base).select("id", F.col("v_idx").alias("vector"))
    pts = vectors.points_of_pages(pages, vecs)
    return pts.select("id", "payload.doc_id", "payload.page", "payload.exact_filename",
                      "payload.probable_referenced_years", F.size("vector").cast("bigint").alias("n_entries"))


@register("vector_upsert")
def vector_upsert(spark: SparkSession, base: str) -> DataFrame:
    """Re-embedded points replace stored ones by id (latest version wins)."""
    stored = catalog.stored_pages(spark, base)
    path = new_path(spark, "upserted-vectors")
    first = catalog.page_vectors(spark, base).select("id", "v_idx", F.lit("markdown").alias("origin"), F.lit(0).alias("version"))
    vectors.write_upsert(spark, path, first, "v0", "id", "version")
    upd = materialize(hashed_embedding(stored.where(F.col("corpus_id") % 4 == 0).select(
        F.col("corpus_id").alias("id"), "text_content"), ["id"], "text_content"), "re-embedded")
    upd = upd.select("id", "v_idx", F.lit("text").alias("origin"), F.lit(2).alias("version")).unionByName(
        upd.select("id", "v_idx", F.lit("stale").alias("origin"), F.lit(1).alias("version")))
    for _ in range(2):  # a repeated run changes nothing
        out = vectors.write_upsert(spark, path, upd, "v1", "id", "version")
    return out.select("id", "origin", F.size("v_idx").cast("bigint").alias("n_entries"))


@register("vector_table_init")
def vector_table_init(spark: SparkSession, base: str) -> DataFrame:
    """Vector table with a dimension check, and its year companion partitioned by year."""
    path = new_path(spark, "vector-table")
    table_path = f"{path}/points"
    vectors.vector_table(spark, table_path, 64)  # created, empty
    v = vectors.check_dimension(fixtures.vectors(spark, base), 64)
    v.select("id", "vector").write.mode("append").parquet(table_path)
    pts = vectors.vector_table(spark, table_path, 64).join(v.select("id", "years"), "id")  # exists: reused
    bm25.year_index(pts, "years", "id").write.partitionBy("year").parquet(f"{path}/year_index")
    return spark.read.parquet(f"{path}/year_index").select(F.col("year").cast("int").alias("year"),
                                                           F.col("corpus_id").alias("id"))


# ---------------------------------------------------------------- hybrid retrieval

# Result size of the retrieval entry point and of the conversation tool.
TOP_K = 5
TOOL_TOP_K = 3


def _hybrid_inputs(spark: SparkSession, base: str):
    return (catalog.page_index(spark, base), catalog.page_vectors(spark, base), catalog.page_store(spark, base))


def _questions_for_retrieval(spark: SparkSession, base: str, with_year: bool) -> DataFrame:
    q = fixtures.questions(spark, base).select("query_id", F.col("original").alias("text"), "year")
    return q if with_year else q.drop("year")


@register("query_variants")
def query_variants(spark: SparkSession, base: str) -> DataFrame:
    """The question plus generated phrasings, order-preserving dedupe."""
    return fusion.query_variants(_questions_for_retrieval(spark, base, False))


@register("hybrid_hits")
def hybrid_hits(spark: SparkSession, base: str) -> DataFrame:
    """R5 + U2: every variant's BM25 and cosine list of top_k * 5 pages."""
    index, points, _ = _hybrid_inputs(spark, base)
    variants = fusion.query_variants(_questions_for_retrieval(spark, base, False))
    hits = fusion.candidate_lists(variants, index, points, TOP_K)
    return hits.select("query_id", "variant_no", "source", F.col("rank0").cast("int").alias("rank0"),
                       "corpus_id", F.round("score", 4).alias("score"))


def _fused(spark: SparkSession, base: str) -> DataFrame:
    index, points, _ = _hybrid_inputs(spark, base)
    variants = fusion.query_variants(_questions_for_retrieval(spark, base, False))
    return fusion.rrf_fuse(fusion.candidate_lists(variants, index, points, TOP_K), TOP_K * fusion.FUSION_FACTOR)


@register("rrf_fuse")
def rrf_fuse(spark: SparkSession, base: str) -> DataFrame:
    """R6 + A3 + W7: reciprocal-rank fusion of all lists of a question."""
    return _fused(spark, base).select("query_id", "corpus_id", F.round("rrf_score", 6).alias("rrf_score"),
                                      F.col("fused_rank").cast("bigint").alias("fused_rank"))


@register("rerank")
def rerank(spark: SparkSession, base: str) -> DataFrame:
    """R7 + T1b: pair scorer over the fused pages, top_k kept, ties in fusion order."""
    _, _, pages = _hybrid_inputs(spark, base)
    out = fusion.rerank(_fused(spark, base), _questions_for_retrieval(spark, base, False), pages, TOP_K)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "corpus_id",
                      F.round("rerank_score", 4).alias("rerank_score"),
                      F.col("fused_rank").cast("bigint").alias("fused_rank"))


def _final(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("bigint").alias("rank"), "corpus_id", "source",
                     "markdown_content", F.round("rerank_score", 4).alias("rerank_score"),
                     F.round("rrf_score", 6).alias("rrf_score"), F.col("fused_rank").cast("bigint").alias("fused_rank"))


@register("hybrid_retrieve")
def hybrid_retrieve(spark: SparkSession, base: str) -> DataFrame:
    """R8 + P12: end-to-end hybrid retrieval of every question (top 5)."""
    index, points, pages = _hybrid_inputs(spark, base)
    return _final(fusion.hybrid_retrieve(_questions_for_retrieval(spark, base, False), index, points, pages, TOP_K))


@register("hybrid_retrieve_year")
def hybrid_retrieve_year(spark: SparkSession, base: str) -> DataFrame:
    """The conversation tool — per-question year filter, top 3 (15 per list, k = 9)."""
    index, points, pages = _hybrid_inputs(spark, base)
    return _final(fusion.hybrid_retrieve(_questions_for_retrieval(spark, base, True), index, points, pages,
                                         TOOL_TOP_K, year_col="year"))


# Filters of the filtered retrieval query (the text search honours the year alone).
RETRIEVAL_FILTERS = {"probable_referenced_years": "2013", "doc_id": "src3_2013"}


@register("hybrid_retrieve_filtered")
def hybrid_retrieve_filtered(spark: SparkSession, base: str) -> DataFrame:
    """R8 + P9 + P10: hybrid retrieval with a year and another payload field for all questions."""
    index, points, pages = _hybrid_inputs(spark, base)
    return _final(fusion.hybrid_retrieve(_questions_for_retrieval(spark, base, False), index, points, pages, TOP_K,
                                         filters=RETRIEVAL_FILTERS))


# ---------------------------------------------------------------- conversation state


@register("extract_year")
def extract_year(spark: SparkSession, base: str) -> DataFrame:
    """First year mentioned in each user message."""
    t = conversation.user_turns(fixtures.turns(spark, base))
    return t.select("thread_id", "turn", mentioned_year(F.col("content")).alias("year"))


@register("sticky_year")
def sticky_year(spark: SparkSession, base: str) -> DataFrame:
    """Active year after each user turn (SET / RELATIVE / CLEAR / KEEP fold)."""
    return conversation.sticky_year(fixtures.turns(spark, base))


@register("route_queries")
def route_queries(spark: SparkSession, base: str) -> DataFrame:
    """Retrieve only when the message is financial and needs retrieval."""
    return conversation.route_queries(fixtures.turns(spark, base))


@register("last_user_message")
def last_user_message(spark: SparkSession, base: str) -> DataFrame:
    """Latest user message per thread."""
    return conversation.last_user_message(fixtures.turns(spark, base))


@register("transcript")
def transcript(spark: SparkSession, base: str) -> DataFrame:
    """A1: retained history of each thread as an ordered transcript."""
    return conversation.transcript(fixtures.turns(spark, base))


@register("history_lines")
def history_lines(spark: SparkSession, base: str) -> DataFrame:
    """``role: content`` lines of the retained history."""
    return conversation.history_lines(fixtures.turns(spark, base))


def _direct_answers(spark: SparkSession, base: str) -> DataFrame:
    last = conversation.last_user_message(fixtures.turns(spark, base))
    ans = F.struct(
        F.lit("Answered from the dialogue.").alias("logic_steps"),
        answers.first_sentence(F.col("content")).alias("generated_response"),
        F.lit("dialogue").alias("summary_sources"), F.array(F.lit("dialogue")).alias("sources"))
    return last.select("thread_id", ans.alias("answer"))


@register("history_record")
def history_record(spark: SparkSession, base: str) -> DataFrame:
    """The assistant message recorded for an answer."""
    return _direct_answers(spark, base).select("thread_id", conversation.history_record(F.col("answer")).alias("record"))


@register("trim_history")
def trim_history(spark: SparkSession, base: str) -> DataFrame:
    """Last four messages of each thread plus the new assistant message."""
    new = _direct_answers(spark, base).select(
        "thread_id", F.lit("assistant").alias("role"), conversation.history_record(F.col("answer")).alias("content"))
    return conversation.trim_history(fixtures.turns(spark, base), new)


@register("assemble_context")
def assemble_context(spark: SparkSession, base: str) -> DataFrame:
    """A2: retrieved pages of each question as one context block (fallback when none)."""
    index, points, pages = _hybrid_inputs(spark, base)
    qs = _questions_for_retrieval(spark, base, True)
    got = fusion.hybrid_retrieve(qs, index, points, pages, TOOL_TOP_K, year_col="year")
    return answers.assemble_context(qs, got)


@register("prompt_rows")
def prompt_rows(spark: SparkSession, base: str) -> DataFrame:
    """P15 + P16 + W4: persona, context (retrieved or dialogue) and question per question."""
    index, points, pages = _hybrid_inputs(spark, base)
    qs = _testset(spark, base).where(F.col("query_text").isNotNull()).select(
        F.col("query_text").alias("query_id"), F.col("query_text").alias("text")).distinct()
    out = answers.answer_questions(qs, index, points, pages, "query_id", "text", TOOL_TOP_K)
    return out.select("query_id", "is_financial", "route", "year", "prompt")


@register("conversation_run")
def conversation_run(spark: SparkSession, base: str) -> DataFrame:
    """W1 to W5, P14 to P16, R9 in one job: every user turn of every thread with its sticky
    year, route, searched question, prompt (retrieved pages or transcript), answer record and
    the history that is kept after it."""
    index, points, pages = _hybrid_inputs(spark, base)
    turns = fixtures.turns(spark, base)
    at = ["thread_id", "turn"]
    years = conversation.sticky_year(turns).select(*at, "year")
    asked = (
        conversation.context_aware_query(turns).join(years, at).join(conversation.running_transcript(turns), at)
        .withColumn("qkey", F.concat_ws("#", *at))
    )
    asked = materialize(asked, "asked-turns")
    out = answers.answer_questions(asked, index, points, pages, "qkey", "content", TOOL_TOP_K, year_col="year",
                                   search_col="search_text", dialogue_col="dialogue")
    record = conversation.history_record(F.col("answer"))
    return asked.select("qkey", *at, "search_text", "kept").join(out, "qkey").select(
        *at, "year", "is_financial", "route", "search_text", "prompt", record.alias("record"),
        F.concat(F.col("kept"), F.lit("\nassistant: "), record).alias("history"))


# ---------------------------------------------------------------- answers and evaluation


def _testset(spark: SparkSession, base: str) -> DataFrame:
    joined = testset.testset_join(catalog.answers(spark, base), fixtures.questions(spark, base))
    return testset.testset_unpivot(joined)


def _answered(spark: SparkSession, base: str) -> DataFrame:
    index, points, pages = _hybrid_inputs(spark, base)
    return evaluation.generate_answers(_testset(spark, base), index, points, pages, TOOL_TOP_K)


@register("generate_answers")
def generate_answers(spark: SparkSession, base: str) -> DataFrame:
    """An answer (or the error answer) for every row of the testset."""
    return _answered(spark, base)


@register("judge_parse")
def judge_parse(spark: SparkSession, base: str) -> DataFrame:
    """E5: judge JSON parsed; malformed or off-scale ratings become 0 with a reason."""
    raw = fixtures.judge_raw(spark, base)
    return raw.select("row_id", answers.parse_judgement(F.col("raw")).alias("j")).select("row_id", "j.*")


@register("judge_answers")
def judge_answers(spark: SparkSession, base: str) -> DataFrame:
    """E5 + U3: judged answers (time excluded)."""
    return evaluation.judge_answers(_answered(spark, base)).drop("time")


@register("store_evaluation")
def store_evaluation(spark: SparkSession, base: str) -> DataFrame:
    """Judged answers validated to the record schema and appended; invalid ones quarantined."""
    path = new_path(spark, "evaluations")
    stored = evaluation.store_evaluation(evaluation.judge_answers(_answered(spark, base)), path)
    return stored.drop("time")


@register("evaluation_run")
def evaluation_run(spark: SparkSession, base: str) -> DataFrame:
    """Testset → answers → judge → store, end to end; returns the stored records."""
    path = new_path(spark, "evaluations")
    rows = ingest.first_n(_testset(spark, base), None, ["query_id", "difficulty"])
    index, points, pages = _hybrid_inputs(spark, base)
    judged = evaluation.judge_answers(evaluation.generate_answers(rows, index, points, pages, TOOL_TOP_K))
    return evaluation.store_evaluation(judged, path).drop("time")


@register("evaluation_rollup")
def evaluation_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Mean rating and share of each rating by difficulty and over all."""
    out = metrics.score_rollup(evaluation_run(spark, base))
    return out.select("difficulty", "n", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("difficulty", "n")))


@register("retrieval_metrics")
def retrieval_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Recall, hit rate and mean reciprocal rank of the flagship's first 1, 3 and 5 pages,
    against the pages that hold the passage."""
    hits = hybrid_retrieve(spark, base).select("query_id", "rank", "corpus_id")
    out = metrics.ranked_metrics(hits, catalog.answers(spark, base))
    return out.select("k", "n_queries", *(F.round(c, 6).alias(c) for c in ("recall", "hit_rate", "mrr")))


@register("enrich_pages")
def enrich_pages(spark: SparkSession, base: str) -> DataFrame:
    """The OCR call as a batched, retried table enrichment over the page images."""
    corpus = fixtures.corpus(spark, base).select("corpus_id", "image_filename", "image")
    schema = T.StructType([T.StructField("corpus_id", T.LongType()), T.StructField("image_filename", T.StringType()),
                           T.StructField("markdown_content", T.StringType())])
    return enrich(corpus, ocr_stand_in, schema, batch_size=50, on_error="default",
                  default={"markdown_content": None})


# ---------------------------------------------------------------- streaming


@register("stream_ingest")
def stream_ingest(spark: SparkSession, base: str) -> DataFrame:
    """Corpus files arriving a few per trigger (plus a re-delivery of stored pages) →
    skip-existing → OCR → validate → append; returns the page table."""
    from folio import schemas
    from folio.streaming import jobs

    root = new_path(spark, "stream-ingest")
    corpus = fixtures.corpus(spark, base).drop("markdown_content")
    corpus.write.parquet(f"{root}/in")
    corpus.where(F.col("corpus_id") % 3 == 0).write.mode("append").parquet(f"{root}/in")
    files = spark.sparkContext.defaultParallelism
    jobs.ingest_stream(spark, f"{root}/in", schemas.CORPUS, f"{root}/out", f"{root}/checkpoint", max_files=max(1, files // 2))
    return spark.read.parquet(f"{root}/out/pages").drop("batch")


@register("stream_thread_state")
def stream_thread_state(spark: SparkSession, base: str) -> DataFrame:
    """T2 + W6: all turns arriving as files that hold any turns in any order, folded per thread
    with bounded state, and threads with turns older than their log folded again; equals the batch
    sticky-year fold."""
    from folio.streaming import jobs

    root = new_path(spark, "stream-threads")
    files = spark.sparkContext.defaultParallelism
    t = fixtures.turns(spark, base)
    t.repartition(files, F.xxhash64("turn", "thread_id")).write.parquet(f"{root}/in")
    jobs.thread_state_stream(spark, f"{root}/in", t.schema, f"{root}/out", f"{root}/checkpoint",
                             max_files=max(1, files // 3), state_partitions=files)
    return jobs.complete_state(spark, f"{root}/out")


@register("stream_embed")
def stream_embed(spark: SparkSession, base: str) -> DataFrame:
    """Stored page files arriving a few per trigger → embed pages not yet in the vector
    table → append points."""
    from folio.streaming import jobs

    root = new_path(spark, "stream-embed")
    pages = catalog.stored_pages(spark, base)
    pages.write.parquet(f"{root}/in")
    files = spark.sparkContext.defaultParallelism
    jobs.embed_stream(spark, f"{root}/in", pages.schema, f"{root}/out", f"{root}/checkpoint", max_files=max(1, files // 2))
    pts = spark.read.parquet(f"{root}/out")
    return pts.select("id", F.size("v_idx").cast("bigint").alias("n_entries"), "years")


FLAGSHIP = "hybrid_retrieve"
