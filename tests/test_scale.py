"""What keeps a task's work and memory apart from the size of the whole input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio import session
from folio.operators import blocks, bm25, fusion, passages, vectors
from tests.test_operators import PAGES, _plan, _random_pages, rows


def test_spread_makes_more_tasks_of_a_larger_table(spark, monkeypatch):
    path = session.new_path(spark, "t-spread")
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(path)
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    assert session.spread(df, "id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "TASK_BYTES", 1 + session.size_in_bytes(df) // (3 * cores))
    more = session.spread(df, "id")
    assert more.rdd.getNumPartitions() == 3 * cores and more.count() == 20000
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,)], cores), "id long")
    assert session.spread(unknown, "id") is unknown


def test_tokens_of_a_bucket_are_counted_by_several_tasks(spark, monkeypatch):
    pages = spark.createDataFrame(_random_pages(300), PAGES)
    monkeypatch.setattr(bm25, "BUCKET_BYTES", 4000)
    n = bm25._dealt(pages, 4, "text_content", "corpus_id").rdd.getNumPartitions()
    assert n > 4 and n % 4 == 0
    idx, plain = bm25.build_index(pages, buckets=4), bm25.build_index(pages, persist=False)
    assert sorted(rows(idx.postings, "term", "corpus_id", "tf", "dl")) == sorted(rows(plain.postings, "term", "corpus_id", "tf", "dl"))
    per_page = idx.postings.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in _plan(per_page)  # a page is in one bucket still


@pytest.mark.parametrize("pass_terms", [500_000, 40])
def test_block_search_equals_plain_and_keeps_no_pairs(spark, monkeypatch, pass_terms):
    pages = _random_pages(800)
    pages += [(5000 + i, pages[3][1], [2001]) for i in range(60)]  # copies: ties at the cut
    pages += [(pages[7][0], pages[7][1], [2001]), (6000, "w1 w2", None), (6001, "w1 w2", [None, 2001])]
    idx = bm25.build_index(spark.createDataFrame(pages, PAGES), buckets=4)
    qs = [(k, pages[k][1] + " w0 w1 w2", [None, 2001, 2050][k % 3]) for k in range(12)]
    qs = spark.createDataFrame([*qs, (3, pages[3][1], 2001), (None, "w250 w3 w4", 2000), (50, "unknown", None), (51, None, None)],
                               "query_id long, text string, year int")
    monkeypatch.setattr(bm25, "PASS_TERMS", pass_terms)
    monkeypatch.setattr(blocks, "CELLS", 300)
    monkeypatch.setattr(blocks, "PRODUCTS", 50)
    for year in (None, "year"):
        got, want = (sorted(rows(bm25.bm25_topk(idx, qs, ["query_id"], limit=5, year_col=year, strategy=s).withColumn("score", F.round("score", 6)).fillna(-1, ["query_id"]),
                                 "query_id", "rank", "corpus_id", "score")) for s in ("auto", "plain"))
        assert got == want and got
    pairs = bm25.bm25_scores(idx, qs, ["query_id"]).count()
    assert bm25._block_search(idx, qs, ["query_id"], "text", 5).count() < pairs / 3


def test_prune_keeps_k_of_many_copies():
    qi, pid = np.zeros(1000, dtype=np.int64), np.arange(1000)[::-1].copy()
    got = blocks.prune(qi, pid, np.full(1000, 0.5), 4)
    assert sorted(got[1]) == [0, 1, 2, 3]


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_points_are_prepared_once_and_copies_do_not_pile_up(spark, monkeypatch, strategy):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(size=(120, 6)), np.tile(rng.normal(size=6), (80, 1))])
    first = 2**60  # beyond what a float holds
    data = [(first + i, [float(x) for x in pts[i]], [2000 + i % 4, None] if i % 9 else None, None if i % 2 else 2000 + i % 3, first + i)
            for i in range(200)]
    df = spark.createDataFrame(data, "id long, vector array<float>, years array<int>, qy int, self_id long")
    q = df.select(F.col("id").alias("query_id"), "vector", "self_id", "qy")
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    got = vectors.vector_topk(q, df, ["query_id"], 4, exclude_self_col="self_id", query_year_col="qy", point_years_col="years",
                              strategy=strategy, block_rows=64)
    got = {(r["query_id"] - first, r["rank"]): r["id"] - first for r in got.collect()}
    m = pts.astype(np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s, want = m @ m.T, {}
    for i, (_, _, _, y, own) in enumerate(data):
        fits = [j for j in range(200) if data[j][0] != own and (y is None or (data[j][2] and y in data[j][2]))]
        want |= {(i, r + 1): j for r, j in enumerate(sorted(fits, key=lambda j: (-round(s[i, j], 6), j))[:4])}
    assert got == want


def test_a_block_of_points_becomes_a_matrix_once(monkeypatch):
    made = []
    matrix = vectors._matrix
    monkeypatch.setattr(vectors, "_matrix", lambda pdf, vc: made.append(len(pdf)) or matrix(pdf, vc))
    monkeypatch.setattr(vectors, "TILE_ROWS", 8)
    m = np.random.default_rng(1).normal(size=(64, 4))
    pdf = pd.DataFrame({"id": np.arange(64), "vector": list(m)})
    best = blocks.Best(64, 3)
    vectors.score_points(vectors.QueryRows(pdf, vectors.DENSE, "id", None), vectors.PointBlock(pdf, vectors.DENSE, "id", None), best)
    assert made == [64, 64]
    qi, pid, _ = best.rows()
    assert len(set(qi)) == 64 and not (qi == pid).any()


def test_rerank_ranks_without_page_texts(spark):
    pages = spark.createDataFrame([(1, "alpha beta", "f1"), (1, "alpha beta", "f1"), (2, "beta", "f2"), (3, None, "f3")],
                                  "corpus_id long, markdown_content string, exact_filename string")
    fused = spark.createDataFrame([(7, 1, 0.5, 1), (7, 2, 0.4, 2), (7, 3, 0.3, 3), (8, 2, 0.5, 1)], "query_id long, corpus_id long, rrf_score double, fused_rank int")
    qs = spark.createDataFrame([(7, "alpha beta"), (8, "beta")], "query_id long, text string")
    out = fusion.rerank(fused, qs, pages, 4)
    assert "Window" not in _plan(out)  # ranked before the texts are joined
    assert sorted(rows(out, "query_id", "rank", "corpus_id", "source")) == [
        (7, 1, 1, "f1"), (7, 2, 1, "f1"), (7, 3, 2, "f2"), (7, 4, 3, "f3"), (8, 1, 2, "f2")]


def test_containment_shuffles_the_texts_of_candidates_alone(spark):
    docs = [(k, f"filler{k} and more of it") for k in range(300)] + [(300, "so one two three four it is"), (300, "nothing"), (301, "one three two four"), (None, "one two three four")]
    path = session.new_path(spark, "t-docs")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    asked = spark.createDataFrame([(1, "one two three four"), (2, "is")], "item_id long, text string")
    out = passages.containment_pairs(asked, spark.read.parquet(path))
    assert sorted(rows(out, "item_id", "doc_id")) == [(1, 300), (2, 300)]
    plan = _plan(out)
    assert "LeftSemi" in plan
    for scan in plan.split("LeftSemi")[1:]:  # the texts come from the files straight into the semi join
        assert "Exchange" not in scan.split("FileScan")[0].replace("BroadcastExchange", "")
