"""Hand-made edge rows for the operators, and plan-shape checks."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import enrich as E
from folio.functions.embed import model_embedder
from folio.functions.text import clean_text, mentioned_year, page_number, referenced_years, spoken_year, tokens
from folio import session
from folio.operators import answers, blocks, bm25, conversation, evaluation, fusion, ingest, metrics, vectors
from folio.operators.passages import containment_pairs
from folio.session import new_path
from folio.sources import tables


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---------------------------------------------------------------- scalar functions


def test_years_page_and_year_mentions(spark):
    df = spark.createDataFrame(
        [("src_2013", "src_2013_page_7.png", "what about 2019?"), ("src_draft", "src_2013_7.png", "é2019 x"),
         (None, None, "in 1999 and 2005")],
        "k string, f string, q string")
    out = df.select(referenced_years(F.col("k")).alias("y"), page_number(F.col("f")).alias("p"),
                    mentioned_year(F.col("q")).alias("m")).collect()
    assert out[0]["y"] == [2013, 2012, 2011, 2010] and out[0]["p"] == 7 and out[0]["m"] == 2019
    assert out[1]["y"] is None and out[1]["p"] is None and out[1]["m"] is None  # no word boundary after é
    assert out[2]["y"] is None and out[2]["m"] == 1999


def test_clean_text_drops_script_bodies_and_decodes_entities(spark):
    html = ('<html><head><script>var t="</p>";</script><style>p{x:1}</style></head>'
            '<body><!-- c --><p>A &amp; B &copy; 2020</p><a href="/x">link</a> **bold** '
            '[label](http://u) &amp;lt;</body></html>')
    out = spark.createDataFrame([(html,)], "h string").select(clean_text(F.col("h")).alias("t")).first()["t"]
    assert out == "A & B © 2020 link bold label &lt;"


@pytest.mark.parametrize("source, want", [
    ("caf&eacute; &euro;5 &#8217; *it* _em_", "café €5 ’ it em"),
    ("a__b __c__ x_y_z __d e__.", "a__b c x_y_z d e."),
    ("- one\n* two\n12. three\n> quote\n> > deep\n## Head", "one two three quote deep Head"),
    ("&amp;lt; &nope; &amp &#0; &#xD800; &#x1F600; AT&T;", "&lt; &nope; &amp \ufffd \ufffd \U0001f600 AT&T;"),
    ("*d* *e*, _f_ _g_ 2*3*4 * not*", "d e, f g 2*3*4 * not*"),
    ("Head\n====\nSub\n---\ntext\n\n***\nend", "Head Sub text end"),
    (r"a \*star\* and \_line\_ 1\. \\ \x", r"a *star* and _line_ 1. \ \x"),
    ("see [the page][1] and ![pic][p]\n\n[1]: http://u 'T'\n[p]: x.png", "see the page and pic"),
    ("a[0][1] stays", "a[0][1] stays"),
    ("[![alt](i.png)](http://u) [w](http://u/a_(b)) [x [y](z)", "alt w [x y"),
    ("a <script>x='<!--'</script> b <!-- c --> d <!-- open <b>e</b> <script f", "a b d <!-- open e <script f"),
    ("<script>1</script>k<style>2", "k 2"),
    ("", ""),
])
def test_clean_text_literally(spark, source, want):
    got = spark.createDataFrame([(source,)], "t string").select(clean_text(F.col("t")).alias("x")).first()["x"]
    assert got == want


def test_clean_text_is_linear(spark):
    """A megabyte of any mark is cleaned in seconds (a group repeated per mark overflowed the
    stack, and searches to a missing end were quadratic)."""
    marks = [">", "> ", "<!--", "<script ", "</script", "__x ", "[", "*", "<style>", "[a](", "&lt", "_a", "* ", "\\", "<a ", "=", "[a]: "]
    texts = [(m * (1_000_000 // len(m)),) for m in marks]
    df = spark.createDataFrame(texts, "t string").repartition(4)
    began = time.monotonic()
    assert df.select(F.length(clean_text(F.col("t"))).alias("n")).where("n is not null").count() == len(marks)
    assert time.monotonic() - began < 2 * len(marks)


def test_fiscal_years(spark):
    texts = ["FY24", "in fy2023?", "FY'22 rose", "2019 and FY24", "FYI 24", "xFY24", "FY99", "FY70 FY69", "FY00"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(spoken_year(F.col("t"))).collect()] == [2024, 2023, 2022, 2019, None, None, 1999, 1970, 2000]
    assert [r[0] for r in df.select(mentioned_year(F.col("t"))).collect()] == [None, None, None, 2019, None, None, None, None, None]
    turns = spark.createDataFrame([(1, 0, "user", "sales in FY24?"), (1, 1, "user", "the year before?")], "thread_id long, turn int, role string, content string")
    assert sorted(rows(conversation.sticky_year(turns), "turn", "year")) == [(0, 2024), (1, 2023)]


def test_unknown_payload_fields_are_errors(spark):
    points = spark.createDataFrame([(1, [2013], "a", 3), (2, [2014], "a", 4)], "id long, years array<int>, doc_id string, page int")
    assert rows(fusion.filtered_points(points, {"doc_id": "a", "probable_referenced_years": "2013"}), "id") == [(1,)]
    assert fusion.filtered_points(points, {"probable_referenced_years": 0}).count() == 2
    with pytest.raises(ValueError, match="title"):
        fusion.filtered_points(points, {"title": "x"})


def test_running_transcript_holds_earlier_turns(spark):
    turns = spark.createDataFrame(
        [(1, n, "user" if n % 2 == 0 else "assistant", f"m{n}") for n in range(7)], "thread_id long, turn int, role string, content string")
    got = {r["turn"]: (r["dialogue"], r["kept"]) for r in conversation.running_transcript(turns).collect()}
    assert got[0] == ("Human: m0", "user: m0")
    assert got[6][0] == "Human: m2\nAI: m3\nHuman: m4\nAI: m5\nHuman: m6"
    assert got[6][1] == "assistant: m3\nuser: m4\nassistant: m5\nuser: m6"
    asked = {r["turn"]: r["search_text"] for r in conversation.context_aware_query(turns).collect()}
    assert asked == {0: "m0", 2: "m0 m2", 4: "m2 m4", 6: "m4 m6"}


def test_tokens_lowercase_unicode(spark):
    out = spark.createDataFrame([("Ça va, ÜBER-cool 42!",)], "t string").select(tokens(F.col("t")).alias("x")).first()
    assert out["x"] == ["ça", "va", "über", "cool", "42"]


# ---------------------------------------------------------------- ingest


def test_validation_reasons_and_skip_existing(spark):
    corpus = spark.createDataFrame(
        [(1, "a_2013", "a_2013_page_1.png", "x"), (2, "a_draft", "a_page_2.png", "y"),
         (3, "a_2014", "a_2014_3.png", "z"), (4, "a_2015", "a_2015_page_4.png", None),
         (4, "a_2015", "a_2015_page_0.png", "w"), (5, "a_2016", "a_2016_page_5.png", "v")],
        "corpus_id long, doc_key string, image_filename string, markdown_content string")
    stored = spark.createDataFrame([(5,)], "corpus_id long")
    v = ingest.ingest(corpus, stored)
    got = dict(rows(v, "corpus_id", "reject_reason"))
    assert got == {1: "", 2: "bad_year", 3: "no_page", 4: ""}  # id 5 stored; id 4: lowest file name wins
    assert rows(ingest.accepted(v).where("corpus_id = 4"), "exact_filename") == [("a_2015_page_0.png",)]


def test_insert_if_absent_matches_nulls(spark):
    target = spark.createDataFrame([(1, None), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, None), (2, "c"), (2, "c")], "id long, v string")
    assert sorted(rows(ingest.insert_if_absent(new, target), "id", "v")) == [(2, "c")]


def test_upsert_latest_wins_and_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, version int")
    upd = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "id long, v string, version int")
    once = vectors.upsert(base, upd, "id", "version")
    twice = vectors.upsert(once, upd, "id", "version")
    assert sorted(rows(once, "id", "v")) == [(1, "a"), (2, "new"), (3, "c")]
    assert sorted(rows(twice, "id", "v")) == sorted(rows(once, "id", "v"))


# ---------------------------------------------------------------- search and fusion


def test_rrf_null_id_consumes_rank_and_ties_by_id(spark):
    hits = spark.createDataFrame(
        [(1, 0, "bm25", 0, None), (1, 0, "bm25", 1, 10), (1, 0, "vector", 0, 11), (1, 0, "vector", 1, 10)],
        "query_id long, variant_no int, source string, rank0 int, corpus_id long")
    out = fusion.rrf_fuse(hits, 9).orderBy("fused_rank")
    got = rows(out, "corpus_id", "rrf_score", "fused_rank")
    assert got[0][0] == 10 and abs(got[0][1] - 2 / 11) < 1e-12
    assert got[1] == (11, 1 / 10, 2)


def test_rerank_empty_in_empty_out(spark):
    fused = spark.createDataFrame([], "query_id long, corpus_id long, rrf_score double, fused_rank int")
    qs = spark.createDataFrame([(1, "q")], "query_id long, text string")
    pages = spark.createDataFrame([], "corpus_id long, markdown_content string, exact_filename string")
    assert fusion.rerank(fused, qs, pages, 3).count() == 0


def test_query_variants_order_preserving_dedupe(spark):
    qs = spark.createDataFrame([(1, "Alpha beta"), (2, None)], "query_id long, text string")
    resp = F.when(F.col("query_id") == 1, F.lit(" gamma \n\nAlpha beta\n delta "))
    got = rows(fusion.query_variants(qs, response=resp).orderBy("query_id", "variant_no"),
               "query_id", "variant_no", "variant_text")
    assert got == [(1, 0, "Alpha beta"), (1, 1, "gamma"), (1, 2, "delta")]


@pytest.mark.parametrize("strategy", ["broadcast", "blocked", "broadcast-over-bytes"])
def test_vector_topk_strategies_agree_with_bruteforce(spark, strategy, monkeypatch):
    import numpy as np

    if strategy == "broadcast-over-bytes":  # the byte bound sends it to the blocked strategy
        monkeypatch.setattr(vectors, "MAX_BROADCAST_BYTES", 1)
        strategy = "broadcast"

    rng = np.random.default_rng(3)
    pts = rng.normal(size=(60, 5))
    years = [[2000 + i % 4] for i in range(60)]
    qys = [None if i % 2 else 2000 + (i % 3) for i in range(60)]
    data = [(i, [float(x) for x in pts[i]], years[i], qys[i]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, vector array<double>, years array<int>, qy int")
    q = df.select(F.col("id").alias("query_id"), "vector", F.col("id").alias("self_id"), "qy")
    got = vectors.vector_topk(q, df, ["query_id"], 4, exclude_self_col="self_id", query_year_col="qy",
                              point_years_col="years", strategy=strategy, block_rows=16)
    got = {(r["query_id"], r["rank"]): r["id"] for r in got.collect()}
    norm = pts / np.linalg.norm(pts, axis=1, keepdims=True)
    s = norm @ norm.T
    for i in range(60):
        cand = [j for j in range(60) if j != i and (qys[i] is None or years[j][0] == qys[i])]
        best = sorted(cand, key=lambda j: (-round(s[i, j], 6), j))[:4]
        assert [got[(i, r)] for r in range(1, len(best) + 1)] == best


def test_bm25_scores_match_formula(spark):
    pages = spark.createDataFrame([(1, "apple banana apple", [2020]), (2, "banana cherry", [2021]), (3, "date", [2020])],
                                  "corpus_id long, text_content string, probable_referenced_years array<int>")
    idx = bm25.build_index(pages, persist=False)
    qs = spark.createDataFrame([(7, "Apple banana", 2020)], "query_id long, text string, year int")
    got = rows(bm25.bm25_topk(idx, qs, ["query_id"], limit=5, year_col="year"), "corpus_id", "score")
    import math

    n, avgdl = 3, 2.0
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))
    want = idf(1) * part(2, 3) + idf(2) * part(1, 3)
    assert [g[0] for g in got] == [1]  # page 2 filtered by year, page 3 shares no term
    assert abs(got[0][1] - want) < 1e-12


# ---------------------------------------------------------------- conversation


def _turns(spark, data):
    return spark.createDataFrame(data, "thread_id long, turn int, role string, content string")


def test_sticky_year_clear_then_relative_and_chunks(spark):
    data = [(1, 0, "user", "revenue in 2020"), (1, 1, "assistant", "x"), (1, 2, "user", "and the year before?"),
            (1, 3, "user", "what about costs"), (1, 4, "user", "a new topic please"), (1, 5, "user", "the year before"),
            (1, 6, "user", "in 2010 then"), (1, 7, "user", "next year"), (1, 8, "user", "next year"),
            (2, 0, "user", "the year before")]
    t = _turns(spark, data)
    want = {(1, 0): 2020, (1, 2): 2019, (1, 3): 2019, (1, 4): None, (1, 5): None, (1, 6): 2010, (1, 7): 2011,
            (1, 8): 2012, (2, 0): None}
    for chunk in (4096, 2, 3):
        got = {(r["thread_id"], r["turn"]): r["year"] for r in conversation.sticky_year(t, chunk).collect()}
        assert got == want, chunk


def test_null_threads_and_turns_keep_their_rows(spark):
    data = [(None, 0, "user", "in 2019"), (None, 1, "user", "the year before"), (1, 0, "user", "in 2020"), (1, None, "user", "hello")]
    got = set(rows(conversation.sticky_year(_turns(spark, data)), "thread_id", "turn", "year"))
    assert got == {(None, 0, 2019), (None, 1, 2018), (1, 0, 2020), (1, None, None)}
    assert set(rows(conversation.context_aware_query(_turns(spark, data)), "thread_id", "turn")) == {(None, 0), (None, 1), (1, 0), (1, None)}


@pytest.mark.parametrize("block", [4, 5, 7, 1024])
def test_windows_of_long_threads_are_cut_into_blocks(spark, block):
    r = random.Random(3)
    data = [(t, 3 * k, r.choice(["user", "assistant", None, "system"]), f"m{t}-{k}") for t, n in ((1, 60), (2, 3), (None, 9)) for k in range(n)]
    turns = _turns(spark, data)
    line = {"user": "Human", "assistant": "AI", "system": "System"}
    want, searched = {}, {}
    for thread in (1, 2, None):
        own = [d for d in data if d[0] == thread]
        for k, (_, turn, role, content) in enumerate(own):
            if role == "user":
                said = [f"{line[x]}: {c}" for _, _, x, c in own[max(0, k - 4):k + 1] if x]
                kept = [f"{x or 'unknown'}: {c}" for _, _, x, c in own[max(0, k - 3):k + 1]]
                want[(thread, turn)] = ("\n".join(said), "\n".join(kept))
                asked = [c for _, _, x, c in own[:k + 1] if x == "user"]
                searched[(thread, turn)] = " ".join(asked[-2:])
    cut = conversation.running_transcript(turns, block_turns=block)
    assert {(x["thread_id"], x["turn"]): (x["dialogue"], x["kept"]) for x in cut.collect()} == want
    assert {(x["thread_id"], x["turn"]): x["search_text"] for x in conversation.context_aware_query(turns, block).collect()} == searched


def test_message_windows_are_not_partitioned_by_thread_alone(spark):
    turns = _turns(spark, [(1, k, "user", "x") for k in range(9)])
    for df in (conversation.running_transcript(turns), conversation.context_aware_query(turns)):
        windows = [x for x in _plan(df).splitlines() if " Window [" in x and ("collect_list" in x or "lag(" in x)]
        assert windows and all("_block" in x for x in windows)


def test_trim_history_keeps_four_and_appends(spark):
    t = _turns(spark, [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(7)])
    new = spark.createDataFrame([(1, "assistant", "answer")], "thread_id long, role string, content string")
    got = rows(conversation.trim_history(t, new).orderBy("turn"), "turn", "content")
    assert got == [(3, "m3"), (4, "m4"), (5, "m5"), (6, "m6"), (7, "answer")]


def test_context_fallback_when_nothing_retrieved(spark):
    qs = spark.createDataFrame([(1,), (2,)], "query_id long")
    ret = spark.createDataFrame([(1, 2, "f2", "two"), (1, 1, "f1", "one")],
                                "query_id long, rank int, source string, markdown_content string")
    got = dict(rows(answers.assemble_context(qs, ret), "query_id", "context"))
    assert got[1] == "[1] f1\none\n\n[2] f2\ntwo"
    assert got[2] == answers.NO_CONTEXT


# ---------------------------------------------------------------- judge, store, enrich


def test_parse_judgement_bad_json_and_off_scale(spark):
    df = spark.createDataFrame([('{"reasoning": "ok", "answer_accuracy": 4}',), ('{"reasoning": "cut',),
                                ('{"reasoning": "x", "answer_accuracy": 3}',), (None,)], "raw string")
    got = rows(df.select(answers.parse_judgement(F.col("raw")).alias("j")).select("j.*"), "reasoning", "answer_accuracy")
    assert got[0] == ("ok", 4)
    assert got[1] == ("judge output could not be parsed", 0)
    assert got[2] == ("rating out of scale: 3", 0)
    assert got[3][1] == 0


def test_store_evaluation_fail_and_quarantine(spark):
    good = dict(query_id=1, difficulty="original", query_text="q", answer="a", generated_response="g",
                reasoning="r", answer_accuracy=4, model="m", logic_steps="l", summary_sources="s", sources=["x"])
    bad = dict(good, query_text=None, answer_accuracy=3)
    df = spark.createDataFrame([Row(**good), Row(**bad)]).withColumn("time", F.current_timestamp())
    with pytest.raises(ValueError):
        evaluation.store_evaluation(df, new_path(spark, "t-eval"), on_error="fail")
    path = new_path(spark, "t-eval")
    stored = evaluation.store_evaluation(df, path, on_error="quarantine")
    assert stored.count() == 1
    rej = spark.read.parquet(f"{path}/_rejected").first()["reject_reason"]
    assert rej == "null_query_text;rating_out_of_scale"


class _Err(Exception):
    def __init__(self, code):
        super().__init__(code)
        self.status_code = code


def test_retry_only_retryable_errors():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise _Err(429)
        return "ok"

    assert E.call_with_retry(flaky, 1, E.NO_WAIT, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(_Err):
        E.call_with_retry(lambda x: (_ for _ in ()).throw(_Err(400)), 1, E.NO_WAIT, sleep=lambda s: None)
    waits = [E.RetryPolicy(jitter=0).wait(a) for a in range(6)]
    assert waits == [6, 6, 8, 16, 32, 64]


def test_enrich_error_policies(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id long")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.StringType())])

    def make():
        def call(b):
            if (b["id"] == 3).any():
                raise ValueError("boom")
            return pd.DataFrame({"y": [f"v{i}" for i in b["id"]]})
        return call

    got = E.enrich(df.coalesce(1), make, schema, batch_size=2, on_error="drop", policy=E.NO_WAIT)
    assert sorted(rows(got, "id", "y")) == [(0, "v0"), (1, "v1"), (2, "v2"), (4, "v4")]
    got = E.enrich(df.coalesce(1), make, schema, batch_size=2, on_error="default", policy=E.NO_WAIT,
                   default={"y": "Error"})
    assert sorted(rows(got, "id", "y")) == [(0, "v0"), (1, "v1"), (2, "v2"), (3, "Error"), (4, "v4")]


def test_enrich_loses_only_the_bad_row_and_keeps_its_reason(spark):
    df = spark.createDataFrame([(i, bytes([0xFF, 0xFE]) if i == 41 else str(i).encode()) for i in range(100)], "id long, image binary")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("markdown_content", T.StringType()),
                           T.StructField("error", T.StringType())])
    for mode in ("default", "drop"):
        got = E.enrich(df.coalesce(1), E.ocr_stand_in, schema, batch_size=50, on_error=mode, policy=E.NO_WAIT,
                       default={"markdown_content": None}, error_col="error").collect()
        assert len(got) == 100
        assert [r["id"] for r in got if r["markdown_content"] is None] == [41]
        assert [(r["id"], r["error"].split(":")[0]) for r in got if r["error"] is not None] == [(41, "UnicodeDecodeError")]


def _counting(folder, broken=()):
    """A client that leaves a file for each call, slow enough to overlap; 503 for some rows."""
    def make():
        def call(batch):
            name = f"{min(batch['id'])}-{len(batch)}-{time.monotonic_ns()}"
            (Path(folder) / name).write_text("")
            if broken == "all" or set(batch["id"]) & set(broken):
                down = Exception("503")
                down.status_code = 503
                raise down
            return pd.DataFrame({"y": [f"v{i}" for i in batch["id"]]})
        return call

    return make


Y = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.StringType()), T.StructField("error", T.StringType())])


def test_an_outage_costs_the_retries_of_a_few_batches(spark, tmp_path):
    df = spark.range(50).coalesce(1)
    got = E.enrich(df, _counting(tmp_path, "all"), Y, batch_size=50, on_error="default", policy=E.NO_WAIT, error_col="error").collect()
    assert len(got) == 50 and all(r["y"] is None and "503" in r["error"] for r in got)
    assert len(list(tmp_path.iterdir())) == 5
    many = spark.range(1000).coalesce(1)
    got = E.enrich(many, _counting(tmp_path, "all"), Y, batch_size=10, on_error="drop", policy=E.NO_WAIT, error_col="error").collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and len(list(tmp_path.iterdir())) == 5 + 3 * 5
    with pytest.raises(Exception, match="503"):
        E.enrich(df, _counting(tmp_path, "all"), Y, policy=E.NO_WAIT).collect()


def test_slow_calls_overlap_and_keep_their_order(spark, tmp_path):
    def make():
        def call(batch):
            time.sleep(0.4 if min(batch["id"]) % 20 else 0.6)
            return pd.DataFrame({"y": [f"v{i}" for i in batch["id"]]})
        return call

    began = time.monotonic()
    got = E.enrich(spark.range(100).coalesce(1), make, Y, batch_size=10, concurrency=10, error_col="error").collect()
    assert [(r["id"], r["y"]) for r in got] == [(i, f"v{i}") for i in range(100)]
    assert time.monotonic() - began < 3.5  # one after another: 5


def test_a_rerun_calls_only_for_new_and_failed_rows(spark, tmp_path):
    ledger, answer = new_path(spark, "t-ledger"), T.StructType([T.StructField("y", T.StringType())])
    calls = lambda: len(list(tmp_path.iterdir()))
    df = spark.createDataFrame([(i % 40, "x" if i % 2 else None) for i in range(80)], "id long, kind string").coalesce(1)

    def run(frame, broken=()):
        return sorted(rows(E.enrich_resumable(frame, _counting(tmp_path, broken), answer, ledger, ["id"], batch_size=10, policy=E.NO_WAIT), "id", "y", "error"))

    first = run(df, broken=[7])
    assert len(first) == 80 and calls() == 3 + 5  # equal inputs are sent once; one batch of four is down
    down = {i for i, y, _ in first if y is None}
    assert 7 in down and len(down) == 10
    assert run(df) == sorted((i % 40, f"v{i % 40}", None) for i in range(80)) and calls() == 9
    assert run(df) == sorted((i % 40, f"v{i % 40}", None) for i in range(80)) and calls() == 9
    more = df.unionByName(spark.createDataFrame([(100, None), (None, "x")], df.schema).coalesce(1).where("id is not null"))
    assert len(run(more)) == 81 and calls() == 10


def test_model_embedder_tells_the_mode(spark):
    def make():
        return lambda batch: pd.DataFrame({"vector": [[float(len(t)), 1.0 if m == "query" else 0.0] for t, m in zip(batch["text"], batch["mode"])]})

    model = model_embedder(make)
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, t string")
    assert sorted(rows(model.document(texts, ["id"], "t", 2), "id", "vector")) == [(1, [2.0, 0.0]), (3, [0.0, 0.0])]
    assert sorted(rows(model.query(texts, ["id"], "t", 2), "id", "vector")) == [(1, [2.0, 1.0]), (3, [0.0, 1.0])]
    with pytest.raises(Exception, match="3 dimensions"):
        model.query(texts, ["id"], "t", 3).collect()
    pages = spark.createDataFrame([(i, f"d{i}", i, f"f{i}.png", [2001], "x" * i, f"word{i}") for i in range(1, 6)],
                                  "corpus_id long, doc_id string, page int, exact_filename string, probable_referenced_years array<int>, markdown_content string, text_content string")
    points = model.document(pages.select(F.col("corpus_id").alias("id"), "markdown_content"), ["id"], "markdown_content", 2)
    index = bm25.build_index(pages, persist=False)
    variants = fusion.query_variants(spark.createDataFrame([(1, "word3")], "query_id long, text string"))
    hits = fusion.candidate_lists(variants, index, points, 2, dim=2, embed=model)
    assert {r["source"] for r in hits.collect()} == {"bm25", "vector"}


def test_images_of_new_pages_are_not_shuffled(spark):
    path = new_path(spark, "t-images")
    data = [(i, f"f{k}.png", bytearray([k])) for i in range(40) for k in range(2 if i % 10 == 0 else 1)] + [(None, "n", bytearray(b"n"))] * 2
    spark.createDataFrame(data, "corpus_id long, image_filename string, image binary").write.parquet(path)
    stored = spark.createDataFrame([(i,) for i in range(0, 40, 4)] * 2, "corpus_id long")
    out = ingest.skip_existing(spark.read.parquet(path), stored)
    plan = _plan(out)
    fresh = plan[plan.index("Union"):plan.index("Window")]  # rows of ids that come once
    assert "LeftAnti" in fresh and "image" in fresh and "Exchange hashpartitioning" not in fresh.split("LeftSemi")[0]
    got = rows(out, "corpus_id", "image_filename", "image")
    want = [(i, "f0.png", bytearray([0])) for i in range(40) if i % 4] + [(None, "n", bytearray(b"n"))] * 2
    assert sorted(got, key=str) == sorted(want, key=str)


def test_insert_if_absent_compares_whole_rows(spark, monkeypatch):
    schema = "k long, v string, w array<int>"
    new = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "b", [1]), (None, None, None), (None, None, None), (2, "c", [2]), (3, "d", [])], schema)
    old = spark.createDataFrame([(1, "b", [1]), (2, "c", [3]), (9, "z", None), (3, "d", [])], schema)
    want = [(1, "a", None), (2, "c", [2]), (None, None, None)]
    for bound in (2_000_000, 0):
        monkeypatch.setattr(ingest, "MAX_BROADCAST_IDS", bound)
        assert sorted(rows(ingest.insert_if_absent(new, old), "k", "v", "w"), key=str) == sorted(want, key=str)


def test_enrich_fails_on_a_row_count_mismatch(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "id long")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.StringType())])

    def make():
        return lambda b: pd.DataFrame({"y": ["only one"]})

    with pytest.raises(Exception, match="returned 1 rows for 4"):
        E.enrich(df.coalesce(1), make, schema, batch_size=4, policy=E.NO_WAIT).collect()
    got = E.enrich(df.coalesce(1), make, schema, batch_size=4, on_error="default", default={"y": "x"}, policy=E.NO_WAIT)
    assert got.count() == 4


def test_null_ids_reach_the_rejects(spark):
    corpus = spark.createDataFrame(
        [(1, "a_2013", "a_2013_page_1.png", "x"), (None, "a_2013", "a_2013_page_2.png", "y"), (None, "a_2013", "a_2013_page_2.png", "y")],
        "corpus_id long, doc_key string, image_filename string, markdown_content string")
    v = ingest.ingest(corpus, spark.createDataFrame([(None,), (7,)], "corpus_id long"))
    assert sorted(str(r) for r in rows(ingest.rejected(v), "corpus_id", "reject_reason")) == ["(None, 'null_id')"] * 2
    assert rows(ingest.accepted(v), "corpus_id") == [(1,)]


def test_containment_of_short_and_tokenless_passages(spark):
    docs = [(1, "abc def"), (2, "x *** y"), (3, "bc"), (4, ""), (5, None), (6, "one two three four five"), (7, "zé—q")]
    passages = [(1, "bc de"), (2, "***"), (3, "b"), (4, ""), (5, None), (6, "ne two three fo"), (7, "é—"), (8, "three"), (9, "nowhere to be found")]
    got = containment_pairs(spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = {(p, d) for p, t in passages for d, x in docs if t is not None and x is not None and t in x}
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == want and got.count() == len(want)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_root(Session())


# ---------------------------------------------------------------- plans


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_plans_use_group_limit_and_no_cartesian(spark):
    pages = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common", [2000 + i % 3]) for i in range(50)],
                                  "corpus_id long, text_content string, probable_referenced_years array<int>")
    idx = bm25.build_index(pages, persist=False)
    qs = spark.createDataFrame([(1, "w1 common")], "query_id long, text string")
    plan = _plan(bm25.bm25_topk(idx, qs, ["query_id"], limit=3))
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan


def test_filters_and_columns_reach_the_scan(spark):
    path = new_path(spark, "t-scan")
    spark.createDataFrame([(1, "a", "b", None)], "corpus_id long, doc_id string, markdown_content string, x string") \
        .write.parquet(path)
    df = ingest.embeddable(spark.read.parquet(path)).select("corpus_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(markdown_content), IsNotNull(corpus_id)]" in plan
    assert "ReadSchema: struct<corpus_id:bigint,markdown_content:string>" in plan


def test_hybrid_retrieve_global_year_filter(spark):
    pages = spark.createDataFrame(
        [(i, f"d_{2000 + i % 3}", i, f"f{i}.png", [2000 + i % 3], f"alpha beta w{i}", f"alpha beta w{i}")
         for i in range(12)],
        "corpus_id long, doc_id string, page int, exact_filename string, probable_referenced_years array<int>, "
        "markdown_content string, text_content string")
    from folio.functions.embed import hashed_embedding

    idx = bm25.build_index(pages, persist=False)
    vecs = hashed_embedding(pages.select(F.col("corpus_id").alias("id"), "markdown_content"), ["id"],
                            "markdown_content").join(
        pages.select(F.col("corpus_id").alias("id"), F.col("probable_referenced_years").alias("years")), "id")
    qs = spark.createDataFrame([(1, "alpha w4")], "query_id long, text string")
    got = fusion.hybrid_retrieve(qs, idx, vecs, pages, 3, filters={"probable_referenced_years": "2001"})
    ids = [r["corpus_id"] for r in got.orderBy("rank").collect()]
    assert ids and ids[0] == 4 and all(i % 3 == 1 for i in ids)


def test_hybrid_with_dense_embedder_plugin_matches_sparse(spark):
    from folio.functions.embed import hashed_embedding

    def dense(rows, keys, text_col, dim=64):
        sp = hashed_embedding(rows, keys, text_col, dim)
        m = F.map_from_arrays("v_idx", "v_val")
        vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
        return sp.select(*keys, vec.alias("vector"))

    pages = spark.createDataFrame(
        [(i, "d_2001", i, f"f{i}.png", [2001], f"alpha w{i % 5} beta w{i % 7} gamma{i}", f"alpha w{i % 5} beta")
         for i in range(30)],
        "corpus_id long, doc_id string, page int, exact_filename string, probable_referenced_years array<int>, "
        "markdown_content string, text_content string")
    idx = bm25.build_index(pages, persist=False)
    prows = pages.select(F.col("corpus_id").alias("id"), "markdown_content")
    years = pages.select(F.col("corpus_id").alias("id"), F.col("probable_referenced_years").alias("years"))
    sparse_pts = hashed_embedding(prows, ["id"], "markdown_content").join(years, "id")
    dense_pts = dense(prows, ["id"], "markdown_content").join(years, "id")
    qs = spark.createDataFrame([(1, "alpha w3 gamma7"), (2, "beta w2")], "query_id long, text string")
    a = fusion.hybrid_retrieve(qs, idx, sparse_pts, pages, 3)
    b = fusion.hybrid_retrieve(qs, idx, dense_pts, pages, 3, embed=dense)
    cols = ("query_id", "rank", "corpus_id")
    assert sorted(rows(a, *cols)) == sorted(rows(b, *cols)) and a.count() == 6


def test_lsh_recall_zero_vectors_and_hot_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    pts = rng.normal(size=(300, 64))
    pts[100:180] = pts[100] + rng.normal(size=(80, 64)) * 0.05  # a hot bucket
    pts[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in pts[i]]) for i in range(300)] + [(900, None), (901, [])], "id long, vector array<double>")
    q = df.select(F.col("id").alias("query_id"), "vector", F.col("id").alias("self_id"))
    exact = vectors.vector_topk(q, df, ["query_id"], 5, exclude_self_col="self_id")
    approx = vectors.lsh_topk(q, df, ["query_id"], 5, exclude_self_col="self_id", tables=24, bits=4, block_rows=16)
    assert vectors.recall_at_k(approx, exact, ["query_id"]) >= 0.9
    assert not {7, 900, 901} & {r["id"] for r in approx.collect()}


@pytest.mark.parametrize("share", [1000, 4, 1])
def test_queries_of_a_year_are_scored_with_its_pages_alone(monkeypatch, share):
    """Common terms as a matrix and rare ones as lists give the sums of all terms; a query of a year meets
    the pages that list it only (before, every page was scored for every query)."""
    import numpy as np

    monkeypatch.setattr(blocks, "COMMON_SHARE", share)
    r = random.Random(5)
    names = [f"t{k}" for k in range(30)]
    qs = [(100 + k, sorted({r.choice(names) for _ in range(r.choice([1, 4, 9]))}), r.choice([None, 2001, 2002, 2003])) for k in range(40)]
    idf = {t: r.random() + 0.1 for t in names}
    pdf = pd.DataFrame({"_q": [q[0] for q in qs], "_terms": [q[1] for q in qs], "_idfs": [[idf[t] for t in q[1]] for q in qs], "_year": [q[2] for q in qs]})
    block = blocks.QueryBlock.of(pdf)
    pages = [(k, sorted({r.randrange(len(block.terms)) for _ in range(6)}), r.choice([None, [2001], [2002, 2001, 2002], [None, 2003], []])) for k in range(50)]
    pp = pd.DataFrame({"corpus_id": [p[0] for p in pages], "_t": [p[1] for p in pages], "_w": [[0.5 + t / 100 for t in p[1]] for p in pages], "_years": [p[2] for p in pages]})
    scored, inner = [], blocks._scores
    monkeypatch.setattr(blocks, "_scores", lambda b, lens, *more: scored.append((len(lens), len(b.numbers))) or inner(b, lens, *more))
    got = pd.concat(list(blocks.best_pages([pp.iloc[:20], pp.iloc[20:]], block, 3)))
    place = {t: k for k, t in enumerate(block.terms)}
    want = {}
    for number, terms, year in qs:
        hits = []
        for k, t, years in pages:
            common = [place[x] for x in terms if place[x] in t]
            if common and (year is None or year in (years or [])):
                hits.append((-round(sum(idf[block.terms[x]] * (0.5 + x / 100) for x in common), 6), k))
        want[number] = [k for _, k in sorted(hits)[:3]]
    for number, _, _ in qs:
        mine = got[got["_q"] == number]
        order = sorted((-round(s, 6), k) for s, k in zip(mine["score"], mine["corpus_id"]))[:3]
        assert [k for _, k in order] == want[number]
    assert sum(a * b for a, b in scored) < len(pages) * len(qs) / 1.5


def test_rerank_splits_and_shuffles_a_page_once(spark):
    """A page that is a candidate of many questions is one row before the join with them."""
    pages = spark.createDataFrame([(k, f"page {k} word{k % 3}", f"f{k}") for k in range(6)], "corpus_id long, markdown_content string, exact_filename string")
    qs = spark.createDataFrame([(k, f"word{k % 3} page") for k in range(9)], "query_id long, text string")
    fused = spark.createDataFrame([(q, p, 1.0 / (p + 1), p + 1) for q in range(9) for p in range(6)], "query_id long, corpus_id long, rrf_score double, fused_rank int")
    calls = []
    inner = fusion.distinct_tokens
    fusion.distinct_tokens = lambda c: calls.append(1) or inner(c)
    try:
        got = fusion.rerank(fused, qs, pages, 2)
    finally:
        fusion.distinct_tokens = inner
    assert len(calls) == 2  # the pages' and the questions', each before the join
    assert sorted(rows(got, "query_id", "rank", "corpus_id", "source")) == sorted(
        (q, r + 1, p, f"f{p}") for q in range(9) for r, p in enumerate([p for p in range(6) if p % 3 == q % 3]))


@pytest.mark.parametrize("tables, bits, whole", [(12, 3, True), (2, 7, False)])
def test_lsh_moves_a_query_once_for_each_block_and_equals_brute_force(spark, monkeypatch, tables, bits, whole):
    """Wide buckets: the points are held in blocks over all tables, not copied for each of them (before,
    every vector was shuffled for each table and block of a bucket); narrow ones: block by bucket."""
    import numpy as np

    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(vectors, "LSH_FIRST_ROWS", 5)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(240, 8))
    m[100:150] = m[100] + rng.normal(size=(50, 8)) * 0.01  # a hot bucket
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(3, [float(x) for x in m[3]])], "id long, vector array<double>")
    q = df.where("id % 2 = 0").select(F.col("id").alias("query_id"), "vector", F.col("id").alias("self_id"))
    got = vectors.lsh_topk(q, df, ["query_id"], 4, exclude_self_col="self_id", tables=tables, bits=bits, block_rows=25)
    assert "CoGroup" not in _plan(got)
    assert (_plan(got).count("posexplode") == 0) == whole
    planes = np.array(vectors.hyperplanes(tables, bits, 8), dtype=np.float64)
    code = ((m @ planes.reshape(-1, 8).T >= 0).reshape(240, tables, bits) @ (1 << np.arange(bits)))
    same = (code[:, None, :] == code[None, :, :]).any(axis=2)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.where(same, u @ u.T, -np.inf)
    np.fill_diagonal(s, -np.inf)
    want = set()
    for i in range(0, 240, 2):
        order = sorted((-round(float(s[i, j]), 6), j) for j in range(240) if s[i, j] > -np.inf)[:4]
        want |= {(i, r + 1, j) for r, (_, j) in enumerate(order)}
    assert set(rows(got, "query_id", "rank", "id")) == want


def test_blocked_topk_holds_either_side_and_does_not_cogroup(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    rng = np.random.default_rng(9)
    pts = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(90, 8)))], "id long, vector array<double>")
    few = pts.where("id < 20").select(F.col("id").alias("query_id"), "vector")
    for qs, ps in ((few, pts), (pts.select(F.col("id").alias("query_id"), "vector"), pts.where("id < 20"))):
        got = vectors.vector_topk(qs, ps, ["query_id"], 4, block_rows=25)
        assert "CoGroup" not in _plan(got)
        m = np.array([r["vector"] for r in pts.orderBy("id").collect()])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        n_p = ps.count()
        want = {(i, r + 1, int(j)) for i in range(qs.count()) for r, j in enumerate(np.argsort(-(m[:n_p] @ m[i]))[:4])}
        assert set(rows(got, "query_id", "rank", "id")) == want


def test_upsert_writes_only_the_buckets_of_its_ids(spark):
    path = new_path(spark, "t-buckets")
    schema = "id long, v string, tags array<string>, n int"
    vectors.write_upsert(spark, path, spark.createDataFrame([(i, "old", None, 0) for i in range(2000)] + [(None, "x", [], 0)], schema), "v0", buckets=16)
    bucket = F.pmod(F.xxhash64("id"), F.lit(16))
    ids = [r["id"] for r in spark.range(2000).where(bucket == 5).collect()][:20]
    out = vectors.write_upsert(spark, path, spark.createDataFrame([(i, "new", ["t"], 1) for i in ids] + [(ids[0], "older", None, 0)], schema), "v1", order_col="n")
    written = {f.name for f in (Path(path.removeprefix("file:")) / "versions" / "v1").iterdir() if f.name.startswith("_bucket=")}
    assert written == {"_bucket=5"}
    got = rows(out, "id", "v", "tags")
    assert len(got) == 2001 and {i for i, v, tags in got if v == "new" and tags == ["t"]} == set(ids)
    bad = spark.createDataFrame([(7, "bad", None, 2)], schema).withColumn("v", F.raise_error(F.lit("no value")).cast("string"))
    with pytest.raises(Exception, match="no value"):
        vectors.write_upsert(spark, path, bad, "v2")
    assert sorted(rows(vectors.current_version(spark, path), "id", "v"), key=str) == sorted(((i, v) for i, v, _ in got), key=str)
    assert vectors.write_upsert(spark, path, spark.createDataFrame([], schema), "v3").count() == 2001
    empty = new_path(spark, "t-empty")
    assert vectors.write_upsert(spark, empty, spark.createDataFrame([], schema), "v0").count() == 0


def test_versioned_upsert_swaps_the_pointer_once(spark):
    path = new_path(spark, "t-upsert")
    vectors.write_upsert(spark, path, spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, version int"), "v0", order_col="version")
    upd = spark.createDataFrame([(2, "x", 1), (2, "y", 1), (3, "c", 1)], "id long, v string, version int")
    first = sorted(rows(vectors.write_upsert(spark, path, upd, "v1", order_col="version"), "id", "v"))
    again = sorted(rows(vectors.write_upsert(spark, path, upd, "v1", order_col="version"), "id", "v"))
    assert first == again and [i for i, _ in first] == [1, 2, 3] and first[1][1] in ("x", "y")


def test_bounded_broadcast_respects_the_bound_and_spread_is_a_noop_when_parallel(spark):
    from folio.session import bounded_broadcast, spread

    big = spark.range(0, 1000).withColumnRenamed("id", "k")
    small = spark.range(0, 10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(bounded_broadcast(small, 100), "k")
        refused = big.join(bounded_broadcast(small, 5), "k")
        assert "BroadcastHashJoin" in _plan(hinted)
        assert "BroadcastHashJoin" not in _plan(refused)
        assert "BroadcastHashJoin" in _plan(big.join(bounded_broadcast(small, 100, bound_by=small), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = spark.range(0, 100, numPartitions=spark.sparkContext.defaultParallelism)
    assert spread(wide) is wide
    narrow = spark.range(0, 100, numPartitions=1)
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_index_reopens_in_another_application_and_reads_only_its_terms(spark, tmp_path):
    pages = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(12)), [2000 + i % 3]) for i in range(60)],
                                  "corpus_id long, text_content string, probable_referenced_years array<int>")
    path = new_path(spark, "t-index")
    built = bm25.ensure_index(pages, path, buckets=4)
    qs = spark.createDataFrame([(1, "w3", 2001), (2, "w3", None)], "query_id long, text string, year int")
    want = sorted(rows(bm25.bm25_topk(built, qs, ["query_id"], limit=5, year_col="year"), "query_id", "rank", "corpus_id"))
    plain = bm25.build_index(pages, persist=False)
    assert want == sorted(rows(bm25.bm25_topk(plain, qs, ["query_id"], limit=5, year_col="year"), "query_id", "rank", "corpus_id"))
    other = spark.newSession()
    for k, v in (("spark.sql.shuffle.partitions", "8"),):
        other.conf.set(k, v)
    again = bm25.ensure_index(other.createDataFrame([], pages.schema), path)  # nothing to build it from: it is opened
    assert again.n_docs == 60
    search = bm25.bm25_scores(again, other.createDataFrame(qs.collect(), qs.schema), ["query_id"])
    plan = _plan(search)
    assert "PartitionFilters: [isnotnull(term_hash" in plan or "PartitionFilters: [(term_hash" in plan or "term_hash#" in plan.split("PartitionFilters")[1][:80]
    assert search.count() == bm25.bm25_scores(plain, qs, ["query_id"]).count()


def _random_pages(n, seed=1, start=0):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    return [(start + i, " ".join(words[min(2999, int(r.paretovariate(0.6)))] for _ in range(r.choice([3, 20, 60]))), [2000 + i % 3, 1999]) for i in range(n)]


PAGES = "corpus_id long, text_content string, probable_referenced_years array<int>"


@pytest.mark.parametrize("lookups", [500_000, 0])
def test_bounded_search_equals_plain_and_scores_fewer_pages(spark, monkeypatch, lookups):
    pages, r = _random_pages(1500), random.Random(2)
    idx = bm25.build_index(spark.createDataFrame(pages, PAGES), buckets=4)
    qs = [(k, " ".join(r.choice([t for _, t, _ in pages if len(t) > 200]).split()[:14]) + " w0 w1 w2", r.choice([None, 2001])) for k in range(20)]
    qs = spark.createDataFrame([*qs, (None, "w250 w3 w4", 2000), (50, "unknown", None), (51, None, None)], "query_id long, text string, year int")
    monkeypatch.setattr(bm25, "MAX_BROADCAST_LOOKUPS", lookups)
    for year in (None, "year"):
        got, want = (sorted(rows(bm25.bm25_topk(idx, qs, ["query_id"], limit=5, year_col=year, strategy=s).withColumn("score", F.round("score", 6)).fillna(-1, ["query_id"]),
                                 "query_id", "rank", "corpus_id", "score")) for s in ("bounded", "plain"))
        assert got == want and len({q for q, *_ in got}) == 21
    search = bm25.pruned_scores(idx, qs, ["query_id"], "text", 5)
    assert search.essential.count() < (0.6 if lookups else 0.9) * bm25.bm25_scores(idx, qs, ["query_id"]).count()


def test_index_grows_by_segments(spark):
    """Built, appended to with replaced pages, and merged: the same as one full build."""
    first, more = _random_pages(200), _random_pages(90, 5, 160)
    last = {i: (i, t, y) for i, t, y in [*first, *more]}
    want = bm25.build_index(spark.createDataFrame(list(last.values()), PAGES), buckets=4)
    path = new_path(spark, "t-grown")
    bm25.ensure_index(spark.createDataFrame(first, PAGES), path, buckets=4)
    grown = bm25.append_pages(spark.createDataFrame(more[:50], PAGES), path)
    grown = bm25.append_pages(spark.createDataFrame(more[50:], PAGES), path)
    merged = bm25.merge_index(spark, path)
    qs = spark.createDataFrame([(k, f"w{k} w{3 * k} w1", 2001) for k in range(9)], "query_id long, text string, year int")
    for idx in (grown, merged, bm25.open_index(spark, path)):
        assert (idx.n_docs, idx.avgdl) == (want.n_docs, want.avgdl)
        assert sorted(rows(idx.postings, "term", "corpus_id", "tf", "dl")) == sorted(rows(want.postings, "term", "corpus_id", "tf", "dl"))
        assert sorted(rows(idx.terms, "term", "df", "idf")) == sorted(rows(want.terms, "term", "df", "idf"))
        bounds = idx.terms.join(want.terms.select("term", F.col("bound").alias("least")), "term")
        assert bounds.where("bound < least - 1e-9").count() == 0  # never below what a posting can add
        for year in (None, "year"):
            assert sorted(rows(bm25.bm25_topk(idx, qs, ["query_id"], year_col=year, strategy="bounded"), "query_id", "rank", "corpus_id")) == \
                sorted(rows(bm25.bm25_topk(want, qs, ["query_id"], year_col=year), "query_id", "rank", "corpus_id"))


def test_unfinished_segment_is_not_seen(spark):
    path = new_path(spark, "t-failed")
    bm25.ensure_index(spark.createDataFrame(_random_pages(30), PAGES), path, buckets=2)
    bad = spark.createDataFrame(_random_pages(9, 3, 100), PAGES).withColumn(
        "text_content", F.when(F.col("corpus_id") == 104, F.raise_error(F.lit("broken page")).cast("string")).otherwise(F.col("text_content")))
    with pytest.raises(Exception, match="broken page"):
        bm25.append_pages(bad, path)
    assert bm25.open_index(spark, path).n_docs == 30
    assert bm25.append_pages(spark.createDataFrame(_random_pages(9, 3, 100), PAGES), path).n_docs == 39


def test_index_build_has_one_exchange(spark):
    pages = spark.createDataFrame([(i, f"a b c{i}") for i in range(20)], "corpus_id long, text_content string")
    assert _plan(bm25.build_postings(pages.repartition(4, "corpus_id"))).count("Exchange hashpartitioning") == 1


def test_score_rollup_and_ranked_metrics(spark):
    records = spark.createDataFrame([("a", 4), ("a", 0), ("b", 2), (None, 4)], "difficulty string, answer_accuracy int")
    got = {r["difficulty"]: (r["n"], r["mean_accuracy"], r["share_0"], r["share_2"], r["share_4"]) for r in metrics.score_rollup(records).collect()}
    assert got == {"a": (2, 2.0, 0.5, 0.0, 0.5), "b": (1, 2.0, 0.0, 1.0, 0.0), None: (1, 4.0, 0.0, 0.0, 1.0), "all": (4, 2.5, 0.25, 0.25, 0.5)}
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 20), (3, 1, 30)], "query_id long, rank int, corpus_id long")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 11), (2, 20), (4, 40), (None, 1)], "query_id long, corpus_id long")
    got = {r["k"]: (r["n_queries"], round(r["recall"], 4), round(r["hit_rate"], 4), round(r["mrr"], 4)) for r in metrics.ranked_metrics(hits, relevant, (1, 3)).collect()}
    assert got == {1: (3, 0.3333, 0.3333, 0.3333), 3: (3, 0.6667, 0.6667, 0.5)}
    assert metrics.ranked_metrics(hits, relevant.limit(0)).count() == 0


def test_rerank_reads_the_buckets_of_its_candidates(spark):
    path = new_path(spark, "t-store")
    pages = spark.createDataFrame([(i, f"word{i} text", f"f{i}") for i in range(200)], "corpus_id long, markdown_content string, exact_filename string")
    pages.withColumn("_bucket", fusion.page_bucket(F.col("corpus_id"))).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    fused = spark.createDataFrame([(1, 7, 0.5, 1), (1, 8, 0.4, 2)], "query_id long, corpus_id long, rrf_score double, fused_rank int")
    out = fusion.rerank(fused, spark.createDataFrame([(1, "word8")], "query_id long, text string"), spark.read.parquet(path), 2)
    assert sorted(rows(out, "rank", "corpus_id")) == [(1, 8), (2, 7)]
    wanted = {r[0] for r in fused.select(fusion.page_bucket(F.col("corpus_id"))).collect()}
    read = {f.split("_bucket=")[1].split("/")[0] for f in spark.read.parquet(path).where(F.col("_bucket").isin(*wanted)).inputFiles()}
    scan = next(x for x in _plan(out).splitlines() if "FileScan" in x and "markdown_content" in x)
    assert "PartitionFilters: [_bucket#" in scan and " IN (" in scan or "_bucket#" in scan.split("PartitionFilters")[1] and read


def test_image_files_equal_the_corpus_table(spark, tmp_path):
    data = [(i, f"key_{2000 + i % 5}", f"key_page_{i}.png", f"text {i}".encode()) for i in range(12)]
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    for i, _, name, image in data:
        if i != 5:
            (folder / name).write_bytes(bytes([0xFF, 0xFE]) if i == 4 else image)
    (folder / "note.txt").write_text("no image")
    listing = spark.createDataFrame([x[:3] for x in data], "corpus_id long, doc_key string, image_filename string")
    files = tables.image_files(spark, str(tmp_path / "in"), "*.png")
    corpus = tables.corpus_of_files(files, listing)
    assert sorted(rows(corpus.where("corpus_id not in (4, 5)"), "corpus_id", "doc_key", "image_filename", "image")) == [(a, b, c, bytearray(d)) for a, b, c, d in data if a not in (4, 5)]
    schema = T.StructType([*(f for f in corpus.schema.fields if f.name != "image"), T.StructField("markdown_content", T.StringType()), T.StructField("ocr_error", T.StringType())])
    read = E.enrich(corpus, E.ocr_stand_in, schema, on_error="default", default={"markdown_content": None}, error_col="ocr_error", policy=E.NO_WAIT)
    checked = {r["corpus_id"]: r["reject_reason"] for r in ingest.validate_pages(ingest.to_page_rows(read, ["ocr_error"])).collect()}
    assert {i for i, reason in checked.items() if reason} == {4, 5} and "ocr: UnicodeDecodeError" in checked[4] and checked[5] == "null_content"
    stream = tables.corpus_of_files(tables.image_files(spark, str(tmp_path / "in"), "*.png", streaming=True, max_files=4), listing)
    query = stream.writeStream.format("memory").queryName("t_images").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(rows(spark.table("t_images"), "corpus_id", "image")) == sorted(rows(corpus.where("image is not null"), "corpus_id", "image"))
