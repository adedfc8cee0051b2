"""Incremental ingest: re-running with the same checkpoint adds nothing; a new file that
re-delivers stored pages only appends the new ones."""

import pytest
from pyspark.sql import functions as F

from folio import schemas
from folio.operators import conversation
from folio.session import list_folders, new_path, remove
from folio.streaming import jobs


def _corpus(spark, ids):
    rows = [(i, f"src_{2000 + i % 5}", f"src_{2000 + i % 5}_page_{i}.png", f"page {i} text".encode()) for i in ids]
    return spark.createDataFrame(rows, schemas.CORPUS)


def test_ingest_stream_is_incremental_and_idempotent(spark):
    root = new_path(spark, "t-ingest")
    _corpus(spark, range(0, 6)).coalesce(1).write.parquet(f"{root}/in")
    jobs.ingest_stream(spark, f"{root}/in", schemas.CORPUS, f"{root}/out", f"{root}/ck")
    first = spark.read.parquet(f"{root}/out/pages")
    assert sorted(r["corpus_id"] for r in first.collect()) == list(range(6))

    jobs.ingest_stream(spark, f"{root}/in", schemas.CORPUS, f"{root}/out", f"{root}/ck")  # nothing new
    assert spark.read.parquet(f"{root}/out/pages").count() == 6

    _corpus(spark, range(4, 9)).coalesce(1).write.mode("append").parquet(f"{root}/in")  # 4, 5 again
    jobs.ingest_stream(spark, f"{root}/in", schemas.CORPUS, f"{root}/out", f"{root}/ck")
    out = spark.read.parquet(f"{root}/out/pages")
    assert sorted(r["corpus_id"] for r in out.collect()) == list(range(9))
    got = out.where("corpus_id = 7").select("markdown_content", "text_content", "page").first()
    assert (got[0], got[1], got[2]) == ("page 7 text", "page 7 text", 7)
    assert out.select(F.countDistinct("batch")).first()[0] == 2


def test_many_batches_leave_few_folders(spark):
    root = new_path(spark, "t-many")
    for k in range(9):
        _corpus(spark, range(3 * k, 3 * k + 4)).coalesce(1).write.mode("append").parquet(f"{root}/in")  # one id again
    jobs.ingest_stream(spark, f"{root}/in", schemas.CORPUS, f"{root}/out", f"{root}/ck", compact_after=3)
    assert sorted(r["corpus_id"] for r in spark.read.parquet(f"{root}/out/pages").collect()) == list(range(28))
    for name in ("pages", "rejected"):
        assert len(list_folders(spark, f"{root}/out/{name}", "batch=")) <= 3


def test_a_merge_that_was_cut_short_goes_on(spark, monkeypatch):
    path = new_path(spark, "t-merge")
    for b in range(5):
        spark.range(10 * b, 10 * b + 10).coalesce(1).write.parquet(f"{path}/batch={b}")
    want = list(range(50))

    def ids():
        return sorted(r["id"] for r in spark.read.parquet(path).collect())

    real = jobs.finish_merge
    monkeypatch.setattr(jobs, "finish_merge", lambda *a: None)  # stopped before the exchange
    jobs.compact_batches(spark, path, 2)
    assert ids() == want and len(list_folders(spark, path, "batch=")) == 5
    monkeypatch.setattr(jobs, "finish_merge", real)
    for b in (0, 1):  # stopped within it
        remove(spark, f"{path}/batch={b}")
    jobs.finish_merge(spark, path)
    assert ids() == want and sorted(list_folders(spark, path, "batch=")) == [0, 4]
    spark.range(3).write.parquet(f"{path}/_merged/rows")  # rows without the line that completes them
    jobs.finish_merge(spark, path)
    assert ids() == want and not jobs.compact_batches(spark, path, 2)


def test_failed_pages_keep_the_reason(spark):
    root = new_path(spark, "t-reasons")
    rows = [(1, "s_2001", "s_page_1.png", b"fine"), (2, "s_2001", "s_page_2.png", bytes([0xFF])), (3, "s_2001", "s_page_3.png", None)]
    spark.createDataFrame(rows, schemas.CORPUS).coalesce(1).write.parquet(f"{root}/in")
    jobs.ingest_stream(spark, f"{root}/in", schemas.CORPUS, f"{root}/out", f"{root}/ck")
    got = {r["corpus_id"]: r["reject_reason"] for r in spark.read.parquet(f"{root}/out/rejected").collect()}
    assert got[2].startswith("null_content;ocr: UnicodeDecodeError") and got[3] == "null_content" and 1 not in got


def _turns(threads, turns):
    phrases = ["Revenue in 2011?", "And the year before?", "Who leads the board? New topic", "Tell me more.", "What about FY24?", "And the year after?"]
    return [(t, n, "user" if n % 3 != 2 else "assistant", phrases[(t * 5 + n * 3) % 6]) for t in range(threads) for n in range(turns)]


SCHEMA = "thread_id long, turn int, role string, content string"


def _run_threads(spark, files, name, **options):
    root = new_path(spark, name)
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        jobs.thread_state_stream(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, f"{root}/out", f"{root}/ck",
                                 state_partitions=2, **options)
    return root


def test_thread_state_equals_the_batch_fold_in_any_order(spark):
    rows = _turns(4, 14)
    want = sorted(map(tuple, conversation.sticky_year(spark.createDataFrame(rows, SCHEMA)).collect()))
    reverse = [[r for r in rows if 5 * k <= r[1] < 5 * k + 5] for k in (2, 1, 0)]
    root = _run_threads(spark, reverse, "t-reverse")
    got = jobs.current_state(spark, f"{root}/out")
    assert sorted(map(tuple, got.select("thread_id", "turn", "action", "year").collect())) == want
    assert jobs.late_turns(spark, f"{root}/out").count() == 0


def test_turns_before_the_log_go_to_the_side_table(spark):
    rows = _turns(1, 12)
    root = _run_threads(spark, [rows[6:], rows[:6], rows[11:]], "t-late", log_turns=2)
    late = sorted((r["turn"], r["reason"]) for r in jobs.late_turns(spark, f"{root}/out").collect())
    assert [t for t, _ in late] == [r[1] for r in rows[:6] if r[2] == "user"]
    assert all("before" in r for _, r in late)
    assert {r["turn"] for r in jobs.current_state(spark, f"{root}/out").collect()} == {r[1] for r in rows[6:] if r[2] == "user"}


def test_turns_before_the_log_are_in_the_complete_state(spark):
    rows = _turns(1, 4000) + [(t + 1, n, role, text) for t, n, role, text in _turns(2, 30)]
    want = sorted(map(tuple, conversation.sticky_year(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    files = [[r for r in rows if (r[1] * 7919 + r[0]) % 31 % 3 == k] for k in range(3)]
    root = _run_threads(spark, [*files, files[1][:40]], "t-complete")
    assert jobs.late_turns(spark, f"{root}/out").count() > 512
    got = jobs.complete_state(spark, f"{root}/out").select("thread_id", "turn", "action", "year")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_thread_state_expires(spark):
    rows = [(1, 0, "user", "Revenue in 2011?"), (2, 0, "user", "Revenue in 2012?")]
    later = [(1, 1, "user", "And the year before?")]
    root = new_path(spark, "t-ttl")
    for part in (rows, later):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        jobs.thread_state_stream(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, f"{root}/out", f"{root}/ck", state_partitions=2, ttl_ms=600_000)
    got = {(r["thread_id"], r["turn"]): r["year"] for r in jobs.current_state(spark, f"{root}/out").collect()}
    assert got == {(1, 0): 2011, (2, 0): 2012, (1, 1): 2010}


def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_path):
    target = tmp_path / "pages"
    target.mkdir()
    (target / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        jobs._stored(spark, str(target), 0, ["corpus_id"]).count()
    assert jobs._stored(spark, str(tmp_path / "none"), 0, ["corpus_id"]) is None
