"""Structured Streaming jobs: incremental page ingest, per-thread state, incremental embedding.

The source is a folder of parquet files (``readStream``); a trigger takes ``max_files`` new
files.  Sinks are replay-safe: ``foreachBatch`` writes each micro-batch to its own
``batch=<id>`` partition with overwrite, and excludes that partition when it looks up what is
already stored, so re-running a batch after a failure gives the same result; the stateful job
writes to the exactly-once parquet file sink.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from folio.functions.embed import DEFAULT_DIM, hashed_embedding
from folio.functions.enrich import enrich, ocr_stand_in
from folio.operators import conversation, ingest
from folio.session import list_folders, materialize, move, path_exists, remove


def _stored(spark: SparkSession, path: str, batch_id: int, cols: list[str]) -> DataFrame | None:
    """Rows of earlier batches of a ``batch=<id>``-partitioned table (None before the first).

    Only a missing path means "nothing stored"; any other failure to read fails the batch."""
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("batch") != batch_id).select(*cols)


#: Batch folders of a streamed table from which on all but the last are merged into one.
COMPACT_AFTER = 16
#: Rows of a file of merged batches.
FILE_ROWS = 1_000_000


def compact_batches(spark: SparkSession, path: str, after: int = COMPACT_AFTER) -> bool:
    """Merges the batch folders of the table at ``path``, all but the last, into the first one's
    when there are more than ``after``; tells whether it did.

    The last folder stays, as only the last batch can be run again.  The merged rows are written
    aside, then a line is written that names the folders they replace; only then these are removed
    and the merged one takes its place.  A merge that was cut short goes on from that line
    (``finish_merge``) before the next batch reads the table.  The writer of the table calls it; a
    reader that lists the folders during the exchange may miss rows, so let it read between batches.
    """
    finish_merge(spark, path)
    folders = sorted(list_folders(spark, path, "batch="))
    if len(folders) <= after:
        return False
    old = folders[:-1]
    rows = spark.read.parquet(*(f"{path}/batch={b}" for b in old))
    files = max(1, -(-rows.count() // FILE_ROWS))
    rows.coalesce(files).write.mode("overwrite").parquet(f"{path}/_merged/rows")
    line = spark.createDataFrame([(old,)], "replaced array<bigint>")
    line.coalesce(1).write.mode("overwrite").json(f"{path}/_merged/ready")
    finish_merge(spark, path)
    return True


def finish_merge(spark: SparkSession, path: str) -> None:
    """Puts merged rows that are complete in the place of the folders they replace."""
    if not path_exists(spark, f"{path}/_merged/ready/_SUCCESS"):
        remove(spark, f"{path}/_merged")
        return
    replaced = sorted(spark.read.schema("replaced array<bigint>").json(f"{path}/_merged/ready").first()["replaced"])
    if path_exists(spark, f"{path}/_merged/rows"):  # else they are in place already
        for b in replaced:
            remove(spark, f"{path}/batch={b}")
        move(spark, f"{path}/_merged/rows", f"{path}/batch={replaced[0]}")
    remove(spark, f"{path}/_merged")


def _run(query_builder, checkpoint: str, max_files: int | None = None):
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def ingest_stream(spark: SparkSession, source_dir: str, schema: T.StructType, target: str, checkpoint: str,
                  max_files: int = 1, ocr=ocr_stand_in, compact_after: int = COMPACT_AFTER) -> None:
    """New corpus files → skip stored ids and in-batch duplicates → OCR (only the new pages)
    → clean → validate → append pages (``target/pages``) and rejects with their reason
    (``target/rejected``).  Folders of earlier batches are merged (``compact_batches``), so looking
    up ids reads a bounded number of folders, and of those the id column."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        for name in ("pages", "rejected"):
            finish_merge(spark, f"{target}/{name}")
        stored = _stored(spark, f"{target}/pages", batch_id, ["corpus_id"])
        existing = stored if stored is not None else batch.limit(0).select("corpus_id")
        fresh = ingest.skip_existing(batch, existing)
        ocr_schema = T.StructType([f for f in schema.fields if f.name != "image"]
                                  + [T.StructField("markdown_content", T.StringType()), T.StructField("ocr_error", T.StringType())])
        with_text = enrich(fresh, ocr, ocr_schema, batch_size=50, on_error="default",
                           default={"markdown_content": None}, error_col="ocr_error")
        # written, so that a lost executor does not send pages to the model again
        with_text = materialize(with_text, "ocr")
        rows = ingest.to_page_rows(with_text, keep=["ocr_error"])
        validated = ingest.validate_pages(rows)
        ingest.accepted(validated).write.mode("overwrite").parquet(f"{target}/pages/batch={batch_id}")
        ingest.rejected(validated).write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        for name in ("pages", "rejected"):
            compact_batches(spark, f"{target}/{name}", compact_after)

    _run(src.writeStream.foreachBatch(per_batch), checkpoint)


def embed_stream(spark: SparkSession, source_dir: str, schema: T.StructType, target: str, checkpoint: str,
                 max_files: int = 1, dim: int = DEFAULT_DIM, compact_after: int = COMPACT_AFTER) -> None:
    """New page files → pages not yet in the vector table → hashed embedding → append points
    ``(id, v_idx, v_val, years)`` under ``target``."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        pages = ingest.embeddable(batch)
        finish_merge(spark, target)
        stored = _stored(spark, target, batch_id, ["id"])
        if stored is not None:
            pages = pages.join(stored.withColumnRenamed("id", "corpus_id"), "corpus_id", "left_anti")
        first = Window.partitionBy("corpus_id").orderBy(*[F.col(c).asc_nulls_last() for c in pages.columns if c != "corpus_id"])
        pages = pages.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
        vecs = hashed_embedding(pages.select(F.col("corpus_id").alias("id"), "markdown_content"), ["id"],
                                "markdown_content", dim)
        years = pages.select(F.col("corpus_id").alias("id"), F.col("probable_referenced_years").alias("years"))
        vecs.join(years, "id").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        compact_batches(spark, target, compact_after)

    _run(src.writeStream.foreachBatch(per_batch), checkpoint)


#: User turns of a thread that a late turn may still be sorted into; older ones are settled.
LOG_TURNS = 512
#: How the reason of a turn that came when it was settled begins.
BEFORE_LOG = "turn before the"

STATE_SCHEMA = T.StructType([
    T.StructField("settled_turn", T.IntegerType()),
    T.StructField("settled_year", T.IntegerType()),
    T.StructField("turns", T.ArrayType(T.IntegerType())),
    T.StructField("actions", T.ArrayType(T.StringType())),
    T.StructField("values", T.ArrayType(T.IntegerType())),
    T.StructField("years", T.ArrayType(T.IntegerType())),
    T.StructField("hist_turns", T.ArrayType(T.IntegerType())),
    T.StructField("hist_roles", T.ArrayType(T.StringType())),
    T.StructField("hist_contents", T.ArrayType(T.StringType())),
    T.StructField("revision", T.IntegerType()),
])
THREAD_OUTPUT = T.StructType([
    T.StructField("thread_id", T.LongType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("value", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("history_size", T.IntegerType()),
    T.StructField("revision", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("kind", T.StringType()),
])


def _next_year(year: int | None, action: str, value) -> int | None:
    if action == "SET":
        return int(value)
    if action == "CLEAR":
        return None
    return year + int(value) if action == "RELATIVE" and year is not None else year


def _fold_thread(ttl_ms: int | None, log_turns: int = LOG_TURNS):
    """The per-thread fold: turns may arrive in any order.

    The state is a bounded, ordered log of the last ``log_turns`` user turns with their
    actions and years, the year settled before it, and the last ``HISTORY_KEEP + 1`` messages.
    A turn is sorted into the log, the years after it are folded again, and a row is emitted
    for it and for each later turn whose year changed, with a higher ``revision``.  A turn
    that belongs before the log, or one that is already in it, is emitted as ``kind = late``
    with the reason instead; ``complete_state`` folds the former in afterwards.  Batches are folded one at a time, so a thread with very many
    turns is never held whole.
    """
    keep = conversation.HISTORY_KEEP + 1

    def fold(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            settled, base, turns, actions, values, years, h_t, h_r, h_c, revision = state.get
            turns, actions, values, years = list(turns), list(actions), list(values), list(years)
            history = list(zip(h_t, h_r, h_c))
        else:
            settled, base, turns, actions, values, years, history, revision = -1, None, [], [], [], [], [], 0
        for pdf in batches:
            out = []
            revision += 1
            new: set[int] = set()
            for row in pdf.sort_values("turn", kind="stable").itertuples(index=False):
                turn = int(row.turn)
                if turn not in {m[0] for m in history}:
                    history = sorted([*history, (turn, row.role, row.content)], key=lambda m: m[0])[-keep:]
                if row.role != "user":
                    continue
                at = bisect.bisect_left(turns, turn)
                known = at < len(turns) and turns[at] == turn
                if known or turn <= settled:
                    reason = "repeated turn" if known else f"{BEFORE_LOG} {log_turns} that are kept"
                    value = None if pd.isna(row.value) else int(row.value)
                    out.append((int(key[0]), turn, row.action, value, None, len(history), revision, reason, "late"))
                    continue
                turns.insert(at, turn)
                actions.insert(at, row.action)
                values.insert(at, None if pd.isna(row.value) else int(row.value))
                years.insert(at, None)
                new.add(turn)
            if new:
                first = bisect.bisect_left(turns, min(new))
                year = years[first - 1] if first else base
                for k in range(first, len(turns)):
                    year = _next_year(year, actions[k], values[k])
                    if turns[k] in new or year != years[k]:
                        years[k] = year
                        out.append((int(key[0]), turns[k], actions[k], values[k], year, len(history), revision, None, "state"))
            over = len(turns) - log_turns
            if over > 0:
                settled, base = turns[over - 1], years[over - 1]
                turns, actions, values, years = turns[over:], actions[over:], values[over:], years[over:]
            if out:
                yield pd.DataFrame(out, columns=[f.name for f in THREAD_OUTPUT.fields]).astype(
                    {"value": "Int32", "year": "Int32", "turn": "int32", "history_size": "int32", "revision": "int32"})
        h_t, h_r, h_c = ([list(c) for c in zip(*history)] if history else ([], [], []))
        state.update((settled, base, turns, actions, values, years, h_t, h_r, h_c, revision))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return fold


def thread_state_stream(spark: SparkSession, source_dir: str, schema: T.StructType, output: str, checkpoint: str,
                        max_files: int = 1, state_partitions: int | None = None, ttl_ms: int | None = None,
                        log_turns: int = LOG_TURNS) -> None:
    """Conversation turns arriving as files, in any order → per-thread sticky year and bounded
    history (append mode, parquet file sink partitioned by ``kind``).

    ``kind=state`` has a row per user turn and revision; ``current_state`` reads the latest.
    ``kind=late`` is the side table of turns that the log could not take, with the reason;
    ``complete_state`` folds both.  With
    ``ttl_ms`` the state of a thread without turns for so long (processing time) is removed; its
    later turns start a new thread state.

    ``state_partitions`` fixes the number of state-store partitions when the checkpoint is
    new (Spark records it in the checkpoint; streaming has no adaptive coalescing), and the
    session setting is restored afterwards.  Expiry is looked at in batches that bring data."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    acted = src.select("thread_id", "turn", "role", "content",
                       conversation.year_action(F.col("content")).alias("a")).select(
        "thread_id", "turn", "role", "content", F.col("a.action").alias("action"), F.col("a.value").alias("value"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    out = acted.groupBy("thread_id").applyInPandasWithState(
        _fold_thread(ttl_ms, log_turns), THREAD_OUTPUT, STATE_SCHEMA, "append", timeout)
    settings = {"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {}
    if ttl_ms:  # else a run over the files at hand would go on with empty batches for ever
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    previous = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        sink = out.writeStream.format("parquet").option("path", output).partitionBy("kind").outputMode("append")
        _run(sink, checkpoint)
    finally:
        for k, v in previous.items():
            spark.conf.set(k, v)


def current_state(spark: SparkSession, output: str) -> DataFrame:
    """``(thread_id, turn, action, year)`` of the latest revision of every folded user turn."""
    rows = spark.read.schema(THREAD_OUTPUT).parquet(output).where("kind = 'state'")
    latest = rows.groupBy("thread_id", "turn").agg(F.max_by(F.struct("action", "year"), "revision").alias("r"))
    return latest.select("thread_id", "turn", "r.action", "r.year")


def complete_state(spark: SparkSession, output: str) -> DataFrame:
    """``(thread_id, turn, action, year)`` of every user turn, also of those that came after their
    place was settled: a thread that has such turns is folded again as a whole by the chunked batch
    fold, the others are as in ``current_state``.  The first delivery of a turn counts.  A thread
    that is folded again is one thread, also where ``ttl_ms`` had let its state expire."""
    rows = spark.read.schema(THREAD_OUTPUT).parquet(output).where(
        (F.col("kind") == "state") | F.col("reason").startswith(BEFORE_LOG))
    touched = rows.where("kind = 'late'").select("thread_id").distinct()
    first = F.struct("revision", "kind", "action", "value")
    again = rows.join(touched, "thread_id", "left_semi").groupBy("thread_id", "turn").agg(F.min(first).alias("r"))
    folded = conversation.fold_years(again.select("thread_id", "turn", F.struct("r.action", "r.value").alias("a")))
    return current_state(spark, output).join(touched, "thread_id", "left_anti").unionByName(folded)


def late_turns(spark: SparkSession, output: str) -> DataFrame:
    """``(thread_id, turn, reason)`` of the turns that were not folded."""
    return spark.read.schema(THREAD_OUTPUT).parquet(output).where("kind = 'late'").select("thread_id", "turn", "reason")
