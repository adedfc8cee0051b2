"""Conversation state as batch jobs: year actions, sticky year, routing, history, transcript.

Input is a turns table ``(thread_id, turn, role, content)``.  Every per-thread computation is
either a bounded top-N per thread (``row_number <= n``, planned with a partial
``WindowGroupLimit`` before the shuffle) or a running fold computed in two levels so that a
thread holding a large share of all turns is still split across tasks (see ``sticky_year``).
The rule-based classifiers are deterministic stand-ins for the model calls of the original
request path; a model can be plugged in through :func:`folio.functions.enrich.enrich`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import spoken_year, words

# Phrases that move the active year (case-insensitive, whole words).
RELATIVE_BACK = words("the year before|previous year|prior year|a year earlier")
RELATIVE_FORWARD = words("the year after|following year|next year|a year later")
TOPIC_CHANGE = words("change of topic|new topic|another subject|who leads the board")
# Lexicon of the relevance router.
FINANCIAL_TERMS = words("revenue|revenues|profit|profits|income|cost|costs|earnings|margin|cash|debt|"
                        "dividend|dividends|sales|report|reports|year|fiscal|quarter")
NO_RETRIEVAL = words("thanks|thank you|hello|hi|you said|your answer|previous answer")
# Speaker prefixes of a transcript line.
SPEAKER = {"user": "Human", "assistant": "AI", "system": "System"}
# Messages kept before the new assistant message is appended.
HISTORY_KEEP = 4
CHUNK_TURNS = 4096


def year_action(content: Column) -> Column:
    """``struct<action string, value int>``: SET (explicit year), RELATIVE (±1), CLEAR (topic
    change) or KEEP, checked in this order."""
    year = spoken_year(content)
    return (
        F.when(year.isNotNull(), F.struct(F.lit("SET").alias("action"), year.alias("value")))
        .when(content.rlike(RELATIVE_BACK), F.struct(F.lit("RELATIVE").alias("action"), F.lit(-1).alias("value")))
        .when(content.rlike(RELATIVE_FORWARD), F.struct(F.lit("RELATIVE").alias("action"), F.lit(1).alias("value")))
        .when(content.rlike(TOPIC_CHANGE),
              F.struct(F.lit("CLEAR").alias("action"), F.lit(None).cast("int").alias("value")))
        .otherwise(F.struct(F.lit("KEEP").alias("action"), F.lit(None).cast("int").alias("value")))
    )


def user_turns(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("role") == "user")


def sticky_year(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Active year after each user turn: ``(thread_id, turn, action, year)``.

    SET starts a new segment with its year, CLEAR starts one with none, RELATIVE shifts the
    current year (nothing stays nothing), KEEP keeps it.  Level 1 folds inside
    ``(thread, turn div chunk_turns)`` groups; level 2 scans the per-chunk summaries of a
    thread (few rows) to get the year carried into each chunk.
    """
    return fold_years(user_turns(turns).select("thread_id", "turn", year_action(F.col("content")).alias("a")), chunk_turns)


def fold_years(acted: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The fold of ``sticky_year`` over user turns ``(thread_id, turn, a)`` with their actions."""
    act = acted.withColumn("chunk", F.floor(F.col("turn") / chunk_turns))
    rows = act.select(
        "thread_id", "turn", "chunk", F.col("a.action").alias("action"), F.col("a.value").alias("value"),
        F.col("a.action").isin("SET", "CLEAR").cast("int").alias("reset"),
        F.when(F.col("a.action") == "RELATIVE", F.col("a.value")).otherwise(F.lit(0)).alias("shift"))
    upto = Window.partitionBy("thread_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("lseg", F.sum("reset").over(upto))
    seg = Window.partitionBy("thread_id", "chunk", "lseg")
    seg_upto = seg.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seg_base", F.max(F.when(F.col("action") == "SET", F.col("value"))).over(seg)).withColumn(
        "seg_shift", F.sum("shift").over(seg_upto))

    # Level 2: one summary row per (thread, chunk).
    summary = rows.groupBy("thread_id", "chunk").agg(
        F.max("reset").alias("has_reset"),
        F.sum(F.when(F.col("lseg") == 0, F.col("shift")).otherwise(0)).alias("shift0"),
        F.max_by(F.col("seg_base") + F.col("seg_shift"), F.col("turn")).alias("end_local"),
    )
    before = Window.partitionBy("thread_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    upto_c = Window.partitionBy("thread_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("prefix", F.sum("shift0").over(upto_c))
    summary = summary.withColumn(
        "last_reset",
        F.last(F.when(F.col("has_reset") == 1, F.struct("end_local", "prefix")), ignorenulls=True).over(before))
    carry = summary.select(
        "thread_id", "chunk",
        (F.col("last_reset.end_local") + (F.col("prefix") - F.col("shift0") - F.col("last_reset.prefix"))).alias(
            "carry"))
    carry = carry.select(F.col("thread_id").alias("_thread"), F.col("chunk").alias("_chunk"), "carry")
    out = rows.join(carry, rows["thread_id"].eqNullSafe(carry["_thread"]) & rows["chunk"].eqNullSafe(carry["_chunk"]))
    year = F.when(F.col("lseg") > 0, F.col("seg_base") + F.col("seg_shift")).otherwise(
        F.col("carry") + F.col("seg_shift"))
    return out.select("thread_id", "turn", "action", year.cast("int").alias("year"))


def route(content: Column) -> Column:
    """``struct<is_financial, needs_retrieval, route>``: retrieve only when both flags hold."""
    fin = F.coalesce(content.rlike(FINANCIAL_TERMS), F.lit(False))
    need = F.coalesce(~content.rlike(NO_RETRIEVAL), F.lit(False))
    return F.struct(fin.alias("is_financial"), need.alias("needs_retrieval"),
                    F.when(fin & need, F.lit("retrieve")).otherwise(F.lit("answer")).alias("route"))


def route_queries(turns: DataFrame) -> DataFrame:
    """Routing decision per user turn: ``(thread_id, turn, is_financial, needs_retrieval, route)``."""
    return user_turns(turns).select("thread_id", "turn", route(F.col("content")).alias("r")).select(
        "thread_id", "turn", "r.*")


def last_user_message(turns: DataFrame) -> DataFrame:
    """``(thread_id, turn, content)`` of the latest user turn of each thread (an aggregate,
    partially computed before the shuffle)."""
    return user_turns(turns).groupBy("thread_id").agg(
        F.max("turn").alias("turn"), F.max_by("content", "turn").alias("content"))


def last_messages(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each thread with ``pos`` 1..n (oldest first)."""
    w = Window.partitionBy("thread_id").orderBy(F.col("turn").desc())
    kept = turns.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("thread_id").orderBy("turn"))).drop("_back")


def _ordered_join(df: DataFrame, line: Column, sep: str = "\n") -> DataFrame:
    gathered = df.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return gathered.select("thread_id", F.array_join(F.transform("l", lambda x: x["line"]), sep).alias("text"))


def transcript(turns: DataFrame, keep: int = HISTORY_KEEP + 1) -> DataFrame:
    """``(thread_id, transcript)``: the retained history as ``Human: …`` / ``AI: …`` lines."""
    speaker = F.coalesce(*[F.when(F.col("role") == r, F.lit(p)) for r, p in SPEAKER.items()], F.col("role"))
    line = F.concat(speaker, F.lit(": "), F.coalesce(F.col("content"), F.lit("")))
    return _ordered_join(last_messages(turns, keep), line).withColumnRenamed("text", "transcript")


def history_lines(turns: DataFrame, keep: int = HISTORY_KEEP + 1) -> DataFrame:
    """``(thread_id, history)``: ``role: content`` lines (defaults ``unknown`` and ``''``)."""
    line = F.concat(F.coalesce(F.col("role"), F.lit("unknown")), F.lit(": "), F.coalesce(F.col("content"), F.lit("")))
    return _ordered_join(last_messages(turns, keep), line).withColumnRenamed("text", "history")


def history_record(answer: Column) -> Column:
    """The assistant message stored in the history for a structured answer."""
    return F.concat(
        F.lit("Answer: "), answer["generated_response"],
        F.lit("\nReasoning: "), answer["logic_steps"],
        F.lit("\nSources summary: "), answer["summary_sources"],
        F.lit("\nSources: "), F.array_join(answer["sources"], ", "),
    )


def trim_history(turns: DataFrame, new_messages: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """Keep the last ``keep`` messages of each thread, then append the new messages
    ``(thread_id, role, content)`` after them (turn = last turn + 1, + 2, …)."""
    kept = last_messages(turns, keep)
    last_turn = turns.groupBy("thread_id").agg(F.max("turn").alias("_last"))
    w = Window.partitionBy("thread_id").orderBy("content")
    new = new_messages.join(last_turn, "thread_id").withColumn(
        "turn", (F.col("_last") + F.row_number().over(w)).cast("int")).drop("_last")
    return kept.select("thread_id", "turn", "role", "content").unionByName(
        new.select("thread_id", "turn", "role", "content"))


#: Consecutive messages of a thread that one window holds.
BLOCK_TURNS = 1024


def blocked(rows: DataFrame, back: int, block_turns: int = BLOCK_TURNS, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """``rows`` with ``_pos`` (place in the thread from 0), ``_block`` and ``_halo``: the last ``back``
    rows of each block stand in the next one, too, marked as halo.  A window over ``(thread_id,
    _block)`` then sees ``back`` rows before each row, and a long thread is many windows.

    The place is counted in two levels, inside chunks of turn numbers and over the chunks of a
    thread (few rows), so no task sorts a whole thread.  Null threads and turns keep their rows.
    """
    if not 0 < back <= block_turns:
        raise ValueError("a block must hold the rows that are looked back at")
    order = ["turn", *(c for c in ("role", "content") if c in rows.columns)]
    rows = rows.withColumn("_chunk", F.floor(F.col("turn") / chunk_turns))
    counts = rows.groupBy(F.col("thread_id").alias("_t"), F.col("_chunk").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_t").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_t", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("thread_id", "_chunk").orderBy(*order)))
    placed = placed.join(starts, F.col("thread_id").eqNullSafe(F.col("_t")) & F.col("_chunk").eqNullSafe(F.col("_c")))
    pos = F.col("_start") + F.col("_rn") - 1
    placed = placed.select(*(c for c in rows.columns if c != "_chunk"), pos.alias("_pos"), F.floor(pos / block_turns).alias("_own"))
    reach = F.when(F.col("_pos") % block_turns >= block_turns - back, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    return placed.withColumn("_block", F.explode(reach)).withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own")


def _in_block():
    return Window.partitionBy("thread_id", "_block").orderBy("_pos")


def context_aware_query(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """User turns with ``search_text``, the question as it is searched: by default the previous
    user message of the thread followed by the question (a model's rewriting can be plugged in as
    this column)."""
    asked = user_turns(turns).select("thread_id", "turn", "content")
    said = blocked(asked, 1, block_turns).withColumn("_before", F.lag("content").over(_in_block())).where("not _halo")
    return said.select("thread_id", "turn", "content", F.concat_ws(" ", "_before", F.col("content")).alias("search_text"))


def running_transcript(turns: DataFrame, keep: int = HISTORY_KEEP, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """For each user turn the messages retained at that point (the last ``keep`` and the turn
    itself) as transcript lines, and the last ``keep`` up to it as ``role: content`` lines."""
    speaker = F.coalesce(*[F.when(F.col("role") == r, F.lit(p)) for r, p in SPEAKER.items()], F.col("role"))
    content = F.coalesce(F.col("content"), F.lit(""))
    rows = blocked(turns.select("thread_id", "turn", "role", "content"), max(keep, 1), block_turns).select(
        "thread_id", "turn", "role", "_halo",
        F.collect_list(F.concat(speaker, F.lit(": "), content)).over(_in_block().rowsBetween(-keep, 0)).alias("said"),
        F.collect_list(F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), content)).over(_in_block().rowsBetween(1 - keep, 0)).alias("kept"),
    )
    return user_turns(rows).where("not _halo").select("thread_id", "turn", F.array_join("said", "\n").alias("dialogue"), F.array_join("kept", "\n").alias("kept"))
