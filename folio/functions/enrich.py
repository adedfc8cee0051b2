"""Enrich a table with an external function (a model or service), batched per task.

``enrich`` runs a user function over Arrow batches with ``mapInPandas``.  A failing call is
retried with bounded exponential back-off when the error is retryable (HTTP 429 or >= 500).  What
is left of a failure follows ``on_error``: ``fail`` the job, ``drop`` the rows, or emit a
``default`` row.  An error of the data is halved down to the rows that cause it; an outage (a
retryable error that outlives its retries) is one of the service, so the batch fails as a whole,
and after ``max_outages`` batches in a row the task calls no more.  Callers in parallel are the
partitions times ``concurrency`` threads of each task; rows keep their order.

``enrich_resumable`` keeps the answers in a ledger table by a hash of the input, so a rerun calls
the service for new or failed rows only, and equal inputs are sent once.
"""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import materialize, path_exists


@dataclass(frozen=True)
class RetryPolicy:
    """Bounded exponential back-off: ``min(max_wait, max(min_wait, multiplier * 2**n))`` plus
    uniform jitter, at most ``attempts`` tries, only for retryable errors."""

    attempts: int = 5
    multiplier: float = 2.0
    min_wait: float = 6.0
    max_wait: float = 100.0
    jitter: float = 2.0

    def wait(self, attempt: int) -> float:
        base = min(self.max_wait, max(self.min_wait, self.multiplier * (2 ** attempt)))
        return base + random.uniform(0, self.jitter)


NO_WAIT = RetryPolicy(min_wait=0.0, max_wait=0.0, multiplier=0.0, jitter=0.0)


def is_retryable(exc: BaseException) -> bool:
    """Rate limit (429) or server error (≥ 500) on ``code`` or ``status_code``."""
    code = getattr(exc, "status_code", None)
    if code is None:
        code = getattr(exc, "code", None)
    return isinstance(code, int) and (code == 429 or code >= 500)


def call_with_retry(fn: Callable, arg, policy: RetryPolicy, sleep: Callable[[float], None] = time.sleep):
    for attempt in range(policy.attempts):
        try:
            return fn(arg)
        except Exception as exc:  # noqa: BLE001
            if attempt + 1 >= policy.attempts or not is_retryable(exc):
                raise
            sleep(policy.wait(attempt))
    raise RuntimeError("unreachable")


#: Batches in a row that may end in an outage before a task stops calling.
MAX_OUTAGES = 3


class Outage(Exception):
    """The service did not answer; the cause is the last error."""


def enrich(df: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
           output_schema: T.StructType, *, batch_size: int = 50, on_error: str = "fail",
           default: dict | None = None, policy: RetryPolicy = RetryPolicy(),
           sleep: Callable[[float], None] = time.sleep, partitions: int | None = None,
           error_col: str | None = None, concurrency: int = 1, max_outages: int = MAX_OUTAGES) -> DataFrame:
    """Apply ``make_client()`` (built once per task and thread) to batches of rows.

    The client takes a pandas frame of up to ``batch_size`` input rows and returns a frame with
    the columns of ``output_schema`` in the same row order (one row out per row in).  Input
    columns named in ``output_schema`` are passed through when the client does not return them.
    ``partitions`` times ``concurrency`` is the number of concurrent callers (a service's rate
    limit, not the input layout, decides it).  ``error_col`` names a string column of
    ``output_schema`` that is null for answered rows and holds the error of a failed one; with
    ``drop`` such rows are then emitted with their input columns and the reason, for the caller
    to set aside.  A batch in an outage costs ``policy.attempts`` calls; batches that are not sent
    because of earlier ones cost none and carry the same reason.
    """
    if on_error not in ("fail", "drop", "default"):
        raise ValueError(f"on_error must be fail, drop or default, not {on_error!r}")
    names = [f.name for f in output_schema.fields]
    if error_col is not None and error_col not in names:
        raise ValueError(f"{error_col!r} is not a column of the output schema")

    def answered(client, chunk: pd.DataFrame) -> pd.DataFrame:
        out = call_with_retry(client, chunk, policy, sleep)
        if len(out) != len(chunk):
            raise ValueError(f"the client returned {len(out)} rows for {len(chunk)}")
        return out.reset_index(drop=True)

    def failed(chunk: pd.DataFrame, exc: BaseException) -> list[pd.DataFrame]:
        """Failed rows as the policy wants them."""
        if on_error == "drop" and error_col is None:
            return []
        n = len(chunk)
        out = pd.DataFrame({k: [v] * n for k, v in (default or {}).items()}, index=range(n)) if on_error == "default" else pd.DataFrame(index=range(n))
        if error_col is not None:
            out[error_col] = f"{type(exc).__name__}: {exc}"[:500]
        return [complete(out, chunk)]

    def complete(out: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        for col in names:
            if col not in out.columns:
                out[col] = chunk[col].to_numpy() if col in chunk.columns else None
        return out[names]

    def solve(client, chunk: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [complete(answered(client, chunk), chunk)]
        except Exception as exc:  # noqa: BLE001 - the policy decides
            if on_error == "fail":
                raise
            if is_retryable(exc):
                raise Outage(str(exc)) from exc
            if len(chunk) == 1:
                return failed(chunk, exc)
            half = len(chunk) // 2
            return solve(client, chunk.iloc[:half].reset_index(drop=True)) + solve(client, chunk.iloc[half:].reset_index(drop=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = threading.local()
        guard = threading.Lock()
        outages: list[BaseException] = []  # of the batches in a row that found no service

        def handled(chunk: pd.DataFrame) -> list[pd.DataFrame]:
            if len(outages) >= max_outages:
                return failed(chunk, outages[-1])
            if not hasattr(own, "client"):
                own.client = make_client()
            try:
                out = solve(own.client, chunk)
            except Outage as exc:
                with guard:
                    outages.append(exc.__cause__ or exc)
                return failed(chunk, exc.__cause__ or exc)
            with guard:
                if len(outages) < max_outages:
                    outages.clear()
            return out

        def chunks() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), batch_size):
                    yield pdf.iloc[start:start + batch_size].reset_index(drop=True)

        if concurrency <= 1:
            for chunk in chunks():
                yield from handled(chunk)
            return
        with ThreadPoolExecutor(concurrency) as pool:
            waiting: deque = deque()
            for chunk in chunks():
                waiting.append(pool.submit(handled, chunk))
                if len(waiting) > concurrency:  # as many batches are held as are being answered
                    yield from waiting.popleft().result()
            while waiting:
                yield from waiting.popleft().result()

    if partitions:
        df = df.repartition(partitions)
    return df.mapInPandas(run, output_schema)


def enrich_resumable(df: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                     answer_schema: T.StructType, ledger: str, inputs: list[str], *, default: dict | None = None,
                     error_col: str = "error", **options) -> DataFrame:
    """``df`` with the columns of ``answer_schema`` and ``error_col``, asked for the ``inputs`` columns.

    Answers are kept in the table at ``ledger`` by a SHA-256 of the inputs.  Distinct inputs that
    the ledger does not hold are sent (``enrich`` with ``options``), what is answered is appended,
    and every row then takes its answer from the ledger; rows that failed now have the ``default``
    and the reason, and are sent again by the next run.  Nulls are told apart from empty values.
    """
    spark = df.sparkSession
    # a null input is hashed under a mark of its own; binary and other types by their own bytes
    each = [F.coalesce(F.sha2(F.col(c).cast("binary") if dict(df.dtypes)[c] in ("string", "binary") else F.to_json(F.struct(c)).cast("binary"), 256), F.lit("null")) for c in inputs]
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("|", *each), 256))
    answers = [f.name for f in answer_schema.fields]
    clash = set(answers + [error_col]) & set(df.columns)
    if clash:
        raise ValueError(f"answers would replace columns: {', '.join(sorted(clash))}")
    wanted = keyed.select("_key", *inputs).dropDuplicates(["_key"])
    stored = T.StructType([T.StructField("_key", T.StringType()), *answer_schema.fields])
    if path_exists(spark, ledger):
        wanted = wanted.join(spark.read.schema(stored).parquet(ledger).select("_key"), "_key", "left_anti")
    told = T.StructType([*stored.fields, T.StructField(error_col, T.StringType())])
    asked = materialize(enrich(wanted, make_client, told, on_error="default", default=default, error_col=error_col, **options), "answers")
    asked.where(F.col(error_col).isNull()).drop(error_col).write.mode("append").parquet(ledger)
    failed = asked.where(F.col(error_col).isNotNull())
    # a key may stand twice if two runs asked for it at once
    known = spark.read.schema(stored).parquet(ledger).dropDuplicates(["_key"]).withColumn(error_col, F.lit(None).cast("string")).unionByName(failed)
    return keyed.join(known, "_key").select(*df.columns, *answers, error_col)


def ocr_stand_in() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Deterministic stand-in for the OCR model: the page image holds UTF-8 text; decode it."""

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        texts = [None if b is None else bytes(b).decode("utf-8") for b in batch["image"]]
        return pd.DataFrame({"markdown_content": texts})

    return call
