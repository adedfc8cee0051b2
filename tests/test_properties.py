"""Property tests: the two-level sticky-year fold equals a sequential fold for any action
sequence and any chunk size; fusion does not depend on the order of its input rows."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folio.operators import conversation, fusion

PHRASES = {"SET": "revenue in {y}", "BACK": "and the year before?", "FWD": "what about next year",
           "CLEAR": "a new topic please", "KEEP": "and the costs"}


def fold(actions):
    year, out = None, []
    for a, y in actions:
        if a == "SET":
            year = y
        elif a == "CLEAR":
            year = None
        elif a == "BACK" and year is not None:
            year -= 1
        elif a == "FWD" and year is not None:
            year += 1
        out.append(year)
    return out


action = st.tuples(st.sampled_from(sorted(PHRASES)), st.integers(1990, 2030))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(threads=st.lists(st.lists(action, min_size=1, max_size=12), min_size=1, max_size=3),
       chunk=st.integers(1, 5))
def test_sticky_year_two_level_equals_sequential(spark, threads, chunk):
    rows, want = [], {}
    for t, acts in enumerate(threads):
        for i, ((a, y), yr) in enumerate(zip(acts, fold(acts))):
            rows.append((t, 2 * i, "user", PHRASES[a].format(y=y)))
            rows.append((t, 2 * i + 1, "assistant", "ok"))
            want[(t, 2 * i)] = yr
    df = spark.createDataFrame(rows, "thread_id long, turn int, role string, content string")
    got = {(r["thread_id"], r["turn"]): r["year"] for r in conversation.sticky_year(df, chunk).collect()}
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list(range(8))))
def test_rrf_independent_of_row_order(spark, perm):
    base = [(1, v, src, r, 100 + (v * 7 + r * 3) % 5) for v in range(2) for src in ("bm25", "vector")
            for r in range(2)]
    rows = [base[i] for i in perm]
    df = spark.createDataFrame(rows, "query_id long, variant_no int, source string, rank0 int, corpus_id long")
    got = [(r["corpus_id"], r["fused_rank"]) for r in fusion.rrf_fuse(df, 9).orderBy("fused_rank").collect()]
    ref = spark.createDataFrame(base, df.schema)
    want = [(r["corpus_id"], r["fused_rank"]) for r in fusion.rrf_fuse(ref, 9).orderBy("fused_rank").collect()]
    assert got == want
