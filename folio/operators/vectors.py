"""Vector points, payload filters and exact / approximate cosine top-k.

Exact top-k has two physical strategies, chosen by the size of the query table:

* **broadcast** (query block proven small in bytes): the block is broadcast once and every task
  scans its slice of the points with ``mapInPandas``, scoring tiles of queries against Arrow
  batches of points as matrix products and keeping only scores that reach the k-th best so far;
  the points are never shuffled.
* **blocked** (any size): the larger side is cut into hash blocks and shuffled once, the
  smaller side is replicated to the blocks; a task holds one block and streams the other side
  past it, so memory is bounded by a block and nothing is broadcast.

Both emit candidates, not pairs: per query the rows whose score is within 1e-6 of the local
k-th best (ties at the cut are kept), and a final ``row_number`` over
``(round(score, 6) desc, id asc)`` picks the exact global top-k.  Filters (payload equality,
per-query year, self-exclusion) are applied before any cut.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.blocks import TIE_TOLERANCE, Best, lists
from folio.operators.bm25 import rank_top
from folio.session import at_most, path_exists

MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of a held block, at most and (to keep all cores busy) at least; queries scored against a batch at once; rows of a streamed batch.
BLOCK_ROWS, LEAST_BLOCK_ROWS = 16384, 2048
TILE_ROWS = 512


@dataclass(frozen=True)
class VecCols:
    """Where a frame keeps its vectors: dense ``vector`` or sparse ``idx``/``val`` arrays."""

    vector: str | None = "vector"
    idx: str | None = None
    val: str | None = None
    dim: int | None = None

    def columns(self) -> list[str]:
        return [self.vector] if self.vector else [self.idx, self.val]

    def present(self) -> Column:
        cols = self.columns()
        full = [F.size(self.vector) > 0] if self.vector else []
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols] + full)


DENSE = VecCols()


def sparse(dim: int, idx: str = "v_idx", val: str = "v_val") -> VecCols:
    return VecCols(vector=None, idx=idx, val=val, dim=dim)


# ---------------------------------------------------------------- numpy kernels (per batch)


def _matrix(pdf: pd.DataFrame, vc: VecCols) -> tuple[np.ndarray, np.ndarray]:
    """Row-normalised float64 matrix and a mask of rows with a non-zero vector."""
    n = len(pdf)
    if vc.vector:
        if n == 0:
            return np.zeros((0, 0)), np.zeros(0, dtype=bool)
        values = pdf[vc.vector].to_numpy()
        flat = np.concatenate(values).astype(np.float64)
        if len(flat) % n == 0 and len(values[0]) * n == len(flat):  # one dimension: reshape, no row loop
            m = flat.reshape(n, -1)
        else:
            m = np.vstack([np.asarray(v, dtype=np.float64) for v in values])
    else:
        m = np.zeros((n, vc.dim), dtype=np.float64)
        if n:
            idx = pdf[vc.idx].to_numpy()
            lens = np.fromiter((len(a) for a in idx), dtype=np.int64, count=n)
            if lens.sum():
                rows = np.repeat(np.arange(n), lens)
                m[rows, np.concatenate(idx).astype(np.int64)] = np.concatenate(pdf[vc.val].to_numpy())
    norms = np.linalg.norm(m, axis=1) if n else np.zeros(0)
    ok = norms > 0
    m[ok] /= norms[ok, None]
    return m, ok


class PointBlock:
    """Points as a normalised matrix (those without a direction left out), and by year on demand."""

    def __init__(self, pdf: pd.DataFrame, pc: VecCols, id_col: str, years_col: str | None):
        m, ok = _matrix(pdf, pc)
        self.m, self.id, self.kept = m[ok], pdf[id_col].to_numpy(dtype=np.int64)[ok], ok
        self.years = pdf[years_col][ok] if years_col else None
        self.cuts: dict = {}
        self.by_id = np.argsort(self.id, kind="stable")

    def of_year(self, year: float | None):
        """Places and matrix of the points that list ``year`` (all for None)."""
        if year is None:
            return None, self.m
        if not self.cuts:
            lens, listed = lists(self.years.map(lambda a: None if a is None else [y for y in a if y is not None]), np.float64)
            pairs = np.unique(np.stack([listed, np.repeat(np.arange(len(lens)), lens)]), axis=1)
            heads = np.flatnonzero(np.r_[True, np.diff(pairs[0]) != 0]) if pairs.shape[1] else np.zeros(0, dtype=int)
            for h, rows in zip(heads, np.split(pairs[1], heads[1:])):
                self.cuts[float(pairs[0, h])] = (rows.astype(np.int64), self.m[rows.astype(np.int64)])
            self.cuts[None] = (np.zeros(0, dtype=np.int64), self.m[:0])
        return self.cuts.get(year, self.cuts[None])

    def same(self, ids: np.ndarray):
        """Pairs (place in ``ids``, place of a point) with the same id."""
        known = self.id[self.by_id]
        lo, hi = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(ids)), n), self.by_id[at]


class QueryRows:
    """Queries as a normalised matrix, the ids that they exclude, and their rows by year."""

    def __init__(self, pdf: pd.DataFrame, qc: VecCols, self_col: str | None, year_col: str | None):
        self.m, ok = _matrix(pdf, qc)
        self.self_id = None
        if self_col:  # a null excludes nothing
            excluded = pdf[self_col]
            self.self_id = excluded.fillna(0).to_numpy(dtype=np.int64), excluded.notna().to_numpy()
        if year_col is None:
            self.groups = [(None, np.flatnonzero(ok))]
        else:
            years = pdf[year_col].astype("float64").to_numpy()
            self.groups = [(None, np.flatnonzero(ok & np.isnan(years)))]
            self.groups += [(float(y), np.flatnonzero(ok & (years == y))) for y in np.unique(years[~np.isnan(years)])]


#: Groups of points whose greatest scores bound the k-th best score from below.
BOUND_GROUPS = 64


def _kth_bound(s: np.ndarray, k: int) -> np.ndarray:
    """At most the ``k``-th best score of each row: that of the greatest scores of disjoint groups."""
    groups = max(BOUND_GROUPS, 4 * k)
    width = s.shape[1] // groups
    if width > 1:
        s = s[:, :width * groups].reshape(len(s), width, groups).max(axis=1)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


#: Pairs whose codes are compared at once.
CODE_PAIRS = 500_000


def _same_code(codes: tuple[np.ndarray, np.ndarray], qi: np.ndarray, pj: np.ndarray) -> np.ndarray:
    """Whether query and point of each pair have the same code in some table."""
    steps = range(0, max(len(qi), 1), CODE_PAIRS)
    return np.concatenate([(codes[0][qi[a:a + CODE_PAIRS]] == codes[1][pj[a:a + CODE_PAIRS]]).any(axis=1) for a in steps])


def score_points(queries: QueryRows, points: PointBlock, best: Best, codes: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Adds the candidates among ``points`` to the best of each query, ``TILE_ROWS`` queries at a time,
    so that the score matrix stays small whatever the size of the block.  With ``codes`` (of the queries
    and of the points, a column for each table) only pairs with a code in common are candidates."""
    for year, rows in queries.groups:
        if len(rows) == 0 or len(points.id) == 0:
            continue
        places, m = points.of_year(year)
        if len(m) == 0:
            continue
        for t in range(0, len(rows), TILE_ROWS):
            tile = rows[t:t + TILE_ROWS]
            s = queries.m[tile] @ m.T
            if queries.self_id is not None:
                ids, known = queries.self_id
                q, p = points.same(ids[tile])
                q, p = q[known[tile][q]], p[known[tile][q]]
                if places is not None:  # their places among the points of the year
                    at = np.minimum(np.searchsorted(places, p), len(places) - 1)
                    hit = places[at] == p
                    q, p = q[hit], at[hit]
                s[q, p] = -np.inf
            low = best.low[tile]
            if codes is None and s.shape[1] > best.k and np.isneginf(low).any():
                low = np.maximum(low, _kth_bound(s, best.k) - TIE_TOLERANCE)
            qi, pj = np.divmod(np.flatnonzero(s >= low[:, None]), s.shape[1])
            sc = s[qi, pj]
            real = sc > -np.inf
            qi, pj, sc = qi[real], pj[real], sc[real]
            if codes is not None:
                hit = _same_code(codes, tile[qi], pj)
                qi, pj, sc = qi[hit], pj[hit], sc[hit]
            best.add(tile[qi], points.id[pj if places is None else places[pj]], sc)


# ---------------------------------------------------------------- strategies


def _out_schema(queries: DataFrame, keys: list[str]) -> T.StructType:
    fields = [queries.schema[k] for k in keys]
    return T.StructType(fields + [T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])


def _empty_frame(schema: T.StructType) -> pd.DataFrame:
    kinds = {T.LongType: "int64", T.IntegerType: "int32", T.DoubleType: "float64"}
    return pd.DataFrame({f.name: pd.Series(dtype=kinds.get(type(f.dataType), "object")) for f in schema.fields})


def _broadcast_topk(queries, points, keys, qc, pc, k, self_col, year_col, years_col, id_col):
    spark = queries.sparkSession
    qcols = list(dict.fromkeys(keys + qc.columns() + [c for c in (self_col, year_col) if c]))
    # the bytes of the dense block, known before a row is collected
    width = F.lit(qc.dim) if qc.dim else F.size(F.col(qc.columns()[0]))
    n, wide = queries.agg(F.count(F.lit(1)), F.max(width)).first()
    if n * (wide or 0) * 8 > MAX_BROADCAST_BYTES:
        return None
    qpdf = queries.select(*qcols).toPandas()
    bc = spark.sparkContext.broadcast((qpdf[keys].reset_index(drop=True), QueryRows(qpdf, qc, self_col, year_col)))
    pcols = list(dict.fromkeys([id_col] + pc.columns() + ([years_col] if years_col else [])))
    schema = _out_schema(queries, keys)

    def run(batches):
        kdf, rows = bc.value
        best = Best(len(kdf), k)
        for ppdf in batches:
            if len(ppdf) and len(kdf):
                score_points(rows, PointBlock(ppdf, pc, id_col, years_col), best)
        qi, pid, sc = best.rows()
        if len(qi):
            out = kdf.iloc[qi].reset_index(drop=True)
            out["id"] = pid
            out["score"] = sc
            yield out

    return points.select(*pcols).mapInPandas(run, schema)


def _blocked_topk(queries, points, keys, qc, pc, k, self_col, year_col, years_col, id_col, block_rows):
    """The larger side stays, cut into blocks; the smaller one is copied to every block.  The columns
    of both sides lie flat beside each other, so that vectors reach numpy without a row loop."""
    nq, nv = queries.count(), points.count()
    hold_points = nv >= nq
    n, cores = max(nq, nv), queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / block_rows), min(cores, math.ceil(n / LEAST_BLOCK_ROWS)))
    qcols = list(dict.fromkeys(keys + qc.columns() + [c for c in (self_col, year_col) if c]))
    pcols = list(dict.fromkeys([id_col] + pc.columns() + ([years_col] if years_col else [])))
    q2 = queries.select(*[F.col(c).alias(f"_q_{c}") for c in qcols], F.xxhash64(*keys).alias("_h"))
    p2 = points.select(*[F.col(c).alias(f"_p_{c}") for c in pcols], F.xxhash64(id_col).alias("_h"))
    held, moved = (p2, q2) if hold_points else (q2, p2)
    held = held.withColumn("_b", F.pmod("_h", F.lit(blocks)).cast("int")).withColumn("_side", F.lit(0))
    moved = moved.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_side", F.lit(1))
    both = held.drop("_h").unionByName(moved.drop("_h"), allowMissingColumns=True)
    schema = _out_schema(queries, keys)
    names = [f"_q_{c}" for c in keys]

    def frame(table, side, cols):
        return table.select([f"_{side}_{c}" for c in cols]).rename_columns(cols).to_pandas()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc_

        def queries_of(t):
            return QueryRows(frame(t, "q", qcols), qc, self_col, year_col)

        def points_of(t):
            return PointBlock(frame(t, "p", pcols), pc, id_col, years_col)

        def rows(t, best):  # the keys as Arrow has them
            qi, pid, sc = best.rows()
            for at in range(0, len(qi), 100_000):
                cut = slice(at, at + 100_000)
                key_cols = t.select(names).take(pa.array(qi[cut])).combine_chunks().rename_columns(keys)
                out = key_cols.append_column("id", pa.array(pid[cut], pa.int64())).append_column("score", pa.array(sc[cut], pa.float64()))
                yield from out.to_batches()

        block, parts, known, best, held_rows = None, [], None, None, None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for b in pc_.unique(whole["_b"]).to_pylist():
                of_block = whole.filter(pc_.equal(whole["_b"], b))
                if b != block:
                    if best is not None:
                        yield from rows(held_rows, best)
                    block, parts, known, best, held_rows = b, [], None, None, None
                first = of_block.filter(pc_.equal(of_block["_side"], 0))
                if len(first):
                    parts.append(first)
                second = of_block.filter(pc_.equal(of_block["_side"], 1))
                if len(second) and (parts or known is not None):
                    if known is None:
                        held_rows, parts = pa.concat_tables(parts), []
                        known = points_of(held_rows) if hold_points else queries_of(held_rows)
                        best = None if hold_points else Best(len(held_rows), k)
                    if hold_points:
                        mine = Best(len(second), k)
                        score_points(queries_of(second), known, mine)
                        yield from rows(second, mine)
                    else:
                        score_points(known, points_of(second), best)
        if best is not None:
            yield from rows(held_rows, best)

    ordered = both.select("_b", "_side", *[f"_q_{c}" for c in qcols], *[f"_p_{c}" for c in pcols])
    return ordered.repartitionById(blocks, F.col("_b")).sortWithinPartitions("_b", "_side").mapInArrow(run, schema)


def vector_topk(queries: DataFrame, points: DataFrame, keys: list[str], k: int = 10, *,
                query_vec: VecCols = DENSE, point_vec: VecCols = DENSE, id_col: str = "id",
                exclude_self_col: str | None = None, query_year_col: str | None = None,
                point_years_col: str | None = None, strategy: str = "auto",
                max_broadcast_queries: int = MAX_BROADCAST_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine top-``k`` points per query: ``(keys..., rank, id, score)``.

    ``exclude_self_col`` names a query column holding a point id never to return for that
    query; ``query_year_col`` / ``point_years_col`` give a per-query year that the point's
    year list must contain (null year = no filter).  Queries or points without a vector (or
    with a zero vector) give no rows.  ``broadcast`` falls back to ``blocked`` when the query
    block exceeds ``MAX_BROADCAST_BYTES``.
    """
    queries = queries.where(query_vec.present())
    points = points.where(point_vec.present())
    args = (queries, points, keys, query_vec, point_vec, k, exclude_self_col, query_year_col,
            point_years_col, id_col)
    if strategy == "auto":
        strategy = "broadcast" if at_most(queries, max_broadcast_queries) else "blocked"
    cands = None
    if strategy == "broadcast":
        cands = _broadcast_topk(*args)
        if cands is None:
            strategy = "blocked"
    if strategy == "blocked":
        cands = _blocked_topk(*args, block_rows)
    elif cands is None:
        raise ValueError(f"unknown strategy {strategy!r}")
    return rank_top(cands, keys, k, id_col="id").select(*keys, "rank", "id", "score")


# ---------------------------------------------------------------- payload filters


def payload_filter(points: DataFrame, filters: dict | None, array_fields: set[str] | None = None) -> Column:
    """AND of equality conditions; an array field matches when it contains the value.

    An empty or missing filter is no filter.
    """
    if not filters:
        return F.lit(True)
    array_fields = array_fields or {f.name for f in points.schema.fields if isinstance(f.dataType, T.ArrayType)}
    conds = [
        F.array_contains(F.col(key), F.lit(value)) if key in array_fields else (F.col(key) == F.lit(value))
        for key, value in filters.items()
    ]
    return reduce(lambda a, b: a & b, conds)


def year_only_filter(filters: dict | None, years_col: str = "probable_referenced_years",
                     key: str = "probable_referenced_years") -> Column:
    """Full-text search honours only the year key, coerced to INT; a missing, empty, zero or
    null value means no filter; every other key is ignored."""
    value = (filters or {}).get(key)
    if not value:
        return F.lit(True)
    return F.array_contains(F.col(years_col), F.lit(str(value)).try_cast("int"))


def check_dimension(points: DataFrame, dim: int, vector_col: str = "vector") -> DataFrame:
    """Fails the job on a vector whose length differs from the table's dimension."""
    bad = F.size(F.col(vector_col)) != dim
    return points.withColumn(
        vector_col,
        F.when(bad, F.raise_error(F.concat(F.lit(f"vector dimension differs from {dim}: id "),
                                           F.col("id").cast("string")))).otherwise(F.col(vector_col)),
    )


def vector_table(spark, path: str, dim: int, vector_type: T.DataType = T.FloatType()) -> DataFrame:
    """The vector table at ``path``, created empty (``id``, ``vector``) when absent.

    An existing table is returned as is; its vectors are checked against ``dim`` lazily, so a
    write of a wrong dimension fails the job that reads it.
    """
    if not path_exists(spark, path):
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(vector_type))])
        spark.createDataFrame([], schema).write.parquet(path)
    existing = spark.read.parquet(path)
    return check_dimension(existing, dim)


def points_of_pages(pages: DataFrame, vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Points ``(id, vector, payload struct)`` from page rows and their vectors (joined on id)."""
    payload = F.struct(
        "corpus_id", "doc_id", "page", "exact_filename", "probable_referenced_years", "markdown_content")
    return pages.join(vectors, pages["corpus_id"] == vectors["id"]).select(
        F.col("corpus_id").cast("long").alias("id"), F.col(vector_col), payload.alias("payload"))


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", order_col: str | None = None) -> DataFrame:
    """Latest write wins: ``base`` rows without an update, plus one row per updated key.

    Within ``updates`` the row with the greatest ``order_col`` wins; among equals (or without
    ``order_col``) the one whose row hash is smallest.
    """
    order = [F.col(order_col).desc()] if order_col else []
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*updates.columns))
    updates = updates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


VERSIONS, POINTER = "versions", "current"
#: Rows that a bucket of an upserted table should hold, and how many buckets there are at least and most.
BUCKET_ROWS, BUCKETS = 200_000, (8, 4096)
MANIFEST = "n bigint, version string, buckets int, schema string, folders map<string,string>"


def _manifests(spark, path: str) -> DataFrame | None:
    """The lines of the table's pointer, one per version; None for a new table."""
    pointer = f"{path}/{POINTER}"
    return spark.read.schema(MANIFEST).json(pointer) if path_exists(spark, pointer) else None


def _bucket_rows(spark, path: str, manifest, only: set[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets; each bucket is read where it was last written."""
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    folders = [f"{path}/{VERSIONS}/{v}/_bucket={b}" for b, v in sorted(manifest["folders"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current_version(spark, path: str) -> DataFrame | None:
    """The rows of the version that the table's pointer names; None for a new table."""
    lines = _manifests(spark, path)
    newest = None if lines is None else lines.orderBy(F.col("n").desc()).first()
    return None if newest is None else _bucket_rows(spark, path, newest)


def write_upsert(spark, path: str, updates: DataFrame, version: str, key: str = "id", order_col: str | None = None,
                 buckets: int | None = None) -> DataFrame:
    """Upserts into the versioned table at ``path`` and returns its new state.

    Rows are kept in ``buckets`` by a hash of the key (fixed when the table is made; by the number
    of its first rows if not given).  A version writes the buckets that its updates fall in, under
    ``versions/<version>/_bucket=<b>``, and then appends one line to the pointer that names the
    folder of every bucket, old or new; readers follow the newest line.  So an upsert costs what
    its buckets cost, and a failed write leaves the old version current.  Writing a version that
    the pointer names already changes nothing, so a repeated run is safe.
    """
    lines = _manifests(spark, path)
    known = [] if lines is None else lines.orderBy("n").collect()  # one line per version
    if version not in [r["version"] for r in known]:
        last = known[-1] if known else None
        if last is None:
            buckets = buckets or min(max(-(-updates.count() // BUCKET_ROWS), BUCKETS[0]), BUCKETS[1])
            schema, folders = updates.schema, {}
        else:
            buckets, folders = last["buckets"], dict(last["folders"])
            schema = T.StructType.fromJson(json.loads(last["schema"]))
        place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = updates.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        touched = {r[0] for r in rows.select(place).distinct().collect()}  # at most ``buckets``
        old = rows.limit(0) if last is None else _bucket_rows(spark, path, last, touched)
        new = upsert(old, rows, key, order_col).withColumn("_bucket", place)
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{VERSIONS}/{version}")
        folders |= {str(b): version for b in touched}
        line = spark.createDataFrame([(len(known), version, buckets, schema.json(), folders)], MANIFEST)
        line.coalesce(1).write.mode("append").json(f"{path}/{POINTER}")
    return current_version(spark, path)


# ---------------------------------------------------------------- approximate top-k


def hyperplanes(tables: int, bits: int, dim: int) -> list[list[list[int]]]:
    """Fixed +1/-1 hyperplanes ``[table][bit][dimension]`` from a rule that any engine can repeat:
    the parity of a squared linear form modulo a prime."""
    def sign(t: int, b: int, d: int) -> int:
        x = (t * 7919 + b * 104729 + d * 1299709 + 15485863) % 32452843
        return 1 if (x * x % 32452843) // 7 % 2 else -1

    return [[[sign(t, b, d) for d in range(dim)] for b in range(bits)] for t in range(tables)]


def _code_matrix(vecs, planes: np.ndarray) -> np.ndarray:
    """For each vector and table the signs of the products with the table's planes as bits."""
    tables, bits, dim = planes.shape
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vecs])
    above = (m @ planes.reshape(tables * bits, dim).T >= 0).reshape(len(m), tables, bits)
    return (above @ (1 << np.arange(bits))).astype(np.int32)


def _codes(vector_col: str, planes: np.ndarray) -> Column:
    """``array<int>``: the vector's code in each table."""

    @F.pandas_udf("array<int>")
    def codes(vecs: pd.Series) -> pd.Series:
        return pd.Series(list(_code_matrix(vecs, planes)) if len(vecs) else [], dtype=object)

    return codes(F.col(vector_col))


#: Bytes of the matrix of a held block of points, and the rows that give the first bound of the scores.
LSH_BLOCK_BYTES, LSH_FIRST_ROWS = 32 * 1024 * 1024, 256


def lsh_topk(queries: DataFrame, points: DataFrame, keys: list[str], k: int = 10, *, vector_col: str = "vector",
             id_col: str = "id", exclude_self_col: str | None = None, tables: int = 16, bits: int = 4,
             block_rows: int | None = None) -> DataFrame:
    """Approximate cosine top-``k`` by random hyperplanes: ``(keys..., rank, id, score)``.

    A point is a candidate of a query when they fall on the same side of all ``bits`` planes of
    some table; candidates are ranked by exact cosine, so only recall is approximate.  More
    ``bits`` make smaller buckets, more ``tables`` raise recall.  Null, empty and zero vectors take
    no part.

    Points are held in blocks of ``block_rows`` at most and the queries stream past them; a task
    keeps the best of each query over its block.  The blocks are cut out of the buckets, where
    each vector goes to a bucket of every table, or out of all points, where each query passes
    every block once and is compared with the points that share one of its codes.  The layout that
    moves fewer rows is taken: with wide buckets the same pairs would meet in many tables, and every
    vector would be copied for each table and block.
    """
    def usable(df: DataFrame) -> DataFrame:
        norm = F.aggregate(F.col(vector_col), F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        return df.where(F.col(vector_col).isNotNull() & (norm > 0))

    qcols = list(dict.fromkeys(keys + [vector_col] + ([exclude_self_col] if exclude_self_col else [])))
    pcols = [id_col, vector_col]
    queries, points = usable(queries).select(*qcols), usable(points).select(*pcols)
    dim = points.agg(F.max(F.size(vector_col))).first()[0] or 1
    block_rows = block_rows or max(LEAST_BLOCK_ROWS, LSH_BLOCK_BYTES // (8 * dim))
    planes = np.array(hyperplanes(tables, bits, dim), dtype=np.float64)

    def most_copies() -> int:
        return points.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1

    copies = most_copies()
    if copies > 1:  # equal rows are one point; a block keeps as many more rows as an id has vectors
        points = points.distinct()
        copies = most_copies()

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_codes", _codes(vector_col, planes)).select(*df.columns, F.posexplode("_codes").alias("_table", "_code"))

    def counted(df: DataFrame, name: str) -> DataFrame:  # at most tables * 2 ** bits rows
        return placed(df).groupBy("_table", "_code").agg(F.count(F.lit(1)).alias(name))

    place = ["_table", "_code"]
    sizes = counted(queries, "_nq").join(counted(points, "_np"), place).withColumn("_parts", F.ceil(F.col("_np") / block_rows))
    in_buckets, most = sizes.agg(F.sum(F.col("_np") + F.col("_nq") * F.col("_parts")), F.max("_parts")).first()
    nq, nv, cores = queries.count(), points.count(), queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(nv / block_rows), min(cores, math.ceil(nv / LEAST_BLOCK_ROWS)))
    whole = (in_buckets or 0) >= nv + nq * blocks

    def named(df: DataFrame, side: str, cols: list[str], block: Column) -> DataFrame:
        return df.select(block.cast("bigint").alias("_b"), F.lit(int(side == "q")).alias("_side"), *(F.col(c).alias(f"_{side}_{c}") for c in cols))

    if whole:
        p = named(points, "p", pcols, F.pmod(F.xxhash64(id_col), F.lit(blocks)))
        q = named(queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "q", qcols, F.col("_block"))
        both = p.unionByName(q, allowMissingColumns=True).repartitionById(blocks, F.col("_b").cast("int"))
    else:
        cut = F.broadcast(sizes.select(*place, "_parts"))
        cell = (F.col("_table") * F.lit(2 ** bits) + F.col("_code")).cast("bigint") * F.lit(most or 1)
        p = named(placed(points).join(cut, place), "p", pcols, cell + F.pmod(F.xxhash64(id_col), F.col("_parts")))
        q = placed(queries).join(cut, place).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        both = p.unionByName(named(q, "q", qcols, cell + F.col("_part")), allowMissingColumns=True).repartition("_b")
    qc, schema = VecCols(vector=vector_col), _out_schema(queries, keys)
    names = [f"_q_{c}" for c in keys]

    def frame(table, side, cols):
        return table.select([f"_{side}_{c}" for c in cols]).rename_columns(cols).to_pandas()

    def run(batches):
        import pyarrow as pa

        small = np.min_scalar_type(2 ** bits - 1)

        def coded(vecs):
            return _code_matrix(vecs, planes).astype(small) if whole and len(vecs) else None

        def held_points(table):  # few at first: the best of them bound the scores of the others
            at = 0
            while at < len(table):
                size = min(max(LSH_FIRST_ROWS, 3 * at), BLOCK_ROWS)
                pdf = frame(table.slice(at, size), "p", pcols)
                block = PointBlock(pdf, qc, id_col, None)
                yield block, coded(pdf[vector_col][block.kept])
                at += size

        def answered(table, known):
            pdf = frame(table, "q", qcols)
            rows, codes = QueryRows(pdf, qc, exclude_self_col, None), coded(pdf[vector_col])
            best = Best(len(pdf), k * copies)
            for block, of in known:
                score_points(rows, block, best, None if of is None else (codes, of))
                best.rows()
            qi, pid, sc = best.rows()
            for at in range(0, len(qi), 100_000):
                cut = slice(at, at + 100_000)
                key_cols = table.select(names).take(pa.array(qi[cut])).combine_chunks().rename_columns(keys)
                yield from key_cols.append_column("id", pa.array(pid[cut], pa.int64())).append_column("score", pa.array(sc[cut], pa.float64())).to_batches()

        cell, parts, known = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            b, side = table["_b"].to_numpy(), table["_side"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (side[1:] != side[:-1])]) if len(b) else np.zeros(0, int)
            for x, y in zip(edges, np.r_[edges[1:], len(b)]):
                if b[x] != cell:
                    cell, parts, known = b[x], [], None
                if side[x] == 0:
                    parts.append(table.slice(x, y - x))
                elif parts or known is not None:
                    if known is None:
                        known, parts = list(held_points(pa.concat_tables(parts))), []
                    yield from answered(table.slice(x, y - x), known)

    cands = both.sortWithinPartitions("_b", "_side").mapInArrow(run, schema)
    # a pair that shares several buckets is found several times; dealt by key, for the rank, too
    cands = cands.repartition(*keys).groupBy(*keys, "id").agg(F.max("score").alias("score"))
    return rank_top(cands, keys, k, id_col="id").select(*keys, "rank", "id", "score")


def recall_at_k(approx: DataFrame, exact: DataFrame, keys: list[str]) -> float:
    """Mean share of the exact top-k ids that the approximate result also returns."""
    hit = exact.select(*keys, "id").join(approx.select(*keys, "id").withColumn("_hit", F.lit(1)), keys + ["id"], "left")
    per_q = hit.groupBy(*keys).agg(F.avg(F.coalesce(F.col("_hit"), F.lit(0))).alias("r"))
    return float(per_q.agg(F.avg("r")).first()[0] or 0.0)
