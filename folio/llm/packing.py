"""Packing of token ids into fixed-length rows by best-fit decreasing.

Documents are encoded and packed where they are read, without a shuffle: a task gathers pieces
until it holds ``BUFFER`` tokens, packs them and emits the rows.  A document longer than a row
is split into full rows and a rest; nothing is dropped or truncated.  Pieces are placed in
order of falling length, each into the open row with the smallest sufficient capacity, found by
a segment tree over capacities.

A packed row has its ids as little-endian integers of fixed width, filled up with the padding
id, so rows form a matrix; ``cu_seqlens`` holds the cumulative piece lengths from 0 and
``position_resets`` where position ids start at 0 again.  ``doc_ids`` and ``piece_starts`` say
which document each piece is from and where in it the piece begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bpe import Vocabulary, batch_encoder, encoded, shared
from folio.llm.words import clean

LENGTH = 2048
#: Tokens that a task gathers before it packs them.
BUFFER = 4_000_000

PACKED = (
    "pack_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, piece_starts array<bigint>"
)


class Capacities:
    """Open rows by free capacity; a segment tree finds the smallest sufficient one."""

    def __init__(self, most: int) -> None:
        self.base = 1 << most.bit_length()
        self.open = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(self.base)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = capacity + self.base
        while k and not self.open[k]:
            self.open[k] = 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """``(capacity, row)`` of the fullest row that has room, the latest among equals."""
        k = least + self.base
        while not self.open[k]:
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.base:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        capacity = k - self.base
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.open[k] = 0
            k >>= 1
            while k and not (self.open[2 * k] or self.open[2 * k + 1]):
                self.open[k] = 0
                k >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; pieces are at most ``length`` long and ties keep their order."""
    rows: list[list[int]] = []
    room = Capacities(length)
    for piece in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = room.take(lengths[piece])
        if found is None:
            found = length, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(piece)
        if capacity > lengths[piece]:
            room.put(capacity - lengths[piece], row)
    return rows


def _packed(pieces: list[tuple[object, int, np.ndarray]], length: int, kind: np.dtype, pad: int, first_id: int) -> pa.RecordBatch:
    """The packed rows of pieces ``(doc_id, start, ids)``."""
    rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
    matrix = np.full((len(rows), length), pad, kind)
    cuts, resets, docs, starts, sizes = [], [], [], [], []
    for k, row in enumerate(rows):
        cut = np.cumsum([0] + [len(pieces[p][2]) for p in row])
        matrix[k, : cut[-1]] = np.concatenate([pieces[p][2] for p in row])
        cuts.append(cut.tolist())
        resets.append(cut[:-1].tolist())
        docs.append([pieces[p][0] for p in row])
        starts.append([pieces[p][1] for p in row])
        sizes.append(int(cut[-1]))
    ids = pa.array([m.tobytes() for m in matrix], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(first_id, first_id + len(rows)), pa.int64()), pa.array(sizes, pa.int32()), ids, pa.array(cuts, pa.list_(pa.int32())),
            pa.array(resets, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())),
        ],
        names=["pack_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "piece_starts"],
    )


def pack(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH, pad: int | None = None, buffer: int = BUFFER) -> DataFrame:
    """Packed rows of all texts of ``docs(doc_id, text)``; see the module for the columns.

    Null and empty texts have no ids and so no piece; a null ``doc_id`` is carried; repeated rows
    are packed each.  ``pad`` is the last id of the vocabulary unless given.  Pack ids are unique
    and the same when a task runs again.  An empty table gives no row.
    """
    held = shared(docs.sparkSession, vocabulary)
    size = len(vocabulary.tokens)
    fill = size - 1 if pad is None else pad
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(held.value)
        next_id = TaskContext.get().partitionId() << 33
        pieces: list[tuple[object, int, np.ndarray]] = []
        tokens = 0
        for batch in batches:
            doc_ids, texts, at = batch.column("doc_id").to_pylist(), clean(batch.column("text").to_pylist()), 0
            for ids, counts in encoded(encoder, texts):
                ids = ids.astype(kind)
                end = 0
                for n in counts.tolist():
                    for start in range(0, n, length):
                        pieces.append((doc_ids[at], start, ids[end + start : end + min(start + length, n)]))
                    end += n
                    at += 1
                tokens += len(ids)
                if tokens >= buffer:
                    out = _packed(pieces, length, kind, fill, next_id)
                    next_id += len(out)
                    pieces, tokens = [], 0
                    yield out
        if pieces:
            yield _packed(pieces, length, kind, fill, next_id)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PACKED)


def matrix(rows: pd.DataFrame, length: int = LENGTH, size: int = 50257) -> np.ndarray:
    """The id matrix of collected packed rows."""
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    return np.frombuffer(b"".join(bytes(b) for b in rows["ids"]), kind).reshape(len(rows), length)


def position_ids(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """Positions of one row: from 0 in each piece, and from 0 in the padding."""
    cuts = [*cu_seqlens, length] if cu_seqlens[-1] < length else list(cu_seqlens)
    return np.concatenate([np.arange(b - a) for a, b in zip(cuts, cuts[1:])])


def write(packs: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet; a rewrite of the same path replaces it."""
    packs.write.mode("overwrite").parquet(path)
