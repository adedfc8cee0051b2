"""Prefix trie of rebuilt conversations as balanced parentheses.

Conversations share beginnings; the trie of their turns tells how much a prefix cache saves.  A
conversation ``c`` is rebuilt from the first ``h`` turns of ``c - c % 100`` and its own turns after
its first ``h`` (``h = crc32(decimal c) % 6``).

1. All turns are sorted by range, so a very long conversation lies in several tasks; each task
   carries a polynomial hash (two lanes modulo 2**64) along, and one line per task joins the parts.
   As the hash is a sum, the prefixes of a rebuilt conversation follow from those of its two
   sources by one multiplication.
2. A node is a prefix hash and depth; counting its conversations is one partial aggregation.
   Consecutive nodes with the same conversations form a run, named by its smallest conversation
   and their number.  Along a path the number falls with every run, so a path has at most
   ``sqrt(2 * turns)`` runs.
3. The paths of all leaves, sorted by range, are cut into shards.  A shard writes its part of the
   trie as balanced parentheses; ``findclose`` (blocks of excess minima under a tree of minima)
   delimits subtrees, the rank of the pairs ``()`` counts leaves, and cumulative arrays over the
   preorder give savings.
4. The spine that a shard shares with the one before adds nothing of its own there; equal nodes
   of neighbouring shards are merged by sums.

Keys with very many rows (a first turn that a third of the conversations have) are joined by
broadcast; there can be only as many as the rows allow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import materialize

#: Fixed values of the rebuilding rule: a head comes from the conversation that ends in 00.
GROUP, HEADS = 100, 6
#: Multipliers of the two hash lanes (odd, so they can be undone).
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD = 1 << 64
#: Turns that a task sorts; leaf paths of a shard, at least and at most.
TASK_TURNS, SHARD_PATHS = 500_000, (5_000, 500_000)
#: At most this many keys are broadcast because they have many rows.
HOT_KEYS = 100_000
#: Bits of a block of the excess sequence.
EXCESS_BLOCK = 256
#: Conversation ids that are written as one piece of an end list.
CHUNK_IDS = 65_536
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted turns with their place and running sums inside their conversation's part here."""
    part = TaskContext.get().partitionId()
    last, idx0, sums, chars0 = None, 0, [0, 0], 0
    for batch in batches:
        conv = batch["conv_id"].to_numpy(np.int64)
        if not len(conv):
            continue
        new = np.append(last is None or conv[0] != last, conv[1:] != conv[:-1])
        group = np.cumsum(new) - new[0]
        start = np.flatnonzero(np.append(True, new[1:]))
        carried = not new[0]
        step = np.arange(len(conv)) - start[group]
        idx = step + np.where((group == 0) & carried, idx0, 0)
        out = {"part": part, "conv_id": conv, "idx": idx, "chars": batch["chars"].to_numpy(np.int64)}
        for lane, base in enumerate(LANES):
            power = np.cumprod(np.append(np.uint64(1), np.full(int(step.max()), np.uint64(base))))[step]
            if carried:
                power[group == 0] *= np.uint64(pow(base, idx0, WORD))
            total = np.cumsum(batch[f"t{lane + 1}"].to_numpy(np.int64).view(np.uint64) * power)
            total -= np.append(np.uint64(0), total)[start][group]
            if carried:
                total[group == 0] += np.uint64(sums[lane])
            sums[lane] = int(total[-1])
            out[f"s{lane + 1}"] = total.view(np.int64)
        cum = np.cumsum(out["chars"])
        cum = cum - np.append(0, cum)[start][group] + np.where((group == 0) & carried, chars0, 0)
        last, idx0, chars0 = conv[-1], int(idx[-1]) + 1, int(cum[-1])
        yield pd.DataFrame({**out, "cum": cum})


SCANNED = "part int, conv_id bigint, idx bigint, chars bigint, s1 bigint, s2 bigint, cum bigint"


def _signed(x: int) -> int:
    x %= WORD
    return x - WORD if x >= WORD >> 1 else x


def _carried(rows: DataFrame) -> dict[int, tuple]:
    """For each task whose first conversation began in an earlier one: its id, and the turns, hash
    sums and characters before.  One row per task reaches the driver."""
    last = F.max_by(F.struct("conv_id", "idx", "s1", "s2", "cum"), F.struct("conv_id", "idx")).alias("last")
    out: dict[int, tuple] = {}
    before = None  # the state at the end of the task before
    for r in rows.groupBy("part").agg(F.min("conv_id").alias("first"), last).orderBy("part").collect():
        if before is not None and before[0] == r["first"]:
            out[r["part"]] = before
        end = r["last"]
        state = (end["conv_id"], end["idx"] + 1, end["s1"], end["s2"], end["cum"])
        if r["part"] in out and end["conv_id"] == r["first"]:
            _, n, s1, s2, cum = out[r["part"]]
            state = (end["conv_id"], n + state[1], *(_signed(s + pow(b, n, WORD) * e) for s, b, e in zip((s1, s2), LANES, state[2:4])), cum + state[4])
        before = state
    return out


def ordered_turns(turns: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """``(conv_id, pos, chars, s1, s2, cum)``: each turn's place from 0 in its conversation (by
    turn, null first, then role, then hash), its characters, and hash and characters up to it."""
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.char_length(text).cast("bigint").alias("chars"))
    n = turns.count()
    parts = max(1, -(-n // task_turns), min(spark.sparkContext.defaultParallelism, n // 5_000))
    order = ["conv_id", "turn", "role", "t1", "t2"]
    rows = materialize(hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_scanned, SCANNED), "turns")
    carried = _carried(rows) if parts > 1 else {}
    if not carried:
        return rows.withColumnRenamed("idx", "pos").drop("part")
    held = spark.sparkContext.broadcast(carried)  # one entry per task at most

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in set(batch["part"]) & held.value.keys():
                conv, n, s1, s2, cum = held.value[part]
                mine = ((batch["part"] == part) & (batch["conv_id"] == conv)).to_numpy()
                for name, s, base in zip(("s1", "s2"), (s1, s2), LANES):
                    old = batch.loc[mine, name].to_numpy(np.int64).view(np.uint64)
                    batch.loc[mine, name] = (np.uint64(s % WORD) + np.uint64(pow(base, n, WORD)) * old).view(np.int64)
                batch.loc[mine, "idx"] += n
                batch.loc[mine, "cum"] += cum
            yield batch

    return rows.mapInPandas(joined, SCANNED).withColumnRenamed("idx", "pos").drop("part")


def taken_heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the head of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def _joined(left: DataFrame, right: DataFrame, on: list[str], heavy: Column) -> DataFrame:
    """An inner join; the keys of ``right`` with very many rows in ``left`` (at most ``HOT_KEYS``)
    are broadcast, and their rows are not shuffled."""
    hot, cold = F.broadcast(right.where(heavy)), right.where(~heavy)
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(cold, on))


@F.pandas_udf(T.StructType([T.StructField("p1", T.LongType()), T.StructField("p2", T.LongType())]))
def _prefix(e1: pd.Series, e2: pd.Series, s1: pd.Series, s2: pd.Series, o1: pd.Series, o2: pd.Series, shift: pd.Series) -> pd.DataFrame:
    """Hash of a head (``e``) followed by the own turns between ``o`` and ``s``, moved by ``shift``."""
    out = {}
    for name, base, e, s, o in zip(("p1", "p2"), LANES, (e1, e2), (s1, s2), (o1, o2)):
        power = np.array([pow(base, -k, WORD) for k in range(HEADS)], np.uint64)[-shift.to_numpy(np.int64)]
        e, s, o = (x.to_numpy(np.int64).view(np.uint64) for x in (e, s, o))
        out[name] = (e + power * (s - o)).view(np.int64)
    return pd.DataFrame(out)


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conversations, prefixes)``: ``(conv_id, length)`` of each rebuilt conversation, and
    ``(conv_id, depth, p1, p2, chars, cum, is_end)`` of each of its prefixes with a turn."""
    first = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "s1", "s2", "chars", "cum"))
    found = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(first)).alias("own"))
    convs = materialize(found.withColumn("h", taken_heads(F.col("conv_id")).cast("int")), "conversations")
    heads = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head"), F.col("own").alias("given"))
    none = F.struct(F.lit(0).cast("bigint").alias("pos"), *(F.lit(0).cast("bigint").alias(c) for c in ("s1", "s2", "chars", "cum")))
    convs = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce(F.size("given"), F.lit(0)))).withColumn("taken", F.greatest("taken", F.lit(0)))
    convs = convs.select(
        "conv_id", "n", "h", "taken", F.slice(F.coalesce("given", F.array()), F.lit(1), F.col("taken")).alias("given"),
        F.when((F.col("h") > 0) & (F.col("n") > F.col("h")), F.element_at("own", F.greatest("h", F.lit(1)))).otherwise(none).alias("o"),
        (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = convs.withColumn("e", F.when(F.col("taken") > 0, F.element_at("given", F.greatest("taken", F.lit(1)))).otherwise(none))
    convs = materialize(convs, "rebuilt")
    many = F.col("n") >= _heavy(rows)
    source = convs.where("n > h").select("conv_id", "n", "h", "taken", "length", "e", "o")
    own = _joined(rows.where(F.col("pos") >= taken_heads(F.col("conv_id"))), source, ["conv_id"], many)
    depth = F.col("taken") + F.col("pos") - F.col("h") + 1
    own = own.select("conv_id", depth.alias("depth"), _prefix("e.s1", "e.s2", "s1", "s2", "o.s1", "o.s2", F.col("taken") - F.col("h")).alias("p"),
                     "chars", (F.col("e.cum") + F.col("cum") - F.col("o.cum")).alias("cum"), (depth == F.col("length")).alias("is_end"))
    taken = convs.select("conv_id", "length", F.explode("given").alias("g")).select(
        "conv_id", (F.col("g.pos") + 1).alias("depth"), F.struct(F.col("g.s1").alias("p1"), F.col("g.s2").alias("p2")).alias("p"),
        "g.chars", "g.cum", (F.col("g.pos") + 1 == F.col("length")).alias("is_end"))
    prefixes = own.unionByName(taken).select("conv_id", "depth", "p.p1", "p.p2", "chars", "cum", "is_end")
    return convs.select("conv_id", "length"), materialize(prefixes, "prefixes")


def _heavy(rows: DataFrame) -> int:
    """Rows from which on a key is heavy: at most ``HOT_KEYS`` keys have as many."""
    return max(1_000, -(-rows.count() // HOT_KEYS))


# --- balanced parentheses -------------------------------------------------------------------


class Parentheses:
    """A tree as a sequence of parentheses (1 opens, 0 closes) with its excess in blocks."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(np.where(bits == 1, 1, -1))
        self.opens = np.flatnonzero(bits == 1)
        pair = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.concatenate([[0], np.cumsum(pair), [int(pair.sum())]])
        blocks = max(1, -(-len(bits) // EXCESS_BLOCK))
        high = np.iinfo(np.int64).max
        padded = np.full(blocks * EXCESS_BLOCK, high)
        padded[: len(bits)] = self.excess
        self.padded = padded.reshape(blocks, EXCESS_BLOCK)
        level = self.padded.min(axis=1)
        self.minima = [level]
        while len(level) > 1:
            level = np.append(level, high)[: -(-len(level) // 2) * 2].reshape(-1, 2).min(axis=1) if len(level) % 2 else level.reshape(-1, 2).min(axis=1)
            self.minima.append(level)

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place behind ``after`` in each block with excess at most ``target``, or -1."""
        out = np.full(len(block), -1)
        for a in range(0, len(block), 4096):
            b = slice(a, a + 4096)
            low = (self.padded[block[b]] <= target[b, None]) & (np.arange(EXCESS_BLOCK) > after[b, None])
            out[b] = np.where(low.any(axis=1), low.argmax(axis=1), -1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place with less excess."""
        target = self.excess[opens] - 1
        block = opens // EXCESS_BLOCK
        found = self._in_block(block, opens % EXCESS_BLOCK, target)
        out = np.where(found >= 0, block * EXCESS_BLOCK + found, -1)
        left = np.flatnonzero(found < 0)
        if not len(left):
            return out
        at, level = block[left].copy(), np.zeros(len(left), np.int64)
        rising = np.ones(len(left), bool)
        while rising.any():  # up to the first right neighbour that goes low enough
            for depth, minima in enumerate(self.minima[:-1]):
                here = np.flatnonzero(rising & (level == depth))
                nxt = np.minimum(at[here] + 1, len(minima) - 1)
                ok = (at[here] % 2 == 0) & (at[here] + 1 < len(minima)) & (minima[nxt] <= target[left[here]])
                at[here] = np.where(ok, at[here] + 1, at[here] // 2)
                level[here] += np.where(ok, 0, 1)
                rising[here[ok]] = False
            rising &= level < len(self.minima) - 1
        for depth in range(len(self.minima) - 1, 0, -1):  # and down to its first block
            here = np.flatnonzero(level == depth)
            child = at[here] * 2
            at[here] = np.where(self.minima[depth - 1][child] <= target[left[here]], child, child + 1)
            level[here] -= 1
        out[left] = at * EXCESS_BLOCK + self._in_block(at, np.full(len(left), -1), target[left])
        return out

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Leaf pairs inside each subtree, by rank."""
        return self.pairs[closes] - self.pairs[opens]


def shard_sums(paths: list[list[tuple]], shared: int) -> list[tuple]:
    """``(top, first, n, parent, leaves, saved, children)`` of the nodes of one shard.

    ``paths`` are its sorted leaf paths, each a list of runs ``(top, first, n, weight)``; the first
    ``shared`` runs of the first path stand in the shard before, too, and count nothing here.  The
    root is the run of depth 0."""
    bits, nodes, parent = [1], [(0, None, 0, 0)], [-1]
    stack, before = [0], []
    for path in paths:
        k = 0
        while k < len(path) and k < len(before) and path[k] == before[k]:
            k += 1
        bits += [0] * (len(before) - k) + [1] * (len(path) - k)
        del stack[k + 1 :]
        for run in path[k:]:
            parent.append(stack[-1])
            stack.append(len(nodes))
            nodes.append(run)
        before = path
    bits += [0] * (len(before) + 1)
    tree = Parentheses(np.array(bits, np.uint8))
    close = tree.findclose(tree.opens)
    leaves = tree.leaves(tree.opens, close)
    size = (close - tree.opens + 1) // 2
    counted = np.ones(len(nodes), bool)
    counted[1 : 1 + shared] = False
    weight = np.where(counted, np.array([run[3] for run in nodes], np.int64), 0)
    upto = np.concatenate([[0], np.cumsum(weight)])
    saved = upto[np.arange(len(nodes)) + size] - upto[:-1]
    children = np.bincount(np.array(parent[1:], np.int64)[counted[1:]], minlength=len(nodes)) if len(nodes) > 1 else np.zeros(1, np.int64)
    return [
        (run[0], run[1], run[2], nodes[p][1] if p > 0 else None, int(x), int(s), int(c))
        for run, p, x, s, c in zip(nodes, parent, leaves, saved, children)
    ]


SUMS = "top bigint, first bigint, n bigint, parent bigint, leaves bigint, saved bigint, children bigint"


def _runs_of(cell) -> list[tuple]:
    return [(int(r["top"]), int(r["first"]), int(r["n"]), int(r["weight"])) for r in cell]


def subtree_sums(paths: DataFrame, shard_paths: int | None = None) -> DataFrame:
    """``SUMS`` of every run of the trie of the leaf paths ``(path)``, and of the root."""
    spark = paths.sparkSession
    n = paths.count()
    per = shard_paths or min(max(n // 1_000, SHARD_PATHS[0]), SHARD_PATHS[1])
    shards = max(1, -(-n // per))
    dealt = materialize(paths.select("path").repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "shards")
    edge = dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    edge = edge.withColumn("before", F.lag("high").over(Window.orderBy("shard")))  # one row per shard
    differs = F.array_position(F.zip_with("before", "low", lambda x, y: x.eqNullSafe(y)), False)
    same = F.when(F.col("before").isNull(), 0).when(differs > 0, differs - 1).otherwise(F.least(F.size("before"), F.size("low")))
    shared = spark.sparkContext.broadcast({r["shard"]: int(r["same"]) for r in edge.select("shard", same.alias("same")).collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, []

        def done() -> pd.DataFrame:
            columns = zip(*shard_sums(held, shared.value[shard]))  # nulls must not turn ids into doubles
            return pd.DataFrame({name: pd.array(list(column), "Int64") for name, column in zip(("top", "first", "n", "parent", "leaves", "saved", "children"), columns)})

        for batch in batches:
            for s, cell in zip(batch["shard"], batch["path"]):
                if s != shard and held:
                    yield done()
                    held = []
                shard = s
                held.append(_runs_of(cell))
        if held:
            yield done()

    sums = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path").mapInPandas(run, SUMS)
    return sums.groupBy("top", "first", "n").agg(
        F.min("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"))


# --- the trie -------------------------------------------------------------------------------


def _leaf_paths(prefixes: DataFrame, runs: DataFrame, heavy: int) -> DataFrame:
    """``(path)``: for the smallest conversation of each leaf its runs from the top."""
    weight = ((F.col("n_convs") - 1) * F.col("run_chars")).alias("weight")
    tops = runs.where("n_convs > 1").select(
        F.col("top").alias("depth"), "key.p1", "key.p2", F.struct("top", F.col("conv_id").alias("first"), F.col("n_convs").alias("n"), weight).alias("run"))
    on = _joined(prefixes.select("conv_id", "depth", "p1", "p2"), tops, ["depth", "p1", "p2"], F.col("run.n") >= heavy).select("conv_id", "run")
    leaves = runs.where("leaf").select("conv_id", F.struct("top", F.col("conv_id").alias("first"), F.col("n_convs").alias("n"), weight).alias("end"))
    ends = leaves.select("conv_id", F.col("end").alias("run")).where("run.n = 1")
    mine = on.join(leaves.select("conv_id"), "conv_id", "left_semi").unionByName(ends)
    return mine.groupBy("conv_id").agg(F.array_sort(F.collect_list("run")).alias("path")).select("path")


def _end_digests(ended: DataFrame) -> DataFrame:
    """``(first, depth, ends_sha256)`` of ``(conv_id, first, depth)``: the ids of a node in
    ascending order, written in pieces of at most ``CHUNK_IDS`` ids; a node's pieces pass through
    one digest (it is sequential), one batch at a time."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    pieces = ended.withColumn("chunk", F.floor(F.col("conv_id") / CHUNK_IDS)).groupBy("first", "depth", "chunk").agg(F.array_join(ids, ",").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            rows = []
            for first, depth, piece in zip(batch["first"], batch["depth"], batch["piece"]):
                if key != (first, depth):
                    if key is not None:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = (first, depth), hashlib.sha256()
                    digest.update(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            yield pd.DataFrame(rows, columns=["first", "depth", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["first", "depth", "ends_sha256"])

    return pieces.repartition("first", "depth").sortWithinPartitions("first", "depth", "chunk").mapInPandas(run, "first bigint, depth bigint, ends_sha256 string")


NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def trie(turns: DataFrame, task_turns: int = TASK_TURNS, shard_paths: int | None = None) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, turn, role, text)`` rebuilt: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are in order of ``turn`` (null first); turns of one number are in order of role and
    hash of the content, and a repeated row is a turn of its own.  Null role and text count as
    empty, so a null and an empty text are the same turn.  Rows without ``conv_id`` belong to
    no conversation and are left out.  Further columns are ignored; an empty table has no node.
    Turns are told apart by 128 bits of hash.
    """
    spark: SparkSession = turns.sparkSession
    convs, prefixes = rebuilt(ordered_turns(turns, task_turns))
    total, root_first, turnless = convs.agg(F.count("*"), F.min("conv_id"), F.count_if(F.col("length") == 0)).first()
    if not total:
        return spark.createDataFrame([], NODE)
    heavy = _heavy(prefixes)
    nodes = materialize(prefixes.groupBy("depth", "p1", "p2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), F.min("cum").alias("cum"),
        F.count_if("is_end").alias("ends"), F.min(F.when(F.col("is_end"), F.col("conv_id"))).alias("end_first")), "nodes")
    runs = materialize(nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("chars").alias("run_chars"), F.min(F.col("cum") - F.col("chars")).alias("above"),
        F.bool_or(F.col("ends") == F.col("n_convs")).alias("leaf"), F.min_by(F.struct("p1", "p2"), "depth").alias("key")), "runs")
    sums = materialize(subtree_sums(materialize(_leaf_paths(prefixes, runs, heavy), "paths"), shard_paths), "sums")
    known = runs.join(sums.where("top > 0").select(F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), "parent", "leaves", "saved", "children"), ["conv_id", "n_convs"])
    known = known.select("conv_id", "n_convs", "top", "bottom", "above", "parent", "leaves", "saved", "children")
    inner = _joined(nodes.select("conv_id", "n_convs", "depth", "chars", "cum", "ends", "end_first"), known, ["conv_id", "n_convs"], F.col("bottom") - F.col("top") >= heavy)
    passed = (F.col("n_convs") - 1) * (F.col("cum") - F.col("chars") - F.col("above"))
    inner = inner.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.coalesce("parent", F.lit(root_first))).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - passed).alias("saved_tokens"), "ends", "end_first")
    root = sums.where("top = 0").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children")).select(
        F.lit(root_first).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(total).cast("bigint").alias("n_convs"),
        F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.lit(turnless).cast("bigint").alias("ends"), F.lit(None).cast("bigint").alias("end_first"))
    several = nodes.where("ends > 1").select("depth", "p1", "p2", F.col("conv_id").alias("first"), "ends")
    ended = _joined(prefixes.where("is_end").select("conv_id", "depth", "p1", "p2"), several, ["depth", "p1", "p2"], F.col("ends") >= heavy)
    ended = ended.select("conv_id", "first", "depth").unionByName(
        convs.where("length = 0").select("conv_id", F.lit(root_first).alias("first"), F.lit(0).cast("bigint").alias("depth")))
    digests = _end_digests(ended).withColumnRenamed("first", "conv_id")
    out = inner.unionByName(root).join(digests, ["conv_id", "depth"], "left")
    only = F.when(F.col("ends") == 0, F.lit(EMPTY_SHA256)).when(F.col("ends") == 1, F.sha2(F.col("end_first").cast("string"), 256))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", only)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
