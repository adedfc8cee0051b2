"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is the order of the shingles' 64-bit hashes.  It is cut into fragments
(ranges), every document's shingle set is cut along, overlaps are counted inside each fragment,
and a pair's overlap is the sum over the fragments.  Nothing is approximate: two documents link
exactly when ``100 * |A & B| >= 75 * |A | B|`` (up to 64-bit hash equality of shingles and of
whole sets).

1. One pass over the texts gives each set's size and 64-bit signature (sets of one signature
   form one class, so copies are compared once) and sends the first ``SCREEN`` of the order to its fragments.  A class that links must
   share all but ``n - ceil(0.75 n)`` of its shingles there with some other class; the others
   are settled.
2. Fragments of the whole order are built for the remaining classes.  Within a fragment the
   frequency of a shingle is known, shingles of one class drop out, and the rest is kept as
   the segment of (class, fragment).
   Segments travel packed to the bucket of their class, which joins them to ``SHARES`` segments a
   class, however many fragments there are.
3. Prefix filter: of each set its ``n - ceil(0.75 n) + 1`` rarest shingles are its keys; two
   linked classes share a key.  Every class is first compared with the smallest class of each
   of its keys (its hub), a number of pairs linear in the keys; this joins most of a group of
   near copies.
4. Keys that still hold classes of different components put those components into one
   cluster.  A cluster's classes are cut into blocks of ``BLOCK`` classes and ``BLOCK_TOKENS``
   shingles at most; the overlaps of a block pair are counted in one matrix inside a task.  Only
   links found between different components leave the tasks, never counts or pairs.

A shingle that very many classes have (a licence line) is settled where it is read: it leaves a
slice of texts once in the first pass, and goes by class to fragments of its own in the second.

Which rows are held to be members of the remaining classes is told to the second pass by a
Bloom filter of bounded size; false members only cost work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import bloom
from folio.llm.components import components
from folio.llm.words import clean, mix, release, shingle_sets, slices
from folio.session import materialize

WIDTH = 5
#: Share of the global order that the screening pass looks at.
SCREEN = 0.35
#: Shingles that one fragment task should hold at most, on average.
SCREEN_TOKENS, FRAGMENT_TOKENS = 400_000, 1_000_000
#: Characters that are cut into shingles at once.
SLICE = 2_500_000
#: Least number of fragments of the whole order.
FRAGMENTS = 16
#: Shares of the order that the shingles of a class are kept in; two classes are compared share by share.
SHARES = 4
#: Classes, and shingles of all of them, in a block of a cluster.
BLOCK, BLOCK_TOKENS = 512, 1_000_000
#: The owner of a shingle that several classes of a slice have (no class has this signature).
SEVERAL = np.uint64(0)
#: A shingle is heavy with one in ``HEAVY_SHARE`` classes, and at least so many in a slice or in all;
#: so many heavy ones are told to the tasks at most (16 MB).
HEAVY_SHARE, HEAVY_HERE, HEAVY_LEAST, HEAVY_MOST = 100, 32, 1000, 1_000_000


def allowed(n):
    """Shingles of a set of ``n`` that a linked set may lack: ``n - ceil(0.75 n)``."""
    return n // 4


def _pack(a: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def _signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each set from its shingles (in order of the sets); 0 if empty."""
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(h), (np.cumsum(n) - n)[some]) + n[some].astype(np.uint64))
    return out


def _cuts(at: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of the sorted array ``at`` and the borders of their runs."""
    ids, first = np.unique(at, return_index=True)
    return ids, np.append(first, len(at))


# --- pass 1: sizes, signatures and the screen ---------------------------------------------

SCREEN_ROWS = "part int, owners binary, tokens binary, extra binary"
STATS = "kind int, doc_id bigint, n bigint, r bigint, cls bigint, shared bigint"


def _screen_rows(parts: int):
    """Per slice of texts: one packed row of (class, shingle) for every fragment of the screen
    and one row with the documents' sizes and signatures, how many of their shingles other classes
    of the slice have, and the slice's heavy shingles with their numbers of classes.

    A shingle of several classes of a slice leaves it once, as one of ``SEVERAL``, so a line that a
    third of all documents hold is one entry per slice in its fragment, not one per document.  A
    class in several slices may have a shingle counted more than once, which only keeps it open."""
    limit = np.uint64(int(SCREEN * 2**64))
    step = int(limit) // parts + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            texts = clean(batch["text"])
            for a, b in slices(texts, SLICE):
                h, own, n = shingle_sets(texts[a:b], WIDTH)
                cls = _signatures(h, n)
                low = h < limit
                r = np.bincount(own[low], minlength=b - a)
                null = pd.isna(ids[a:b])
                known = np.where(null, 0, ids[a:b]).astype(np.int64)
                _, once = np.unique(cls, return_index=True)
                one = np.zeros(b - a, bool)
                one[once] = True
                keep = one[own]
                order = np.argsort(h[keep], kind="stable")
                h, own = h[keep][order], own[keep][order]
                token, first, count = np.unique(h, return_index=True, return_counts=True)
                # shingles that several classes of this slice have are settled here: one row each
                several = np.repeat(count, count) > 1
                low = h < limit
                here = np.bincount(own[low & several], minlength=b - a)
                many = count >= max(HEAVY_HERE, len(once) // HEAVY_SHARE)
                info = np.stack([known, null.astype(np.int64), n, r, cls.view(np.int64), here])
                heavy = np.stack([token[many].view(np.int64), count[many]])
                rows = [(-1 - int(cls[0] % np.uint64(parts)), b"", _pack(heavy, np.int64), _pack(info, np.int64))]
                shared = first[(count > 1) & (token < limit)]
                own[shared] = b - a  # SEVERAL in the place of the classes
                low &= ~several
                low[shared] = True
                h, own, cls = h[low], own[low], np.append(cls, SEVERAL)
                part = (h // np.uint64(step)).astype(np.int64)
                order = np.lexsort((own, part))  # by class, so that a row has a count for each one and no index
                h, own, part = h[order], own[order], part[order]
                for p, x, y in zip(*(lambda v, c: (v, c[:-1], c[1:]))(*_cuts(part, parts))):
                    who, size = np.unique(own[x:y], return_counts=True)
                    rows.append((int(p), _pack(cls[who], np.uint64), _pack(h[x:y] & np.uint64(0xFFFFFFFF), np.uint32), _pack(size, np.uint32)))
                yield pd.DataFrame(rows, columns=["part", "owners", "tokens", "extra"])
        release()

    return run


def _screen_counts(group: pa.Table) -> pa.Table:
    """One fragment: for each class the number of its shingles that another class has, too."""
    part = group["part"][0].as_py()
    columns = {name: np.zeros(0, np.int64) for name in ("doc_id", "n", "r", "cls", "shared")}
    null = None
    kinds = None
    if part < 0:
        info = np.concatenate([np.frombuffer(x, np.int64).reshape(6, -1) for x in group["extra"].to_pylist()], axis=1)
        heavy = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in group["tokens"].to_pylist()], axis=1)
        here = info[:, info[5] > 0]
        sizes = [info.shape[1], here.shape[1], heavy.shape[1]]
        zeros = np.zeros(sizes[1] + sizes[2], np.int64)
        columns = {name: np.append(info[k], zeros) for name, k in (("doc_id", 0), ("n", 2), ("r", 3))}
        columns["cls"] = np.concatenate([info[4], here[4], heavy[0]])
        columns["shared"] = np.concatenate([np.zeros(sizes[0], np.int64), here[5], heavy[1]])
        null = np.append(info[1] != 0, zeros != 0)
        kinds = np.repeat(np.arange(3), sizes)
    else:
        owners = [np.frombuffer(x, np.uint64) for x in group["owners"].to_pylist()]
        tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in group["tokens"].to_pylist()]).astype(np.uint64)
        size = np.concatenate([np.frombuffer(x, np.uint32) for x in group["extra"].to_pylist()])
        who, dense = np.unique(np.concatenate(owners), return_inverse=True)
        pairs = np.unique(tokens << np.uint64(32) | np.repeat(dense, size).astype(np.uint64))
        token = pairs >> np.uint64(32)
        many = np.zeros(len(pairs), bool)
        same = token[1:] == token[:-1]
        many[1:] |= same
        many[:-1] |= same
        of, count = np.unique(pairs[many] & np.uint64(0xFFFFFFFF), return_counts=True)
        classes = who[of.astype(np.int64)]
        of, count = of[classes != SEVERAL], count[classes != SEVERAL]
        zero = np.zeros(len(of), np.int64)
        columns = {"doc_id": zero, "n": zero, "r": zero, "cls": who[of.astype(np.int64)].view(np.int64), "shared": count.astype(np.int64)}
    size = len(columns["cls"])
    kind = pa.array(np.full(size, 1, np.int32) if kinds is None else kinds.astype(np.int32))
    arrays = [pa.array(columns["doc_id"], mask=null)] + [pa.array(columns[c]) for c in ("n", "r", "cls", "shared")]
    return pa.table([kind, *arrays], names=["kind", "doc_id", "n", "r", "cls", "shared"])


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def set_stats(docs: DataFrame, name: str = "jaccard") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, cls, rows, open)`` per document: set size, class (signature), number of
    equal rows, and whether its class may still link with another class; and ``(token, classes)``
    of the shingles that were heavy in some slice."""
    parts = max(16, int(_text_bytes(docs) / 6 * SCREEN / SCREEN_TOKENS))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(_screen_rows(parts), SCREEN_ROWS)
    stats = rows.groupBy("part").applyInArrow(_screen_counts, STATS)
    keys = ["kind", "doc_id", "n", "r", "cls"]
    stats = materialize(stats.groupBy(*keys).agg(F.sum("shared").alias("shared"), F.count("*").alias("rows")), f"{name}-stats")
    info = stats.where("kind = 0").drop("kind", "shared")
    shared = stats.where("kind = 1").select("cls", "shared")
    found = info.join(shared, "cls", "left").select(
        "doc_id", "n", "cls", "rows",
        (F.coalesce("shared", F.lit(0)) >= F.greatest(F.col("r") - F.floor(F.col("n") / 4), F.lit(0))).alias("open"),
    )
    return found, stats.where("kind = 2").select(F.col("cls").alias("token"), F.col("shared").alias("classes"))


def heavy_shingles(found: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and numbers of the shingles that very many classes have; at most
    ``HEAVY_MOST``, the heaviest ones (the others are counted like any shingle)."""
    heavy = found.where(F.col("classes") >= max(HEAVY_LEAST, classes // HEAVY_SHARE))
    rows = heavy.orderBy(F.col("classes").desc(), "token").limit(HEAVY_MOST).collect()
    token = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r["classes"] for r in rows], np.int64)[order]


# --- pass 2: segments of the remaining classes --------------------------------------------


SEGMENT_ROWS = "part int, classes binary, sizes binary, counts binary, tokens binary"
SHARED_ROWS = "bucket int, classes binary, sizes binary, counts binary, tokens binary, freqs binary"
SEGMENTS = "cls bigint, n bigint, part int, tokens array<bigint>, keys array<bigint>"
#: Greatest frequency that is told apart in the order of the keys.
FREQ_MOST = 65_535


def _segment_rows(bitmap, bits: int, parts: int, heavy, salts: int):
    """Per slice one packed row of (class, shingle) for every fragment.  Heavy shingles go to
    fragments of their own, dealt by class, where each class is found once."""
    step = 2**64 // parts + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            member = bloom.members(bitmap.value, bits, ids)
            ids, texts = ids[member], clean(batch["text"][member])
            for a, b in slices(texts, SLICE):
                h, own, n = shingle_sets(texts[a:b], WIDTH)
                cls = _signatures(h, n)
                part = (h // np.uint64(step)).astype(np.int64)
                tokens = heavy.value[0]
                if len(tokens):
                    hot = tokens[np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)] == h
                    part[hot] = parts + (cls[own[hot]] % np.uint64(salts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                h, own, part = h[order], own[order], part[order]
                rows = []
                for p, x, y in zip(*(lambda v, c: (v, c[:-1], c[1:]))(*_cuts(part, parts))):
                    who, size = np.unique(own[x:y], return_counts=True)  # ascending in a part, too
                    rows.append((int(p), _pack(cls[who], np.uint64), _pack(n[who], np.uint32), _pack(size, np.uint32), _pack(h[x:y], np.uint64)))
                yield pd.DataFrame(rows, columns=["part", "classes", "sizes", "counts", "tokens"])
        release()

    return run


def _joined(group: pa.Table, name: str, kind) -> np.ndarray:
    """The packed values of a column, one row's after the other's."""
    return np.concatenate([np.frombuffer(x, kind) for x in group[name].to_pylist()])


def _shared(group: pa.Table, parts: int, heavy: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """One fragment: for each class its shingles that another class has, with frequencies, packed
    by bucket of the class.  The heavy ones are known to be shared, so the classes of one fragment
    of them are enough."""
    part = min(group["part"][0].as_py(), parts)
    classes, sizes = _joined(group, "classes", np.uint64), _joined(group, "sizes", np.uint32)
    tokens = _joined(group, "tokens", np.uint64)
    owner = np.repeat(np.arange(len(classes)), _joined(group, "counts", np.uint32))
    once = np.zeros(len(classes), bool)
    once[np.unique(classes, return_index=True)[1]] = True
    tokens, owner = tokens[once[owner]], owner[once[owner]]
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    if part == parts:
        freq = heavy[1][np.searchsorted(heavy[0], tokens)]
    else:
        _, count = np.unique(tokens, return_counts=True)
        freq = np.repeat(count, count)
    many = freq > 1
    tokens, owner, freq = tokens[many], owner[many], np.minimum(freq[many], FREQ_MOST)
    bucket = (classes % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((owner, bucket[owner]))
    tokens, owner, freq = tokens[order], owner[order], freq[order]
    rows = []
    for b, x, y in zip(*(lambda v, c: (v, c[:-1], c[1:]))(*_cuts(bucket[owner], parts))):
        who, size = np.unique(owner[x:y], return_counts=True)
        rows.append((int(b), _pack(classes[who], np.uint64), _pack(sizes[who], np.uint32), _pack(size, np.uint32), _pack(tokens[x:y], np.uint64), _pack(freq[x:y], np.uint16)))
    kinds = [pa.int32()] + [pa.binary()] * 5
    names = ["bucket", "classes", "sizes", "counts", "tokens", "freqs"]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _segments(group: pa.Table) -> pa.Table:
    """The classes of one bucket: their shared shingles in ``SHARES`` segments at most, and, with the
    first one, their keys: the rarest shingles that a linked class cannot lack all of.  The ones
    that no other class has come first in the order: n - (number of shared ones) of them."""
    classes, counts = _joined(group, "classes", np.uint64), _joined(group, "counts", np.uint32)
    tokens, freq = _joined(group, "tokens", np.uint64), _joined(group, "freqs", np.uint16)
    who, dense = np.unique(classes, return_inverse=True)
    n = np.zeros(len(who), np.int64)
    n[dense] = _joined(group, "sizes", np.uint32)
    owner = np.repeat(dense, counts)
    order = np.lexsort((tokens, freq, owner))
    size = np.bincount(owner, minlength=len(who))
    wanted = np.maximum(size - n + allowed(n) + 1, 0)
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    keys = tokens[order][place < np.repeat(wanted, size)]
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    share = (tokens // np.uint64(2**64 // SHARES + 1)).astype(np.int64)
    cell, cut = _cuts(owner * SHARES + share, 0)
    of = cell // SHARES
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    held = np.append(0, np.cumsum(np.where(first, np.minimum(wanted, size)[of], 0)))
    return pa.table(
        [
            pa.array(who[of].view(np.int64)), pa.array(n[of]), pa.array((cell % SHARES).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(tokens.view(np.int64))),
            pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), pa.array(keys.view(np.int64))),
        ],
        names=["cls", "n", "part", "tokens", "keys"],
    )


# --- block pairs ---------------------------------------------------------------------------

LINKS = "a bigint, b bigint"


def _side(packed: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a packed block and the slot each belongs to, without Python objects."""
    members = packed.values
    tokens = members.field("tokens")
    slots = np.repeat(members.field("slot").to_numpy(), tokens.value_lengths().to_numpy())
    return tokens.flatten().to_numpy(), slots


def _overlaps(left: pa.ListScalar, right: pa.ListScalar) -> np.ndarray:
    """The numbers of common shingles of the slots of two blocks, as one flat matrix."""
    (token, own), (other, slot) = _side(left), _side(right)
    order = np.argsort(other, kind="stable")
    other, slot = other[order], slot[order]
    lo, hi = np.searchsorted(other, token, "left"), np.searchsorted(other, token, "right")
    size = hi - lo
    total = np.zeros(BLOCK * BLOCK * 4, np.int64)
    cut = np.append(np.flatnonzero(np.diff(np.cumsum(size) // 1_000_000, prepend=-1)), len(size))
    for x, y in zip(cut[:-1], cut[1:]):  # bounded memory for frequent shingles
        s = size[x:y]
        at = np.repeat(lo[x:y] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        total += np.bincount(np.repeat(own[x:y], s) * (2 * BLOCK) + slot[at], minlength=len(total))
    return total


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the two blocks of a cell; links between different components, one for each class
    and component at most."""
    for batch in batches:
        for k in range(batch.num_rows):
            cell = batch.column("sides")[k].values
            left, right = np.argsort(cell.field("side").to_numpy(), kind="stable")
            total = _overlaps(cell.field("held")[int(left)], cell.field("held")[int(right)])
            at = np.flatnonzero(total)
            i, j, common = at // (2 * BLOCK), at % (2 * BLOCK), total[at]
            sides = []
            for side in (left, right):
                members = cell.field("members")[int(side)].values
                slot = np.zeros((3, 2 * BLOCK), np.int64)
                slot[:, members.field("slot").to_numpy()] = [members.field(f).to_numpy() for f in ("cls", "n", "comp")]
                sides.append(slot)
            (p, n, c), (q, m, d) = sides[0][:, i], sides[1][:, j]
            hit = (c != d) & (100 * common >= 75 * (n + m - common))
            once = pd.DataFrame({"a": p[hit], "b": q[hit], "c": c[hit], "d": d[hit]}).drop_duplicates(["a", "d"]).drop_duplicates(["c", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(once["a"].to_numpy()), pa.array(once["b"].to_numpy())], names=["a", "b"])


def _of(segments: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """The segments of ``classes``, and a few others that a Bloom filter cannot tell from them, so
    that a join with ``classes`` shuffles little more than it needs."""
    bitmap, bits = bloom.build(classes, count)
    return segments.where(bloom.maybe_in(segments.sparkSession.sparkContext.broadcast(bitmap), bits)("cls"))


def _hub_links(segments: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Links of classes with the smallest class of each of their keys."""
    hubs = keys.groupBy("token").agg(F.min(F.struct("cls", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1")
    pairs = (
        keys.join(hubs, "token")
        .where("cls <> hub.cls and 100 * least(n, hub.n) >= 75 * greatest(n, hub.n)")
        .select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct()
    )
    pairs = materialize(pairs, f"{name}-pairs")
    count = pairs.count()
    left = _of(segments, pairs.select("a"), count).select(F.col("cls").alias("a"), F.col("n").alias("na"), "part", F.col("tokens").alias("ta"))
    right = _of(segments, pairs.select("b"), count).select(F.col("cls").alias("b"), F.col("n").alias("nb"), "part", F.col("tokens").alias("tb"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("common"))
    return (
        partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        .where("100 * common >= 75 * (na + nb - common)").select("a", "b")
    )


def _cluster_links(segments: DataFrame, keys: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    """All links between different components, found block by block."""
    held = keys.join(comps.select(F.col("node").alias("cls"), F.col("label")), "cls", "left").select(
        "token", "cls", "n", F.coalesce("label", "cls").alias("comp")
    )
    mixed = held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token", "low")
    members = materialize(held.join(mixed, "token").select("cls", "n", "comp", "low").distinct(), f"{name}-mixed")
    cluster = components(members.select(F.col("low").alias("a"), F.col("comp").alias("b")).distinct(), f"{name}-clusters")
    docs = members.select("cls", "n", "comp").distinct().join(cluster.select(F.col("node").alias("comp"), F.col("label").alias("cluster")), "comp")
    # small clusters share bins; in large ones, large components have blocks of their own
    def blocks_for(size: str, tokens: str):
        return F.ceil(F.greatest(F.col(size) * 2 / BLOCK, F.col(tokens) / BLOCK_TOKENS))

    few = (F.col("size") <= BLOCK) & (F.col("tokens") <= BLOCK_TOKENS)
    sizes = docs.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    small = sizes.where(few).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    bins = max(1, small.select(blocks_for("size", "tokens")).first()[0])
    large = docs.groupBy("cluster", "comp").agg(F.count("*").alias("in_comp"), F.sum("n").alias("comp_tokens"))
    placed = docs.join(sizes, "cluster").join(large, ["cluster", "comp"]).withColumn(
        "space", F.when(few, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(-1 - F.col("cluster"))
    ).withColumn(
        "pure", ~few & (F.col("in_comp") >= BLOCK)
    ).withColumn(
        "block", F.when(few, F.lit("s"))
        .when(F.col("pure"), F.concat_ws("/", "comp", F.pmod(F.xxhash64("cls"), blocks_for("in_comp", "comp_tokens"))))
        .otherwise(F.concat(F.lit("m"), F.pmod(F.xxhash64("cls"), blocks_for("size", "tokens"))))
    )
    # hashing fills a block of BLOCK / 2 expected members beyond 2 * BLOCK practically never; if so it is cut again
    blocks = (
        placed.groupBy("space", "block")
        .agg(F.array_sort(F.collect_list(F.struct("cls", "n", "comp"))).alias("all"), F.max(F.when(F.col("pure"), F.col("comp"))).alias("only"))
        .select("space", "block", "only", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / (2 * BLOCK)).cast("int")), lambda k: F.slice(F.col("all"), k * (2 * BLOCK) + 1, F.lit(2 * BLOCK)))).alias("k", "members"))
        .select("space", "only", F.concat_ws("#", "block", "k").alias("block"), F.transform("members", lambda m, i: F.struct(m.cls.alias("cls"), m.n.alias("n"), m.comp.alias("comp"), i.alias("slot"))).alias("members"))
    )
    blocks = materialize(blocks, f"{name}-blocks")
    flat = blocks.select("space", "block", F.explode("members").alias("m")).select("space", "block", "m.cls", "m.slot")
    held = _of(segments, flat.select("cls"), flat.count()).join(flat, "cls").groupBy("space", "block").agg(F.collect_list(F.struct("slot", "tokens")).alias("held"))
    packed = materialize(blocks.select("space", "block", "members").join(held, ["space", "block"]), f"{name}-packed")
    a, b = (blocks.select("space", "block", "only").alias(side) for side in "ab")
    cells = a.join(b, F.expr("a.space = b.space and a.block <= b.block")).where("not (a.only <=> b.only) or a.only is null").select(
        F.concat_ws("|", "a.space", "a.block", "b.block").alias("cell"), "a.space", F.posexplode(F.array("a.block", "b.block")).alias("side", "block"),
    )
    sides = cells.join(packed, ["space", "block"]).groupBy("cell").agg(F.collect_list(F.struct("side", "members", "held")).alias("sides"))
    return sides.mapInArrow(_link_blocks, LINKS)


def link(docs: DataFrame, name: str = "jaccard") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable by links (the row's own id included).
    Null, empty and blank texts have an empty set, size 0, and link with nothing.  A row without
    ``doc_id`` keeps its size and has a null component.  Repeated rows give repeated result
    rows; of rows with one id and different texts each has the
    component of its own text.  Further
    columns of ``docs`` are ignored.  An empty table gives an empty result.
    """
    rows = linked(docs, name)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("k")).drop("k")


def linked(docs: DataFrame, name: str = "jaccard") -> DataFrame:
    """``(doc_id, cls, n, rows, label, component_id)`` per id and class (shingle set): its size, how
    many rows it stands for, the name of its component (null where it has no link), and the
    smallest id of that."""
    spark = docs.sparkSession
    stats, heavy = set_stats(docs, name)
    stats = materialize(stats, f"{name}-sets")
    reps = stats.where("open and n > 0 and doc_id is not null").groupBy("cls", "n").agg(F.min("doc_id").alias("doc_id"))
    reps = materialize(reps, f"{name}-open")
    count, shingles = reps.agg(F.count("*"), F.sum("n")).first()
    bitmap, bits = bloom.build(reps.select("doc_id"), count)
    parts = max(FRAGMENTS, int((shingles or 0) / FRAGMENT_TOKENS))
    hot = heavy_shingles(heavy, count)
    salts = max(1, -(-int(hot[1].sum()) // FRAGMENT_TOKENS))
    held = spark.sparkContext.broadcast(hot)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text").mapInPandas(
        _segment_rows(spark.sparkContext.broadcast(bitmap), bits, parts, held, salts), SEGMENT_ROWS
    )
    shared = rows.groupBy("part").applyInArrow(lambda group: _shared(group, parts, held.value), SHARED_ROWS)
    segments = materialize(shared.groupBy("bucket").applyInArrow(lambda group: _segments(group), SEGMENTS), f"{name}-segments")
    keys = segments.select("cls", "n", F.explode("keys").alias("token"))
    segments = segments.drop("keys")
    hub = materialize(_hub_links(segments, keys, name), f"{name}-hubs")
    comps = components(hub, f"{name}-hub")
    cross = materialize(_cluster_links(segments, keys, comps, name), f"{name}-cross")
    found = components(hub.union(cross), f"{name}-all").select(F.col("node").alias("cls"), "label")
    rows = stats.join(found, "cls", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "cls")))
    # written, so that the join below is one of plain exchanges, whose hot labels can be split
    lowest = materialize(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("low")), f"{name}-lowest")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return rows.join(lowest, "label", "left").select("doc_id", "cls", "n", "rows", "label", component.alias("component_id"))


def _classes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__cls``, the signature of each row's shingle set, and ``__n``, its size."""

    @F.pandas_udf("struct<cls: bigint, n: bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = clean(texts)
        cls, size = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        for a, b in slices(found, SLICE):
            h, _, n = shingle_sets(found[a:b], WIDTH)
            cls[a:b], size[a:b] = _signatures(h, n).view(np.int64), n
        return pd.DataFrame({"cls": cls, "n": size})

    return docs.withColumn("__of", of("text")).withColumns({"__cls": F.col("__of.cls"), "__n": F.col("__of.n")}).drop("__of")


def keep_one(docs: DataFrame, name: str = "jaccard") -> DataFrame:
    """``docs`` without the near copies: of each group of linked texts one row, with the smallest
    ``doc_id`` of the group.

    Rows without an id, and rows without words, stay.  Each row is judged by its own text: where a
    ``doc_id`` stands for several texts, only those go that are linked with a kept one.  Of several
    linked rows with the smallest id one stays, the one with the smallest text hash.  Rows that a
    Bloom filter of the removed and the repeated ids does not hold stay where they are read; only
    the others are joined with those ids, so most texts are not shuffled.
    """
    spark = docs.sparkSession
    found = materialize(linked(docs, name).where("doc_id is not null"), f"{name}-linked")
    ids = found.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.sum("rows").alias("rows"))
    marked = materialize(ids.where("rows > 1 or low <> doc_id").select("doc_id", (F.col("rows") > 1).alias("repeated")), f"{name}-marked")
    bitmap, bits = bloom.build(marked.select("doc_id"), marked.count())
    known = docs.where("doc_id is not null")
    maybe = bloom.maybe_in(spark.sparkContext.broadcast(bitmap), bits)(F.col("doc_id").cast("bigint"))
    out = known.where(~maybe).unionByName(known.where(maybe).join(marked.select("doc_id"), "doc_id", "left_anti").select(*docs.columns))
    repeated = marked.where("repeated").select("doc_id")
    if repeated.limit(1).count():
        rows = _classes(known.where(maybe).join(repeated, "doc_id", "left_semi").select(*docs.columns))
        label = found.where("n > 0").select(F.col("doc_id").alias("__id"), F.col("cls").alias("__of"), "component_id", F.coalesce("label", "cls").alias("__label"))
        judged = rows.where("__n > 0").join(label, (F.col("doc_id") == F.col("__id")) & (F.col("__cls") == F.col("__of")))
        row = F.struct(*docs.columns)  # of a group the smallest row, without holding the group
        one = judged.where("component_id = doc_id").groupBy("__id", "__label").agg(F.min_by(row, F.struct(F.xxhash64("text"), row)).alias("row"))
        out = out.unionByName(rows.where("__n = 0").select(*docs.columns)).unionByName(one.select("row.*"))
    return out.unionByName(docs.where("doc_id is null"))
