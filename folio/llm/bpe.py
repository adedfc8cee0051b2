"""Byte-pair encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token the byte-pair encoding ends in exactly one token.  An automaton
over the vocabulary reports all tokens that are suffixes of a prefix; the one that may follow
the last token of the remaining shorter prefix (``Codec.fits``: encoding their concatenation
gives back exactly this pair) is stored, and following these back-pointers from the end emits
the ids that merging by rank gives.

Texts are cut at the tokenizer's special strings, then at its pre-token pattern.  Encoded
chunks are cached per worker in a bounded table, so work grows with distinct chunks plus one
lookup per chunk.  Every row is read whole; a null text counts as empty (no tokens).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.words import KEPT, clean, hash_spans, release, slices

#: White space of the pre-token pattern, as a character class (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens never cross the border of these chunks.
CHUNK = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of a worker's chunk table and of its pair table; each is bounded in size.
CACHED_CHUNKS = 100_000
CACHED_PAIRS = 400_000
#: Slots (as a power of two), entries and ids of a worker's table of encoded pre-tokens.
TABLE_BITS, ENTRIES, POOL = 21, 1_000_000, 4_000_000
#: Characters that are encoded at once.
SLICE = 250_000
#: Bytes of a pre-token that is encoded in bulk.
LONG = 64
#: White space besides the plain space and the line feed.
RARE_SPACES = [chr(c) for c in [9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, ranked merges as id pairs, and special strings with their ids."""

    tokens: tuple[bytes, ...]
    merges: tuple[tuple[int, int], ...]
    special: tuple[tuple[str, int], ...]

    @classmethod
    def from_file(cls, path: str) -> "Vocabulary":
        """Read a byte-level BPE file (JSON) on the driver; executors get the parsed value."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        special = tuple((a["content"], a["id"]) for a in spec.get("added_tokens") or [])
        ids = model["vocab"]
        size = max([*ids.values(), *(i for _, i in special)]) + 1
        tokens: list[bytes] = [b""] * size
        for text, i in ids.items():
            tokens[i] = bytes(alphabet[c] for c in text)
        for text, i in special:
            tokens[i] = text.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return cls(tuple(tokens), tuple((ids[a], ids[b]) for a, b in pairs), special)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = vocabulary.tokens
        by_bytes = {t: i for i, t in enumerate(self.tokens) if t}
        reserved = {i for _, i in vocabulary.special}
        self.rank = {pair: rank for rank, pair in enumerate(vocabulary.merges)}
        self.halves = {by_bytes[self.tokens[a] + self.tokens[b]]: (a, b) for a, b in vocabulary.merges}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[str, tuple[int, ...]] = {}
        self.suffixes = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            if t and i not in reserved and (len(t) == 1 or self.arises(i)):
                self.suffixes.add_word(t.decode("latin-1"), (i, len(t)))
                self.whole[t.decode("latin-1")] = (i,)
        self.suffixes.make_automaton()
        self.special = dict(vocabulary.special)
        self.cut = re.compile("|".join(re.escape(s) for s in self.special)) if self.special else None
        self.chunk, self.pre = re.compile(CHUNK), regex.compile(PRE_TOKEN)
        self.chunks, self.spaced = _Chunks(self, ""), _Chunks(self, " ")

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The outermost parts of a token on one side (0 left, 1 right), bytes first, each with
        the rank of the merge that uses it up inside the token."""
        key = (token, side)
        if key not in self.spines:
            parts, node, rank = [(token, float("inf"))], token, 0
            while node in self.halves:
                rank = self.rank[self.halves[node]]
                node = self.halves[node][side]
                parts.append((node, rank))
            self.spines[key] = parts[::-1]
        return self.spines[key]

    def first_merge(self, left: int, right: int) -> tuple[int, int] | None:
        """The merge that would join two neighbouring tokens' byte strings across their border,
        or None: the parts at the border change in rank order until a merge of both comes first
        (among equal ranks the left one)."""
        a, b, i, j = self.spine(left, 1), self.spine(right, 0), 0, 0
        while True:
            (x, until_x), (y, until_y) = a[i], b[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < until_x and rank <= until_y:
                return x, y
            if i + 1 == len(a) and j + 1 == len(b):
                return None
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def arises(self, token: int) -> bool:
        """Whether encoding a token's own bytes gives this one token."""
        left, right = self.halves.get(token, (None, None))
        return left is not None and self.first_merge(left, right) == (left, right)

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may directly follow ``left`` in an encoding."""
        return self.first_merge(left, right) is None

    def encode_pre_token(self, data: str) -> tuple[int, ...]:
        """Ids of one pre-token, given as bytes in Latin-1."""
        known = self.whole.get(data)
        if known is not None:
            return known
        last, pairs = [-1] * len(data), self.pairs
        if len(pairs) > CACHED_PAIRS:
            pairs.clear()
        for end, (token, size) in self.suffixes.iter(data):
            if last[end] < 0:
                before = end - size
                if before < 0:
                    last[end] = token
                    continue
                left = last[before]
                key = left << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.fits(left, token)
                if fits:
                    last[end] = token
        out, at, tokens = [], len(data) - 1, self.tokens
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= len(tokens[token])
        return tuple(out[::-1])

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special strings.

        Where every space stands alone between other characters, pieces between spaces are the
        chunks; other texts are cut by the chunk pattern.
        """
        if not text:
            return []
        if text[-1] == " " or "  " in text or "\n \n" in text or any(s in text for s in RARE_SPACES):
            chunks = self.chunks
            return list(chain.from_iterable([chunks[c] for c in self.chunk.findall(text)]))
        first, *rest = text.split(" ")
        return list(chain(self.chunks[first], chain.from_iterable(map(self.spaced.__getitem__, rest))))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.encode_plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.encode_plain(text[at:])

    def decode(self, ids) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


class _Chunks(dict):
    """Chunk (after a fixed lead) -> ids, filled on first use.

    Two generations: when the young one is full it becomes the old one, whose entries are taken
    over when asked for again, so frequent chunks stay and the size is bounded.
    """

    def __init__(self, codec: Codec, lead: str) -> None:
        super().__init__()
        self.codec, self.lead, self.old = codec, lead, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.old.pop(chunk, None)
        if ids is None:
            ids = self.compute(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHED_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def compute(self, chunk: str) -> tuple[int, ...]:
        encode = self.codec.encode_pre_token
        if chunk.isalpha():
            return encode((self.lead + chunk).encode().decode("latin-1"))
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return self[chunk[:-1]] + encode(chunk[-1])
        pieces = self.codec.pre.findall(self.lead + chunk)
        return tuple(chain.from_iterable(encode(p.encode("utf-8", "surrogatepass").decode("latin-1")) for p in pieces))


class BatchEncoder:
    """Encodes batches of texts with array operations.

    Pre-tokens are found from the character classes of the whole batch and hashed; a bounded
    table maps hashes to encoded pre-tokens.  Those it does not hold are encoded together: at
    each position all of them step through the automaton and test their candidates at once.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.kinds = _character_kinds()
        self.automaton = Automaton(codec)
        self.size = np.array([len(t) for t in codec.tokens], np.int64)
        self.pair_keys = np.full(1 << 21, -1, np.int64)
        self.pair_fits = np.zeros(1 << 21, bool)
        self.forget()

    def forget(self) -> None:
        """Empties the table of encoded pre-tokens."""
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.entry = np.zeros(1 << TABLE_BITS, np.int32)
        self.pool = np.zeros(POOL, np.int32)
        self.offset, self.length = np.zeros(ENTRIES, np.int32), np.zeros(ENTRIES, np.int32)
        self.used = self.entries = 0

    def pre_tokens(self, texts: list[str]):
        """``(buffer, starts, ends, owner)``: byte spans of all pre-tokens of the batch."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0] + [len(t) for t in texts])
        kind = self.kinds[code]
        new_text = np.zeros(len(code) + 1, bool)
        new_text[first] = True
        run = np.ones(len(code) + 1, bool)
        run[1:-1] = kind[1:] != kind[:-1]
        run |= new_text
        token = run.copy()
        after_space = np.flatnonzero(run[1:-1] & ~new_text[1:-1] & (kind[:-1] == 0)) + 1
        token[after_space - 1] = True
        token[after_space[code[after_space - 1] == 32]] = False
        quote = np.flatnonzero((code == 39) & token[:-1] & run[1:] & ~new_text[1:])
        if len(quote):
            last = len(code) - 1
            a, b = code[np.minimum(quote + 1, last)], code[np.minimum(quote + 2, last)]
            whole = (quote + 2 <= last) & ~new_text[np.minimum(quote + 2, last)]
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = whole & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
            at, end = quote[two | three], quote[two | three] + np.where(two[two | three], 2, 3)
            token[at + 1] = False
            goes_on = (end <= last) & ~new_text[np.minimum(end, last + 1)] & (kind[np.minimum(end, last)] == 1)
            token[end[goes_on]] = True
        begin = np.flatnonzero(token[:-1])
        width = np.ones(len(code), np.int8)
        for limit in (0x80, 0x800, 0x10000):
            width += code >= limit
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        starts = place[begin]
        ends = np.append(starts[1:], place[-1])
        buf = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        return buf, starts, ends, np.searchsorted(first[1:], begin, side="right")

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Codec.fits`` for arrays of tokens, each distinct pair being tested once."""
        key = left.astype(np.int64) << 20 | right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        unknown = np.flatnonzero(self.pair_keys[slot] != key)
        out = self.pair_fits[slot]
        if len(unknown):
            pairs = self.codec.pairs
            distinct, inverse = np.unique(key[unknown], return_inverse=True)
            if len(pairs) > CACHED_PAIRS:
                pairs.clear()
            fits = np.zeros(len(distinct), bool)
            for n, k in enumerate(distinct.tolist()):
                known = pairs.get(k)
                if known is None:
                    known = pairs[k] = self.codec.fits(k >> 20, k & 0xFFFFF)
                fits[n] = known
            out[unknown] = fits[inverse]
            self.pair_keys[slot[unknown]] = key[unknown]
            self.pair_fits[slot[unknown]] = fits[inverse]
            # of several pairs of one slot the last stays: its own verdict is written again
            kept = self.pair_keys[slot[unknown]] == key[unknown]
            self.pair_fits[slot[unknown][kept]] = fits[inverse][kept]
        return out

    def encode_spans(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of pre-tokens of at most ``LONG`` bytes."""
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        rows = len(starts)
        last = np.zeros((rows, int(size[0])), np.int32)
        state = np.zeros(rows, np.int32)
        for p in range(int(size[0])):
            active = int(np.searchsorted(-size, -p, side="left"))  # those longer than p
            state[:active] = self.automaton.step(state[:active], buf[starts[:active] + p])
            who = np.arange(active)
            node = self.automaton.found[state[:active]]
            while len(who):
                token = self.automaton.token_at[node]
                before = p - self.size[token]
                ok = before < 0
                inner = np.flatnonzero(~ok)
                if len(inner):
                    ok[inner] = self.fit(last[who[inner], before[inner]], token[inner])
                last[who[ok], p] = token[ok]
                who, node = who[~ok], self.automaton.shorter[node[~ok]]
        at, n = size - 1, 0
        back = np.zeros_like(last)
        count = np.zeros(rows, np.int64)
        live = np.arange(rows)
        while len(live):
            token = last[live, at[live]]
            back[live, n] = token
            count[live] += 1
            at[live] -= self.size[token]
            live = live[at[live] >= 0]
            n += 1
        where = np.repeat(count, count) - 1 - (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
        ids = back[np.repeat(np.arange(rows), count), where]
        counts = np.zeros(rows, np.int64)
        counts[order] = count
        first = np.zeros(rows, np.int64)
        first[order] = np.cumsum(count) - count
        take = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
        return ids[take], counts

    def learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encodes the given distinct pre-tokens: ``(ids, offsets, counts)``."""
        size = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts = []
        short = size <= LONG
        if short.any():
            ids, counts[short] = self.encode_spans(buf, starts[short], size[short])
            parts.append(ids)
        offsets = np.zeros(len(starts), np.int64)
        offsets[short] = np.cumsum(counts[short]) - counts[short]
        total = int(counts.sum())
        for k in np.flatnonzero(~short):
            ids = np.array(self.codec.encode_pre_token(buf[starts[k] : ends[k]].tobytes().decode("latin-1")), np.int32)
            offsets[k], counts[k] = total, len(ids)
            total += len(ids)
            parts.append(ids)
        return np.concatenate(parts), offsets, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: ids of all texts after one another, and how many each has.

        Texts with a special string are encoded one by one.
        """
        special = self.codec.special
        plain = ["" if any(s in t for s in special) else t for t in texts]
        buf, starts, ends, owner = self.pre_tokens(plain)
        h = hash_spans(buf, starts, ends) | np.uint64(1)  # 0 marks a free slot
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != h)
        extra = np.zeros(0, np.int32)
        if len(missing):
            distinct, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            extra, offsets, counts = self.learn(buf, starts[at], ends[at], distinct)
        entry = self.entry[slot]
        offset, length = self.offset[entry].astype(np.int64), self.length[entry]
        end = self.used + len(extra)
        if end <= POOL:  # where ``keep`` puts them
            self.pool[self.used : end] = extra
            source = self.pool[:end]
        else:
            source = np.concatenate([self.pool[: self.used], extra])
        if len(missing):
            offset[missing] = offsets[inverse] + self.used
            length[missing] = counts[inverse]
        ids = source[np.repeat(offset - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        per_text = np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64)
        if len(missing):
            self.keep(distinct, extra, offsets, counts)
        if any(p != t for p, t in zip(plain, texts)):
            parts = np.split(ids, np.cumsum(per_text)[:-1])
            for k, t in enumerate(texts):
                if plain[k] != t:
                    parts[k] = np.array(self.codec.encode(t), np.int32)
                    per_text[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, per_text

    def keep(self, h: np.ndarray, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> None:
        """Adds encoded pre-tokens to the table, which starts anew when its pool is full."""
        if self.used + len(ids) > POOL or self.entries + len(h) > ENTRIES:
            self.forget()
            if len(ids) > POOL or len(h) > ENTRIES:
                return
        self.pool[self.used : self.used + len(ids)] = ids
        new = np.arange(self.entries, self.entries + len(h))
        self.offset[new], self.length[new] = offsets + self.used, counts
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.keys[slot], self.entry[slot] = h, new
        stays = self.keys[slot] == h
        self.entry[slot[stays]] = new[stays]
        self.used += len(ids)
        self.entries += len(h)


def _character_kinds() -> np.ndarray:
    """Kind of every code point for the pre-token pattern: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = np.full(0x110000, 3, np.uint8)
    everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, members in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, f"[{SPACE}]+")):
        for run in regex.findall(members, everything):
            kinds[[ord(c) for c in run]] = kind
    return kinds


class Automaton:
    """The suffix matcher as arrays: ``found`` is the state of the longest token that ends in a
    state, ``shorter`` that of the next shorter one, ``token_at`` the token of such a state.

    Edges of the token tree are kept in a hash table; where a state has no edge for a byte, its
    longest proper suffix state is asked.
    """

    def __init__(self, codec: Codec) -> None:
        edges: dict[int, int] = {}
        parent, label, token_at = [0], [0], [-1]
        for text, ids in codec.whole.items():
            node = 0
            for b in text.encode("latin-1"):
                key = node << 8 | b
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(parent)
                    parent.append(node)
                    label.append(b)
                    token_at.append(-1)
                node = nxt
            token_at[node] = ids[0]
        bits = (4 * len(edges)).bit_length()
        self.shift = np.uint64(64 - bits)
        keys, targets = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        slot = self.slot(keys)
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.keys[slot], self.targets[slot] = keys, targets
        self.targets[slot[self.keys[slot] == keys]] = targets[self.keys[slot] == keys]
        lost = self.keys[slot] != keys  # of several edges in a slot one is there, the others are here
        order = np.argsort(keys[lost])
        self.more, self.more_targets = keys[lost][order], targets[lost][order]
        size = len(parent)
        parent, label = np.array(parent), np.array(label)
        self.fail = np.zeros(size, np.int32)
        depth = np.zeros(size, np.int64)
        for node in range(1, size):  # parents come first
            depth[node] = depth[parent[node]] + 1
        for d in range(2, int(depth.max(initial=0)) + 1):
            level = np.flatnonzero(depth == d)
            self.fail[level] = self.step(self.fail[parent[level]], label[level])
        self.token_at = np.array(token_at, np.int32)
        self.found, self.shorter = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for d in range(1, int(depth.max(initial=0)) + 1):
            level = np.flatnonzero(depth == d)
            self.shorter[level] = self.found[self.fail[level]]
            self.found[level] = np.where(self.token_at[level] >= 0, level, self.shorter[level])

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state of each state by its byte."""
        out = np.zeros(len(state), np.int32)
        who, state = np.arange(len(state)), state.astype(np.int64)
        while len(who):
            key = state << 8 | byte[who]
            slot = self.slot(key)
            hit, target = self.keys[slot] == key, self.targets[slot]
            missed = np.flatnonzero(~hit & (self.keys[slot] >= 0))
            if len(missed) and len(self.more):
                at = np.minimum(np.searchsorted(self.more, key[missed]), len(self.more) - 1)
                there = self.more[at] == key[missed]
                hit[missed], target[missed] = there, self.more_targets[at]
            out[who[hit]] = target[hit]
            on = ~hit & (state != 0)  # at the root a byte without an edge stays there
            who, state = who[on], self.fail[state[on]].astype(np.int64)
        return out


@lru_cache(maxsize=2)
def batch_encoder(vocabulary: Vocabulary) -> BatchEncoder:
    """The batch encoder of a vocabulary, built once per process."""
    return BatchEncoder(codec(vocabulary))


@lru_cache(maxsize=2)
def codec(vocabulary: Vocabulary) -> Codec:
    """The codec of a vocabulary, built once per process."""
    return Codec(vocabulary)


KEPT += [batch_encoder.cache_clear, codec.cache_clear]


def encoded(encoder: BatchEncoder, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, counts)`` of consecutive slices of texts."""
    for a, b in slices(texts, SLICE):
        yield encoder.encode(texts[a:b])


def shared(spark: SparkSession, vocabulary: Vocabulary):
    """The vocabulary (a few MB, fixed by its file) as a broadcast value."""
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` as ``ids_col`` (array<int>); null text: empty.

    A column already named ``ids_col`` is replaced; all others are kept.
    """
    held = shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = batch_encoder(held.value)
        for batch in texts:
            out = []
            for ids, counts in encoded(encoder, clean(batch)):
                out += np.split(ids, np.cumsum(counts)[:-1])
            yield pd.Series(out, dtype=object)

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of ``ids_col`` as ``text_col``; null ids give an empty text."""
    held = shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(held.value)
        for batch in ids:
            yield pd.Series([c.decode(i) if i is not None else "" for i in batch])

    return docs.withColumn(text_col, text(F.col(ids_col)))


ROUND_TRIP = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encode and decode every text in one pass; digests of the ids and of the decoded text.

    One row per row of ``docs(doc_id, text)``, repeated rows included; a null ``doc_id`` is
    carried, a null or empty text has no tokens and the digests of the empty string.
    """
    held = shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, encoder = codec(held.value), batch_encoder(held.value)
        digits = [str(i) for i in range(len(c.tokens))]
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for flat, counts in encoded(encoder, clean(batch["text"])):
                flat, end = flat.tolist(), 0
                for n in counts.tolist():
                    ids, end = flat[end : end + n], end + n
                    count.append(n)
                    of_ids.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                    of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": count, "ids_sha256": of_ids, "decoded_sha256": of_text})
        encoder.forget()  # the worker lives on and other operators run in it
        c.pairs.clear()
        release(drop=False)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, ROUND_TRIP)
