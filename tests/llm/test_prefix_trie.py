import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folio.llm import prefix_trie
from folio.llm.prefix_trie import Parentheses, shard_sums

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Nodes by their literal turn sequences."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)

    def below(s):
        yield s
        for x in children[s]:
            yield from below(x)

    out = set()
    for s, m in members.items():
        tree = list(below(s))
        out.add((
            min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), sum(not children[x] for x in tree),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in tree if x), hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest(),
        ))
    return out


def conversations(seed: int):
    r = random.Random(seed)
    texts = ["", None, "a", "né", "long text " * 3]
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 230), 300]:
        n = r.choice([1, 1, 2, 3, 5, 9]) if c else 7
        turns = list(range(n))
        if r.random() < 0.2:
            turns[0] = None
        if r.random() < 0.2:
            turns.append(turns[0])  # two turns of one number
        more = [(c, t, r.choice(["user", "assistant", None]) if r.random() < 0.3 else "user", r.choice(texts)) for t in turns]
        rows += [*more[:n], *((c, t, "zz", text) for c, t, _, text in more[n:])]
    rows += [(17, k, "user", f"long {k // 2}") for k in range(10, 400)] + [(18, k, "user", f"long {k // 2}") for k in range(10, 390)]
    rows += [(2**60 + 100 * (c // 3) - 2**60 % 100 + c % 3, t, "user", f"{c} {t}" if t > 2 else "big") for c in range(9) for t in range(6)]
    rows += [(None, 1, "user", "x"), rows[0], rows[5]]
    r.shuffle(rows)
    return rows


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed, task_turns, shard_paths", [(1, 100, 3), (2, 37, 1), (3, 10_000, None)])
def test_equals_brute_force(spark, seed, task_turns, shard_paths):
    rows = conversations(seed)
    df = spark.createDataFrame([(*row, "more") for row in rows], SCHEMA + ", n_convs string").repartition(5)
    assert found(prefix_trie.trie(df, task_turns, shard_paths)) == brute(rows)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_heavy", lambda rows: 2)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 4)
    rows = [(c, t, "user", "same" if t < 2 else f"t{c % 3}") for c in range(120) for t in range(4)]
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), 60, 2)) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, 0, "user", "x") for c in range(101, 140)]  # no conversation 100: short ones lose their turns
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    rows = [(c, 0, "user", "x") for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6]
    got = found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 1


def test_parentheses_over_many_blocks():
    r = random.Random(4)
    bits, depth, match, stack = [], 0, {}, []
    for k in range(20_000):
        if stack and (r.random() < 0.499 or k > 15_000):
            match[stack.pop()] = len(bits)
            bits.append(0)
        else:
            stack.append(len(bits))
            bits.append(1)
    while stack:
        match[stack.pop()] = len(bits)
        bits.append(0)
    tree = Parentheses(np.array(bits, np.uint8))
    close = tree.findclose(tree.opens)
    assert dict(zip(tree.opens.tolist(), close.tolist())) == match
    leaves = tree.leaves(tree.opens, close)
    for k in range(0, len(close), 997):
        inside = bits[tree.opens[k] : close[k] + 1]
        assert leaves[k] == sum(a == 1 and b == 0 for a, b in zip(inside, inside[1:]))


def test_shared_spine_counts_once():
    paths = [[(1, 1, 9, 80), (2, 1, 4, 30)], [(1, 1, 9, 80), (2, 5, 3, 20)], [(1, 1, 9, 80), (2, 5, 3, 20), (3, 6, 1, 0)]]
    whole = {row[:3]: row for row in shard_sums(paths, 0)}
    parts = [shard_sums(paths[:2], 0), shard_sums(paths[2:], 2)]
    for key, row in whole.items():
        same = [r for part in parts for r in part if r[:3] == key]
        assert [sum(r[k] for r in same) for k in (5, 6)] == [row[5], row[6]]
