import zlib

import duckdb
import public_tokenizers
import pytest

from folio.llm import bpe, packing, queries, rules, shards

ROWS = [
    (1, "a b c a b c a b c", 0), (2, None, 0), (3, "", 0), (4, " \n\t", 0), (None, "x" * 5000, 0), (6, "one\none\n\n \none # $", 0),
    (7, " ".join(f"w{k % 70}" for k in range(400)), 0), (8, " ".join(f"w{k}" for k in range(90)), 0), (8, " ".join(f"w{k}" for k in range(90)), 0),
    (9, "é ß 　 ü! " * 30, 0), (10, "the the the", 0),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, words int")


def key(rows):
    return sorted([tuple("" if v is None else str(v) for v in r) for r in rows])


def test_ledger_equals_sql(spark, docs, tmp_path):
    got = docs.sparkSession
    path = str(tmp_path / "documents.parquet")
    docs.coalesce(1).write.parquet(path)
    out = queries.op8_quality_rules(got, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.SQL["op8_quality_rules"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(out.columns)
    assert key(out.select(*names).collect()) == key(want.fetchall())


def test_repeat_words_by_hand(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in rules.measure(docs).collect()}
    assert got[(1, 9)]["n_repeat_words"] == 9
    assert got[(10, 3)]["n_repeat_words"] == 0
    assert got[(6, 5)]["n_dup_lines"] == 1 and got[(6, 5)]["n_symbols"] == 2
    assert got[(None, 1)]["word_chars"] == 5000


def test_policies_and_ablation(docs):
    book = rules.ledger(docs).cache()
    strict = {r["rule"]: r for r in rules.ablation(book, "v2").collect()}
    failed = [r["failed"] for r in book.collect()]
    for k, (name, _) in enumerate(rules.RULES):
        rest = rules.mask("v2", without=name)
        assert strict[name]["failing"] == sum(f >> k & 1 for f in failed)
        assert strict[name]["alone"] == sum(f == 1 << k for f in failed)
        assert strict[name]["kept_without"] == sum(f & rest == 0 for f in failed)
    assert rules.ledger(docs.limit(0)).count() == 0
    assert all(r["failing"] == 0 for r in rules.ablation(rules.ledger(docs.limit(0))).collect())


def test_differencing_is_tight_and_complete():
    sizes = [997, 3, 3, 3, 500, 499, 498, 250, 249] + list(range(1, 200))
    shard = shards.difference(sizes, 4)
    sums = [sum(s for s, k in zip(sizes, shard) if k == q) for q in range(4)]
    assert max(sums) - min(sums) <= 1
    assert shards.difference([], 4) == []
    assert sorted(shards.difference([5, 5, 5], 4)) != [0, 0, 0]


def test_shards(spark, docs):
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, f"text {k % 300} " * (k % 40)) for k in range(1500)], "doc_id bigint, text string"))
    out = shards.assign(many.withColumn("shard", many.doc_id * 0)).collect()
    assert len(out) == many.count()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    text = {(r["doc_id"], zlib.crc32((r["text"] or "").encode())): r["text"] or "" for r in many.collect()}
    home = {}
    for r in out:
        t = text[(r["doc_id"], r["text_crc32"])]
        assert r["size"] == len(t.encode()) + 1 and r["law"] == "bytes" and r["grown_shard"] is None
        assert home.setdefault(t, r["shard"]) == r["shard"]
    assert shards.assign(docs.limit(0)).count() == 0


def test_best_fit_decreasing_equals_a_plain_one():
    import random

    r = random.Random(4)
    lengths = [r.randint(1, 64) for _ in range(400)]
    rows, free = [], []
    for k in sorted(range(400), key=lambda k: (-lengths[k], k)):
        fit = [(f, i) for i, f in enumerate(free) if f >= lengths[k]]
        if fit:
            best = min(f for f, _ in fit)
            i = min(i for f, i in fit if f == best)
            free[i] -= lengths[k]
            rows[i].append(k)
        else:
            rows.append([k])
            free.append(64 - lengths[k])
    got = packing.best_fit_decreasing(lengths, 64)
    assert sorted(sum(lengths[k] for k in row) for row in got) == sorted(64 - f for f in free)
    assert sorted(k for row in got for k in row) == list(range(400))


def test_packs_hold_every_token_once(spark, docs):
    vocabulary = bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec = bpe.codec(vocabulary)
    length = 32
    rows = packing.pack(docs, vocabulary, length=length, buffer=200).toPandas()
    ids = packing.matrix(rows, length)
    assert rows["pack_id"].is_unique and ids.shape == (len(rows), length)
    pieces = {}
    for k, row in enumerate(rows.itertuples()):
        assert list(row.position_resets) == list(row.cu_seqlens[:-1]) and row.cu_seqlens[-1] == row.n_tokens <= length
        assert len(packing.position_ids(list(row.cu_seqlens), length)) == length
        for d, start, a, b in zip(row.doc_ids, row.piece_starts, row.cu_seqlens, row.cu_seqlens[1:]):
            pieces.setdefault(d, []).append((start, ids[k, a:b].tolist()))
        assert (ids[k, row.n_tokens :] == len(vocabulary.tokens) - 1).all()
    want = {}
    for d, t, _ in ROWS:
        if t:
            want.setdefault(d, []).extend(codec.encode(t))
    for d, tokens in want.items():
        assert sum(len(p) for _, p in pieces[d]) == len(tokens)
        if d != 8:
            assert [t for _, p in sorted(pieces[d]) for t in p] == tokens
    assert packing.pack(docs.limit(0), vocabulary).count() == 0
