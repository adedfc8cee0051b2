import hashlib

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm import secret_scan
from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs, results = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        results[name] = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in results[name]], docs.schema)

    labels = dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{SF}/labels.parquet' GROUP BY doc_id").fetchall())
    kept = {r["doc_id"] for r in results["quality_classifier"]}
    judged = [(labels[r["doc_id"]], r["doc_id"] in kept) for r in inputs["quality_classifier"] if r["doc_id"] in labels]
    assert sum(bool(q) == k for q, k in judged) >= 0.97 * len(judged)

    component = brute([(r["doc_id"], r["text"]) for r in inputs["ngram_jaccard"]])
    assert {r["doc_id"] for r in results["ngram_jaccard"]} == {d for d, (_, c) in component.items() if d == c}

    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    leaked = {r["doc_id"] for r in inputs["decontamination"] if any(t in r["text"] for t in items)}
    gone = {r["doc_id"] for r in inputs["decontamination"]} - {r["doc_id"] for r in results["decontamination"]}
    assert leaked <= gone and len(gone - leaked) <= 2

    before = {r["doc_id"]: r for r in inputs["secret_scan"]}
    for r in results["secret_scan"]:
        assert not secret_scan.base_spans(r["text"])
        if not secret_scan.base_spans(before[r["doc_id"]]["text"]) and secret_scan.MARK not in r["text"]:
            assert r == before[r["doc_id"]]
        else:
            assert r["n_chars"] == len(r["text"])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in inputs["bpe_encoding"]}
    assert {r["doc_id"] for r in results["bpe_encoding"]} == set(texts)
    for r in results["bpe_encoding"]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(200))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, leaks int, secrets int, ids int, cls int, predicted int"
    rows = [(d, t, None, None, None, "s", 1, 2, 3, 4, 5) for d, t in [(1, long), (1, long), (2, long + " more"), (3, None), (4, ""), (None, long), (None, None), (5, "token=abcdefgh12 " + "x y z " * 30)]]
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
            if name != "bpe_encoding":
                assert out.columns == docs.columns
        got = out.collect()
        ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got)
        assert ids == ([-1, -1, 1, 3, 4, 5] if docs.count() else [])
