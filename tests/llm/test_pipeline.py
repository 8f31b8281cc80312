"""The pipeline: each stage against its operator, and the whole against the stages by hand."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, decontaminate, queries, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_run_agree(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = f"{tmp_path}/{number}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name == "tokens":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(kept)
        if name == "toxicity":
            chain = queries.toxicity_chain(before, SF)
            p = {i: chain.probabilities([t])[0][2] for i, t in kept.items()}
            assert set(after) == {i for i in kept if p[i] < chain.thresholds[2]}
        elif name == "near_duplicates":
            fps = {i: np.uint64(simhash.fingerprint(t)) for i, t in kept.items()}
            ids = sorted(kept)
            array = np.array([fps[i] for i in ids])
            near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 4
            label = np.arange(len(ids))
            while True:
                new = np.array([label[row].min() for row in near])
                if (new == label).all():
                    break
                label = new
            assert set(after) == {ids[k] for k in label}
        elif name == "decontamination":
            hits = decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert set(after) == set(kept) - {r.doc_id for r in hits}
        elif name == "secrets":
            find, kinds = secrets.finder(), {r.kind for r in secrets.RULES}
            for i, t in kept.items():
                parts, at = [], 0
                for a, _, b in find(t, kinds):
                    if a >= at:
                        parts += [t[at:a], "[secret]"]
                    at = max(at, b)
                assert after[i] == "".join([*parts, t[at:]])
        kept = after
    own = bpe.WordBpe(open(public_tokenizers.path("word_bpe_49k.json")).read())
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(kept)
    for i, t in kept.items():
        assert bytes(rows[i].ids) == own.encode_batch([t])[0].tobytes()
    whole = {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.n_tokens, bytes(r.ids)) for r in rows.values()}


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_awkward_rows(spark, tmp_path, empty):
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, "some words here", "en", "s", 1), (3, "some words here", "en", "s", 1),
            (None, "no id at all", "fr", "s", 1), (None, None, "fr", "s", 1), (4, "w " * 50_000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([] if empty else rows, schema)
    for name in ("row", "row_key", "kinds", "fp", "clean", "root"):
        docs = docs.withColumn(name, F.lit(1))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert name == "tokens" or out.columns == docs.columns
        path = f"{tmp_path}/{number}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    # Null and empty texts are one group, and so are the repeated rows.
    assert ids == ([] if empty else [(False, 1), (False, 3), (False, 4), (True, 0)])


def test_toxicity_stage_needs_no_rows_with_labels(spark):
    docs = spark.createDataFrame([(10**9, "words")], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs, SF).count() == 1
    assert toxicity.MAX_ROWS == 8_000
