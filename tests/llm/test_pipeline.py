"""The pipeline held against a plain-Python version, and the registry."""

from collections import Counter

import numpy as np
import public_tokenizers
from test_operators import brute_targets, slow_components, slow_print
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from docketry.llm import common, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries.QUERIES}


def test_stages_equal_plain_python(spark):
    docs = common.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, bias = toxicity.train(docs, labels)
    score = toxicity.scorer(weights, bias)
    rows = [r for r in docs.orderBy("doc_id").collect() if score(r.text) < 0.5]
    step = common.stash(corpus_pipeline.drop_toxic(spark, docs, SF), "t")
    assert sorted(step.collect()) == rows and step.columns == docs.columns

    groups = slow_components([r.doc_id for r in rows], [slow_print(r.text) for r in rows])
    rows = [r for r, g in zip(rows, groups, strict=True) if r.doc_id == g]
    step = common.stash(corpus_pipeline.drop_near_duplicates(spark, step, SF), "t")
    assert sorted(step.collect()) == rows

    automata = secrets.learn(step)
    texts = {r.doc_id: secrets.redact(r.text, automata) for r in rows}
    step = common.stash(corpus_pipeline.redact_secrets(spark, step, SF), "t")
    assert {r.doc_id: r.text for r in step.collect()} == texts

    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(texts[r.doc_id].split())
    target = brute_targets(dict(sizes))
    step = common.stash(corpus_pipeline.mix_sources(spark, step, SF), "t")
    mixed, longest = Counter(), Counter()
    for r in step.collect():
        assert texts[r.doc_id] == r.text
        mixed[r.source] += len(r.text.split())
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    assert all(target[s] - 1 <= mixed[s] <= target[s] + longest[s] for s in target)
    assert step.columns == docs.columns

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in step.collect():
        want[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for p in corpus_pipeline.pack_sequences(spark, step, SF).collect():
        got[p.doc_id] += p.length
    assert got == want and corpus_pipeline.run(spark, SF).count() > 0
    assert np.isfinite(bias)


def test_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    from test_operators import SCHEMA, frame, messy

    labels = "doc_id long, quality int, toxic int"
    for name, docs, marks in (("messy", frame(spark, messy()), [(1, 1, 1), (2, 1, 0), (None, 0, 1), (3, 1, None)]), ("empty", spark.createDataFrame([], SCHEMA), [])):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marks, labels).write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, (_, function) in enumerate(corpus_pipeline.STAGES):
            kept = common.stash(function(spark, kept, folder), "stage")
            assert stage == 4 or kept.columns == docs.columns
        assert kept.count() == corpus_pipeline.run(spark, folder).count() and (kept.count() > 0) == (name == "messy")
