"""Stages over tables whose ids are missing or repeat."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np

import corpus_pipeline
from migraspark.llm import classifier, stages

CLEAN = " ".join(f"clean{i} words that nobody else has" for i in range(30))
OTHER = " ".join(f"other{i} things said in another way" for i in range(30))


def test_contaminated_rows_go_whatever_their_id(spark, tiny):
    item = max(spark.read.parquet(f"{tiny}/benchmark.parquet").collect(), key=lambda r: len(r.text)).text
    held = f"{CLEAN} {item} {CLEAN}"
    docs = spark.createDataFrame(
        [(None, held), (None, CLEAN), (1, held), (1, CLEAN), (2, OTHER)], "doc_id bigint, text string"
    )
    left = stages.decontamination(spark, docs, tiny)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(
        map(str, spark.createDataFrame([(None, CLEAN), (1, CLEAN), (2, OTHER)], docs.schema).collect())
    )


def test_a_repeated_id_does_not_drop_another_text(spark, tiny):
    rows = [(3, CLEAN), (5, CLEAN + " end"), (5, OTHER), (5, OTHER), (7, ""), (7, ""), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = stages.near_dedup(spark, docs, tiny).collect()
    assert sorted(map(tuple, left), key=str) == sorted(
        [(3, CLEAN), (5, OTHER), (7, ""), (8, ""), (8, None)], key=str
    )


def test_columns_of_any_name_come_through_all_stages(spark, tiny):
    """Names that the operators use themselves, with values of their own."""
    names = ["score", "predicted", "_row", "_size", "_in", "_part", "_place", "_copy", "_copies", "row", "shard"]
    kinds = ", ".join(f"{n} string" for n in names)
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {kinds}"
    rows = [(i, f"{CLEAN}\nplain line {i}" if i < 2 else f"{OTHER} {i}", "en", "abc"[i % 3], 1, *[f"{n}{i}" for n in names]) for i in range(6)]
    rows.append((None, None, None, None, None, *[None] * len(names)))
    docs = spark.createDataFrame(rows, schema)
    for stage in (stages.quality_classifier, stages.near_dedup, stages.decontamination, stages.mixing):
        left = stage(spark, docs, tiny)
        assert left.columns == docs.columns
        for r in left.collect():
            if r.doc_id is not None:
                assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    placed = stages.sharding(spark, docs, tiny)
    assert placed.count() == 7 and placed.columns == [*[c for c in docs.columns if c != "shard"], "slot", "shard"]


def test_stages_over_an_empty_table(spark, tiny):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
        assert docs.count() == 0, name
    assert docs.columns == [*empty.columns, "slot", "shard"]


def test_memory_of_the_classifier_follows_a_slice(tmp_path):
    """The resident growth over a text of very many short lines, in a process of its own."""
    code = (
        "import resource, sys, numpy as np\n"
        "from migraspark.llm.classifier import Model, OWN\n"
        "model = Model(np.zeros(3 * OWN + 1), np.zeros((2, 2)), 0.5)\n"
        "model.score([b'warm up'])\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "model.score([b'ab\\n' * 120_000])\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)\n"
    )
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(ran.stdout) < 60_000


def test_scores_in_blocks_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    model = classifier.Model(rng.normal(size=3 * classifier.OWN + 1), rng.normal(size=(2, 2)), 0.5)
    texts = [b"\n".join(b"line %d!" % (i % 7) for i in range(n)) for n in (0, 1, 2, 50)]
    whole = model.score(texts)
    features = [classifier.line_features(t)[0] for t in texts]
    for t, f in zip(texts, features, strict=True):
        direct = classifier.with_neighbours(f) @ model.weights
        assert np.allclose(classifier.line_scores(t, model.weights)[0], direct)
    monkeypatch.setattr(classifier, "BLOCK_LINES", 3)
    assert np.allclose(model.score(texts), whole)
    assert all(np.allclose(classifier.line_features(t)[0], f) for t, f in zip(texts, features, strict=True))
