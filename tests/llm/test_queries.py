"""Every query of the operators against its SQL, or against a brute-force version."""

from __future__ import annotations

import hashlib
import zlib

import compare
import numpy as np
import pytest

import corpus_pipeline
from migraspark.llm import classifier, decontaminate, mixing, sharding
from migraspark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(tiny):
    return compare.connect(tiny)


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, tiny, connection):
    assert compare.differences(QUERIES[name](spark, tiny), ORACLES[name], connection) == []


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_classifier"](spark, folder).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.3)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50
    assert np.mean([a == b for a, b in judged]) >= 0.95
    assert all(b == 1 for a, b in judged if a == 1)


def test_token_counts_are_those_of_whole_texts(spark, tiny, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, tiny).collect()}
    assert len(found) == len(documents)
    for d in documents:
        n = len(loaded.encode(d.text, add_special_tokens=False).ids)
        row = found[d.doc_id]
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(d.text.encode()), n > 512)


def brute_contaminated(documents, items) -> dict[tuple[int, int], int]:
    words, first = decontaminate.normal_words([d.text.encode() for d in documents])
    wanted, at = decontaminate.normal_words([i.text.encode() for i in items])
    found = {}
    for k, d in enumerate(documents):
        region = words[first[k] : first[k + 1] - 1]
        for j, i in enumerate(items):
            item = wanted[at[j] : at[j + 1] - 1]
            limit = len(item) * decontaminate.EDIT_PERCENT // 100
            if np.isin(item, region).sum() >= len(item) - limit:
                edits = decontaminate.fewest_edits(item, region)
                if edits <= limit:
                    found[d.doc_id, i.item_id] = edits
    return found


def test_contaminated_documents(spark, tiny, documents):
    items = spark.read.parquet(f"{tiny}/benchmark.parquet").collect()
    rows = QUERIES["op9_decontamination"](spark, tiny).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == brute_contaminated(documents, items)


def brute_components(documents) -> dict[int, int]:
    sets = {}
    for d in documents:
        w = (d.text or "").encode().lower().split()
        size = min(len(w), 5)
        sets[d.doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def brute_copies(documents) -> dict[int, int]:
    sized = {}
    for d in documents:
        sized.setdefault(d.source, []).append((len((d.text or "").encode().split()), d.doc_id))
    copies = {}
    for source, total, target in mixing.targets([(s, sum(n for n, _ in v)) for s, v in sized.items()]):
        offset = int(hashlib.md5(f"mix:{source or ''}".encode()).hexdigest()[:5], 16) / 2**20
        rate = target / total if total else 0.0
        for k, (_, doc_id) in enumerate(sorted(sized[source]), 1):
            copies[doc_id] = int(np.floor(rate * k + offset) - np.floor(rate * (k - 1) + offset))
    return copies


def test_pipeline(spark, tiny, documents):
    """The whole pipeline against plain Python, stage by stage."""
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    model = classifier.train(spark.createDataFrame(documents), labels)
    left = [d for d in documents if model.score([(d.text or "").encode()])[0] >= 0.3]
    component = brute_components(left)
    left = [d for d in left if component[d.doc_id] == d.doc_id]
    items = spark.read.parquet(f"{tiny}/benchmark.parquet").collect()
    held = {doc_id for doc_id, _ in brute_contaminated(left, items)}
    left = [d for d in left if d.doc_id not in held]
    copies = brute_copies(left)
    slots = sharding.lookup_table()
    expected = []
    for d in left:
        slot = int(hashlib.md5(str(d.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        expected += [(*d, slot, slots[slot])] * copies[d.doc_id]
    got = corpus_pipeline.run(spark, tiny)
    assert got.columns == [*documents[0].__fields__, "slot", "shard"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert 0 < len(left) < len(documents)
