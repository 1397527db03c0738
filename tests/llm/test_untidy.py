"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import io
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from migraspark.llm import classifier, decontaminate, line_dedup, near_dedup, sharding, stages, tokens, warc
from migraspark.llm.line_dedup import WORD_EDITS, duplicate_lines, without_lines
from migraspark.llm.linking import components
from migraspark.llm.mixing import mix, targets
from migraspark.llm.quality_rules import quality_rules
from migraspark.llm.url_filter import url_filter
from migraspark.session import shared_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size int, slot int"
PROSE = " ".join(f"word{i} the of and" for i in range(40))


@pytest.fixture(scope="module")
def untidy(spark):
    rows = [
        (1, PROSE, "en", "a", 1, "x", 1, 1),
        (1, PROSE, "en", "a", 1, "x", 1, 1),
        (2, PROSE.upper(), None, "a", None, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "x", 1, 1),
        (5, " \t\n\r ", "en", "b", 0, "x", 1, 1),
        (None, PROSE, "en", None, 1, "x", 1, 1),
        (6, "one two", "en", "b", 1, "x", 1, 1),
        (7, "One two", "en", "b", 1, "x", 1, 1),
        (8, "\n".join(["a line that is said again and again"] * 3), "en", "b", 1, "x", 1, 1),
        (9, "x" * 200_000 + " " + "long text " * 20_000, "en", "c", 1, "x", 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return classifier.fit([PROSE.encode(), b"!! ## !!", b""], np.array([1.0, 0.0, 1.0]), 50)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_rules(untidy, empty):
    rows = by_id(quality_rules(untidy))
    assert quality_rules(untidy).count() == 11 and quality_rules(empty).count() == 0
    assert rows[1].kept and not rows[1].base_failed
    assert [rows[i].n_words for i in (3, 4, 5)] == [0, 0, 0]
    assert all(rows[i].base_failed and not rows[i].kept for i in (3, 4, 5, 6, 9))
    assert rows[8].n_dup_lines == 2 and rows[8].n_repeat_words == 24


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (2, None), (3, "no scheme"), (None, "x://EXAMPLE.com/en/?q"),
         (4, "http://WWW.example.com/en/a#b"), (5, "http://b.net/es/"), (6, "http://bad.org/1"), (7, "http://bad.org/2")],
        "page_id bigint, url string",
    )
    outcomes = spark.createDataFrame(
        [(i, True) for i in (6, 7)] + [(1, False), (5, False), (None, True), (2, None)], "page_id bigint, bad boolean"
    )
    rows = url_filter(pages, outcomes).collect()
    assert len(rows) == 9
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in rows}
    assert got[1, "a.com"] == ("/en/1", "com/", "allow")
    assert got[2, ""] == ("", None, "allow") and got[3, ""] == ("", None, "allow")
    assert got[None, "example.com"] == ("/en/", "example.com/en/", "block")
    assert got[4, "www.example.com"] == ("/en/a", "www.example.com/en/", "allow")
    assert got[5, "b.net"] == ("/es/", "net/es/", "block")
    assert url_filter(pages, outcomes.limit(0)).count() == 9
    assert url_filter(pages.limit(0), outcomes).count() == 0


def test_a_host_needs_evidence_to_be_blocked(spark):
    pages = spark.createDataFrame(
        [(i, f"http://{'bad' if i < 40 else f'h{i % 30}'}.org/{i}") for i in range(400)], "page_id bigint, url string"
    )
    outcomes = pages.select("page_id", (F.col("page_id") < 41).alias("bad"))
    rows = url_filter(pages, outcomes).collect()
    assert {r.host for r in rows if r.verdict == "block"} == {"bad.org"}


def test_classifier(untidy, empty, model):
    rows = by_id(classifier.classify(untidy, model))
    assert classifier.classify(empty, model).count() == 0
    assert classifier.classify(untidy, model).columns == [c for c in untidy.columns if c != "score"] + ["score", "predicted"]
    assert rows[3].score == rows[4].score == rows[5].score == pytest.approx(0.6)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_marginals_against_all_labellings():
    random_numbers = np.random.default_rng(1)
    scores, transition = random_numbers.normal(size=5), random_numbers.normal(size=(2, 2))
    good, pairs, total = classifier.marginals(scores, np.array([0, 3, 3, 5]), transition)
    for a, b, which in ((0, 3, 0), (3, 5, 1)):
        n, weights = b - a, {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(
                sum(s * v for s, v in zip(scores[a:b], y)) + sum(transition[u, v] for u, v in zip(y, y[1:]))
            )
        z = sum(weights.values())
        assert np.log(z) == pytest.approx(total[which])
        for k in range(n):
            assert sum(w for y, w in weights.items() if y[k]) / z == pytest.approx(good[a + k])
    assert pairs.sum() == pytest.approx(3)


def test_training_without_labels_is_indifferent():
    assert classifier.fit([], np.array([])).score([b"any line", b""]) == pytest.approx([0.5, 0.5])


def test_near_duplicates(untidy, empty):
    rows = near_dedup.near_duplicates(untidy).collect()
    assert len(rows) == 11 and near_dedup.near_duplicates(empty).count() == 0
    got = {r.doc_id: (r.component_id, r.kept) for r in rows}
    assert got[1] == (1, True) and got[2] == (1, False) and got[None] == (None, True)
    assert got[3] == (3, True) and got[4] == (4, True) and got[5] == (5, True)
    assert got[6] == (6, True) and got[7] == (6, False)


def test_a_chain_of_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 40, 4)]  # neighbours share 52 of 60 shingles
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {91}


def test_a_large_group_of_near_copies(spark):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(draw.randint(0, 8)):
            words[draw.randrange(80)] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for _, t in rows]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {k: root(k) for k in range(300)}


def test_registers_estimate_similarity_and_merge():
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (600, 1200, 1800):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - shared : 4000 - shared])
        left, right, union = near_dedup.registers([a, b, np.union1d(a, b)], 1024)
        assert (near_dedup.merged(left, right) == union).all()
        above, below = np.array([(left > right).sum()]), np.array([(left < right).sum()])
        share = np.array([len(a) / (len(a) + len(b))])
        found = near_dedup.estimated_similarity(above, below, 1024 - above - below, share)[0]
        assert abs(found - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.06


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (501, 500)]
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    got = {r.node: r.component for r in rows}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {500: 500, 501: 500}


def test_mix(untidy, empty):
    rows = mix(untidy).collect()
    assert len(rows) == 11 and mix(empty).count() == 0
    assert all(0 <= r.copies <= 2 for r in rows)
    again = mix(untidy.repartition(5)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, again), key=key)
    assert stages.mixing(None, untidy, "").columns == untidy.columns
    assert stages.mixing(None, untidy, "").count() == sum(r.copies for r in rows)


def test_targets_stop_at_twice_the_size():
    got = {s: t for s, _, t in targets([("a", 10), ("b", 1000), (None, 500), ("c", 0)])}
    assert got["a"] == 20 and got["c"] == 0
    assert sum(got.values()) == pytest.approx(1.5 * 1510)
    assert all(got[s] <= 2 * n + 1e-9 for s, n in (("a", 10), ("b", 1000), (None, 500)))
    assert targets([]) == []


def test_sharding(untidy, empty):
    rows = sharding.assign_shards(untidy).collect()
    assert len(rows) == 11 and sharding.assign_shards(empty).count() == 0
    assert rows[0].__fields__[-2:] == ["slot", "shard"] and len(rows[0]) == 9
    table = sharding.lookup_table(16, 1009)
    assert max(np.bincount(table)) - min(np.bincount(table)) <= 1
    fewer = sharding.lookup_table(15, 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.3 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(4, 1000)


def test_archives(spark):
    pages = spark.createDataFrame(
        [(3, "http://a\r\nX: y", "same"), (1, None, "same"), (1, None, "same"), (2, "u", None), (4, "u", ""),
         (None, "u", "same"), (5, "é", "ü" * 50_000)],
        "page_id bigint, url string, html string",
    )
    rows = warc.archived(pages, split_bytes=100).collect()
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == sorted(
        [(3, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (2, 0, "response", None),
         (4, 0, "revisit", 2), (0, 4, "revisit", 1), (5, 100_000, "response", None)],
        key=str,
    )
    assert warc.archived(pages.limit(0)).count() == 0
    few = warc.archived(pages, least=5).where("record_type = 'revisit'")
    assert few.count() == 0


def test_every_split_owns_the_records_that_start_in_it():
    draw = random.Random(2)
    data, places = b"", []
    for k in range(60):
        payload = draw.randbytes(draw.randint(0, 300)) + warc.MAGIC * draw.randint(0, 3)
        places.append(len(data))
        data += warc.encoded_record(k, "u", payload, warc.base32_digest(payload), None, False)
    for step in (1, 7, 100, 5000, len(data)):
        found = []
        for start in range(0, len(data), step):
            source = io.BytesIO(data)
            records = warc.records_starting_in(source, start, min(start + step, len(data)))
            found += [warc.decoded_record(r)[0] for r in records]
        assert found == list(range(60))


def test_token_counts(spark, untidy, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = tokens.token_counts(untidy, path).collect()
    assert len(rows) == 11 and tokens.token_counts(empty, path).count() == 0
    loaded = tokens.tokenizer(path)
    expected = sorted(len(loaded.encode(d.text or "", add_special_tokens=False).ids) for d in untidy.collect())
    assert sorted(r.n_tokens for r in rows) == expected


def test_splicing_agrees_with_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    loaded = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(1)
    pieces = ["a", "b", " ", "  ", "\n", "\t", "é", "23", "'s", "<|endoftext|>", "!", "\u3000", "🙂", "x" * 30, "\r\n"]
    for _ in range(400):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 120)))
        whole = len(loaded.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((8, 2), (20, 4), (40, 10)):
            assert tokens.count_tokens(text, loaded, chunk, overlap) == whole


def test_lines(spark, untidy, empty):
    rows = by_id(duplicate_lines(untidy))
    assert duplicate_lines(empty).count() == 0
    assert rows[3].n_lines == rows[4].n_lines == rows[5].n_lines == 0
    assert rows[8].removed == [1, 2] and rows[8].n_lines == 3
    cut = by_id(without_lines(untidy, duplicate_lines(untidy)))
    assert cut[8].text == "a line that is said again and again" and cut[3].text is None


def test_fuzzy_lines(spark):
    line = "the quick brown fox jumps over the lazy dog while nobody looks at all, he said to himself"
    other = "an entirely different sentence about nothing that anybody would ever want to read aloud"
    docs = spark.createDataFrame(
        [(1, f"{other}\n{line}"), (2, f"{line}!"), (3, f"x {line}\nshort"), (4, "short\n\nshort")], "doc_id bigint, text string"
    )
    assert {r.doc_id: r.removed for r in duplicate_lines(docs).collect()} == {1: [], 2: [0], 3: [0], 4: [0, 2]}


def test_lines_are_linked_without_storing_their_shingles(spark):
    """Before, every shingle of a line that met another one was stored as eight bytes, and shuffled twice."""
    draw, rows, size = random.Random(4), [], 0
    for k in range(600):
        line = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(70))
        rows += [(2 * k, line), (2 * k + 1, f"{line}.")]
        size += 2 * len(line)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    assert all(r.removed == ([0] if r.doc_id % 2 else []) for r in duplicate_lines(docs).collect())
    assert sum(f.stat().st_size for f in folder.rglob("*.parquet")) - before < 2 * size


def test_lines_of_repeated_words(spark):
    """The sets of shingles are equal, however often a word stands in the line."""
    rows = [(k, "abc def ghi jkl " * (8 + 90 * k) + "once upon a time there was a line that goes on for some while") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [len(r.removed) for r in duplicate_lines(docs).orderBy("doc_id").collect()] == [0, 1, 1, 1, 1]


def test_lines_of_every_length_meet_in_some_band(spark):
    """Pairs at the limit by bytes put in front, lines of 15 to 1007 bytes. A distinct line is one row of sixteen minima."""
    draw, rows = random.Random(9), []
    for k in range(600):
        n = draw.choice((8, 12, 20, 32, 40, 64, 200, 800))
        line = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n + 7))
        rows += [(2 * k, line), (2 * k + 1, "".join(draw.choice("0123456789") for _ in range(n // 4)) + line)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = line_dedup._signed(docs, 8, 80)
    assert signed.count() == 1200 and len(signed.columns) == 17
    removed = {r.doc_id: r.removed for r in line_dedup.duplicate_lines(docs).collect()}
    assert sum(removed[2 * k + 1] == [0] for k in range(600)) >= 592
    assert all(removed[2 * k] == [] for k in range(600))


def test_a_word_changed_in_the_middle_of_a_line(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 7))) for _ in range(4000)]
    rows = []
    for k in range(80):
        line = []
        while len(" ".join(line)) < 40 + k:
            line.append(draw.choice(words))
        middle = len(line) // 2
        line[middle] = draw.choice([w for w in words if len(w) == 5])
        other = [*line[:middle], draw.choice([w for w in words if len(w) == 5]), *line[middle + 1 :]]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    percent, shingle_bytes = WORD_EDITS
    found = {r.doc_id: r.removed for r in duplicate_lines(docs, percent, shingle_bytes).collect()}
    assert all(found[2 * k] == [] for k in range(80))
    assert sum(found[2 * k + 1] == [0] for k in range(80)) >= 78


def test_contaminated(spark, untidy, empty):
    items = spark.createDataFrame(
        [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "one two"), (4, "not there at all, really")],
        "item_id bigint, text string",
    )
    rows = decontaminate.contaminated(untidy, items).collect()
    found = sorted(((r.doc_id, r.item_id, r.edits) for r in rows), key=str)
    plain = [(d, 1, 0) for d in (1, 1, 2, None) for _ in range(2)] + [(6, None, 0), (7, None, 0)]
    assert found == sorted(plain, key=str)
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(untidy, items.limit(0)).count() == 0


def test_recall_of_edited_passages():
    """The share of edited passages that some repetition proposes, and that the check confirms."""
    draw = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [[draw.choice(vocabulary) for _ in range(draw.randint(16, 70))] for _ in range(150)]
    texts = [" ".join(i).encode() for i in items]
    words, first = decontaminate.normal_words(texts)
    sampler = decontaminate.Sampler([words[a : b - 1] for a, b in zip(first[:-1], first[1:])])
    edits = np.array([len(i) // 10 for i in items])
    for amount, least in ((0, 1.0), (1, 0.97), (2, 0.9)):
        found = total = 0
        for k, item in enumerate(items):
            if amount > edits[k]:
                continue
            changed = list(item)
            for _ in range(amount):
                at = draw.randrange(len(changed))
                kind = draw.randrange(3)
                if kind == 0:
                    changed[at] = "edited"
                elif kind == 1:
                    del changed[at]
                else:
                    changed.insert(at, "edited")
            around = [[draw.choice(vocabulary) for _ in range(40)] for _ in range(2)]
            text = " ".join(around[0] + changed + around[1]).encode()
            total += 1
            found += (0, k) in decontaminate._matches(sampler, edits, [text])
        assert found >= least * total, (amount, found, total)


def test_stages_keep_columns_and_clean_rows(spark, untidy, tiny):
    assert stages.near_dedup(spark, untidy, tiny).columns == untidy.columns
    left = [r.doc_id for r in stages.near_dedup(spark, untidy, tiny).collect()]
    assert sorted(str(x) for x in left) == sorted(["1", "3", "4", "5", "6", "8", "9", "None"])
    clean = stages.decontamination(spark, untidy, tiny)
    assert clean.columns == untidy.columns and clean.count() == 11
