"""Periodic runs, repeated passages and repaired conversations against brute-force versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from migraspark.llm import conversations as talk
from migraspark.llm.fm_index import WindowIndex
from migraspark.llm.periodic import SquareCatcher, periodic_runs, run_digests, text_runs
from migraspark.llm.substring_dedup import repeated_spans, substring_digests, without_repeats

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, spans int, runs int, place int"


def doc(doc_id, text):
    return (doc_id, text, "en", "a", 1, "clash", 1, 1, 1)


def brute_runs(words) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            k = i
            while k < n - p and words[k] == words[k + p]:
                k += 1
            if k + p - i >= max(6, 4 * p):
                found.setdefault((i, k + p), p)
            i = max(k, i + 1)
    return sorted((s, e, p) for (s, e), p in found.items())


def random_words(rng) -> np.ndarray:
    n = rng.randint(0, 200)
    words = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return np.array(words, np.uint64)


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        assert text_runs(texts) == [brute_runs(t.tolist()) for t in texts]


def test_runs_do_not_depend_on_how_words_are_appended():
    rng = random.Random(12)
    for _ in range(40):
        words = random_words(rng)
        catcher = SquareCatcher(len(words).bit_length())
        at = 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 7, 64])
            catcher.append(words[at : at + step])
            at += step
        assert [r for r in catcher.finish() if r[1] - r[0] >= 6] == brute_runs(words.tolist())


def test_a_run_is_open_before_it_ends():
    catcher = SquareCatcher(4)
    catcher.append(np.tile(np.arange(3, dtype=np.uint64), 5))
    assert [(r[0], r[2]) for r in catcher.open] == [(0, 3)] and catcher.runs == []


def test_untidy_texts_have_runs(spark):
    rows = [
        doc(1, "a a a a a a b"), doc(1, "a a a a a a b"), doc(2, None), doc(3, ""), doc(4, " \t\n"),
        doc(None, "x y x y x y x y"), doc(5, "loop é " * 30_000), doc(6, "a a a a a"),
    ]
    found = periodic_runs(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 8
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in found}
    assert got[1] == ([(0, 6, 1)], "a b")
    assert got[2] == got[3] == got[4] == ([], "")
    assert got[None] == ([(0, 8, 2)], "x y")
    assert got[5] == ([(0, 60_000, 2)], "loop é") and got[6] == ([], "a a a a a")
    digests = {r.doc_id: r for r in run_digests(periodic_runs(spark.createDataFrame(rows, DOCS))).collect()}
    assert digests[2].length is None and digests[2].n_runs == 0
    assert digests[2].runs_sha256 == digests[2].collapsed_sha256 == hashlib.sha256().hexdigest()
    assert digests[None].exponent_milli == 4000
    assert digests[1].runs_sha256 == hashlib.sha256(b"0,6,1\n").hexdigest()
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_window_index():
    rng = random.Random(13)
    for _ in range(150):
        width, letters = rng.choice([1, 2, 3, 8, 50]), rng.choice([1, 2, 9])
        longest = 30 if width < 50 else 120
        texts = [
            np.array([rng.randint(1, letters) for _ in range(rng.randint(0, longest))], np.uint64)
            for _ in range(rng.randint(0, 6))
        ]
        owners = np.array([rng.randint(0, 9) for _ in texts], np.int64)
        streamed = texts + [np.array([rng.randint(1, letters + 1) for _ in range(longest)], np.uint64)]
        lowest: dict[tuple, int] = {}
        for t, owner in zip(texts, owners.tolist(), strict=True):
            for a in range(len(t) - width + 1):
                key = tuple(t[a : a + width].tolist())
                lowest[key] = min(owner, lowest.get(key, owner))
        expected = [
            (i, a, lowest[tuple(t[a : a + width].tolist())])
            for i, t in enumerate(streamed)
            for a in range(len(t) - width + 1)
            if tuple(t[a : a + width].tolist()) in lowest
        ]
        found = WindowIndex(texts, owners, width).matches(streamed)
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == expected


def brute_repeats(rows, window) -> dict[int, list[bool]]:
    lowest: dict[tuple, int] = {}
    for doc_id, words in rows:
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            lowest[key] = min(doc_id, lowest.get(key, doc_id))
    gone = {}
    for doc_id, words in rows:
        flags = [False] * len(words)
        for a in range(len(words) - window + 1):
            if lowest[tuple(words[a : a + window])] < doc_id:
                flags[a : a + window] = [True] * window
        gone[doc_id] = flags
    return gone


@pytest.mark.parametrize("window, shard, many", [(50, 4096, 512), (50, 3, 512), (50, 4096, 0), (7, 16, 2), (2, 8, 4)])
def test_repeated_passages(spark, window, shard, many):
    """Planted passages around the length of a window, in shards of a few contexts, in hot windows."""
    rng = random.Random(window * 7 + many)
    passages = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate((window - 1, window, window + 3, 2 * window, 5 * window))]
    rows = []
    for doc_id in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, window))]
            words += rng.choice(passages)[rng.choice([0, 0, 1]) :]
        if doc_id % 7 == 3:
            words = list(rows[rng.randrange(len(rows))][1])
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = "edit"
        rows.append((doc_id, words))
    docs = spark.createDataFrame([doc(d, " ".join(w)) for d, w in rows], DOCS)
    gone = brute_repeats(rows, window)
    got = {r.doc_id: r for r in without_repeats(docs, window, shard=shard, many=many).collect()}
    for doc_id, words in rows:
        left = [w for w, g in zip(words, gone[doc_id], strict=True) if not g]
        assert (got[doc_id].n_words, got[doc_id].n_removed) == (len(words), len(words) - len(left))
        assert got[doc_id].text == " ".join(left)
    assert any(map(any, gone.values())) and not all(map(all, gone.values()))


def test_untidy_texts_and_passages(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        doc(2, long), doc(2, long), doc(5, "new " + long), doc(5, "other text"), doc(None, long), doc(7, None),
        doc(8, ""), doc(9, "w0 w1"), doc(10, long.replace(" ", "\n") + " end" * 20_000),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in without_repeats(docs).collect())
    assert got == [(-1, 120, 0), (2, 120, 0), (2, 120, 0), (5, 2, 0), (5, 121, 120), (7, 0, 0), (8, 0, 0), (9, 2, 0), (10, 20120, 120)]
    digests = {(r.doc_id, r.n_words): r.kept_sha256 for r in substring_digests(without_repeats(docs)).collect()}
    assert digests[5, 121] == hashlib.sha256(b"new").hexdigest()
    assert digests[7, 0] == hashlib.sha256().hexdigest()
    empty = spark.createDataFrame([], DOCS)
    assert without_repeats(empty).count() == 0 and repeated_spans(empty).count() == 0


def test_a_passage_in_every_document_stays_in_small_pieces(spark):
    """A hot anchor is cut into windows: no index gets more contexts of it than allowed."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [doc(i, f"a{i} " * 40 + passage + f" b{i}" * 40) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.n_removed for r in without_repeats(docs, many=20).collect()}
    assert got == {i: 60 * (i > 0) for i in range(300)}


def cheapest(turns) -> tuple[int, str]:
    """Least (cost, edits) over all ways, by a search over (turn, state)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap = [(0, "", 0, "")]
    done = set()
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, edits
        if (at, state) in done:
            continue
        done.add((at, state))
        spoken = [r for r in after[state] if r in "ua"]
        for role in spoken:
            heapq.heappush(heap, (cost + 3, edits + "I", at, role))
        if at < len(turns):
            initial, must_go, truncated = turns[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state))
            if not must_go:
                for role in spoken:
                    heapq.heappush(heap, (cost + 3 + 3 * truncated, edits + "R", at + 1, role))
                if initial in after[state]:
                    heapq.heappush(heap, (cost + 3 * truncated, edits + "K", at + 1, initial))
    raise AssertionError


def audit(turns) -> str:
    repair = talk.Repair()
    edits = [e for turn in turns for e in repair.push(*turn)]
    return "".join(letter for letter, _ in edits + repair.finish())


def test_repairs_are_the_cheapest():
    rng = random.Random(14)
    for _ in range(3000):
        turns = [
            (rng.choice("suauax "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))
        ]
        assert audit(turns) == cheapest(turns)[1]


def test_repair_holds_unsettled_edits_only():
    repair = talk.Repair()
    rng = random.Random(15)
    given, most = 0, 0
    for i in range(20_000):
        given += sum(letter != "I" for letter, _ in repair.push("ua"[i % 2], rng.random() < 0.1, False))
        most = max(most, i + 1 - given)
    assert most < 200


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, edit string, fault int, old_role int"


def test_untidy_conversations(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello!"), (1, 1, "assistant", "Hello!"), (1, 5, "user", "cut"),
        (2, None, None, None), (None, 3, "user", "Who?"), (None, None, "system", "Be kind."), (3, 1, "tool", " \t"),
        (4, 2, "assistant", "Only me."), (5, 1, "user", "x" * 300_000 + "."), (5, 2, "assistant", "y" * 300_000 + "!\n"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], CONVERSATIONS)
    edits = talk.repaired(docs)
    got = {r.conv_id: r for r in talk.summarised(edits).collect()}
    assert len(got) == 6
    assert (got[1].audit, got[1].cost, got[1].gaps, got[1].duplicate, got[1].truncated, got[1].illegal) == ("KKDD", 8, 3, 1, 1, 1)
    assert (got[2].audit, got[2].cost, got[2].blank, got[2].gaps) == ("D", 4, 1, 0)
    assert (got[None].audit, got[None].cost) == ("KKI", 3)
    assert got[None].repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Who?\nassistant:").hexdigest()
    assert (got[3].audit, got[4].audit) == ("D", "IK") and (got[5].audit, got[5].cost) == ("KK", 0)
    kept = [(r.edit, r.role) for r in edits.where("conv_id = 4").collect()]
    assert kept == [("I", "user"), ("K", "assistant")]
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert talk.repaired(empty).count() == 0 and talk.damaged_and_repaired(empty).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A b. C?") for c in range(30) for t in range(8)] + [(None, None, "user", "x.")]
    damaged = talk.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = sorted((-1 if r.conv_id is None else r.conv_id, -1 if r.turn is None else r.turn, r.role, r.text) for r in damaged.collect())
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (-1 if c is None else c, -1 if t is None else t, "user" if kind == 4 else role,
               {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(kind, text))
        expected += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(expected)
    all_gone = spark.createDataFrame(
        [(c, t, "user", "x.") for c, t in [(c, 0) for c in range(60)] if zlib.crc32(f"{c}:0".encode()) % 20 == 0],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = talk.damaged_and_repaired(all_gone).collect()
    assert rows and all((r.audit, r.cost, r.repaired_sha256) == ("", 0, hashlib.sha256().hexdigest()) for r in rows)


def test_one_shuffle_of_the_turns(spark, tiny):
    plan = talk.summarised(talk.repaired(spark.read.parquet(f"{tiny}/conversations.parquet")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text
