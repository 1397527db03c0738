"""Removal of passages that an earlier document holds, by matching statistics in compressed indexes.

A passage is a window of some words that starts in a document with a smaller id. Two equal windows
pick the same anchor, the run of half a window whose hash is smallest among all in the window, so
documents need to meet only at anchors they share. Around an anchor stands its context: all windows
that hold it. Equal contexts are settled at once, by their smallest document. Of the others, one
per document and content, each goes with those of its anchor into a shard; a task builds the
compressed index of a shard and streams the contexts through it backwards. Contexts of an anchor
with very many of them are cut into their windows, which are settled like equal contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migraspark.llm.common import kept_table
from migraspark.llm.fm_index import WindowIndex
from migraspark.llm.shingles import GOLDEN, mixed, text_batches, word_hashes, word_spans

WINDOW = 50
# Contexts of one index; an anchor with more contexts than MANY is cut into windows.
SHARD, MANY = 4096, 512


def _sums(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A value for every run of ``length`` words."""
    n = len(words) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        weights = mixed(np.arange(1, length + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)
        for k in range(length if n > 0 else 0):
            total += words[k : k + n] * weights[k]
    return total


def _extreme(values: np.ndarray, length: int, best) -> np.ndarray:
    """The least or greatest value of every ``length`` neighbours, by doubling."""
    held, have = values, 1
    while have < length:
        step = min(have, length - have)
        held, have = best(held[: len(held) - step], held[step:]), have + step
    return held


def anchors(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, anchors, contexts): the runs of half a window that are smallest in some window, with
    the hash of the words around them: up to a window's rest on both sides."""
    half, n = window // 2, len(words)
    rest = window - half
    if n < window:
        return np.zeros(0, np.int64), words[:0], words[:0]
    grams = mixed(_sums(words, half, 0))
    smallest = _extreme(grams, rest + 1, np.minimum)
    over = np.concatenate([np.zeros(rest, np.uint64), smallest, np.zeros(rest, np.uint64)])
    places = np.flatnonzero(_extreme(over, rest + 1, np.maximum) == grams)
    wide = np.concatenate([np.zeros(rest, np.uint64), words, np.zeros(rest, np.uint64)])
    sides = _sums(wide, rest, 1)
    with np.errstate(over="ignore"):
        around = mixed(mixed(sides[places]) + sides[places + rest + half] * GOLDEN)
    return places, grams[places], around


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    joined, starts, ends, bounds = word_spans(texts)
    hashes = word_hashes(joined, starts, ends)
    return [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _signed(values) -> pa.Array:
    return pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64), pa.int64())


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """anchor, context, doc_id, key, place and n_words of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "key"))
            for first, _, texts in text_batches(batch, "text"):
                words = _hashed(texts)
                found = [anchors(w, window) for w in words]
                counts = [len(f[0]) for f in found]
                owner = np.repeat(np.arange(first, first + len(texts)), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed([f[1] for f in found]),
                        _signed([f[2] for f in found]),
                        pa.array(ids[owner]),
                        pa.array(keys[owner]),
                        pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)),
                        pa.array(np.repeat([len(w) for w in words], counts).astype(np.int32)),
                    ],
                    names=["anchor", "context", "doc_id", "key", "place", "n_words"],
                )

    schema = "anchor bigint, context bigint, doc_id bigint, key bigint, place int, n_words int"
    return docs.mapInArrow(run, schema)


def _contexts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words around the wanted places, once per anchor and context: anchor, context, first (the
    owner), shard, many, words."""
    rest = window - window // 2
    lists = wanted.groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("anchor", "context", "shard", "many", "place")).alias("places")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = (batch.column("text")[row].as_py() or "").encode().split()
                doc_id = batch.column("doc_id")[row].as_py()
                places = batch.column("places")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["anchor"] for p in places], pa.int64()),
                        pa.array([p["context"] for p in places], pa.int64()),
                        pa.array([doc_id] * len(places), pa.int64()),
                        pa.array([p["shard"] for p in places], pa.int64()),
                        pa.array([p["many"] for p in places], pa.bool_()),
                        pa.array(
                            [b" ".join(words[max(p["place"] - rest, 0) : p["place"] + window]) for p in places],
                            pa.binary(),
                        ),
                    ],
                    names=["anchor", "context", "first", "shard", "many", "words"],
                )

    schema = "anchor bigint, context bigint, first bigint, shard bigint, many boolean, words binary"
    return docs.join(lists, ["doc_id", "key"]).select("doc_id", "text", "places").mapInArrow(run, schema)


def _spans(text: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (text, start) as disjoint stretches (text, begin, end)."""
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    opens = np.ones(len(text), bool)
    opens[1:] = (text[1:] != text[:-1]) | (start[1:] > start[:-1] + window)
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(text)) - 1 if len(at) else at
    return text[at], start[at], start[last] + window


def _matched(table: pa.Table, window: int) -> pa.Table:
    """What of each context of a shard also stands in one of an earlier document."""
    texts = _hashed(table.column("words").to_pylist())
    owners = table.column("first").to_numpy()
    text, start, lowest = WindowIndex(texts, owners, window).matches(texts)
    earlier = lowest < owners[text]
    text, begin, end = _spans(text[earlier], start[earlier], window)
    taken = table.select(["anchor", "context"]).take(pa.array(text))
    return pa.table([*taken.columns, pa.array(begin), pa.array(end)], names=["anchor", "context", "begin", "end"])


def _windows(contexts: DataFrame, window: int) -> DataFrame:
    """anchor, context, first, begin, and a 128-bit hash (w1, w2) of all windows of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _hashed(batch.column("words").to_pylist())
            w1 = [mixed(_sums(t, window, 2)) for t in texts]
            w2 = [mixed(_sums(t, window, 3)) for t in texts]
            counts = [len(w) for w in w1]
            row = pa.array(np.repeat(np.arange(len(texts)), counts))
            begin = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in ("anchor", "context", "first")), pa.array(begin),
                 _signed(w1), _signed(w2)],
                names=["anchor", "context", "first", "begin", "w1", "w2"],
            )

    schema = "anchor bigint, context bigint, first bigint, begin bigint, w1 bigint, w2 bigint"
    return contexts.select("anchor", "context", "first", "words").mapInArrow(run, schema)


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, shard: int = SHARD, many: int = MANY
) -> DataFrame:
    """doc_id, key (xxhash64 of the text) and spans: the stretches of words (begin, end) that are in
    a window which also starts in a document with a smaller doc_id. Texts without any are left out.

    Words count from 0, stretches may overlap. A NULL text and one of fewer words than ``window`` has
    no windows; rows without a doc_id neither lose words nor take any from others. Rows that repeat
    a doc_id are compared with smaller ids only, not with each other. Other columns are ignored; an
    empty table gives an empty result.

    Words and anchors are told apart by 64-bit hashes, whole contexts by two of them. ``shard``
    contexts make an index and ``many`` bounds those of one anchor in it; both leave the result as
    it is. Anchors that one document has alone go no further than the first aggregation.
    """
    rest = window - window // 2
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")
    places = kept_table(_occurrences(texts, window), "anchors")
    distinct = kept_table(
        places.groupBy("anchor", "context").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")),
        "contexts",
    )
    shared = kept_table(
        distinct.groupBy("anchor")
        .agg(F.min("first").alias("low"), F.max("last").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("anchor", (F.col("n") > 1).alias("open"), (F.col("n") > many).alias("many")),
        "shared-anchors",
    )
    met = kept_table(
        places.join(distinct, ["anchor", "context"])
        .join(shared, "anchor")
        .where("doc_id > first OR open"),
        "shared-places",
    )
    whole = met.where("doc_id > first").selectExpr(
        "doc_id", "key", f"greatest(place - {rest}, 0) AS begin", f"least(place + {window}, n_words) AS end"
    )
    unsettled = met.where("open AND doc_id = first")
    wanted = kept_table(
        unsettled.groupBy("anchor", "context")
        .agg(F.min("first").alias("doc_id"), F.min_by("key", "place").alias("key"),
             F.min("place").alias("place"), F.first("many").alias("many")),
        "unsettled-contexts",
    )
    shards = wanted.count() // shard + 1
    wanted = wanted.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    contexts = kept_table(_contexts(texts, wanted, window), "context-words")
    few = (
        contexts.where("NOT many")
        .groupBy("shard")
        .applyInArrow(
            lambda table: _matched(table, window), "anchor bigint, context bigint, begin bigint, end bigint"
        )
    )
    cut = kept_table(_windows(contexts.where("many"), window), "hot-windows")
    lowest = kept_table(
        cut.groupBy("w1", "w2").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high")
        .select("w1", "w2", "low"),
        "hot-window-owners",
    )
    hot = (
        cut.join(lowest, ["w1", "w2"])
        .where("first > low")
        .select("anchor", "context", "begin", (F.col("begin") + window).alias("end"))
    )
    found = kept_table(few.union(hot).distinct(), "context-spans")
    parts = unsettled.join(found, ["anchor", "context"]).selectExpr(
        "doc_id", "key",
        f"greatest(place - {rest}, 0) + begin AS begin", f"greatest(place - {rest}, 0) + end AS end",
    )
    return (
        whole.selectExpr("doc_id", "key", "CAST(begin AS INT)", "CAST(end AS INT)")
        .union(parts.selectExpr("doc_id", "key", "CAST(begin AS INT)", "CAST(end AS INT)"))
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed and text for every row of ``docs``: the text without the words
    that ``repeated_spans`` finds, those left parted by one blank.

    The texts are joined with their spans by id and hash of the text, which shuffles them once.
    """
    spans = kept_table(repeated_spans(docs, window, **sizes), "repeated-spans")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_batches(batch, "text"):
                n_words, n_removed, left = [], [], []
                for i, text in enumerate(texts):
                    words = text.split()
                    n_words.append(len(words))
                    spans = batch.column("spans")[first + i].as_py()
                    if spans:
                        depth = np.zeros(len(words) + 1, np.int64)
                        np.add.at(depth, [s["begin"] for s in spans], 1)
                        np.add.at(depth, [s["end"] for s in spans], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    left.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(n_words, pa.int64()),
                     pa.array(n_removed, pa.int64()), pa.array(left, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "text"],
                )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, text string"
    return rows.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def substring_digests(found: DataFrame) -> DataFrame:
    """The result of ``without_repeats`` with the hash of the text that is left."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
