"""Runs of periodically repeated words, found online by catching squares at dyadic blocks.

Words are appended one batch after another. Whenever 2**k of them fill an aligned block, a catcher
watches for the block's return: every further word completes one more suffix of 2**k words, and a
suffix equal to the block between 2**k and 2**(k + 1) words later is the second half of a square
with that distance as its period. A stretch of a period that is at least four periods long holds two
neighbouring blocks of the level of its period, so two neighbouring catchers report it at the same
distance, before it is four periods long. A report inside a run of a smaller period is known; any
other opens a run, which is stretched to the left once and to the right with every word appended.
Levels go from small periods to large.

All catchers of a level compare at once: their blocks are the rows of a matrix of suffix hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migraspark.llm.shingles import GOLDEN, mixed, text_batches, word_hashes, word_spans

REPEATS, LEAST_WORDS = 4, 6
PIECE = 1 << 15


class _Level:
    """The catchers of blocks of 2**k words."""

    def __init__(self, k: int):
        self.k, self.width = k, 1 << k
        self.base = 0  # where the block of the first row begins
        self.hashes = np.zeros(0, np.uint64)  # of the runs of 2**k words from base on
        self.before = np.zeros((2, self.width), bool)  # hits of the two rows before


class SquareCatcher:
    """Online detection of runs: stretches of a smallest period, ``repeats`` periods or longer.

    ``append`` takes 64-bit word values; ``finish`` settles the end. ``runs`` holds (start, end,
    period) of the runs that have ended. Periods up to 2**levels - 1 are caught.
    """

    def __init__(self, levels: int, repeats: int = REPEATS):
        self.repeats = max(repeats, REPEATS)
        self.levels = [_Level(k) for k in range(levels)]
        self.words = np.zeros(1 << 10, np.uint64)
        self.n = 0
        self.open: list[list[int]] = []
        self.ended: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        if self.n + len(words) > len(self.words):
            larger = np.zeros(max(2 * len(self.words), self.n + len(words)), np.uint64)
            larger[: self.n] = self.words[: self.n]
            self.words = larger
        self.words[self.n : self.n + len(words)] = words
        self.n += len(words)
        self.open = [run for run in self.open if self._stretched(run)]
        self._catch(mixed(words), False)

    def finish(self) -> list[tuple[int, int, int]]:
        self._catch(np.zeros(0, np.uint64), True)
        for run in self.open:
            self._close(run)
        self.open = []
        return self.runs

    @property
    def runs(self) -> list[tuple[int, int, int]]:
        """By start, then period. A stretch belongs to its smallest period."""
        smallest: dict[tuple[int, int], int] = {}
        for start, end, period in self.ended:
            smallest[start, end] = min(period, smallest.get((start, end), period))
        return sorted((start, end, p) for (start, end), p in smallest.items())

    def _stretched(self, run: list[int]) -> bool:
        """Whether the run [start, end, period] reaches the last word."""
        step = 64
        while run[1] < self.n:
            end = min(run[1] + step, self.n)
            apart = self.words[run[1] : end] != self.words[run[1] - run[2] : end - run[2]]
            if apart.any():
                run[1] += int(apart.argmax())
                self._close(run)
                return False
            run[1], step = end, step * 2
        return True

    def _close(self, run: list[int]) -> None:
        if run[1] - run[0] >= self.repeats * run[2]:
            self.ended.append(tuple(run))

    def _catch(self, fresh: np.ndarray, last: bool) -> None:
        """Hand the new suffix hashes from level to level; fill and compare the rows they complete."""
        for level in self.levels:
            known = len(level.hashes)
            level.hashes = np.concatenate([level.hashes, fresh])
            held, width = level.hashes, level.width
            # A run of twice the words is two neighbouring runs; those of the words just added.
            begin = max(known - width, 0)
            with np.errstate(over="ignore"):
                fresh = mixed(held[begin : max(len(held) - width, 0)] * GOLDEN ^ held[begin + width :])
            if last:
                rows = -(-len(held) // width)
                held = np.concatenate([held, np.zeros((rows + 1) * width - len(held), np.uint64)])
            else:
                rows = max(len(held) // width - 1, 0)
            if not rows:
                continue
            watched = held[width : (rows + 1) * width].reshape(rows, width)
            hits = np.concatenate([level.before, watched == held[: rows * width : width, None]])
            pairs = hits[1:-1] & hits[2:]
            if pairs.any():
                row, column = np.nonzero(pairs & ~hits[:-2])
                self._report(level.base + (row - 1) * width, column + width, 2 * width)
            level.before = hits[-2:].copy()
            level.base += rows * width
            level.hashes = level.hashes[rows * width :].copy()

    def _report(self, at: np.ndarray, period: np.ndarray, length: int) -> None:
        """Squares whose period repeats over ``length`` words, two blocks, from ``at`` on.

        A run of a smaller level that holds all of a square has a divisor of its period. Two such
        runs would share more words than their periods together, so at most one holds it.
        """
        known = sorted(r for r in [*self.ended, *map(tuple, self.open)] if 2 * r[2] < length)
        if known:
            starts = np.array([k[0] for k in known])
            ends = np.maximum.accumulate([k[1] for k in known])
            place = np.searchsorted(starts, at, side="right") - 1
            new = (place < 0) | (ends[place] < at + period + length)
            at, period = at[new], period[new]
        for start, p in zip(at.tolist(), period.tolist(), strict=True):
            run = [self._leftmost(start, p, length), start + p + length, p]
            if not np.array_equal(self.words[start : start + length], self.words[start + p : start + p + length]):
                continue
            if self._stretched(run):
                self.open.append(run)

    def _leftmost(self, start: int, p: int, most: int) -> int:
        """Where the period begins; a whole block further left would have been reported earlier."""
        low = max(start - most, 0)
        apart = self.words[low:start] != self.words[low + p : start + p]
        return start - int(apart[::-1].argmax()) if apart.any() else low


def text_runs(texts: list[np.ndarray], repeats: int = REPEATS, least: int = LEAST_WORDS) -> list[list[tuple]]:
    """(start, end, period) of the runs of each text, given as 64-bit words.

    Texts whose lengths allow for the same periods pass one detector, a word of its own between any
    two of them.
    """
    found: list[list[tuple]] = [[] for _ in texts]
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(texts):
        if len(words) >= least:
            classes.setdefault((len(words) // repeats).bit_length(), []).append(i)
    for levels, members in classes.items():
        catcher = SquareCatcher(levels, repeats)
        marks = mixed(np.arange(1, len(members) + 1, dtype=np.uint64) * GOLDEN)
        stream = np.concatenate([x for i, m in zip(members, marks) for x in (texts[i], m[None])])
        starts = np.cumsum([0, *(len(texts[i]) + 1 for i in members)])
        for k in range(0, len(stream), PIECE):
            catcher.append(stream[k : k + PIECE])
        for start, end, period in catcher.finish():
            at = int(np.searchsorted(starts, start, side="right")) - 1
            if end - start >= least:
                found[members[at]].append((start - starts[at], end - starts[at], period))
    return found


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """For some documents, which word stands at each of ``n`` places once they are made to repeat.

    With h = crc32 of the decimal doc_id and g = h // 10, documents with h % 10 = 0 repeat the words
    from a = g % n on with a period of 1 + (n - a) // (3 + g % 8). Others, those without words and
    those without a doc_id stay as they are (None).
    """
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % period)


SPANS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, loops: bool = False) -> DataFrame:
    """doc_id, the runs of periodic words in the text, and the text without its repetitions.

    For every row of ``docs`` (doc_id, text): ``runs`` has (start, length, period) of every stretch
    of words that repeats with a smallest period, is at least max(6, 4 periods) long and can't be
    extended, by start, then period; words count from 0. ``collapsed`` holds the words that no run
    repeats, each run's first period stays, with one blank between. ``loops`` makes some documents
    repeat first, see ``looped``.

    A NULL or empty text has no words, no runs and collapses to nothing. Words are told apart by
    64-bit hashes. Repeated rows give repeated results; other columns are ignored; an empty table
    gives an empty result. There is no shuffle; a task holds a batch of some texts, or one long text
    with a few numbers per word.
    """
    schema = f"doc_id bigint, runs {SPANS}, collapsed string"
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, end, texts in text_batches(batch, "text"):
                joined, starts, ends, bounds = word_spans(texts)
                hashes = word_hashes(joined, starts, ends)
                sources, words = [], []
                for i in range(len(texts)):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    sources.append(looped(len(own), ids[first + i].as_py()) if loops else None)
                    words.append(own if sources[i] is None else own[sources[i]])
                found = text_runs(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        pa.array(
                            [[{"start": s, "length": e - s, "period": p} for s, e, p in runs] for runs in found],
                            kind,
                        ),
                        pa.array(
                            [_collapsed(t, src, runs) for t, src, runs in zip(texts, sources, found, strict=True)],
                            pa.string(),
                        ),
                    ],
                    names=["doc_id", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _collapsed(text: bytes, source: np.ndarray | None, runs: list[tuple]) -> str:
    words = text.split()
    if source is not None:
        words = [words[i] for i in source.tolist()]
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, end, period in runs:
            depth[start + period] += 1
            depth[end] -= 1
        stays = np.cumsum(depth[:-1]) == 0
        words = [words[i] for i in np.flatnonzero(stays).tolist()]
    return b" ".join(words).decode()


def run_digests(found: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` with the number of runs, the longest one, and hashes.

    The longest run is the first of greatest length, then smallest start and period; without runs
    its columns are NULL.
    """
    best = F.expr(
        "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS place, -r.period AS p)))"
    )
    lines = F.expr(
        "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.place")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) DIV -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
