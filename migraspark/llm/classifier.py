"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. The field scores each line by its own features and those of the lines
before and after it, and each pair of neighbouring labels; forward-backward gives the marginal
of every line, and their mean, weighted by line length, is the quality of the document. Only
whole documents are labelled, so in training each line carries its document's label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Documents to fit on: those with the smallest hashes of their id, a uniform sample.
TRAINING_DOCS = 2000
STEPS = 300
RIDGE = 1e-5
THRESHOLD = 0.3

_ECHO = re.compile(rb"(?:^| )(\S+)(?: \1(?= |$))+")
_LETTERS = np.zeros(256, bool)
_LETTERS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTERS[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_CLASSES = np.stack(
    [_LETTERS, _UPPER, _DIGIT, _SPACE, ~(_LETTERS | _DIGIT | _SPACE), _END]
    + [np.arange(256) == ord(c) for c in "!|#"]
).astype(np.int64)
_CODES = (1 << np.arange(len(_CLASSES))) @ _CLASSES

OWN = 13  # features of a line; with both neighbours and a constant: 3 * OWN + 1


# Lines looked at together; what is computed per line beyond its score lives no longer than these.
BLOCK_LINES = 20_000
SLICE_BYTES = 1 << 18


def line_blocks(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, lengths) of the lines that hold more than white space, some lines at a time."""
    seen: set[int] = set()
    held: list[bytes] = []
    start = 0
    while start <= len(text):
        end = text.find(b"\n", start)
        end = len(text) if end < 0 else end
        line = text[start:end]
        start = end + 1
        if line and not line.isspace():
            held.append(line)
        if len(held) == BLOCK_LINES:
            yield _block_features(held, seen)
            held = []
    if held:
        yield _block_features(held, seen)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of all lines that hold more than white space."""
    blocks = list(line_blocks(text))
    if not blocks:
        return np.zeros((0, OWN)), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*blocks, strict=True))


def _block_features(lines: list[bytes], seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """``seen`` holds the hashes of the lines before, and is added to."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    code = _CODES[np.frombuffer(b"".join(lines), np.uint8)]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    counts = [np.add.reduceat((code >> k) & 1, starts) for k in range(len(_CLASSES))]
    letters, upper, digits, spaces, marks, ends, exclaim, bars, hashes = counts
    words = spaces + 1.0
    again, distinct, echoes, at_end = np.zeros((4, len(lines)))
    for i, line in enumerate(lines):
        known = xxhash.xxh3_64_intdigest(line)
        again[i] = known in seen
        seen.add(known)
        w = line.split()
        distinct[i] = len(set(w)) / len(w)
        echoes[i] = sum(a == b for a, b in zip(w, w[1:])) / len(w)
        at_end[i] = w[-1][-1] in b".!?"
    features = np.stack(
        [
            np.log1p(lengths) / 5,
            letters / lengths,
            upper / np.maximum(letters, 1),
            digits / lengths,
            np.minimum(marks / words, 4) / 2,
            np.minimum(ends / words, 1),
            np.minimum(exclaim / words, 2),
            np.minimum(bars / words, 2),
            np.minimum(hashes / words, 2),
            again,
            distinct,
            echoes,
            at_end,
        ],
        axis=1,
    )
    return features, lengths.astype(float)


def with_neighbours(features: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and the one after (zeros beyond the ends)."""
    n = len(features)
    out = np.zeros((n, 3 * OWN + 1))
    out[:, :OWN] = features
    out[1:, OWN : 2 * OWN] = features[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = features[1:]
    out[:, -1] = 1.0
    return out


def line_scores(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, lengths) of the lines of a text: ``with_neighbours(features) @ weights``, with three
    numbers per line held instead of three times its features."""
    parts = [(f @ weights[:-1].reshape(3, OWN).T, lengths) for f, lengths in line_blocks(text)]
    if not parts:
        return np.zeros(0), np.zeros(0)
    products, lengths = (np.concatenate(part) for part in zip(*parts, strict=True))
    scores = products[:, 0] + weights[-1]
    scores[1:] += products[:-1, 1]
    scores[:-1] += products[1:, 2]
    return scores, lengths


def marginals(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, counts: bool = True):
    """Forward-backward over many chains at once.

    ``scores`` are the scores of label 1 against label 0 of all lines, chains one after another;
    chain i starts at first[i], first[-1] is the end. Returns the marginals of label 1, the
    expected counts of the four transitions (None without ``counts``), and the log of the normalizers. The k-th lines of
    all chains that have one are handled together.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    n = len(scores)
    unary = np.zeros((n, 2))
    unary[:, 1] = scores
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    deepest = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -k, side="left")) for k in range(deepest)]
    for k in range(deepest):
        at = begin[: alive[k]] + k
        if k == 0:
            forward[at] = unary[at]
        else:
            forward[at] = unary[at] + np.logaddexp.reduce(
                forward[at - 1][:, :, None] + transition[None], axis=1
            )
    for k in range(deepest - 2, -1, -1):
        at = begin[: alive[k + 1]] + k
        backward[at] = np.logaddexp.reduce(
            transition[None] + (unary[at + 1] + backward[at + 1])[:, None, :], axis=2
        )
    total = np.logaddexp.reduce(forward + backward, axis=1)
    good = np.exp(forward[:, 1] + backward[:, 1] - total)
    if not counts:
        return good, None, total[begin[lengths > 0]]
    inner = np.ones(n, bool)
    inner[begin[lengths > 0]] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(
        forward[at - 1][:, :, None]
        + transition[None]
        + (unary[at] + backward[at])[:, None, :]
        - total[at][:, None, None]
    ).sum(axis=0)
    return good, pairs, total[begin[lengths > 0]]


class Model:
    """Weights of the line features and of the transitions between labels."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, prior: float):
        self.weights, self.transition, self.prior = weights, transition, prior

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; the prior for texts without a line."""
        parts = [line_scores(t, self.weights) for t in texts]
        counts = np.array([len(length) for _, length in parts])
        first = np.concatenate(([0], np.cumsum(counts)))
        lines, lengths = (np.concatenate(part) for part in zip(*parts, strict=True))
        good, _, _ = marginals(lines, first, self.transition, counts=False)
        owner = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(owner, lengths, len(texts))
        quality = np.bincount(owner, lengths * good, len(texts)) / np.maximum(total, 1)
        return np.where(counts > 0, np.clip(quality, 0.0, 1.0), self.prior)


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by full-batch Adam; the same input gives the same model.

    Chains are weighted to a mean line likelihood. No labelled text at all gives an indifferent
    model.
    """
    parts = [line_features(t)[0] for t in texts]
    prior = (float(np.sum(labels)) + 1.0) / (len(labels) + 2.0)
    used = [i for i, p in enumerate(parts) if len(p)]
    size = 3 * OWN + 1
    if not used:
        return Model(np.append(np.zeros(size - 1), np.log(prior / (1 - prior))), np.zeros((2, 2)), prior)
    x = np.concatenate([with_neighbours(parts[i]) for i in used])
    counts = np.array([len(parts[i]) for i in used])
    first = np.concatenate(([0], np.cumsum(counts)))
    y = np.repeat(np.asarray(labels, float)[used], counts)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    seen = np.array([[np.sum(1 - y[inner]), 0.0], [0.0, np.sum(y[inner])]])
    weights, moments = np.zeros(size + 4), np.zeros((2, size + 4))
    for step in range(1, steps + 1):
        transition = weights[size:].reshape(2, 2)
        good, pairs, _ = marginals(x @ weights[:size], first, transition)
        gradient = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(x)
        gradient -= RIDGE * weights
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        weights = weights + 0.1 * (moments[0] / (1 - 0.9**step)) / (
            np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8
        )
    return Model(weights[:size], weights[size:].reshape(2, 2), prior)


def held_out(doc_id=None):
    """Whether a document's id keeps its label out of training."""
    return F.coalesce(F.crc32((doc_id if doc_id is not None else F.col("doc_id")).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """A model from at most ``most`` labelled documents, on the driver.

    Only rows whose crc32(doc_id) mod 5 is not 0 are used. A document labelled several times
    counts as bad if any label says so, one with several texts is read by the text of the smallest
    hash; NULL ids, texts and labels are left out.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    wanted = F.broadcast(chosen)  # at most ``most`` rows
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where("text IS NOT NULL")
        .join(wanted, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], float))


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of ranges of rows with few bytes and few lines, or of one text."""
    held, start, size, lines = [], 0, 0, 0
    for row in range(len(texts)):
        text = texts[row].as_py() or b""
        more = text.count(b"\n") + 1
        if held and (size + len(text) > SLICE_BYTES or lines + more > BLOCK_LINES):
            yield start, held
            held, start, size, lines = [], row, 0, 0
        held.append(text)
        size, lines = size + len(text), lines + more
    if held:
        yield start, held


def classify(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """All columns of ``docs`` with score and predicted, under ``names``, which replace others.

    The text alone is looked at. A text without lines of more than white space, or NULL, scores
    the share of label 1 in training. Rows are judged alone: repeated rows get repeated results.
    An empty table gives an empty result. There is no shuffle. A task holds a slice of some texts,
    with about a hundred bytes per line of it.
    """
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start, held in slices(batch.column("text").cast(pa.large_binary())):
                scores[start : start + len(held)] = model.score(held)
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), predicted], names=[*batch.schema.names, *names]
            )
            pa.default_memory_pool().release_unused()

    added = StructType().add(names[0], "double").add(names[1], "integer")
    schema = StructType([*kept.schema.fields, *added.fields])
    return kept.mapInArrow(run, schema)
