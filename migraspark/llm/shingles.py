"""Hashes of words and of runs of words, computed for whole batches of texts at once (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 18
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a batch with their texts as bytes, a bounded number of bytes at a time.

    A NULL text is empty. A single text above the bound makes a range of its own.
    """
    texts = batch.column(column).cast(pa.large_binary())
    start, size, held = 0, 0, []
    for row in range(batch.num_rows):
        text = texts[row].as_py() or b""
        if held and size + len(text) > BATCH_BYTES:
            yield start, row, held
            start, size, held = row, 0, []
        held.append(text)
        size += len(text) + 1
    if held:
        yield start, batch.num_rows, held


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, bounds) of all words; bounds[i]:bounds[i + 1] are the words of text i."""
    joined = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    edges = np.diff(_SPACE[joined].astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return joined, starts, ends, bounds


def word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, the same in every batch; words are read eight bytes at a time."""
    eights = np.ndarray((max(len(joined) - 7, 0),), "<u8", joined.data, strides=(1,))
    lengths = ends - starts
    hashes = mixed(lengths.astype(np.uint64))
    short = np.flatnonzero(lengths <= LONG_WORD)
    offset = 0
    with np.errstate(over="ignore"):
        while len(short):
            left = lengths[short] - offset
            piece = eights[starts[short] + offset]
            unused = np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)
            piece = (piece << unused) >> unused
            hashes[short] = mixed(hashes[short] ^ piece)
            short, offset = short[left > 8], offset + 8
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]].tobytes())
    return hashes


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for every run of ``length`` words; a shorter text is one run as a whole."""
    n = len(words)
    if n == 0:
        return words
    if n < length:
        length = n
    with np.errstate(over="ignore"):
        total = np.full(n - length + 1, np.uint64(length))
        for k in range(length):
            weight = mixed(np.array([k + 1], np.uint64)) | np.uint64(1)
            total += words[k : n - length + 1 + k] * weight
    return mixed(total)


def shingle_sets(texts: list[bytes], length: int) -> list[np.ndarray]:
    """The distinct word runs of each text as ascending hashes; A-Z count as a-z."""
    joined, starts, ends, bounds = word_spans([t.lower() for t in texts])
    hashes = word_hashes(joined, starts, ends)
    return [
        np.unique(run_hashes(hashes[a:b], length)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]
