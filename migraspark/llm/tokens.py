"""Token counts of texts of any length by overlap resynchronisation.

A text up to a chunk long is encoded whole. A longer one is encoded in overlapping chunks with
offsets. Two neighbouring chunks are spliced at a place inside their overlap where both begin a
token and where the text proves that no token of the whole text spans it and that both sides are
tokenized alone as they are together. If the overlap has no such place it is widened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OVERLAP = 1 << 8
LIMIT = 512
BATCH_CHARS = 1 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once per worker; it works in the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def stable(text: str, at: int) -> bool:
    """Whether a token boundary at ``at`` depends on nothing but its two characters.

    The pre-tokenizer of byte-level vocabularies keeps letters, digits, other signs and white
    space in separate pieces, a single blank going before the piece it leads, and it scans from
    left to right. A piece never goes on from a sign that is no white space into white space, so
    such a place ends a piece whatever stands further left or right; merging stays inside pieces.
    Both must be ASCII, whose class no tokenizer doubts, and the white space a blank or a line feed. A special string has no
    white space inside and takes none from its sides.
    """
    left, right = text[at - 1], text[at]
    return right in " \n" and left.isascii() and left.isprintable() and left != " "


def count_tokens(text: str, loaded, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, encoding at most a chunk and an overlap at a time."""
    if len(text) <= chunk:
        return len(loaded.encode(text, add_special_tokens=False).ids)
    total, start = 0, 0
    while True:
        end = min(start + chunk, len(text))
        left = loaded.encode(text[start:end], add_special_tokens=False)
        if end == len(text):
            return total + len(left.ids)
        width = min(overlap, chunk // 2)
        while True:
            begin = max(end - width, start + 1)
            stop = min(end + width, len(text))
            right = loaded.encode(text[begin:stop], add_special_tokens=False)
            starts = {begin + a for a, _ in right.offsets}
            common = [
                (k, start + a)
                for k, (a, _) in enumerate(left.offsets)
                if start + a > begin and start + a in starts and stable(text, start + a)
            ]
            if common:
                break
            if begin == start + 1 and stop == len(text):
                return total + len(loaded.encode(text[start:], add_special_tokens=False).ids)
            if begin == start + 1:  # no place in the chunk at all: the chunk itself grows
                end = min(start + 2 * (end - start), len(text))
                left = loaded.encode(text[start:end], add_special_tokens=False)
                if end == len(text):
                    return total + len(left.ids)
            width *= 2
        tokens, at = common[-1]
        total, start = total + tokens, at


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs`` (doc_id, text).

    ``path`` is the vocabulary file, present on every executor. A NULL or empty text has no bytes
    and no tokens. Special strings inside a text become special tokens, none are added. Repeated
    rows give repeated results, other columns are ignored, an empty table gives an empty result.
    There is no shuffle; a task holds one batch of texts, and encodings of a chunk at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = tokenizer(path)
        for batch in batches:
            counts = [0] * batch.num_rows
            texts = batch.column("text")
            rows: list[int] = []
            held: list[str] = []
            size = 0

            def flush():
                encoded = loaded.encode_batch_fast(held, add_special_tokens=False)
                for row, e in zip(rows, encoded, strict=True):
                    counts[row] = len(e)
                rows.clear()
                held.clear()

            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                if len(text) > chunk:
                    counts[row] = count_tokens(text, loaded, chunk, overlap)
                    continue
                rows.append(row)
                held.append(text)
                size += len(text)
                if size > BATCH_CHARS:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    counted = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
