"""Near-duplicate documents by SetSketch registers.

A sketch register holds how far the smallest of exponentially distributed hash values of a set
has fallen, on a scale of powers of ``BASE``. Equal sets have equal registers, the registers of a
union are the larger ones of each side, and two registers agree with a probability that grows
with the Jaccard similarity. Bands of registers propose pairs, all registers together estimate
their similarity by maximum likelihood, and what is not clearly below the threshold is compared
on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migraspark.llm.common import kept_table
from migraspark.llm.linking import components, link
from migraspark.llm.shingles import GOLDEN, mixed, shingle_sets, text_batches

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75

# At a similarity of 0.75 a band of four registers agrees with probability 0.316, so all 32
# bands differ for 5 pairs in a million.
REGISTERS = 128
ROWS = 4
RATE, BASE, TOP = 20.0, 1.001, 65534
# A pair is dropped unseen only if the threshold is e**12 times less likely than the estimate.
LOG_RATIO = 12.0
# Ids of documents to compare are sent to all tasks up to this many (16 bytes each); beyond it
# the documents are shuffled to them.
BROADCAST_IDS = 2_000_000


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` registers (uint16) per set of 64-bit hashes; empty sets get zeros.

    Every element is a source of points in time, at rate RATE per register, each for a random
    register; a register keeps its earliest point. Points beyond the time by which all registers
    of a set have very likely seen one are not drawn; if one has not, the time is doubled.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    earliest = np.full((len(sets), m), np.inf)
    todo = np.flatnonzero(sizes)
    horizon = np.log(m * 20.0) / (RATE * np.maximum(sizes, 1))
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        time = np.zeros(len(element))
        draw = 0
        with np.errstate(over="ignore"):
            while len(element):
                draw += 1
                bits = mixed(element ^ mixed(np.array([draw], np.uint64) * GOLDEN))
                uniform = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
                time = time - np.log1p(-uniform) / (RATE * m)
                near = time <= horizon[owner]
                element, owner, time, bits = element[near], owner[near], time[near], bits[near]
                slot = owner * m + (bits % np.uint64(m)).astype(np.int64)
                np.minimum.at(earliest.reshape(-1), slot, time)
        todo = todo[np.isinf(earliest[todo]).any(axis=1)]
        earliest[todo] = np.inf
        horizon[todo] *= 2
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(earliest) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16)


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(left, right)


def log_likelihood(similarity, above, below, equal, left_share):
    """Of a similarity, given how many registers are above, below and equal."""

    def exceeds(x):
        x = np.clip(x, 0.0, 1.0)
        return -np.log1p(-x * (BASE - 1.0) / BASE) / np.log(BASE)

    right_share = 1.0 - left_share
    p_above = np.maximum(exceeds(left_share - right_share * similarity), 1e-12)
    p_below = np.maximum(exceeds(right_share - left_share * similarity), 1e-12)
    p_equal = np.maximum(1.0 - p_above - p_below, 1e-12)
    return above * np.log(p_above) + below * np.log(p_below) + equal * np.log(p_equal)


def estimated_similarity(above, below, equal, left_share, steps: int = 40):
    """The most likely Jaccard similarity (the likelihood has one peak)."""
    low = np.zeros(len(above))
    high = np.minimum(left_share / (1 - left_share), (1 - left_share) / left_share)
    for _ in range(steps):
        third = (high - low) / 3
        a, b = low + third, high - third
        rising = log_likelihood(a, above, below, equal, left_share) < log_likelihood(
            b, above, below, equal, left_share
        )
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    return (low + high) / 2


def sketches(docs: DataFrame, length: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the shingle set (d1, d2), and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_batches(batch, "text"):
                sets = shingle_sets(texts, length)
                d1 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([np.bitwise_xor.reduce(mixed(~s)) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array([r.tobytes() for r in registers(sets)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "registers"],
                )

    schema = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, registers binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def shingle_table(docs: DataFrame, length: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and its shingle set as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_batches(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(texts, length)]
                offsets = np.cumsum([0, *(len(s) for s in sets)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.ListArray.from_arrays(
                            pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets), pa.int64())
                        ),
                    ],
                    names=["doc_id", "shingles"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, shingles array<bigint>"
    )


def _those(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with the given ids, without shuffling the texts where the ids are few."""
    ids = kept_table(ids, "wanted-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(wanted, "doc_id", "left_semi")


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, registers and sizes of both) whose registers do not rule the threshold out."""
    threshold = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(
                    batch.num_rows, -1
                )
                for c in ("ra", "rb")
            )
            above, below = (left > right).sum(axis=1), (left < right).sum(axis=1)
            equal = left.shape[1] - above - below
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            share = na / (na + nb)
            best = estimated_similarity(above, below, equal, share)
            most = np.minimum(na, nb) / np.maximum(na, nb)
            at = np.minimum(threshold, most)
            lost = log_likelihood(best, above, below, equal, share) - log_likelihood(
                at, above, below, equal, share
            )
            keep = (best >= threshold) | (lost <= LOG_RATIO)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, length: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    A document's set holds its distinct runs of ``length`` words, with A-Z as a-z; fewer words
    make one run; no words or a NULL text make an empty set, linked with nothing. Documents are
    linked at a Jaccard similarity of ``percent`` or more, and component_id is the smallest
    doc_id reachable. Rows that repeat a doc_id are one node of the graph and all returned. Rows
    without a doc_id are linked with nothing, have no component and are kept. Other columns are
    ignored, an empty table gives an empty result.

    Documents with equal sets are one class, found by a 128-bit fingerprint; only one document
    per class is banded and compared. Comparison is on sets of 64-bit hashes.
    """
    sketched = kept_table(sketches(docs, length), "sketches")
    usable = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = kept_table(
        usable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes"
    )
    first = kept_table(
        usable.join(
            classes.select("d1", "d2", F.col("node").alias("doc_id")), ["doc_id", "d1", "d2"]
        ).select(F.col("doc_id").alias("node"), "n_shingles", "registers"),
        "class-sketches",
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)))
    buckets = (
        first.select("node", "registers", band.alias("band"))
        .withColumn("part", F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})"))
        .select(F.xxhash64("band", "part").alias("bucket"), "node")
    )

    def verify(pairs: DataFrame) -> DataFrame:
        def side(name: str) -> DataFrame:
            return first.select(
                F.col("node").alias(name),
                F.col("n_shingles").alias(f"n{name}"),
                F.col("registers").alias(f"r{name}"),
            )

        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        possible = sized.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        candidates = kept_table(
            likely(possible.select("a", "b", "na", "nb", "ra", "rb"), percent).distinct(),
            "candidates",
        )
        ids = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = kept_table(shingle_table(_those(docs, ids), length), "candidate-sets")
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        return (
            candidates.join(left, "a")
            .join(right, "b")
            .withColumn("common", F.size(F.array_intersect("sa", "sb")))
            .where(f"100 * common >= {percent} * (size(sa) + size(sb) - common)")
            .select("a", "b")
        )

    def elements(nodes: DataFrame) -> DataFrame:
        sets = shingle_table(_those(docs, nodes.select(F.col("node").alias("doc_id"))), length)
        return sets.select(F.col("doc_id").alias("node"), F.explode("shingles").alias("element")).distinct()

    found = link(buckets, verify, elements, percent)
    labelled = kept_table(
        classes.join(found, "node", "left").select(
            "d1", "d2", F.coalesce("component", "node").alias("class_component")
        ),
        "class-components",
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    judged = kept_table(
        sketched.join(labelled, ["d1", "d2"], "left").select(
            "doc_id", "n_shingles", component.alias("component_id")
        ),
        "document-components",
    )
    # The rows of a doc_id may lie in several classes; they are one node, which joins the classes.
    seen = (
        judged.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("component_id").alias("a"), F.max("component_id").alias("z"))
        .where("a < z")
    )
    spanning = kept_table(seen.select("doc_id", "a"), "spanning-documents")
    if not spanning.isEmpty():
        links = judged.join(spanning, "doc_id").select("a", F.col("component_id").alias("b")).where("a <> b")
        moved = components(links).withColumnsRenamed({"node": "component_id", "component": "joined"})
        judged = judged.join(moved, "component_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("joined", "component_id").alias("component_id")
        )
    return judged.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
