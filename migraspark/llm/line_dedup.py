"""Fuzzy duplicate lines by MinHash over character shingles, in DataFrame functions alone.

Lines are cut into shingles of some bytes, eight unless told otherwise. One hash per shingle serves all
minima of a line (one-permutation MinHash): a minimum is the hash nearest to a centre, and takes a
hash of the next range where its own has none, so that lines of few shingles have all minima too
(densified). Bands of four minima are keys; two bands share one minimum at most. Lines that share a key
are compared on their full shingle sets, linked lines form components, and the first line of each
component is kept.

Shingles are folded in the task that has the line, and texts are moved a second time only of lines that
share a key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migraspark.llm.common import free_name, kept_table
from migraspark.llm.linking import link
from migraspark.session import prepare_session

# The characters of SPACES.
SPACE_BYTES = " \t\n\x0b\x0c\r"
SHINGLE_BYTES = 8
SIMILARITY_PERCENT = 80
# Shorter shingles and a lower limit, at which a word changed in the middle of a line of 40 to 120
# bytes leaves a link: (percent, shingle_bytes) for duplicate_lines.
WORD_EDITS = (60, 4)
# Sixteen minima make the points of a plane over four elements, and its twenty lines are the bands, of four
# minima each. Of the sets of k minima that agree, so many hold no band. At 0.8 that leaves out five
# pairs in a thousand; a lower limit takes several planes.
ROWS, POINTS, MISSED = 4, 16, 0.005
OPEN_SETS = (1, 16, 120, 560, 1800, 4128, 6688, 7200, 4440, 1120)
BROADCAST_IDS = 2_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and its 64-bit id, for lines with more than white space."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.ltrim("line", F.lit(SPACE_BYTES)) != "")
        .withColumn("node", F.xxhash64("line"))
    )


def planes_for(percent: int) -> int:
    """The planes that let a pair at ``percent`` slip with a probability of MISSED at most."""
    agree = min(percent / 100, 0.999)
    missed = sum(n * agree**k * (1 - agree) ** (POINTS - k) for k, n in enumerate(OPEN_SETS))
    return math.ceil(math.log(MISSED) / math.log(missed))


def _bands(plane: int) -> list[list[int]]:
    """The minima of each band of a plane: the lines y = m * x + c and x = c over the field of four elements."""
    times = ((0, 0, 0, 0), (0, 1, 2, 3), (0, 2, 3, 1), (0, 3, 1, 2))
    field = range(ROWS)
    sloping = [[(x, times[m][x] ^ c) for x in field] for m in field for c in field]
    upright = [[(c, y) for y in field] for c in field]
    return [[plane * POINTS + ROWS * x + y for x, y in band] for band in sloping + upright]


def _hashes(line: str, length: int) -> str:
    """The hashes of a line's shingles, in their order. The bytes of the line are bound once, not per shingle.

    A shingle is the 64-bit hash of its bytes: a one-to-one mapping of eight bytes, so sets of
    whole shingles of that length are compared exactly.
    """
    return (
        f"transform(array(CAST({line} AS BINARY)), bytes -> transform("
        f"sequence(1, greatest(octet_length(bytes) - {length - 1}, 1)), "
        f"i -> xxhash64(substring(bytes, i, {length}))))[0]"
    )


def _signed(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """node and minima (32 bits of each) of every distinct line. A hash that repeats counts once."""
    n = POINTS * planes_for(percent)
    # Evenly spaced, and apart in their lower bits, so that empty ranges take different hashes of one range.
    centres = [i * 2**64 // n + i * 0x9E3779B97F4A7C15 % (2**64 // n) - 2**63 for i in range(n)]
    rows = lines_of(docs).groupBy("node").agg(F.first("line").alias("line"))
    placed = rows.selectExpr("node", "CAST(line AS BINARY) AS bytes").selectExpr(
        "node", "bytes", f"explode(sequence(1, greatest(octet_length(bytes) - {length - 1}, 1))) AS i"
    )
    hashes = placed.selectExpr("node", f"xxhash64(substring(bytes, i, {length})) AS h")
    nearest = [F.hash(F.min(F.col("h").bitwiseXOR(F.lit(c)))).alias(f"m{i}") for i, c in enumerate(centres)]
    return hashes.groupBy("node").agg(*nearest)


def _buckets(signed: DataFrame, percent: int) -> DataFrame:
    """(bucket, node) for every band of every distinct line."""
    bands = [band for plane in range(planes_for(percent)) for band in _bands(plane)]
    keys = [F.xxhash64(F.lit(k), *[F.col(f"m{i}") for i in band]) for k, band in enumerate(bands)]
    return signed.select(F.explode(F.array(*keys)).alias("bucket"), "node")


def _small(ids: DataFrame) -> DataFrame:
    """A stored table of ids, sent to all tasks where it is short."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of the given lines; few ids go to the lines, many are met by a shuffle."""
    wanted = _small(kept_table(nodes.select("node").distinct(), "wanted-lines"))
    rows = lines_of(docs).select("node", "line").join(wanted, "node", "left_semi")
    return rows.groupBy("node").agg(F.min("line").alias("line"))


def duplicate_lines(
    docs: DataFrame, percent: int = SIMILARITY_PERCENT, shingle_bytes: int = SHINGLE_BYTES
) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0) for every doc_id of ``docs``.

    Only lines with more than white space count. Lines are linked at a Jaccard similarity of
    ``percent`` or more of their sets of shingles of ``shingle_bytes`` (a shorter line is one); of
    each component the line with the smallest (doc_id, number) stays, NULL ids before others. A
    NULL or empty text has no lines. Rows that repeat a doc_id, and rows without one, are pooled:
    their lines go by number. Other columns are ignored; an empty table gives an empty result.

    A substituted byte changes ``shingle_bytes`` shingles on each side, so the default is near-exact
    for ordinary lines; WORD_EDITS links lines of 40 to 120 bytes that differ in a word, from more
    bands and thus more work.

    Lines are told apart by 64-bit hashes. The text of a line is shuffled once, and again if it shares a
    key with another one, after equal lines of a task have met; its shingles are cut where two texts have met.
    """
    prepare_session(docs.sparkSession)
    buckets = _buckets(kept_table(_signed(docs, shingle_bytes, percent), "line-minima"), percent)
    read = []

    def texts(nodes: DataFrame) -> DataFrame:
        """The first pairs hold every line that shares a key, so the texts are read for them alone."""
        if not read:
            read.append(kept_table(_texts(docs, nodes), "line-texts"))
        return read[0]

    def verify(pairs: DataFrame) -> DataFrame:
        lines = texts(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        left = lines.select(F.col("node").alias("a"), F.col("line").alias("la"))
        right = lines.select(F.col("node").alias("b"), F.col("line").alias("lb"))
        met = pairs.join(left, "a").join(right, "b")
        cut = [F.expr(_hashes(line, shingle_bytes)).alias(line) for line in ("la", "lb")]
        return met.select("a", "b", *cut).where(
            f"100 * size(array_intersect(la, lb)) >= {percent} * size(array_union(la, lb))"
        ).select("a", "b")

    def elements(nodes: DataFrame) -> DataFrame:
        lines = texts(nodes).join(nodes, "node", "left_semi")
        return lines.select("node", F.explode(F.array_distinct(F.expr(_hashes("line", shingle_bytes)))).alias("element"))

    found = link(buckets, verify, elements, percent, light=True)
    placed = kept_table(
        lines_of(docs)
        .select("doc_id", "line_no", "node")
        .join(_small(found), "node", "left")
        .select("doc_id", "line_no", F.coalesce("component", "node").alias("class")),
        "line-classes",
    )
    first = kept_table(
        placed.groupBy("class")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("class", "first"),
        "first-lines",
    )
    stays = F.col("first").isNull() | F.col("first").eqNullSafe(F.struct("doc_id", "line_no"))
    judged = placed.join(_small(first), "class", "left").withColumn("removed", ~stays)
    per_doc = judged.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line_no")))).alias("removed"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    zero = F.lit(0).cast("long")
    return (
        ids.alias("i")
        .join(per_doc.alias("p"), F.expr("i.doc_id <=> p.doc_id"), "left")
        .select(
            "i.doc_id",
            F.coalesce("n_lines", zero).alias("n_lines"),
            F.coalesce("n_removed", zero).alias("n_removed"),
            F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        )
    )


def without_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of their texts; all columns and rows stay."""
    doc, removed = free_name(docs, "_doc"), free_name(docs, "_removed")
    chosen = decisions.select(F.col("doc_id").alias(doc), F.col("removed").alias(removed))
    kept = F.expr(
        f"array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains({removed}, i)), '\\n')"
    )
    return (
        docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[doc]), "left")
        .withColumn("text", F.when(F.size(removed) > 0, kept).otherwise(F.col("text")))
        .select(*docs.columns)
    )
