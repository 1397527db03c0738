"""Repair of the structure of conversations by a Viterbi search that settles edits as it goes.

A conversation should read ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn.
Its turns pass once, in order, through the states of that pattern. Each state keeps its cheapest way
of editing what has been read, as a leaf of a tree of back pointers whose nodes count their
references. As soon as all leaves hang below one node the edits up to it are settled: they are
written out and forgotten, with the turns they belong to. Equally cheap ways are told apart by
their complete unsettled edits.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from migraspark.llm.common import SPACES

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

# The pattern (s?(ua)+)? as states, named by the last role, "" before any.
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ENDS = ("", "a")
# The one of user and assistant that may come after each state.
SPOKEN = {state: next(r for r in ROLES if r in after) for state, after in NEXT.items()}


class Node:
    """An edit on the way to some survivors; ``refs`` counts its children and survivors."""

    __slots__ = ("letter", "state", "parent", "refs")

    def __init__(self, letter: str, state: str, parent: Node | None):
        self.letter, self.state, self.parent, self.refs = letter, state, parent, 0
        if parent is not None:
            parent.refs += 1


def _released(node: Node | None) -> None:
    """Give up one reference; nodes without any fall away."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


class Repair:
    """The cheapest edits of one conversation, fed turn by turn.

    ``push`` and ``finish`` return settled edits as (letter, role initial). Between calls the tree
    holds unsettled edits only.
    """

    def __init__(self):
        self.root = Node("", "", None)
        self.survivors: dict[str, tuple[int, Node]] = {}
        self._hold("", 0, self.root)
        self._insertions()

    def _hold(self, state: str, cost: int, node: Node) -> None:
        node.refs += 1
        old = self.survivors.get(state)
        self.survivors[state] = (cost, node)
        if old is not None:
            _released(old[1])

    def _suffix(self, node: Node) -> str:
        """The unsettled letters up to ``node``."""
        letters = []
        while node is not self.root:
            letters.append(node.letter)
            node = node.parent
        return "".join(reversed(letters))

    def _better(self, cost: int, node: Node, letter: str, than) -> bool:
        if than is None or cost != than[0]:
            return than is None or cost < than[0]
        other = self._suffix(than[1]) + (than[2] if len(than) == 3 else "")
        return self._suffix(node) + letter < other

    def _insertions(self) -> None:
        """Ways that end in inserted turns, until no state gains by another."""
        todo = deque(self.survivors)
        while todo:
            state = todo.popleft()
            cost, node = self.survivors[state]
            target = SPOKEN[state]
            if self._better(cost + INSERT_COST, node, INSERT, self.survivors.get(target)):
                self._hold(target, cost + INSERT_COST, Node(INSERT, target, node))
                todo.append(target)

    def push(self, initial: str, must_go: bool, truncated: bool) -> list[tuple[str, str]]:
        """Read a turn: its role's initial, whether it has to be deleted, whether it is cut off."""
        best: dict[str, tuple[int, Node, str]] = {}

        def offer(state: str, cost: int, node: Node, letter: str) -> None:
            if self._better(cost, node, letter, best.get(state)):
                best[state] = (cost, node, letter)

        extra = TRUNCATED_COST if truncated else 0
        for state, (cost, node) in self.survivors.items():
            offer(state, cost + DELETE_COST, node, DELETE)
            if not must_go:
                offer(SPOKEN[state], cost + REROLE_COST + extra, node, REROLE)
                if initial in NEXT[state]:
                    offer(NEXT[state][initial], cost + extra, node, KEEP)
        old = [node for _, node in self.survivors.values()]
        self.survivors = {}
        for state, (cost, node, letter) in best.items():
            self._hold(state, cost, Node(letter, state, node))
        for node in old:
            _released(node)
        self._insertions()
        self._drop("s", 0)
        self._drop("", DELETE_COST)
        return self._settled()

    def _drop(self, state: str, lead: int) -> None:
        """Give up a state once it is more than ``lead`` dearer than having ended with an answer.

        Whatever may follow a system turn may follow an answer. What may follow the beginning may
        follow an answer too, but for a system turn, which can be deleted then. Without this the
        beginning, with all turns deleted, would keep every edit unsettled.
        """
        if state in self.survivors and "a" in self.survivors:
            cost, node = self.survivors[state]
            if cost > self.survivors["a"][0] + lead:
                del self.survivors[state]
                _released(node)

    def _settled(self) -> list[tuple[str, str]]:
        """The edits that all survivors share; they leave the tree."""
        if self.root.refs != 1:
            return []
        chain = []
        node = next(iter(self.survivors.values()))[1]
        while node is not self.root:
            chain.append(node)
            node = node.parent
        edits = []
        while chain and self.root.refs == 1:
            self.root = chain.pop()
            self.root.parent = None
            edits.append((self.root.letter, self.root.state))
        return edits

    def finish(self) -> list[tuple[str, str]]:
        """The rest of the best way that ends the pattern."""
        best = None
        for state in ENDS:
            if state in self.survivors and self._better(*self.survivors[state], "", best):
                best = self.survivors[state]
        edits, node = [], best[1]
        while node is not self.root:
            edits.append((node.letter, node.state))
            node = node.parent
        return edits[::-1]


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy after reproducible damage by crc32(``conv_id:turn``) % 20.

    0 drops the turn, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role
    user. A missing value counts as one blank, in the key, as role and as text; conv_id and turn
    themselves stay NULL.
    """
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"),
        _spaced("text").alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy"),
    )


def repaired(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation of ``conversations`` (conv_id, turn, role, text), in order.

    Columns: conv_id, turn, old_role, fault (blank, duplicate, truncated or NULL), edit (Keep,
    Rerole, Delete or Insert by initial), role and text after it (NULL where deleted). Turns go by
    turn, NULLs first, then role and text; they are blank without a word, duplicate if role and text
    stood before in the conversation, truncated if the last character that is no white space is
    none of ``.!?``. Blank and duplicate turns are deleted. The edits are the cheapest that give
    ``(s?(ua)+)?``, of those the ones whose initials read smallest.

    A missing role or text is one blank; rows without a conv_id are one conversation. Repeated rows
    are duplicates. Other columns are ignored, an empty table gives an empty result. There is one
    shuffle, by conversation; a task streams its sorted turns and holds unsettled ones only, so a
    conversation of any length fits, but is read by one task, as each edit hangs on those before.
    Rows of a conversation are in order and in one partition of the result.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"),
        _spaced("text").alias("text"),
    ).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*order[:1])) > 1
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACES}]"), "blank")
        .when(F.col("seen"), "duplicate")
        .when(~F.col("text").rlike(f"[.!?][{SPACES}]*\\z"), "truncated")
    )
    rows = (
        turns.withColumn("seen", seen)
        .select("conv_id", "turn", "role", "text", fault.alias("fault"))
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
    )
    schema = StructType(
        [turns.schema["conv_id"], *StructType().add("turn", "long").add("old_role", "string")
         .add("fault", "string").add("edit", "string").add("role", "string").add("text", "string")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, repair, held = None, None, deque()

        def write(edits) -> None:
            for letter, state in edits:
                if letter == INSERT:
                    out.append((current, None, None, None, letter, ROLES[state], ""))
                    continue
                turn, role, text, fault = held.popleft()
                if letter == DELETE:
                    after = (None, None)
                else:
                    after = (role if letter == KEEP else ROLES[state], text)
                out.append((current, turn, role, fault, letter, *after))

        for batch in batches:
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if repair is None or conv != current:
                    if repair is not None:
                        write(repair.finish())
                    current, repair = conv, Repair()
                held.append((turn, role, text, fault))
                write(repair.push(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            yield _batch(out, batch.schema.field("conv_id").type)
            out.clear()
        if repair is not None:
            write(repair.finish())
            yield _batch(out, batch.schema.field("conv_id").type)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "turn", "old_role", "fault", "edit", "role", "text"]
    kinds = [kind, pa.int64(), *[pa.string()] * 5]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
    )


class _Digest:
    """What is reported of one conversation, folded edit by edit."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = None
        self.distinct = self.illegal = self.cost = 0
        self.before, self.audit, self.lines = None, [], 0
        self.hash = hashlib.sha256()

    def add(self, turn, old_role, fault, edit, role, text) -> None:
        self.audit.append(edit)
        if edit != INSERT:
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.distinct += turn != self.high
                self.high = turn
            if self.before is not None:
                self.illegal += self.before + old_role[:1] not in ("su", "ua", "au")
            self.before = old_role[:1]
            if fault:
                self.faults[fault] += 1
        self.cost += {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[edit]
        self.cost += TRUNCATED_COST * (fault == "truncated" and edit != DELETE)
        if edit != DELETE:
            self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (
            gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit),
            self.hash.hexdigest(),
        )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summarised(edits: DataFrame) -> DataFrame:
    """A row per conversation of the result of ``repaired``: its faults before, cost and edits.

    gaps counts missing turn numbers, illegal the neighbours whose role initials are not su, ua or
    au; audit holds the initials of the edits, repaired_sha256 is of the remaining ``role:text``
    lines. ``edits`` must come as ``repaired`` gives it, in order and unmoved: there is no shuffle.
    """
    schema = StructType([edits.schema["conv_id"]])
    for name in COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def done(rows, kind):
            kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names
            )

        for batch in batches:
            rows = []
            for conv, *edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        rows.append((current, *digest.row()))
                    current, digest = conv, _Digest()
                digest.add(*edit)
            yield done(rows, batch.schema.field("conv_id").type)
        if digest is not None:
            yield done([(current, *digest.row())], batch.schema.field("conv_id").type)

    return edits.mapInArrow(run, schema)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the summary of its repair after ``damaged``.

    A conversation that lost all turns has zeros, no edits and the hash of nothing.
    """
    found = summarised(repaired(damaged(conversations)))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    empty = hashlib.sha256().hexdigest()
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
