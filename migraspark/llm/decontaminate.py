"""Benchmark passages in documents, by the CGK random walk and bit sampling.

A walk starts at a word, writes the word it stands on at every step and moves on by zero or one
word, as a random bit of the step and the word says. Walks over two texts a few word edits apart
fall into step again soon after each edit, so their outputs differ in few places: edit distance
has become Hamming distance. Each repetition samples four steps of the output as a key, for every
window of the documents and for every item; windows whose keys agree with an item's are compared
with it by exact edit distance. Repetitions differ in their bits, in the steps sampled and in
where in the item they start, which brings the recall to its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migraspark.llm.shingles import mixed, text_batches, word_hashes

# Word edits allowed per hundred words of the item. With twelve repetitions 99 in 100 copies with
# one edit, and nearly all with edits up to the limit in long items, share a key; plain copies
# always do (measured in the tests).
EDIT_PERCENT = 10
REPETITIONS = 12
OFFSETS = (0.0, 0.25, 0.5)
# The share of a window's words that its sampled steps may walk over on average.
REACH = 0.6
SHORT_ITEM = 8
TABLE_BITS = 20
HELD_BITS = 22
CHECKED = 20_000
BLOCK_ITEMS = 5000

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD[128:] = True


def normal_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of all words, each text followed by a 0; text i begins at first[i].

    Words are runs of letters and digits in lower case; every sign beyond ASCII counts as a letter.
    """
    lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    joined = np.frombuffer(b" ".join(lowered) + b" " * 9, np.uint8)
    edges = np.diff(_WORD[joined].astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    hashes = word_hashes(joined, starts, ends) | np.uint64(1)
    return np.insert(hashes, bounds[1:], 0), bounds + np.arange(len(bounds))


def _walked(bits: np.ndarray, at: np.ndarray, begin: int, end: int) -> np.ndarray:
    for step in range(begin, end):
        at = at + ((bits[at] >> np.uint64(63 - step % 48)) & np.uint64(1)).astype(np.int64)
    return at


def _joined_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(key * np.uint64(0x2545F4914F6CDD1D) + word)


def _short(words: np.ndarray) -> np.ndarray:
    """Few bits of each word, an index for tables of yes and no."""
    return (words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return ((one * 0x9E3779B1) ^ two) & ((1 << TABLE_BITS) - 1)


class Sampler:
    """The keys of a block of items for every repetition, and the search for windows with them."""

    def __init__(self, items: list[np.ndarray], repetitions: int = REPETITIONS):
        self.items = items
        words = np.concatenate([np.append(i, np.uint64(0)) for i in items])
        first = np.concatenate(([0], np.cumsum([len(i) + 1 for i in items])))[:-1]
        sizes = np.array([len(i) for i in items])
        level = np.where(sizes < SHORT_ITEM, 0, np.log2(np.maximum(sizes, 1)).astype(int))
        keyed = np.zeros(len(items), int)
        random = np.random.default_rng(7)
        scrambled = self._scrambled(words)
        self.plans = []
        for repetition in range(repetitions):
            seed = np.uint64(random.integers(1, 2**63)) | np.uint64(1)
            offset = OFFSETS[repetition % len(OFFSETS)]
            one = int(random.integers(0, 2))
            two = one + int(random.integers(1, 3))
            bits = scrambled * seed
            singles, pairs = (np.zeros(1 << TABLE_BITS, bool) for _ in range(2))
            sampled = []
            for c in sorted(set(level[level > 0].tolist())):
                chosen = np.flatnonzero(level == c)
                skip = (offset * sizes[chosen]).astype(int)
                steps = max(int(2 * REACH * (1 - offset) * 2**c), two + 3)
                middle = (two + steps) // 2
                three = int(random.integers(two + 1, middle + 1))
                four = int(random.integers(middle + 1, steps + 1))
                places = self._places(bits, first[chosen] + skip, (0, one, two, three, four))
                valid = words[places[-1]] != 0
                seen = [words[at[valid]] for at in places]
                singles[_short(seen[0])] = True
                pairs[_pair(_short(seen[0]), _short(seen[1]))] = True
                keyed[chosen] += valid
                key = self._key(seen)
                order = np.argsort(key, kind="stable")
                sampled.append((three, four, key[order], chosen[valid][order], skip[valid][order]))
            self.plans.append((seed, one, two, singles, pairs, sampled))
        self.sizes = sizes
        self.held = np.zeros(1 << HELD_BITS, bool)
        owner = np.repeat(np.arange(len(items)), sizes)
        self.held[self._held_at(owner, words[words != 0])] = True
        self.rest = np.flatnonzero((keyed == 0) & (sizes > 0))  # found by their first word
        self.rest_words = np.array([items[i][0] for i in self.rest], np.uint64)

    @staticmethod
    def _scrambled(words: np.ndarray) -> np.ndarray:
        """What a repetition multiplies by its seed to get the bits of all steps."""
        scrambled = mixed(words)
        scrambled[words == 0] = 0  # a walk stays at the end of its text
        return scrambled

    @staticmethod
    def _places(bits: np.ndarray, at: np.ndarray, steps: tuple[int, ...]) -> list[np.ndarray]:
        """Where walks from ``at``, begun at the first of the steps, stand at the others."""
        places = []
        for begin, end in zip(steps[:-1], steps[1:], strict=True):
            at = _walked(bits, at, begin, end)
            places.append(at)
        return places

    @staticmethod
    def _key(seen: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(seen[0]), np.uint64)
        for word in seen:
            key = _joined_key(key, word)
        return key

    @staticmethod
    def _held_at(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        high = (words >> np.uint64(64 - HELD_BITS)).astype(np.int64)
        return ((item * 0x9E3779B1) ^ high) & ((1 << HELD_BITS) - 1)

    def possible(self, words, low, high, item, edits) -> np.ndarray:
        """Whether the regions low:high hold enough words of the items; true for every match."""
        lengths = np.maximum(high - low, 0)
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - lengths), lengths)
        known = self.held[self._held_at(np.repeat(item, lengths), words[at])]
        total = np.concatenate(([0], np.cumsum(known)))
        return total[ends] - total[ends - lengths] >= self.sizes[item] - edits[item]

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(where the item would begin, item) of all windows that share a key with an item.

        Windows whose first sampled word, or first two, no item has at these steps are left
        early; this loses none, as they could not share a key.
        """
        everywhere = np.flatnonzero(words)
        scrambled, short = self._scrambled(words), _short(words)
        short_here = short[everywhere]
        for seed, one, two, singles, pairs, sampled in self.plans:
            bits = scrambled * seed
            if one == 0:
                begin = at = everywhere[singles[short_here]]
            else:
                at = _walked(bits, everywhere, 0, one)
                hit = np.flatnonzero(singles[short[at]])
                begin, at = everywhere[hit], at[hit]
            second = _walked(bits, at, one, two)
            hit = np.flatnonzero(pairs[_pair(short[at], short[second])])
            begin, at, second = begin[hit], at[hit], second[hit]
            for three, four, keys, chosen, skip in sampled:
                third, fourth = self._places(bits, second, (two, three, four))
                full = self._key([words[p] for p in (at, second, third, fourth)])
                low, high = np.searchsorted(keys, full, "left"), np.searchsorted(keys, full, "right")
                same = np.flatnonzero(high > low)
                while len(same):
                    which = low[same]
                    yield begin[same] - skip[which], chosen[which]
                    low[same] += 1
                    same = same[high[same] > low[same]]
        for item, word in zip(self.rest, self.rest_words, strict=True):
            begin = np.flatnonzero(words == word)
            yield begin, np.full(len(begin), item)


def fewest_edits(item: np.ndarray, region: np.ndarray, limit: int = 2**31) -> int:
    """The smallest number of word edits that turn the item into some part of the region.

    The least of a row never falls from one row to the next, so beyond ``limit`` it is returned.
    """
    least, row = 0, np.zeros(len(region) + 1, np.int64)
    steps = np.arange(len(region) + 1)
    for k, word in enumerate(item):
        cost = np.empty_like(row)
        cost[0] = k + 1
        cost[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(cost - steps) + steps
        least = int(row.min())
        if least > limit:
            break
    return least


def _matches(sampler: Sampler, edits: np.ndarray, texts: list[bytes]) -> dict[tuple[int, int], int]:
    """(text, item) -> the fewest edits found, within the item's limit."""
    words, first = normal_words(texts)
    best: dict[tuple[int, int], int] = {}
    tried: set[tuple[int, int]] = set()
    for all_begin, all_item in sampler.candidates(words):
        for part in range(0, len(all_begin), CHECKED):
            begin, item = all_begin[part : part + CHECKED], all_item[part : part + CHECKED]
            # A window may begin before its text, where the item's first words are missing.
            text = np.searchsorted(first, np.maximum(begin, 0) + sampler.sizes[item] // 2, "right") - 1
            text = np.clip(text, 0, len(texts) - 1)
            low = np.maximum(begin - edits[item], first[text])
            high = np.minimum(begin + sampler.sizes[item] + edits[item], first[text + 1] - 1)
            keep = np.flatnonzero(sampler.possible(words, low, high, item, edits))
            for k in keep.tolist():
                b, i, t = int(begin[k]), int(item[k]), int(text[k])
                limit = int(edits[i])
                if (b, i) in tried or best.get((t, i), limit + 1) == 0:
                    continue
                tried.add((b, i))
                found = fewest_edits(sampler.items[i], words[low[k] : high[k]], limit)
                if found <= limit and found < best.get((t, i), limit + 1):
                    best[(t, i)] = found
    return best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = EDIT_PERCENT, repetitions: int = REPETITIONS
) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold an item, with the fewest word edits found.

    Words are runs of letters and digits, in lower case, so other signs and spacing do not count.
    An item matches with up to ``percent`` edits per hundred words, items under ten words only
    without edits. Items without words or with a NULL text match nothing; items with a NULL id
    match like others. A NULL or empty document holds nothing. Repeated rows of either table give
    repeated rows. Other columns are ignored; an empty table gives an empty result.

    ``benchmark`` is the stated query set: it is collected and goes to the tasks in blocks of
    BLOCK_ITEMS items. Documents are neither shuffled nor held beyond one batch.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    words, first = normal_words(texts)
    ids, items = [], []
    for k, row in enumerate(rows):
        item = words[first[k] : first[k + 1] - 1]
        if len(item):
            ids.append(row["item_id"])
            items.append(item)
    result = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, edits int")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for start in range(0, len(items), BLOCK_ITEMS):
        block, block_ids = items[start : start + BLOCK_ITEMS], ids[start : start + BLOCK_ITEMS]
        edits = np.array([len(i) * percent // 100 for i in block])
        sampler = Sampler(block, repetitions)

        def run(
            batches: Iterator[pa.RecordBatch], sampler=sampler, edits=edits, block_ids=block_ids
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc_ids = batch.column("doc_id")
                for begin, _, held in text_batches(batch, "text"):
                    found = sorted((t, i, e) for (t, i), e in _matches(sampler, edits, held).items())
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                doc_ids.take(pa.array([begin + t for t, _, _ in found])),
                                pa.array([block_ids[i] for _, i, _ in found], pa.int64()),
                                pa.array([e for _, _, e in found], pa.int32()),
                            ],
                            names=["doc_id", "item_id", "edits"],
                        )

        result = result.union(source.mapInArrow(run, "doc_id bigint, item_id bigint, edits int"))
    return result
