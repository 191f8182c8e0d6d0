"""Burrows-Wheeler transforms of shards, and their merge by interleave refinement.

The letters are words of several symbols: as many symbols a round as ``STEP``
allows, numbered densely in their order over the collection, so that a round
deals 16-bit numbers (two passes beyond 65536 of them).
"""

from __future__ import annotations

import numpy as np

#: Symbols of a word at most; a word takes the largest divisor of the depth up to this.
STEP = 10
#: Symbols that are packed in one number, and behind the number of a word; a symbol takes 9 bits: a byte plus one, 0 for a terminator.
PACKED, MORE, BITS = 7, 3, 9


def dense(keys: np.ndarray) -> np.ndarray:
    """The number of each key in the order of the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return rank


def stable_order(numbers: np.ndarray) -> np.ndarray:
    """Stable argsort; 16-bit numbers go by radix, larger ones by two such passes."""
    if numbers.dtype == np.uint16:
        return np.argsort(numbers, kind="stable")
    low = np.argsort(numbers.astype(np.uint16), kind="stable")
    return low[np.argsort((numbers >> 16).astype(np.uint16)[low], kind="stable")]


class Collection:
    """Byte strings one after the other, each closed by a terminator of its own.

    ``word`` numbers the ``step`` symbols from each place on, in order; symbols
    behind a terminator don't count.  ``closed`` tells which words hold a
    terminator.  ``back`` is the place ``step`` symbols before, cyclically
    within the string.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, depth: int):
        self.depth = depth
        self.step = max(s for s in range(1, STEP + 1) if depth % s == 0)
        spans = sizes + 1
        self.ends = np.cumsum(spans)
        self.starts = self.ends - spans
        n = int(self.ends[-1])
        self.string = np.repeat(np.arange(len(sizes)), spans)
        place = np.arange(n)
        left = self.ends[self.string] - 1 - place
        symbols = np.zeros(n + self.step, np.int64)
        symbols[:n][left > 0] = data.astype(np.int64) + 1
        word, done = np.zeros(n, np.int64), 0
        while done < self.step:
            some = min(PACKED if done == 0 else MORE, self.step - done)
            packed = np.zeros(n, np.int64)
            for j in range(done, done + some):
                packed = packed << BITS | np.where(j < left, symbols[j : j + n], 0)
            word = dense(word << BITS * some | packed)
            done += some
        self.closed = left < self.step
        self.word = word.astype(np.uint16 if word.max() < 1 << 16 else np.uint32)
        start = self.starts[self.string]
        self.back = start + (place - start - self.step) % spans[self.string]


class Shard:
    """The transform of some strings: ``at``, the places of their suffixes in order, and the parts of equal prefixes."""

    def __init__(self, at: np.ndarray, part: np.ndarray | None = None):
        self.at, self.part = at, part


def build(text: Collection, first: int, last: int) -> Shard:
    """The transform of the strings from ``first`` to before ``last``, by prefix multiplying from the words on, several ranks a key."""
    a, b = int(text.starts[first]), int(text.ends[last - 1])
    n = b - a
    # suffixes that meet their terminator are alone, in order of their strings
    rank = dense(text.word[a:b].astype(np.int64) * (last - first + 1) + np.where(text.closed[a:b], text.string[a:b] - first + 1, 0))
    width = text.step
    at_once = int(62 / np.log2(max(n, 4)))  # ranks that one key holds
    while width < text.depth and rank.max() < n - 1:
        key = rank
        for k in range(1, at_once):
            key = key * n
            key[: max(0, n - k * width)] += rank[k * width :]
        rank = dense(key)
        width *= at_once
    return Shard(np.argsort(rank * n + np.arange(n)) + a)


def merge(text: Collection, one: Shard, two: Shard) -> Shard:
    """Merge two transforms without sorting suffixes again.

    The interleave starts as one shard behind the other.  A round orders the
    suffixes by one word more: the words that stand before the suffixes of the
    present interleave are dealt stably, which puts each longer suffix in its
    place.  Two neighbours part when their first words or the parts of their
    remainders differ, so the round in which a boundary appears bounds their
    longest common prefix; after the last round the parts are the classes of
    equal prefixes.  Suffixes that have met their terminator are alone.  When a
    round adds no part, none will, and the rest of the rounds is left out.
    """
    at = np.concatenate([one.at, two.at])
    n = len(at)
    row = np.empty(int(at.max()) + 1, np.int32)  # of a place
    row[at] = np.arange(n, dtype=np.int32)
    back = row[text.back[at]]  # rows are known by their shards' orders
    before = text.word[text.back[at]]
    # the words in order are the same in every round, and so are their boundaries
    ordered = np.sort(text.word[at])
    closed = np.zeros(n, bool)
    shut = np.unique(text.word[at][text.closed[at]])
    closed[:] = np.isin(ordered, shut)
    heads = np.ones(n, bool)
    heads[1:] = (ordered[1:] != ordered[:-1]) | closed[1:] | closed[:-1]
    interleave, part, parts = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), 0
    for _ in range(text.depth // text.step):
        deal = stable_order(before[interleave])
        interleave = back[interleave[deal]]
        behind = part[deal]
        new = behind[1:] != behind[:-1]
        new |= heads[1:]
        np.cumsum(new, out=part[1:])
        if part[-1] == parts:
            break
        parts = part[-1]
    return Shard(at[interleave], part)


def prefix_classes(data: np.ndarray, sizes: np.ndarray, depth: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the concatenation (strings with one terminator each): its class, and each string's start.

    Places with one class have the same ``depth`` bytes before any terminator.
    ``data`` holds the strings' bytes, ``sizes`` their lengths.
    """
    text = Collection(data, sizes, depth)
    total = int(text.ends[-1])
    shards = max(2, -(-total // shard_bytes))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(text.ends, np.arange(1, shards) * total // shards) + 1, [len(sizes)]]))
    cuts = cuts[cuts <= len(sizes)]
    found = [build(text, int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if len(found) == 1:
        found.append(Shard(np.zeros(0, np.int64)))
    while len(found) > 1:
        found = [merge(text, *found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    classes = np.empty(total, np.int32)
    classes[found[0].at] = found[0].part
    return classes, text.starts
