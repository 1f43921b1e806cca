"""Signature trees: token bitmaps and size ranges that prune pairs of nodes by their largest possible overlap.

A leaf is one set of tokens: a bitmap of their hashes, its size, and how many tokens share a bit with
another. Tokens that two sets share fall on bits that both have, and no more of them share a bit than
in the set with fewer such tokens. So an overlap is at most the number of common bits plus the lesser of
the two excesses; for nodes this holds with the OR of their bitmaps and the largest excess below each.
"""

from __future__ import annotations

import numpy as np

LEAF = 32
FAN = 8
LEAST_WORDS, MOST_WORDS = 4, 64


def words_for(n: int, most: int = MOST_WORDS) -> int:
    """64-bit words of a bitmap for n tokens: two bits a token, as a power of two within bounds."""
    return min(most, max(LEAST_WORDS, 1 << max(0, (n * 2 + 63) // 64 - 1).bit_length()))


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(64 * words, np.bool_)
    bits[(tokens & np.uint64(64 * words - 1)).astype(np.intp)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The same tokens' bitmap in fewer words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def may_link(a, b, share: int):
    """Whether sizes a and b allow this share, in hundredths."""
    return (100 * np.minimum(a, b) >= share * np.maximum(a, b))


def needed(a, b, share: int):
    """The least overlap of sets of sizes a and b whose Jaccard share is large enough."""
    return -(-share * (a + b) // (100 + share))


class Groups:
    """Which items are known to belong together; labels are kept flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.label[a], self.label[b]))
        self.label[self.label == high] = low


class Tree:
    """A tree over items of one bitmap width, ordered so that like ones are near each other."""

    def __init__(self, items: np.ndarray, bits: np.ndarray, sizes: np.ndarray, order: np.ndarray):
        by = np.lexsort((sizes, order))
        self.items, self.bits, self.sizes = items[by], bits[by], sizes[by].astype(np.int64)
        self.excess = self.sizes - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        starts = np.arange(0, len(items), LEAF)
        self.levels = [self._level(starts, self.bits, self.sizes, self.sizes, self.excess)]
        self.spans = [LEAF]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess = self.levels[-1]
            self.levels.append(self._level(np.arange(0, len(bits), FAN), bits, low, high, excess))
            self.spans.append(self.spans[-1] * FAN)

    @staticmethod
    def _level(starts, bits, low, high, excess):
        return np.bitwise_or.reduceat(bits, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(excess, starts)

    def _may(self, level: int, i: int, j: int, share: int) -> bool:
        bits, low, high, excess = self.levels[level]
        if 100 * high[i] < share * low[j] or 100 * high[j] < share * low[i]:
            return False
        most = int(np.bitwise_count(bits[i] & bits[j]).sum()) + min(excess[i], excess[j])
        return most >= needed(low[i], low[j], share)

    def _one_group(self, level: int, i: int, j: int, groups: Groups) -> bool:
        span = self.spans[level]
        first = groups.label[self.items[i * span : (i + 1) * span]]
        second = groups.label[self.items[j * span : (j + 1) * span]]
        return bool((first == first[0]).all() and (second == first[0]).all())

    def join(self, share: int, groups: Groups, linked) -> None:
        """Walk pairs of nodes from the root; join items that may link and for which linked(a, b) holds.

        Pairs known to belong together are left out: they can't change the groups.
        """
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if self._one_group(level, i, j, groups) or (i != j and not self._may(level, i, j, share)):
                continue
            if level:
                n = len(self.levels[level - 1][0])
                left = range(i * FAN, min(n, (i + 1) * FAN))
                right = range(j * FAN, min(n, (j + 1) * FAN))
                stack.extend((level - 1, a, b) for a in left for b in right if i != j or a < b)
                if i == j:  # last in, first out: a node with itself comes before pairs of its children
                    stack.extend((level - 1, a, a) for a in left)
            else:
                self._leaves(i, j, share, groups, linked)

    def _leaves(self, i: int, j: int, share: int, groups: Groups, linked) -> None:
        a, b = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        common = np.bitwise_count(self.bits[a][:, None, :] & self.bits[b][None, :, :]).sum(axis=2).astype(np.int64)
        most = common + np.minimum(self.excess[a][:, None], self.excess[b][None, :])
        x, y = self.sizes[a][:, None], self.sizes[b][None, :]
        may = may_link(x, y, share) & (most >= needed(x, y, share))
        if i == j:
            may = np.triu(may, 1)
        first, second = self.items[a], self.items[b]
        for p, q in np.argwhere(may):
            left, right = first[p], second[q]
            if groups.label[left] != groups.label[right] and linked(left, right):
                groups.join(left, right)


def group_by_bitmaps(bitmaps: list[np.ndarray], sizes: np.ndarray, order: np.ndarray, share: int, groups: Groups, linked=lambda a, b: True) -> None:
    """Join all items that link, over bitmaps of mixed widths.

    Sizes that can link differ by a factor under two, so their widths are equal or neighbours: for each
    width one tree holds its items and those of the next width, folded.
    """
    widths = np.array([len(b) for b in bitmaps])
    for width in sorted(set(widths.tolist())):
        items = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(items) > 1:
            bits = np.stack([fold(bitmaps[k], width) for k in items])
            Tree(items, bits, sizes[items], order[items]).join(share, groups, linked)
