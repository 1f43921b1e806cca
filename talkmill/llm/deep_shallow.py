"""Deep-shallow sorting: multikey quicksort to a shallow depth, then blind tries for what is still equal.

A blind trie keeps, in its inner nodes, only the depth at which strings below differ and the byte there. A new
string is first led down by those bytes alone; one comparison with the leaf it reaches gives its true common prefix,
and so the place of its branch.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix, which is known to be at least start."""
    end = min(len(a), len(b))
    step = 16
    while start < end and a[start : start + step] == b[start : start + step]:
        start += step
        step *= 2
    stop = min(start + step, end)
    while start < stop:
        middle = (start + stop + 1) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            stop = middle - 1
    return min(start, end)


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


class BlindTrie:
    """Nodes are [depth, {byte: node or leaf}]; leaves are lists of equal strings' numbers."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, [first]

    def insert(self, number: int) -> None:
        s, node = self.strings[number], self.root
        while isinstance(node, tuple):
            below = node[1]
            node = below.get(_byte(s, node[0]))
            if node is None:
                node = next(iter(below.values()))
        other = self.strings[node[0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node.append(number)
            return
        above, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < same:
            above, key = node, _byte(s, node[0])
            node = above[1][key]
        if isinstance(node, tuple) and node[0] == same:
            node[1][_byte(s, same)] = [number]
            return
        fork = (same, {_byte(s, same): [number], _byte(other, same): node})
        if above is None:
            self.root = fork
        else:
            above[1][key] = fork

    def walk(self):
        """(number, common prefix with the one before) in order; the first one's prefix is None."""
        stack, shared = [(self.root, None)], None
        while stack:
            node, depth = stack.pop()
            if isinstance(node, tuple):
                for n, key in enumerate(sorted(node[1], reverse=True)):
                    stack.append((node[1][key], node[0] if n < len(node[1]) - 1 else depth))
                continue
            for k, number in enumerate(node):
                yield number, (depth if k == 0 else len(self.strings[number]))


def sort_strings(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings and the common prefix of each with the one before it (-1 for the first).

    All strings are known to share their first depth bytes. Equal strings stand together in order of number.
    """
    order: list[int] = []
    prefix: list[int] = []
    limit = depth + shallow
    stack = [(list(range(len(strings))), depth, -1)]
    while stack:
        group, at, shared = stack.pop()
        if len(group) == 1:
            order += group
            prefix.append(shared)
        elif at >= limit:
            trie = BlindTrie(strings, group[0])
            for number in group[1:]:
                trie.insert(number)
            for number, same in trie.walk():
                order.append(number)
                prefix.append(shared if same is None else same)
        else:
            pivot = _byte(strings[group[len(group) // 2]], at)
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for number in group:
                byte = _byte(strings[number], at)
                parts[(byte > pivot) - (byte < pivot) + 1].append(number)
            work = []
            for part, equal in zip(parts, (False, True, False), strict=True):
                if part:
                    work.append((part, at, equal, shared if not work else at))
            for part, at_, equal, before in reversed(work):
                if equal and pivot < 0:  # all end here: they are equal
                    stack += [([number], at_, len(strings[number])) for number in reversed(part[1:])]
                    stack.append(([part[0]], at_, before))
                else:
                    stack.append((part, at_ + 1 if equal else at_, before))
    return np.array(order, np.int64), np.array(prefix, np.int64)
