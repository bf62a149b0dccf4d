"""Deep-shallow sorting of byte strings that lie in one buffer.

The shallow part is a multikey quicksort over eight-byte symbols: each pass
splits every open group of equal strings by its next symbol.  What is still
together at the shallow depth shares a long prefix; each such group is ordered
by a blind trie, which compares a string with only one of those that it holds.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey passes look at.
SHALLOW = 32

_SYMBOL = 8


class BlindTrie:
    """Strings by the places where they first differ; equal strings share a leaf.

    An inner node is [place, children by byte], a leaf (string, members).  A
    string that ends at a node's place goes under -1.
    """

    def __init__(self):
        self.root = None

    def add(self, string: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (string, [member])
            return
        path = []
        while type(node) is list:
            path.append(node)
            place, children = node
            node = children.get(string[place] if place < len(string) else -1)
            if node is None:  # any leaf below tells where the string leaves the trie
                node = next(iter(children.values()))
        other = node[0]
        if other == string:
            node[1].append(member)
            return
        common = _common_prefix(string, other)
        mine = string[common] if common < len(string) else -1
        leaf = (string, [member])
        at = 0
        while at < len(path) and path[at][0] < common:
            at += 1
        if at < len(path) and path[at][0] == common:
            path[at][1][mine] = leaf
            return
        below = path[at] if at < len(path) else node
        inner = [common, {other[common] if common < len(other) else -1: below, mine: leaf}]
        if not at:
            self.root = inner
        else:
            above = path[at - 1]
            above[1][string[above[0]] if above[0] < len(string) else -1] = inner

    def classes(self) -> list[list[int]]:
        """Members of the leaves in the strings' order."""
        out, waiting = [], [self.root] if self.root is not None else []
        while waiting:
            node = waiting.pop()
            if type(node) is list:
                waiting += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def _common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    gap = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return size - (gap.bit_length() + 7) // 8


def _symbols(text: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes as numbers, zero where a string has ended; ``text`` has eight bytes to spare."""
    found = np.lib.stride_tricks.sliding_window_view(text, _SYMBOL)[np.minimum(at, len(text) - _SYMBOL)]
    value = np.ascontiguousarray(found).view(">u8").ravel().astype(np.uint64)
    short = left < _SYMBOL
    if short.any():
        cut = (_SYMBOL - np.maximum(left[short], 0)).astype(np.uint64) * np.uint64(8)
        value[short] = np.where(cut >= 64, np.uint64(0), value[short] >> np.minimum(cut, np.uint64(63)) << np.minimum(cut, np.uint64(63)))
    return value


def deep_shallow_sort(text: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings ``text[at : at + size]`` within each ``group``.

    Returns their order and, for each in that order, the number of its class:
    equal strings of one group share a class.
    """
    text = np.concatenate([text, np.zeros(_SYMBOL, np.uint8)])
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    starts = np.ones(len(order), bool)
    starts[1:] = sorted_group[1:] != sorted_group[:-1]
    ended = np.zeros(len(order), bool)  # strings that are read to their end
    for depth in range(0, shallow, _SYMBOL):
        several = ~(starts & np.r_[starts[1:], True]) & ~ended
        where = np.flatnonzero(several)
        if not len(where):
            break
        rows = order[where]
        segment = np.cumsum(starts[where])
        left = size[rows] - depth
        value = _symbols(text, at[rows] + depth, left)
        rest = np.minimum(left, _SYMBOL)
        by = np.lexsort((rest, value, segment))
        order[where] = rows[by]
        value, rest, segment = value[by], rest[by], segment[by]
        new = np.ones(len(where), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (value[1:] != value[:-1]) | (rest[1:] != rest[:-1])
        starts[where] = new
        ended[where] = left[by] <= _SYMBOL
    several = ~(starts & np.r_[starts[1:], True]) & ~ended
    where = np.flatnonzero(several)
    if len(where):
        _order_deep(text.tobytes(), at, size, order, starts, where)
    return order, np.cumsum(starts)


def _order_deep(text: bytes, at, size, order, starts, where) -> None:
    """Orders by blind tries what the shallow passes have left together."""
    rows = order[where]
    begins = np.flatnonzero(starts[where])
    begin_at, ends = at[rows].tolist(), (at[rows] + size[rows]).tolist()
    members = rows.tolist()
    placed: list[int] = []
    fresh = np.zeros(len(rows), bool)
    for first, last in zip(begins.tolist(), [*begins[1:].tolist(), len(members)], strict=True):
        string = text[begin_at[first] : ends[first]]
        k = first + 1
        while k < last and text[begin_at[k] : ends[k]] == string:
            k += 1
        fresh[first] = True
        if k == last:  # a trie of one leaf
            placed += members[first:last]
            continue
        trie = BlindTrie()
        trie.root = (string, members[first:k])
        for i in range(k, last):
            trie.add(text[begin_at[i] : ends[i]], members[i])
        for leaf in trie.classes():
            fresh[len(placed)] = True
            placed += leaf
    order[where] = placed
    starts[where] = fresh
