"""Deep-shallow sorting of suffixes up to a limit of bytes, and the classes of suffixes that agree up to it.

Shallow: multikey quicksort, whose characters are words of 5 bytes, orders all suffixes at once down to ``SHALLOW`` words. Deep: suffixes
that still agree share a long prefix; small groups of them are put in a blind trie, which looks at branching bytes only on the
way down and compares one string in full. Larger groups go on with the next words first, as deep-shallow sorting does. Groups that
agree to the limit, as copies of a passage do, are found by comparing all their words with those of one member and need no sorting;
of two that differ the first different word decides.
"""

from __future__ import annotations

import numpy as np

WORD = 5  # bytes; with the number of a class in front they make one 64-bit key
SHALLOW = 5
BLIND_ROWS = 16


class _Branch:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_sort(strings: list[bytes], known: int) -> list[list[int]]:
    """Positions of ``strings`` in order, equal ones together; all strings have one length and share ``known`` bytes."""
    limit = len(strings[0])
    root = (0, [0])  # a leaf: its string and all positions equal to it
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, _Branch):
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        other = strings[node[0]]
        common = known
        if s == other:
            common = limit
        else:
            while s[common] == other[common]:
                common += 1
        if common == limit:
            node[1].append(i)
            continue
        parent, node = None, root
        while isinstance(node, _Branch) and node.depth < common:
            parent, node = node, node.children[s[node.depth]]
        leaf = (i, [i])
        if isinstance(node, _Branch) and node.depth == common:
            node.children[s[common]] = leaf
            continue
        branch = _Branch(common, {other[common]: node, s[common]: leaf})
        if parent is None:
            root = branch
        else:
            parent.children[s[parent.depth]] = branch
    out, open_nodes = [], [root]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, _Branch):
            open_nodes += [node.children[b] for b in sorted(node.children, reverse=True)]
        else:
            out.append(node[1])
    return out


def sort_suffixes(text: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``text[start : start + limit]`` within their groups, and a class number for each suffix.

    Suffixes of a group that agree in ``limit`` bytes have one class; classes of different groups differ.
    """
    n, words = len(starts), -(-limit // WORD)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))  # the 8 bytes from each byte on

    def word_of(rows: np.ndarray, at: int, size: int = 8) -> np.ndarray:
        word = at_byte[starts[rows] + at].astype(np.uint64)
        return word >> np.uint64(64 - 8 * min(size, limit - at))

    if n and (group[1:] < group[:-1]).any():
        order = np.argsort(group, kind="stable")
    else:
        order = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = group[order[1:]] != group[order[:-1]]
    rank = np.empty(n, np.int64)  # where a suffix's class begins in the order
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    loose = np.arange(n)  # places in the order that are not settled
    blind: list[np.ndarray] = []
    for w in range(words):
        first = rank[order[loose]]
        heads = np.flatnonzero(np.diff(first, prepend=-1))
        sizes = np.diff(heads, append=len(first))
        open_groups = sizes > 1
        if w in (1, SHALLOW):
            several = np.repeat(open_groups, sizes)
            loose, first = loose[several], first[several]
            sizes = sizes[open_groups]
            heads = np.cumsum(sizes) - sizes
            rows, model = order[loose], order[first]
            equal = np.ones(len(loose), bool)
            for at in range(WORD * w, limit, 8):
                equal &= word_of(rows, at) == word_of(model, at)
            open_groups = ~np.logical_and.reduceat(equal, heads) if len(heads) else np.zeros(0, bool)
        if w == SHALLOW:
            two = open_groups & (sizes == 2)  # they differ: the first word that does tells their order
            left, right = loose[heads[two]], loose[heads[two] + 1]
            turned, decided = np.zeros(len(left), bool), np.zeros(len(left), bool)
            for at in range(WORD * w, limit, 8):
                a, b = word_of(order[left], at), word_of(order[right], at)
                turned |= ~decided & (a > b)
                decided |= a != b
            left, right = np.where(turned, right, left), np.where(turned, left, right)
            firsts, seconds = order[left], order[right]
            places = np.minimum(left, right)
            order[places], order[places + 1] = firsts, seconds
            rank[seconds] = places + 1
            open_groups &= ~two
            small = open_groups & (sizes <= BLIND_ROWS)
            blind = [loose[h : h + k] for h, k in zip(heads[small].tolist(), sizes[small].tolist(), strict=True)]
            open_groups &= ~small
        loose = loose[np.repeat(open_groups, sizes)]
        if len(loose) == 0:
            break
        rows = order[loose]
        word = word_of(rows, WORD * w, WORD).astype(np.int64)
        moved = np.argsort(rank[rows] << (8 * WORD) | word) if n < 1 << 23 else np.lexsort((word, rank[rows]))
        rows, word = rows[moved], word[moved]
        order[loose] = rows
        head = np.ones(len(rows), bool)
        head[1:] = (word[1:] != word[:-1]) | (rank[rows][1:] != rank[rows][:-1])
        rank[rows] = loose[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
    for places in blind:
        rows = order[places]
        strings = [text[starts[r] : starts[r] + limit].tobytes() for r in rows]
        at = 0
        for same in blind_sort(strings, WORD * SHALLOW):
            order[places[at : at + len(same)]] = rows[same]
            rank[rows[same]] = places[at]
            at += len(same)
    return order, rank
