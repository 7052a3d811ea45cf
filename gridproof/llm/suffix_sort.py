"""Deep-shallow sorting of suffixes that are compared to a fixed depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHALLOW = 3  # super-characters of 8 bytes
SMALL = 1 << 13  # rows of a group that is not split by pivots any more
CHUNK = 1 << 16


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


def blind_trie(suffixes: list[bytes]) -> Iterator[list[int]]:
    """Indices of the suffixes in sorted order; equal ones come together as one list.

    An insertion goes down blindly by the branching bytes alone, compares once with the leaf it meets, and
    so learns where it branches off. Each suffix is read once however long the prefixes are that they share.
    """
    root: _Node | list[int] = [0]
    for i in range(1, len(suffixes)):
        s, node = suffixes[i], root
        while isinstance(node, _Node):
            node = node.kids.get(s[node.depth]) or next(iter(node.kids.values()))
        other = suffixes[node[0]]
        same = _common(s, other)
        if same == len(s):
            node.append(i)
            continue
        above, node = None, root
        while isinstance(node, _Node) and node.depth < same:
            above, node = node, node.kids[s[node.depth]]
        if isinstance(node, _Node) and node.depth == same:
            node.kids[s[same]] = [i]
            continue
        branch = _Node(same, {other[same]: node, s[same]: [i]})
        if above is None:
            root = branch
        else:
            above.kids[s[above.depth]] = branch
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.kids[c] for c in sorted(node.kids, reverse=True)]
        else:
            yield node


def _ternary(words: np.ndarray, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Split every group over SMALL by pivots into smaller, equal and larger characters, again and again; returns the edges of all groups.

    words: the character of each row; order: the rows, group by group; edges: where groups begin, and the end.
    """
    out = [edges]
    stack = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b - a > SMALL]
    while stack:
        a, b = stack.pop()
        own = order[a:b]
        key = words[own]
        pivot = np.sort(key[np.linspace(0, b - a - 1, 9).astype(np.int64)])[4]
        less, more = key < pivot, key > pivot
        x, y = a + int(less.sum()), b - int(more.sum())
        order[a:b] = np.concatenate([own[less], own[~(less | more)], own[more]])
        out.append(np.array([x, y]))
        stack += [(p, q) for p, q in ((a, x), (y, b)) if q - p > SMALL]
    return np.unique(np.concatenate(out)) if len(out) > 1 else edges


def multikey_quicksort(suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their first `depth` super-characters, and the edges of the groups that agree in all of them.

    Character by character: groups of several rows are split three ways around pivots until they are small, the small ones are
    sorted together, and rows with one character go on to the next.
    """
    n, length = suffixes.shape
    padded = np.zeros((n, depth * 8), np.uint8)
    padded[:, : min(length, depth * 8)] = suffixes[:, : depth * 8]
    words = padded.view(">u8").astype(np.uint64)
    order, edges = np.arange(n), np.array([0, n])
    for d in range(depth):
        edges = _ternary(words[:, d], order, edges)
        sizes = np.diff(edges)
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of rows that are not alone
        if not len(at):
            break
        group = np.repeat(np.arange(len(sizes)), sizes)[at]
        key = words[order[at], d]
        sub = np.lexsort((key, group))
        order[at], key = order[at[sub]], key[sub]
        new = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        edges = np.union1d(edges, at[1:][new])
    return order, edges


def deep_shallow_sort(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (n x length bytes), and for each row in that order the number of its class of equal rows.

    Shallow: multikey quicksort over SHALLOW characters of 8 bytes. Deep: rows that still agree go into a blind trie. A trie of
    one leaf is seen at once, as all its rows agree with the first to the end; the others are built row by row.
    """
    n, length = suffixes.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    depth = min(SHALLOW, -(-length // 8))
    order, edges = multikey_quicksort(suffixes, depth)
    new_class = np.zeros(n, bool)
    new_class[edges[:-1]] = True
    sizes = np.diff(edges)
    at = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if length > depth * 8 and len(at):
        first = np.repeat(edges[:-1], sizes)[at]
        differ = np.zeros(len(at), bool)
        for i in range(0, len(at), CHUNK):
            part = slice(i, i + CHUNK)
            differ[part] = (suffixes[order[at[part]], depth * 8 :] != suffixes[order[first[part]], depth * 8 :]).any(1)
        for a in np.unique(first[differ]).tolist():
            b = int(edges[np.searchsorted(edges, a) + 1])
            members = order[a:b].tolist()
            for leaf in blind_trie([suffixes[m].tobytes() for m in members]):
                new_class[a] = True
                order[a : a + len(leaf)] = [members[i] for i in leaf]
                a += len(leaf)
    return order, np.cumsum(new_class) - 1
