"""Deep-shallow sorting of byte strings, with the common prefix lengths of neighbours.

Multikey quicksort orders the strings by words of eight bytes down to a
shallow depth; what still ties there has a long common prefix, and a blind
trie orders each such group: it is descended by branching bytes alone, one
comparison with the leaf it reaches gives the common prefix, and the new
string branches off there.
"""

from __future__ import annotations

from collections.abc import Sequence

WORD = 8
#: Words that multikey quicksort looks at.
SHALLOW_WORDS = 3
#: Groups up to this size are ordered by their words at once.
SMALL = 48


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # equal up to low, different within high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Order of different strings that are equal up to some depth.

    A node is [depth, children by byte, a leaf below]; a string that ends at
    a node is its child -1, before all bytes.
    """

    def __init__(self, strings: Sequence[bytes], first: int):
        self.strings, self.root = strings, first

    def _branch(self, leaf: int, depth: int) -> int:
        s = self.strings[leaf]
        return s[depth] if depth < len(s) else -1

    def add(self, leaf: int) -> None:
        node, s = self.root, self.strings[leaf]
        while type(node) is list:  # blind: only branching bytes are looked at
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1, node[2])
        depth = common_prefix(s, self.strings[node])
        old, parent, node = node, None, self.root
        while type(node) is list and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][self._branch(leaf, depth)] = leaf
            return
        made = [depth, {self._branch(leaf, depth): leaf, self._branch(old, depth): node}, old]
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]]] = made

    def ordered(self, least: int) -> list[tuple[int, int]]:
        """(leaf, common prefix with the one before); the first has ``least``."""
        out, stack = [], [(self.root, least)]
        while stack:
            node, shared = stack.pop()
            if type(node) is not list:
                out.append((node, shared))
                continue
            kids = sorted(node[1].items())
            stack.extend((kid, shared if k == 0 else node[0]) for k, (_, kid) in reversed(list(enumerate(kids))))
        return out


def _words(strings: Sequence[bytes]):
    """Each string's first words as big-endian numbers, one column a word; short strings end in zeros."""
    import numpy as np

    size = WORD * SHALLOW_WORDS
    block = b"".join([s[:size].ljust(size, b"\0") for s in strings])
    return np.frombuffer(block, ">u8").reshape(-1, SHALLOW_WORDS).astype(np.uint64)


def _multikey(words) -> list:
    """Index arrays of strings with equal words, in order: ternary partitioning word by word."""
    import numpy as np

    out, stack = [], [(np.arange(len(words)), 0)]
    while stack:
        group, depth = stack.pop()
        if depth == SHALLOW_WORDS or len(group) == 1:
            out.append(group)
            continue
        key = words[group, depth]
        if len(group) <= SMALL:
            order = np.argsort(key, kind="stable")
            group, key = group[order], key[order]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            stack.extend((part, depth + 1) for part in reversed(np.split(group, cuts)))
            continue
        pivot = np.sort(key[[0, len(key) // 4, len(key) // 2, 3 * len(key) // 4, -1]])[2]
        parts = ((group[key > pivot], depth), (group[key == pivot], depth + 1), (group[key < pivot], depth))
        stack.extend(p for p in parts if len(p[0]))
    return out


def deep_shallow(strings: Sequence[bytes]):
    """(order, shared): sorted order of different strings; shared[k] is the prefix that order[k] has in common with order[k - 1]."""
    import numpy as np

    order, shared, last = [], [], None
    if not strings:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for group in _multikey(_words(strings)):
        trie = None
        members = group.tolist()
        if len(members) > 1:
            trie = BlindTrie(strings, members[0])
            for leaf in members[1:]:
                trie.add(leaf)
            part = trie.ordered(0)
        else:
            part = [(members[0], 0)]
        first = part[0][0]
        part[0] = (first, 0 if last is None else common_prefix(strings[last], strings[first]))
        order += [leaf for leaf, _ in part]
        shared += [n for _, n in part]
        last = order[-1]
    return np.array(order, np.int64), np.array(shared, np.int64)
