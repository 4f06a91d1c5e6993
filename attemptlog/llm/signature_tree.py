"""Signature trees: joining sets by dual traversal of nodes with OR-combined bitmaps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Children of a node, documents of a leaf.
FAN = 16
#: Node pairs expanded at once, and documents tried as a hub before the traversal.
CHUNK, HUBS = 8192, 4
#: Bytes of bitmaps gathered for one side of a chunk of pairs; wide bitmaps make the chunk shorter.
CHUNK_BYTES = 4 << 20
#: Bits a token at least, rounded up to a power of two: more bits, fewer pairs that only seem similar.
BITS_A_TOKEN, MIN_BITS, MAX_BITS = 1, 64, 1 << 17


def width(n: int) -> int:
    """Bits of the signature of a set of ``n`` tokens."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, BITS_A_TOKEN * int(n) - 1).bit_length()))


def signature(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of a set, one bit a token by its low bits, as 64-bit words."""
    w = width(len(tokens))
    bits = np.zeros(w, np.uint8)
    bits[(tokens & np.uint64(w - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures (a row each) narrowed to ``words`` 64-bit words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def need(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least intersection of sets of ``a`` and ``b`` tokens that gives a Jaccard
    similarity of num / den."""
    return -(-(a + b) * num // (num + den))


class Forest:
    """Union-find over positions; remembers the pairs that joined two parts."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.joined: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p.copy()
        return p

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.joined.append((int(a), int(b)))


def _possible(a: tuple, b: tuple, num: int, den: int) -> np.ndarray:
    """Whether two nodes (bitmaps, least and greatest size, greatest excess of
    tokens over bits) can hold a linked pair: an intersection has at most one
    token more a common bit than either side has tokens beyond its bits."""
    bits_a, min_a, max_a, over_a = a
    bits_b, min_b, max_b, over_b = b
    ok = (max_a * den >= min_b * num) & (max_b * den >= min_a * num)
    common = np.bitwise_count(bits_a & bits_b).sum(1, dtype=np.int64) + np.minimum(over_a, over_b)
    most = np.minimum(np.minimum(max_a, max_b), common)
    return ok & (most >= need(min_a, min_b, num, den))


class Tree:
    """Nodes over documents in the given order, levels from the leaves up."""

    def __init__(self, order: np.ndarray, bits: np.ndarray, n: np.ndarray, part: np.ndarray):
        self.order = order
        over = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        level = (bits[order], n[order], n[order], over[order], part[order])
        self.levels = [level]
        while len(level[1]) > FAN or len(self.levels) == 1:
            cut = np.arange(0, len(level[1]), FAN)
            b, lo, hi, ex, p = level
            low, high = np.minimum.reduceat(p, cut), np.maximum.reduceat(p, cut)
            level = (np.bitwise_or.reduceat(b, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut),
                     np.maximum.reduceat(ex, cut), np.where((low == high) & (low >= 0), low, -1))
            self.levels.append(level)


def _pairs(a: Tree, b: Tree, same: bool, num: int, den: int, forest: Forest, ids_a, ids_b):
    """Candidate document pairs by dual traversal, a chunk at a time.  Node pairs
    whose documents are already in one part are left out."""
    top = min(len(a.levels), len(b.levels)) - 1
    na, nb = len(a.levels[top][1]), len(b.levels[top][1])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(na), np.arange(nb), indexing="ij"))
    if same:
        i, j = i[i <= j], j[i <= j]
    stack = [(top, i, j)]
    chunk = max(64, min(CHUNK, CHUNK_BYTES // (8 * a.levels[0][0].shape[1])))
    while stack:
        k, i, j = stack.pop()
        if len(i) > chunk:
            stack.append((k, i[chunk:], j[chunk:]))
            i, j = i[:chunk], j[:chunk]
        la, lb = a.levels[k], b.levels[k]
        if k == 0:
            roots = forest.roots()
            apart = roots[ids_a[a.order[i]]] != roots[ids_b[b.order[j]]]
            i, j = i[apart], j[apart]
        else:
            apart = ~((la[4][i] == lb[4][j]) & (la[4][i] >= 0))
            i, j = i[apart], j[apart]
        if not len(i):
            continue
        ok = _possible(tuple(x[i] for x in la[:4]), tuple(x[j] for x in lb[:4]), num, den)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            yield ids_a[a.order[i]], ids_b[b.order[j]]
            continue
        step = np.arange(FAN)
        ci = np.repeat((i[:, None] * FAN + step), FAN, axis=1).ravel()
        cj = np.tile((j[:, None] * FAN + step), (1, FAN)).ravel()
        keep = (ci < len(a.levels[k - 1][1])) & (cj < len(b.levels[k - 1][1]))
        if same:
            keep &= ci < cj if k == 1 else ci <= cj
        stack.append((k - 1, ci[keep], cj[keep]))


def tree_join(bits: list[np.ndarray], n: np.ndarray, num: int, den: int,
              linked: Callable[[np.ndarray, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect the linked documents: a spanning forest of the links.

    ``bits``: signature of each document; ``n``: its size; ``linked(i, j)``: which
    of the candidate pairs are links.  With ``side``, only pairs of different sides
    are looked at.  A few hubs are tried against all first, so that groups of near
    copies fall together in linear time; then trees over the documents of
    each signature width, sorted by part and size, are traversed against themselves
    and against the wider ones that linked sets can have, folded.  Every link joins two documents that are
    in one part at the end.
    """
    m = len(n)
    forest = Forest(m)
    words = np.array([len(b) for b in bits])

    def try_pairs(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            roots = forest.roots()
            apart = roots[i] != roots[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            # one pair of each two parts at a time: what it joins spares the others
            key = np.minimum(roots[i], roots[j]) * m + np.maximum(roots[i], roots[j])
            _, first = np.unique(key, return_index=True)
            ok = linked(i[first], j[first])
            for a, b in zip(i[first][ok].tolist(), j[first][ok].tolist(), strict=True):
                forest.join(a, b)
            rest = np.ones(len(i), bool)
            rest[first] = False
            i, j = i[rest], j[rest]

    if m <= FAN:        # one leaf: every pair, at the narrower of its widths
        i, j = np.triu_indices(m, 1)
        near = (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)
        if side is not None:
            near &= side[i] != side[j]
        i, j = i[near], j[near]
        pair = np.minimum(words[i], words[j])
        for w in np.unique(pair).tolist():
            a, b = i[pair == w], j[pair == w]

            def leaf(k: np.ndarray, w: int = w) -> tuple:
                flat = np.concatenate([fold(bits[x][None, :], w) for x in k])
                return flat, n[k], n[k], n[k] - np.bitwise_count(flat).sum(1, dtype=np.int64)
            ok = _possible(leaf(a), leaf(b), num, den)
            try_pairs(a[ok], b[ok])
        return forest.joined
    by_width = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    for w, ids in by_width.items():
        if len(ids) <= FAN:
            continue
        flat = np.stack([bits[k] for k in ids])
        over = n[ids] - np.bitwise_count(flat).sum(1, dtype=np.int64)
        size = n[ids]
        for hub in range(min(HUBS, len(ids))):
            roots = forest.roots()[ids]
            alone = np.flatnonzero(np.bincount(roots, minlength=m)[roots] == 1)
            if len(alone) < FAN:
                break
            h = alone[len(alone) * hub // HUBS]
            ok = _possible((flat, size, size, over), (flat[h:h + 1], size[h:h + 1], size[h:h + 1], over[h:h + 1]), num, den)
            ok &= roots != roots[h]
            if side is not None:
                ok &= side[ids] != side[ids[h]]
            other = np.flatnonzero(ok)
            try_pairs(np.full(len(other), ids[h]), ids[other])

    def traverse(ids_a: np.ndarray, ids_b: np.ndarray, w: int, same: bool) -> None:
        roots = forest.roots()

        def tree(ids: np.ndarray) -> Tree:
            flat = np.concatenate([fold(bits[k][None, :], w) for k in ids])
            return Tree(np.lexsort((n[ids], roots[ids])), flat, n[ids], roots[ids])
        a = tree(ids_a)
        b = a if same else tree(ids_b)
        for i, j in _pairs(a, b, same, num, den, forest, ids_a, ids_b):
            if side is not None:
                cross = side[i] != side[j]
                i, j = i[cross], j[cross]
            try_pairs(i, j)

    for w, ids in by_width.items():
        if len(ids) > 1 and (side is None or len(np.unique(side[ids])) > 1):
            traverse(ids, ids, w, True)
        # linked sets differ in size by den / num at most, so in width by that, rounded up to a power of two
        wider = 2 * w
        while wider <= max(2 * w, 2 * w * den // num):
            if wider in by_width:
                traverse(ids, by_width[wider], w, False)
            wider *= 2
    return forest.joined
