"""The search of a Gray-order hierarchical index of fingerprints, for one word of 64 bits or rows of several.

Fingerprints of a node lie in Gray order, neighbours in leaves, leaves in inner nodes; each factors the bits that all below it share.
The search goes down by pairs of nodes and drops a pair, with all below, as soon as the shared bits differ too much. It returns links
to representatives only, never the pairs of a group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF, FAN = 64, 16
SIGN = -(1 << 63)


def gray_rank(c: Column) -> Column:
    """Position of a bit pattern in Gray order, as a long that sorts like the unsigned value."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c.bitwiseXOR(F.lit(SIGN))


class _Forest:
    """Union-find over 0..n-1 by arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            a, b = self.root[a], self.root[b]
            a, b = np.maximum(a, b), np.minimum(a, b)
            keep = a != b
            a, b = a[keep], b[keep]
            if a.size:
                np.minimum.at(self.root, a, b)
                while (new := self.root[self.root]).tobytes() != self.root.tobytes():
                    self.root = new


def _count(differ: np.ndarray, wide: bool) -> np.ndarray:
    """Bits set, of a word or of all words of a row (fewer than 256 bits)."""
    n = np.bitwise_count(differ)
    return reduce(np.add, np.moveaxis(n, -1, 0)) if wide else n


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bottom up (shared bits, their values) of the leaves and of the inner nodes above them."""
    out, starts = [], np.arange(0, len(x), LEAF)
    common = ~(np.bitwise_or.reduceat(x, starts) ^ np.bitwise_and.reduceat(x, starts))
    value = x[starts] & common
    out.append((common, value))
    while len(common) > 1:
        starts = np.arange(0, len(common), FAN)
        differ = np.bitwise_or.reduceat(value, starts) ^ np.bitwise_and.reduceat(value | ~common, starts)
        up = np.bitwise_and.reduceat(common, starts) & ~differ
        common, value = up, value[starts] & up
        out.append((common, value))
    return out


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    a, b = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
    keep = (a <= b) & (b < n)
    return a[keep], b[keep]


def gray_links(x: np.ndarray, must: int = 0, radius: int = 3, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (position, position of a representative) of one node's fingerprints x, uint64 (or rows of them) in Gray order.

    Pairs that differ in the bits of must may be left out. seen: gets the numbers of pairs of nodes and of leaves that were looked at.
    """
    forest, n, must, wide = _Forest(len(x)), len(x), np.uint64(must), x.ndim > 1
    forest.link(*(lambda i: (i, i + 1))(np.flatnonzero(_count(x[1:] ^ x[:-1], wide) <= radius)))
    levels = _levels(x)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        common, value = levels[k]
        parts = []
        for lo in range(0, len(a), 4096):
            p, q = (a[lo : lo + 4096], b[lo : lo + 4096]) if k == len(levels) - 1 else _children(a[lo : lo + 4096], b[lo : lo + 4096], len(common))
            differ = (value[p] ^ value[q]) & common[p] & common[q]
            keep = _count(differ, wide) <= radius
            if must:
                keep &= differ & must == 0
            parts.append((p[keep], q[keep]))
            if seen is not None:
                seen["nodes"] = seen.get("nodes", 0) + len(p)
        a, b = (np.concatenate(v) for v in zip(*parts, strict=True))
    order = np.argsort(b - a, kind="stable")
    a, b = a[order], b[order]
    if seen is not None:
        seen["leaves"] = seen.get("leaves", 0) + len(a)
    span = np.arange(LEAF)
    starts = np.arange(0, n, LEAF)
    for lo in range(0, len(a), 256):
        p, q = a[lo : lo + 256], b[lo : lo + 256]
        least, most = np.minimum.reduceat(forest.root, starts), np.maximum.reduceat(forest.root, starts)
        keep = ~((least[p] == most[p]) & (least[q] == most[q]) & (least[p] == least[q]))  # else one class already
        p, q = p[keep], q[keep]
        if not p.size:
            continue
        i, j = p[:, None] * LEAF + span, q[:, None] * LEAF + span
        ok_i, ok_j = i < n, j < n
        near = _count(x[np.minimum(i, n - 1)][:, :, None] ^ x[np.minimum(j, n - 1)][:, None, :], wide) <= radius
        t, u, v = np.nonzero(near & ok_i[:, :, None] & ok_j[:, None, :])
        forest.link(i[t, u], j[t, v])
    at = np.flatnonzero(forest.root != np.arange(n))
    return at, forest.root[at]


def _small_links(x: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As gray_links, for many nodes of a leaf's size at most, side by side. size: of each row's node."""
    forest = _Forest(len(x))
    for d in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(size[:-d] > d) if d < len(x) else np.empty(0, int)
        i = i[(group[i] == group[i + d]) & (_count(x[i] ^ x[i + d], x.ndim > 1) <= radius)]
        forest.link(i, i + d)
    at = np.flatnonzero(forest.root != np.arange(len(x)))
    return at, forest.root[at]
