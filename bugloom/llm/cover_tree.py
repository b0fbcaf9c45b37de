"""A cover tree over norm-augmented vectors, and best-first search for inner products in it.

A candidate x becomes x' = (x, sqrt(M^2 - |x|^2)) with M the largest norm in the tree, an anchor q
becomes (q, 0): then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the nearest are those with the largest
inner product. A node is a center and the covering radius of all below it; its children's
centers are picked farthest first, so they lie farther apart than the radius they leave. With
the distance d of an anchor from a center and the radius r, all inner products below a node lie
between (|q|^2 + M^2 - (d + r)^2) / 2 and (|q|^2 + M^2 - (d - r)^2) / 2.

A tree is a bounded block of rows. Vectors are of integers, and products are exact.
"""

from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 32
CHILDREN = 16
# Bounds come from rounded distances; products are integers, so half a unit is a safe margin.
MARGIN = 0.5
NONE = np.int64(-(1 << 62))
# Products of larger norms are not exact in double precision, or leave no room for the rank.
LARGEST_PRODUCT = 1 << 46


@dataclass
class Tree:
    """Rows in tree order; nodes level by level, the root first; a node's rows lie together."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    parents: np.ndarray
    levels: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    @property
    def norm2(self) -> float:
        return float((self.vectors * self.vectors).sum(1).max(initial=0.0))


def _farthest_first(points: np.ndarray, center: int, radius: float) -> tuple[list[int], np.ndarray]:
    """Centers that leave at most half the radius (or ``CHILDREN`` of them), and who is whose."""
    chosen, owner = [center], np.zeros(len(points), np.int64)
    nearest = np.sqrt(((points - points[center]) ** 2).sum(1))
    while len(chosen) < CHILDREN:
        far = int(nearest.argmax())
        if nearest[far] <= radius / 2:
            break
        away = np.sqrt(((points - points[far]) ** 2).sum(1))
        closer = away < nearest
        owner[closer], nearest[closer] = len(chosen), away[closer]
        chosen.append(far)
    return chosen, owner


def build(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tree:
    """A tree over integer vectors (as doubles)."""
    norms = (vectors * vectors).sum(1)
    points = np.hstack([vectors, np.sqrt(norms.max(initial=0.0) - norms)[:, None]])
    middle = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.arange(len(ids))
    centers, radii, parents, levels, spans, leaves = [], [], [], [], [], []
    level, open_nodes = 0, [(0, len(ids), middle, -1)]
    while open_nodes:
        following = []
        for first, last, center, parent in open_nodes:
            own = order[first:last].copy()
            radius = float(np.sqrt(((points[own] - points[center]) ** 2).sum(1).max()))
            node, done = len(centers), last - first <= LEAF_ROWS or radius == 0.0
            centers.append(center)
            radii.append(radius)
            parents.append(parent)
            levels.append(level)
            spans.append((first, last))
            leaves.append(done)
            if done:
                continue
            at = int(np.flatnonzero(own == center)[0])
            chosen, owner = _farthest_first(points[own], at, radius)
            by_owner = np.argsort(owner, kind="stable")
            order[first:last] = own[by_owner]
            begin = first
            for k, size in enumerate(np.bincount(owner, minlength=len(chosen))):
                following.append((begin, begin + int(size), int(own[chosen[k]]), node))
                begin += int(size)
        level, open_nodes = level + 1, following
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    span = np.array(spans, np.int64)
    return Tree(
        vectors[order], ids[order], labels[order], place[np.array(centers)], np.array(radii),
        np.array(parents), np.array(levels), span[:, 0], span[:, 1], np.array(leaves),
    )


def bounds(tree: Tree, anchors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product below each node, for each anchor: [node, anchor].

    Level by level from the root; a child's bounds are never wider than its parent's.
    """
    whole = norms[None, :] + tree.norm2
    away = np.sqrt(np.maximum(whole - 2 * (tree.vectors[tree.centers] @ anchors.T), 0.0))
    radii = tree.radii[:, None]
    low = (whole - (away + radii) ** 2) / 2
    high = (whole - np.maximum(away - radii, 0.0) ** 2) / 2
    for level in range(1, int(tree.levels.max()) + 1):
        own = np.flatnonzero(tree.levels == level)
        above = tree.parents[own]
        low[own] = np.maximum(low[own], low[above])
        high[own] = np.minimum(high[own], high[above])
    return low - MARGIN, high + MARGIN


class Search:
    """The best ``k`` rows per query over several trees, with scores in a query's window.

    Queries are rows of ``anchors`` (by index ``of``), their windows of scores, and the label of
    the anchor; ``same`` tells whether found rows must share it or must not. A found row is kept
    as one number, its score and then the rank of its id, so that smaller ids win ties.
    """

    def __init__(self, trees: list[Tree], anchors, anchor_ids, anchor_labels, of, low, high, k, same):
        self.trees, self.anchors, self.k, self.same = trees, anchors, k, same
        self.anchor_ids, self.anchor_labels = anchor_ids, anchor_labels
        self.of, self.low, self.high = of, low.astype(float), high.astype(float)
        self.norms = (anchors * anchors).sum(1)
        largest = max((t.norm2 for t in trees), default=0.0) * float(self.norms.max(initial=0.0))
        if largest > float(LARGEST_PRODUCT) ** 2:
            raise ValueError("components are too large for exact inner products")
        self.ids = np.sort(np.concatenate([t.ids for t in trees]))
        self.shift = max(1, int(len(self.ids)).bit_length())
        self.best = np.full((len(of), k), NONE)
        self.verified = 0

    def floors(self) -> np.ndarray:
        """The lowest score that can still enter a query's best."""
        worst = self.best.min(1)
        scores = (worst >> self.shift).astype(float)
        return np.maximum(self.low, np.where(worst == NONE, -np.inf, scores))

    def run(self) -> "Search":
        for tree in self.trees:
            self._descend(tree)
        return self

    def _descend(self, tree: Tree) -> None:
        """Leaves by their upper bound, best first, in rounds of doubling size.

        A node is closed for a query once its bounds miss the query's window, or its upper bound
        is below the query's ``k``-th best; what is below a closed node is closed with it.
        """
        low, high = bounds(tree, self.anchors, self.norms)
        low, high = low[:, self.of], high[:, self.of]
        closed = (low > self.high) | (high < self.floors())
        leaves = np.flatnonzero(tree.leaf)
        upper = np.where(closed, -np.inf, high)[leaves]
        order = np.argsort(-upper, axis=0, kind="stable")
        ranks = len(self.ids) - 1 - np.searchsorted(self.ids, tree.ids)
        begin, size = 0, 1
        while begin < len(leaves):
            part = order[begin:begin + size]
            wanted = np.take_along_axis(upper, part, 0) >= self.floors()
            if not (wanted & np.isfinite(np.take_along_axis(upper, part, 0))).any():
                break
            opened = np.zeros(upper.shape, bool)
            np.put_along_axis(opened, part, wanted, 0)
            opened &= np.isfinite(upper)
            for at in np.flatnonzero(opened.any(1)):
                queries = np.flatnonzero(opened[at])
                queries = queries[upper[at, queries] >= self.floors_of(queries)]
                if len(queries):
                    self._verify(tree, int(leaves[at]), queries, ranks)
            begin, size = begin + size, size * 2

    def floors_of(self, queries: np.ndarray) -> np.ndarray:
        worst = self.best[queries].min(1)
        scores = (worst >> self.shift).astype(float)
        return np.maximum(self.low[queries], np.where(worst == NONE, -np.inf, scores))

    def _verify(self, tree: Tree, leaf: int, queries: np.ndarray, ranks: np.ndarray) -> None:
        """Exact scores of a leaf's rows."""
        rows = slice(int(tree.first[leaf]), int(tree.last[leaf]))
        of = self.of[queries]
        asked, inverse = np.unique(of, return_inverse=True)
        scores = (self.anchors[asked] @ tree.vectors[rows].T)[inverse]
        self.verified += scores.size
        alike = self.anchor_labels[of][:, None] == tree.labels[None, rows]
        fits = (scores >= self.low[queries][:, None]) & (scores <= self.high[queries][:, None])
        fits &= alike if self.same else ~alike
        fits &= self.anchor_ids[of][:, None] != tree.ids[None, rows]
        hit = fits.any(1)
        if not hit.any():
            return
        found = (scores[hit].astype(np.int64) << self.shift) | ranks[None, rows]
        both = np.concatenate([self.best[queries[hit]], np.where(fits[hit], found, NONE)], 1)
        cut = both.shape[1] - self.k
        self.best[queries[hit]] = np.partition(both, cut, 1)[:, cut:]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of all found rows."""
        queries, at = np.nonzero(self.best != NONE)
        codes = self.best[queries, at]
        ranks = codes & ((1 << self.shift) - 1)
        return queries, self.ids[len(self.ids) - 1 - ranks], codes >> self.shift
