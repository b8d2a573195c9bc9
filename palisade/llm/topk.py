"""Exact top-k search by inner product with two cover trees.

In each pair of groups (see vectors) the queries and the rows are each indexed in a cover tree: a node's points lie
within its radius of its centre, its children are points at least a shrunken radius apart, chosen farthest first until
they cover them or there are `SPREAD`; a child's radius is that of its own points, so bounds hold either way. The search goes down both trees together. With centres c and radii r, no inner product between two
nodes exceeds cq.cr + rq|cr| + rr|cq| + rq rr; a pair whose bound is below the worst kth score in its query group is
pruned with everything under it. Pairs are taken in the order of their bounds, so that kth scores rise early. Scores
that tie at the edge are kept until the smaller id decides.

Products are exact in double precision while |q| |r| dim stays below 2**53. Vectors with larger components are scored in
whole numbers of any size beside the trees; a score beyond 64 bits is the nearest number of 64 bits.

Defined cases: a vector that is null, or holds a null or a component that isn't finite, takes no part, and neither does
a null id; a zero vector takes part; vectors of different lengths aren't compared; repeated rows are rows of their own,
and only a query's own row is no candidate; fewer candidates than k give them all.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from palisade.llm.vectors import against, blocks

LEAF, SHRINK, SPREAD = 128, 0.7, 24
#: Rows of leaves that a query leaf is scored against at a time.
BATCH = 1024


class Node:
    __slots__ = ("center", "radius", "norm", "points", "children")

    def __init__(self, data: np.ndarray, points: np.ndarray, center: np.ndarray, distance: np.ndarray):
        self.center, self.points, self.children = center, points, []
        self.radius = float(distance.max()) * (1 + 1e-9)
        self.norm = float(np.sqrt((center**2).sum()))
        if len(points) <= LEAF or self.radius == 0:
            return
        # farthest first, until all points lie within the shrunken radius of a child's centre
        own, owner, near = data[points], np.zeros(len(points), np.int64), distance.copy()
        centers = [center]
        while near.max() > SHRINK * self.radius and len(centers) < SPREAD:
            centers.append(own[int(near.argmax())])
            apart = own - centers[-1]
            d = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            closer = d < near
            owner[closer], near[closer] = len(centers) - 1, d[closer]
        if len(centers) > 1:
            for i, c in enumerate(centers):
                at = owner == i
                if at.any():
                    self.children.append(Node(data, points[at], c, near[at]))


def tree(data: np.ndarray) -> Node:
    center = data[0]
    return Node(data, np.arange(len(data)), center, np.sqrt(((data - center) ** 2).sum(axis=1)))


def bound(q: Node, r: Node) -> float:
    return float(q.center @ r.center + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius) * (1 + 1e-12) + 1e-6


def _whole(k: int, queries: np.ndarray, numbers: np.ndarray, data, rows: np.ndarray) -> tuple:
    """The k best of some rows for each query in whole numbers of any size."""
    out = [[], [], []]
    values = [[int(x) for x in data.values[r]] for r in rows]
    for i, q in enumerate(queries):
        q = [int(x) for x in q]
        near = lambda v: min(max(sum(a * b for a, b in zip(q, v)), -(1 << 63)), (1 << 63) - 1)  # noqa: B023, E731
        scores = [(-near(v), int(data.ids[r]), int(r)) for v, r in zip(values, rows) if data.numbers[r] != numbers[i]]
        for score, _, r in sorted(scores)[:k]:
            for column, value in zip(out, (i, r, -score)):
                column.append(value)
    return tuple(np.array(c, np.int64) for c in out)


class _Part:
    def __init__(self, data, rows: np.ndarray):
        self.ids, self.numbers, self.values = data.ids[rows], data.numbers[rows], data.values[rows]


def integer_top_k(k: int):
    """The dual-tree search, with vectors of very large components beside it."""
    trees = dual_tree(k)

    def search(queries: np.ndarray, numbers: np.ndarray, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        limit = (2.0**53 / max(1, queries.shape[1])) ** 0.5
        large_q, large_r = (abs(queries) >= limit).any(axis=1), (abs(data.values) >= limit).any(axis=1)
        if not large_q.any() and not large_r.any():
            return trees(queries, numbers, data)
        parts = []
        for of_q, of_r in ((large_q, np.ones_like(large_r)), (~large_q, large_r)):
            q, r = np.flatnonzero(of_q), np.flatnonzero(of_r)
            i, rows, score = _whole(k, queries[q], numbers[q], data, r)
            parts.append((q[i], rows, score))
        q, r = np.flatnonzero(~large_q), np.flatnonzero(~large_r)
        i, rows, score = trees(queries[q], numbers[q], _Part(data, r))
        parts.append((q[i], r[rows], score.astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*parts))

    return search


def dual_tree(k: int):
    def search(queries: np.ndarray, numbers: np.ndarray, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(queries) or not len(data.ids):
            none = np.empty(0, np.int64)
            return none, none, np.empty(0)
        # by id, so that a row's place settles ties
        order = np.argsort(data.ids, kind="stable")
        values, own = data.values[order], data.numbers[order]
        # each query's best so far, in order; places that are still free are -inf
        best_rows = np.zeros((len(queries), k), np.int64)
        best = np.full((len(queries), k), -np.inf)

        def score(q: Node, rows: np.ndarray) -> None:
            """Score a query leaf against some rows at once and keep the k best of each query."""
            at = q.points
            scores = queries[at] @ values[rows].T
            scores[numbers[at][:, None] == own[rows][None, :]] = -np.inf
            some = (scores >= best[at, -1:]).any(axis=0) & (scores > -np.inf).any(axis=0)
            if not some.any():
                return
            rows = rows[some]
            all_ = np.hstack([best[at], scores[:, some]])
            edge = -np.partition(-all_, k - 1, axis=1)[:, k - 1 : k]
            i, c = np.nonzero((all_ >= edge) & (all_ > -np.inf))
            row = np.where(c < k, best_rows[at[i], np.minimum(c, k - 1)], rows[np.maximum(c - k, 0)])
            order = np.lexsort((row, -all_[i, c], i))
            i, c, row = i[order], c[order], row[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            best[at] = -np.inf
            best[at[i[keep]], place[keep]] = all_[i[keep], c[keep]]
            best_rows[at[i[keep]], place[keep]] = row[keep]

        root = tree(values)
        count = 0
        stack = [(tree(queries), [root])]
        while stack:
            q, nodes = stack.pop()
            floor = best[q.points, -1].min()
            nodes = [r for r in nodes if bound(q, r) >= floor]
            if q.children:
                wider = [c for r in nodes for c in (r.children or [r])]
                stack.extend((c, wider) for c in q.children)
                continue
            heap = []
            for r in nodes:
                heapq.heappush(heap, (-bound(q, r), count, r))
                count += 1
            taken, held = [], 0
            while heap or taken:
                floor = best[q.points, -1].min()
                if heap and -heap[0][0] >= floor:
                    r = heapq.heappop(heap)[2]
                    if not r.children:
                        taken.append(r.points)
                        held += len(r.points)
                    for c in r.children:
                        b = bound(q, c)
                        if b >= floor:
                            heapq.heappush(heap, (-b, count, c))
                            count += 1
                else:
                    heap = []  # every other bound is below the worst kth score
                if taken and (held >= BATCH or not heap):
                    score(q, np.concatenate(taken))
                    taken, held = [], 0
        q, place = np.nonzero(best > -np.inf)
        return q, order[best_rows[q, place]], best[q, place]

    return search


def scaled(factor: float):
    """floor(factor * x) of each component; rows with a component that isn't finite take no part."""

    def convert(values: np.ndarray):
        good = np.isfinite(values).all(axis=1)
        with np.errstate(invalid="ignore"):
            return np.floor(factor * values), good

    return convert


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): each query's k largest integer inner products.

    Queries are the rows whose id `every` divides.
    """
    packed = blocks(vectors, id_col, vector_col, every, scaled(factor))
    return against(packed, every, k, integer_top_k(k), exact=True)


