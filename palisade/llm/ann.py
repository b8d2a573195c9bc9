"""Approximate maximum inner product search with score-aware anisotropic quantisation.

Vectors are product-quantised, two components a subspace and sixteen centres each. The loss weighs the part of a
residual that is parallel to its vector more than the part across it, because only the former shifts large inner
products: eta = (d - 1) T^2 / (1 - T^2) for scores above T times the norm. Centres are fitted to a bounded sample (at
most `SAMPLE` rows, those with the smallest hash of their id) by Lloyd steps under that loss; every row of the table is
encoded, by sweeps over the subspaces that see the parallel residual of all the others. A search adds up table entries
of four-bit codes, two codes a look, for all rows of a group, and the `SHORT` best of each group are scored exactly in
double precision on the original vectors.

The index is in the blocks that vectors.against deals out, so each group of queries scans each group of rows. Recall
against brute force is measured in the tests and stated in the README.

Defined cases: a vector that is null, zero, or holds a null or a component that isn't finite takes no part, and neither
does a null id; vectors of different lengths aren't compared (lengths other than the most frequent are scored exactly,
unquantised); repeated rows are rows of their own, and only a query's own row is no candidate; fewer candidates than k
give them all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from palisade.llm.vectors import against, blocks

SAMPLE, CENTERS, SUB, STEPS, SWEEPS, SEED = 8192, 16, 2, 8, 2, 11
THRESHOLD, SHORT = 0.2, 256


class Quantiser:
    def __init__(self, sample: np.ndarray):
        n, self.dim = sample.shape
        self.subs = -(-self.dim // SUB)
        self.width = self.subs + self.subs % 2  # an even number of codes: two a look
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        rng = np.random.default_rng(SEED)
        x, u = self._split(sample), self._split(sample / np.linalg.norm(sample, axis=1, keepdims=True))
        self.centers = np.zeros((self.subs, CENTERS, SUB))
        for s in range(self.subs):
            self.centers[s] = x[rng.choice(n, CENTERS, replace=n < CENTERS), s]
        w = self.eta - 1
        for _ in range(STEPS):
            for s in range(self.subs):
                r = x[:, s, None, :] - self.centers[s][None]
                loss = (r**2).sum(axis=2) + w * (r * u[:, s, None, :]).sum(axis=2) ** 2
                code = loss.argmin(axis=1)
                m = np.eye(SUB)[None] + w * u[:, s, :, None] * u[:, s, None, :]
                b = (m @ x[:, s, :, None])[:, :, 0]
                for c in range(CENTERS):
                    at = code == c
                    if at.any():
                        self.centers[s, c] = np.linalg.solve(m[at].sum(axis=0), b[at].sum(axis=0))

    def _split(self, values: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(values), self.subs * SUB))
        padded[:, : values.shape[1]] = values
        return padded.reshape(len(values), self.subs, SUB)

    def encode(self, values: np.ndarray) -> np.ndarray:
        x, u = self._split(values), self._split(values / np.linalg.norm(values, axis=1, keepdims=True))
        across = np.empty((self.subs, len(values), CENTERS))
        along = np.empty((self.subs, len(values), CENTERS))
        for s in range(self.subs):
            r = x[:, s, None, :] - self.centers[s][None]
            across[s], along[s] = (r**2).sum(axis=2), (r * u[:, s, None, :]).sum(axis=2)
        w, rows = self.eta - 1, np.arange(len(values))
        code = np.array([(across[s] + w * along[s] ** 2).argmin(axis=1) for s in range(self.subs)])
        total = sum(along[s][rows, code[s]] for s in range(self.subs))
        for _ in range(SWEEPS):
            for s in range(self.subs):
                others = total - along[s][rows, code[s]]
                code[s] = (across[s] + w * (others[:, None] + along[s]) ** 2).argmin(axis=1)
                total = others + along[s][rows, code[s]]
        codes = np.zeros((len(values), self.width), np.uint8)
        codes[:, : self.subs] = code.T
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and pair of subspaces the 256 sums of two codes."""
        one = np.zeros((len(queries), self.width, CENTERS), np.float32)
        one[:, : self.subs] = np.einsum("qsd,scd->qsc", self._split(queries), self.centers)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), self.width // 2, CENTERS * CENTERS)


def _search(k: int, short: int, quantiser: Quantiser | None):
    def search(queries: np.ndarray, numbers: np.ndarray, data):
        none = np.empty(0, np.int64)
        if not len(queries) or not len(data.ids):
            return none, none, np.empty(0)
        quantised = quantiser is not None and data.values.shape[1] == quantiser.dim and len(data.ids) > short
        out = []
        tables = quantiser.tables(queries) if quantised else None
        columns = np.ascontiguousarray(data.extra.T) if quantised else None
        by_id = np.argsort(data.ids, kind="stable")
        for i in range(len(queries)):
            if quantised:
                guess = np.zeros(len(data.ids), np.float32)
                for p in range(len(columns)):
                    guess += tables[i, p][columns[p]]
                rows = np.argpartition(-guess, short)[:short]
                # everything that ties with the edge comes along, so copies are never split by chance
                edge = np.flatnonzero(guess == guess[rows].min())
                rows = np.union1d(rows, edge)
            else:
                rows = by_id
            rows = rows[data.numbers[rows] != numbers[i]]
            # summed one way for every row, so equal vectors have equal scores
            score = (data.values[rows] * queries[i]).sum(axis=1)
            best = np.lexsort((data.ids[rows], -score))[:k]
            out.append((np.full(len(best), i), rows[best], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out))

    return search


def _finite(values: np.ndarray):
    good = np.isfinite(values).all(axis=1)
    good &= (np.where(np.isfinite(values), values, 0) != 0).any(axis=1)
    return values, good


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, short: int = SHORT, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score double): each query's k largest inner products among those that the index finds.

    Queries are the rows whose id `every` divides. sample: rows that the quantiser is fitted to, at most.
    """
    vector = F.col(vector_col).cast("array<double>")
    drawn = (
        vectors.where(F.col(id_col).isNotNull() & vector.isNotNull())
        .select(F.xxhash64(id_col, vector_col).alias("h"), vector.alias("v"))
        .orderBy("h")
        .limit(sample)
        .toPandas()["v"]
    )
    by_dim: dict[int, list] = {}
    for v in drawn:
        by_dim.setdefault(len(v), []).append(v)
    quantiser = None
    if by_dim:
        dim = max(by_dim, key=lambda d: (len(by_dim[d]), d))
        values, good = _finite(np.array([np.asarray(v, np.float64) for v in by_dim[dim]]).reshape(-1, dim))
        if good.any() and dim:
            quantiser = Quantiser(values[good])

    width = quantiser.width // 2 if quantiser else 1

    def encode(values: np.ndarray) -> np.ndarray:
        if quantiser and values.shape[1] == quantiser.dim:
            return quantiser.encode(values)
        return np.zeros((len(values), width), np.uint8)

    packed = blocks(vectors, id_col, vector_col, every, _finite, encode)
    return against(packed, every, k, _search(k, short, quantiser), width)


