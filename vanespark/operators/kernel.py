"""NumPy kernels over Arrow batches: matrices of scores and the best of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vanespark.functions.vectors import Metric

HITS = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
HITS_DDL = "qid long, vec_id long, score double"
#: Queries that go to every task at once: more are done in blocks of so many.
BLOCK_QUERIES = 4096
#: Scores of a tile that are made at once, and hits that a task holds, whatever the size of tables and Arrow batches.
TILE_QUERIES, TILE_ROWS = 128, 2048
HELD, OUT_ROWS = 1 << 20, 1 << 16
#: Scores are ranked at this many decimals.
DECIMALS = 9


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column in doubles; a length other than ``dim`` or a null is an error."""
    if len(col) == 0:
        return np.empty((0, dim))
    sizes = pc.list_value_length(col)
    if col.null_count or pc.min(sizes).as_py() != dim or pc.max(sizes).as_py() != dim:
        raise ValueError(f"vectors must have {dim} components")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def scores(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Score of each query (row) with each vector (column)."""
    if metric.is_cosine:
        return unit(q) @ unit(x).T
    return -np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0)


def fading(ts: np.ndarray, now: int, rate: float) -> np.ndarray:
    """What a positive score of each row is multiplied with at ``now``, and another one divided by."""
    return np.maximum(np.exp(-rate * np.maximum(now - ts.astype(np.float64), 0)), 1e-9)


def decayed(s: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Scores (queries, rows) weakened by :func:`fading`, as :func:`vanespark.functions.vectors.decayed` does."""
    return np.where(s > 0, s * f, s / f)


def best(s: np.ndarray, ids: np.ndarray, k: int, decimals: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(query index, column) of the k best columns of each row, ties by id; NaN never wins."""
    s = np.round(np.where(np.isnan(s), -np.inf, s), decimals)
    k = min(k, s.shape[1])
    if k < s.shape[1]:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, col = np.nonzero(s >= kth[:, None])  # all ties with the k-th: the last cut is by id
    else:
        row, col = np.nonzero(s > -np.inf)
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (nth < k) & (s[row, col] > -np.inf)
    return row[keep], col[keep]


class Scorer:
    """Scores of a block of queries with batches of rows, a tile at a time."""

    def __init__(self, metric: Metric, q: np.ndarray):
        self.cosine = metric.is_cosine
        self.q = unit(q) if self.cosine else q
        self.qq = (q * q).sum(1)

    def of(self, x: np.ndarray, fade: np.ndarray | None = None, whole: bool = True) -> Callable[[np.ndarray, slice], np.ndarray]:
        """A function of places of queries and a slice of the rows ``x``. Without ``whole`` rows keep their length: cosine becomes
        the inner product with the query brought to length one."""
        if self.cosine:
            x = unit(x) if whole else x
        else:
            xx = (x * x).sum(1)

        def score(who: np.ndarray, rows: slice) -> np.ndarray:
            s = self.q[who] @ x[rows].T
            if not self.cosine:
                s = -np.maximum(self.qq[who][:, None] + xx[rows][None, :] - 2 * s, 0)
            return s if fade is None else decayed(s, fade[rows])

        return score


class Tops:
    """The k best rows of each of a block's queries among those that a task has seen; ties by id, NaN never wins.

    Scores are made in tiles, and only those that reach a query's k-th best so far are held. What is held is bounded: where k
    rows a query are more than that, they are given out early and the cut is left to the ranking after the shuffle.
    """

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.room = min(HELD, max(4 * k * len(qids), 1 << 16))
        self.floor = np.full(len(qids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, who: np.ndarray, ids: np.ndarray, score: Callable[[np.ndarray, slice], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows ``ids`` for the queries at places ``who``."""
        for a in range(0, len(ids), TILE_ROWS):
            rows = slice(a, a + TILE_ROWS)
            for b in range(0, len(who), TILE_QUERIES):
                part = who[b : b + TILE_QUERIES]
                self._tile(part, ids[rows], score(part, rows))
                if self.n > self.room:
                    self._cut()
                    if self.n > self.room // 2:
                        yield from self._out()

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._cut()
        yield from self._out()

    def _tile(self, who: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        floor, over = self.floor[who], s.shape[1] - self.k
        if over > 0 and np.isneginf(floor).any():
            s = np.where(np.isnan(s), -np.inf, s)
            floor = np.maximum(floor, np.round(np.partition(s, over, axis=1)[:, over], DECIMALS))
            self.floor[who] = floor
        row, col = np.nonzero(s >= (floor - 10.0**-DECIMALS)[:, None])  # all ties with the k-th: the last cut is by id
        got = s[row, col]
        keep = (got > -np.inf) & (np.round(got, DECIMALS) >= floor[row])
        if keep.any():
            self.held.append((who[row[keep]], ids[col[keep]], got[keep]))
            self.n += int(keep.sum())

    def _cut(self) -> None:
        if not self.n:
            return
        q, ids, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -np.round(s, DECIMALS), q))
        q, ids, s = q[order], ids[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], np.round(s[last], DECIMALS))
        keep = nth < self.k
        self.held, self.n = [(q[keep], ids[keep], s[keep])], int(keep.sum())

    def _out(self) -> Iterator[pa.RecordBatch]:
        for q, ids, s in self.held:
            for a in range(0, len(q), OUT_ROWS):
                b = slice(a, a + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(self.qids[q[b]]), pa.array(ids[b]), pa.array(s[b])], schema=HITS)
        self.held, self.n = [], 0


def block_for(k: int) -> int:
    """Queries of a block whose k best rows each are held at once."""
    return max(512, min(BLOCK_QUERIES, HELD // (4 * k)))


def spread(rows: DataFrame, queries: int) -> DataFrame:
    """``rows`` over all cores, however few files they come from: for many queries a search costs far more than this shuffle,
    which blocks of queries that read the same rows share."""
    if queries < TILE_QUERIES:
        return rows
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 12), "vec_id")


def query_blocks(queries: DataFrame, block: int = BLOCK_QUERIES) -> list[tuple[np.ndarray, np.ndarray]]:
    """(qids, matrix) of a query table (qid, embedding) in blocks of bounded size."""
    rows = queries.select("qid", "embedding").orderBy("qid").toLocalIterator()
    out, qid, vec = [], [], []
    for q, v in rows:
        qid.append(q)
        vec.append(v)
        if len(qid) == block:
            out.append((np.array(qid, dtype=np.int64), np.array(vec, dtype=np.float64)))
            qid, vec = [], []
    if qid:
        out.append((np.array(qid, dtype=np.int64), np.array(vec, dtype=np.float64)))
    return out
