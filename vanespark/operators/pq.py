"""Product quantisation (Jegou, Douze, Schmid 2011): a vector as the nearest codeword of each of its m parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vanespark.operators import kernel
from vanespark.plans import kmeans


@dataclass(frozen=True)
class ProductQuantizer:
    """codebooks: (m, k, dim / m)."""

    codebooks: np.ndarray

    @property
    def m(self) -> int:
        return self.codebooks.shape[0]

    @property
    def k(self) -> int:
        return self.codebooks.shape[1]

    @property
    def dim(self) -> int:
        return self.m * self.codebooks.shape[2]

    @classmethod
    def train(cls, x: np.ndarray, m: int, nbits: int = 8, iters: int = 15, seed: int = 0, sample: int = 5000) -> ProductQuantizer:
        """From rows ``x``, of which an even stride of at most ``sample`` is used; at most 2^nbits codewords, or as many as rows."""
        if x.shape[1] % m or not 1 <= nbits <= 8:
            raise ValueError("m must divide the dimension, and nbits be 1 to 8")
        x = x[:: max(1, -(-len(x) // sample))]
        width = x.shape[1] // m
        k = min(1 << nbits, len(x))
        return cls(np.stack([kmeans.fit(x[:, j * width : (j + 1) * width], k, seed=seed ^ j, max_iters=iters) for j in range(m)]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, m) of unsigned bytes; ties to the lowest codeword."""
        parts = x.reshape(len(x), self.m, -1)
        out = np.empty((len(x), self.m), dtype=np.uint8)
        for j, book in enumerate(self.codebooks):
            out[:, j] = np.round(kmeans.distances(parts[:, j], book), 12).argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.codebooks[j][codes[:, j]] for j in range(self.m)], axis=1)

    def table_ip(self, q: np.ndarray) -> np.ndarray:
        """(queries, m, k) inner products of the queries' parts with the codewords."""
        return np.einsum("qmd,mkd->qmk", q.reshape(len(q), self.m, -1), self.codebooks)

    def table_l2(self, q: np.ndarray) -> np.ndarray:
        """(queries, m, k) squared distances."""
        p = q.reshape(len(q), self.m, 1, -1) - self.codebooks[None]
        return (p * p).sum(-1)

    @staticmethod
    def lookup(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, rows) sums over the parts."""
        return sum(table[:, j, codes[:, j]] for j in range(codes.shape[1]))

    def encode_table(self, rows: DataFrame) -> DataFrame:
        """``rows`` (vec_id, embedding) with codes, a binary of m bytes."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = self.encode(kernel.matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], type=pa.binary())], names=["vec_id", "embedding", "codes"])

        return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<float>, codes binary")

    def to_table(self, spark: SparkSession) -> DataFrame:
        """(j, t, codeword): a fixed number of rows."""
        rows = [(j, t, [float(v) for v in w]) for j, book in enumerate(self.codebooks) for t, w in enumerate(book)]
        return spark.createDataFrame(rows, "j int, t int, codeword array<double>")

    @classmethod
    def from_table(cls, books: DataFrame) -> ProductQuantizer:
        rows = sorted(books.collect())
        m = rows[-1][0] + 1
        return cls(np.array([r[2] for r in rows]).reshape(m, len(rows) // m, -1))
