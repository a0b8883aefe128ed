"""Learned transforms before product quantisation (Ge et al. 2013): a permutation that balances the variance of the parts, a
rotation to principal axes, or both."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.operators import kernel


@dataclass(frozen=True)
class Transform:
    """Rotate, then permute; None leaves out a step."""

    dim: int
    rotation: np.ndarray | None = None
    permutation: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.rotation is not None and self.rotation.shape != (self.dim, self.dim):
            raise ValueError("the rotation must be square in the dimension")
        if self.permutation is not None and sorted(int(i) for i in self.permutation) != list(range(self.dim)):
            raise ValueError("the permutation must hold each place once")

    @property
    def is_identity(self) -> bool:
        return self.rotation is None and self.permutation is None

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.rotation is not None:
            x = x @ self.rotation.T
        return x if self.permutation is None else x[..., self.permutation]

    def apply_table(self, rows: DataFrame) -> DataFrame:
        """``rows`` (vec_id, embedding) transformed, in doubles."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = self.apply(kernel.matrix(b.column(1), self.dim))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), type=pa.list_(pa.float64()))], names=["vec_id", "embedding"])

        return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>")

    def fingerprint(self) -> str:
        h = hashlib.sha256(str(self.dim).encode())
        for a, kind in ((self.rotation, "<f8"), (self.permutation, "<i8")):
            h.update(b"-" if a is None else np.asarray(a).astype(kind).tobytes())
        return h.hexdigest()


def balanced(variance: np.ndarray, m: int) -> np.ndarray:
    """Places in order of m parts of equal size: by falling variance each goes to the lightest part with room."""
    if len(variance) % m:
        raise ValueError("m must divide the dimension")
    room = len(variance) // m
    parts: list[list[int]] = [[] for _ in range(m)]
    weight = np.zeros(m)
    for i in np.argsort(-variance, kind="stable"):
        j = min((p for p in range(m) if len(parts[p]) < room), key=lambda p: (weight[p], p))
        parts[j].append(int(i))
        weight[j] += variance[i]
    return np.array([i for p in parts for i in p])


def train(x: np.ndarray, m: int, mode: str = "pca-perm") -> Transform:
    """mode: none, perm, pca or pca-perm, from rows ``x``. Axes go by falling variance."""
    if mode not in ("none", "perm", "pca", "pca-perm"):
        raise ValueError("mode is none, perm, pca or pca-perm")
    dim = x.shape[1]
    return _from_covariance(np.cov(x.T, bias=True).reshape(dim, dim), m, mode)


def _from_covariance(c: np.ndarray, m: int, mode: str) -> Transform:
    dim = len(c)
    if mode == "none":
        return Transform(dim)
    if mode == "perm":
        return Transform(dim, None, balanced(np.diag(c), m))
    values, vectors = np.linalg.eigh(c)
    r = vectors[:, ::-1].T
    r *= np.where(r[np.arange(dim), np.abs(r).argmax(axis=1)] < 0, -1, 1)[:, None]  # a sign for each axis
    return Transform(dim, r, balanced(values[::-1], m) if mode == "pca-perm" else None)


def variances(rows: DataFrame) -> DataFrame:
    """(i, variance) of each place over all rows."""
    return rows.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("variance"))


def covariance(rows: DataFrame) -> DataFrame:
    """(i, j, cov), i <= j, of all places over all rows. Each task sums products of centred rows to one matrix, so a row for each
    pair of places and task is what is shuffled."""
    dim, means = _means(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            x = kernel.matrix(b.column(0), dim) - means
            total += x.T @ x
            n += len(x)
        i, j = np.triu_indices(dim)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(np.full(len(i), n))], names=["i", "j", "s", "n"])

    parts = rows.select("embedding").mapInArrow(run, "i int, j int, s double, n long")
    return parts.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("cov"))


def _means(rows: DataFrame) -> tuple[int, np.ndarray]:
    got = sorted(rows.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v")).collect())  # a row a place
    return len(got), np.array([r[1] for r in got])


def train_on_all(rows: DataFrame, m: int, mode: str = "pca-perm") -> Transform:
    """As :func:`train`, from the covariance of all rows: what reaches the driver is a number for each pair of places."""
    if mode not in ("none", "perm", "pca", "pca-perm"):
        raise ValueError("mode is none, perm, pca or pca-perm")
    got = covariance(rows).collect() if mode != "none" else []
    dim = 1 + max((r["j"] for r in got), default=-1) if got else len(rows.select("embedding").first()[0])
    c = np.zeros((dim, dim))
    for r in got:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
    return _from_covariance(c, m, mode)
