"""Text to vectors: a seeded toy embedder behind an interface that real models can fill."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vanespark.functions.hashing import fnv1a_all, splitmix, unit_floats


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""


class RandomEmbedder:
    """Coordinates in [-0.5, 0.5) that depend on the text and the seed alone, whatever the order of calls."""

    def __init__(self, dim: int, seed: int = 0, normalize: bool = True):
        self.dim, self.seed, self.normalize = dim, seed, normalize

    def embed(self, texts: list[str]) -> np.ndarray:
        seeds = fnv1a_all([t.encode() for t in texts]) ^ np.uint64(self.seed)
        out = unit_floats(splitmix(seeds, self.dim)).reshape(len(texts), self.dim) - 0.5
        if self.normalize and len(out):
            n = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.where(n == 0, 1, n)
        return out


def embed_table(texts: DataFrame, embedder: Embedder, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(vec_id, embedding) from (id, text); a null text is embedded as ''. Batches go to Python by Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = embedder.embed(["" if t is None else t for t in b.column(1).to_pylist()]).astype(np.float32)
            flat = pa.array(v.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.FixedSizeListArray.from_arrays(flat, embedder.dim).cast(pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return texts.select(id_col, text_col).mapInArrow(run, "vec_id long, embedding array<float>")
