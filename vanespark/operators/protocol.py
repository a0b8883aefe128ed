"""What every index answers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class AnnIndex(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, score, rk) for queries (qid, embedding)."""

    def without(self, ids: DataFrame) -> AnnIndex:
        """The index less the rows of ``ids`` (vec_id)."""
