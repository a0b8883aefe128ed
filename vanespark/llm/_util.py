"""Shared plumbing: pieces of texts, rows that keep any column, tiles and runs of keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.tables import drop_table, table_of, written  # noqa: F401

#: Tables are broadcast up to so many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table of rows of ``row_bytes`` at most, marked for broadcast if it is within BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` if it only reads files, so that every read gives the same rows in the same tasks; else a written copy of it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df, "settled") if any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "Join", "ExistingRDD")) or "FileScan" not in plan else df


def packed(df: DataFrame, *names: str | F.Column) -> DataFrame:
    """``df`` as one struct column _doc beside those of its columns ``names`` that the caller works on: so no other column can
    clash with what the caller adds. ``select("_doc.*")`` gives the rows back."""
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
    return df.select(whole.alias("_doc"), *names)


def own(columns: list[str], **changed: str) -> list[F.Column]:
    """``columns`` out of _doc, or where ``changed`` names another column in their place, out of that."""
    return [(F.col(changed[c]) if c in changed else F.col("_doc").getField(c)).alias(c) for c in columns]


def cols(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def utf8(col: pa.Array) -> list[bytes]:
    """Values as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def strs(col: pa.Array) -> list[str]:
    """Values as str; null is empty."""
    return ["" if x is None else x for x in col.to_pylist()]


#: Bytes of a text whose words are held at once.
PIECE_BYTES = 1 << 20
GAP = re.compile(rb"[\x09-\x0d ]")


def word_pieces(text: bytes, size: int = PIECE_BYTES, change: Callable[[bytes], bytes] = bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` as ASCII white space parts them, of about ``size`` bytes at a time, after ``change``."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield change(text[at:end]).split()
        at = end


def tidy() -> None:
    """Give memory that this worker no longer uses back to the system, for the tasks after it and beside it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def record_batch(schema: str | pa.Schema, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, type=f.type) if not isinstance(d, pa.Array) else d for d, f in zip(data, schema)], schema=schema)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Cut a stream sorted by integer ``keys`` into one record batch for each key; a run is bounded by the caller's tiling."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = [np.asarray(b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for k in ks:
            change[1:] |= k[1:] != k[:-1]
        first = tuple(k[0] for k in ks)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        start = 0
        for c in cuts:
            if c > start:
                held.append(b.slice(start, c - start))
            yield _joined(held)
            held, start = [], int(c)
        held.append(b.slice(start))
        last = tuple(k[-1] for k in ks)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def tiled(rows: DataFrame, keys: list[str], salt: str, tile_rows: int) -> DataFrame:
    """Rows of groups of two or more, dealt into tile pairs of at most about 2 * ``tile_rows`` rows.

    A group of n rows has ceil(n / tile_rows) tiles, chosen by a hash of ``salt``; each row goes to the pairs its tile is part
    of, so every two rows of a group meet in exactly one pair (tile_a, tile_b), and a hot group spreads over many tasks.
    Adds tile_a, tile_b and tile_own (the row's tile).
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    n_tiles = F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int")
    out = rows.join(sizes, keys).withColumn("_tiles", n_tiles)
    out = out.withColumn("tile_own", F.pmod(F.xxhash64(F.col(salt)), F.col("_tiles")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return out.withColumn("tile_a", F.least("_o", "tile_own")).withColumn("tile_b", F.greatest("_o", "tile_own")).drop("_o", "_n", "_tiles")


def adjacency_roots(adj: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index, for a symmetric boolean matrix."""
    n = len(adj)
    root = np.arange(n)
    seen = ~adj.any(axis=1)
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        frontier = np.array([i])
        while len(frontier):
            near = adj[frontier].any(axis=0) & ~seen
            frontier = np.flatnonzero(near)
            seen[frontier] = True
            root[frontier] = i
    return root
