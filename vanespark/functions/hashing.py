"""64-bit hashes and counter-based random numbers, vectorised over unsigned integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def splitmix(seed: int | np.ndarray, n: int) -> np.ndarray:
    """The first n outputs of SplitMix64 (Steele, Lea, Flood 2014); one row for each seed if there are several."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN
        z = np.asarray(seed, dtype=np.uint64)[..., None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def splitmix_table(rows: DataFrame, seed_col: str, n: int) -> DataFrame:
    """(seed, i, z, u): the first n outputs for each seed, as a decimal string and as a number in [0, 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed = b.column(0).to_numpy()
            z = splitmix(seed.view(np.uint64), n).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(seed, n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(seed))), pa.array(z).cast(pa.string()), pa.array(unit_floats(z))], names=["seed", "i", "z", "u"])

    return rows.select(F.col(seed_col).cast("long")).mapInArrow(run, "seed long, i int, z string, u double")


def unit_floats(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from the top 53 bits."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def bounded(x: np.ndarray, n: int) -> np.ndarray:
    return (x % np.uint64(n)).astype(np.int64)


def fnv1a(data: bytes) -> int:
    return _fnv1a_from(0xCBF29CE484222325, data)


def _fnv1a_from(h: int, data: bytes) -> int:
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(texts: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of each text: byte columns of all texts at once, in order of length so that those which have ended drop out."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    start = (np.cumsum(size) - size)[order]
    h = np.full(len(texts), 0xCBF29CE484222325, dtype=np.uint64)
    longest = size[order]
    with np.errstate(over="ignore"):
        for i in range(int(size.max()) if len(size) else 0):
            n = int(np.searchsorted(-longest, -i, side="left"))  # texts longer than i
            if n < 8:  # a few long ones are left: byte by byte
                for j in range(n):
                    h[j] = _fnv1a_from(int(h[j]), texts[order[j]][i:])
                break
            h[:n] = (h[:n] ^ raw[start[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_column(text: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes as decimal(20,0), in SQL: exact and slow, for checks."""
    raw = F.encode(text, "UTF-8")
    at = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    low = lambda h: (h % F.lit(256).cast("decimal(20,0)")).cast("int")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    m = F.expr("cast('18446744073709551616' as decimal(38,0))")

    def step(h: Column, i: Column) -> Column:
        mixed = h - low(h).cast("decimal(20,0)") + low(h).bitwiseXOR(byte(i)).cast("decimal(20,0)")
        # times 2^40 + 435, in two parts that stay inside 38 digits
        high = ((mixed.cast("decimal(20,0)") % F.lit(1 << 24).cast("decimal(20,0)")).cast("decimal(10,0)") * F.lit(1 << 40).cast("decimal(20,0)")).cast("decimal(38,0)")
        rest = (mixed.cast("decimal(20,0)") * F.lit(435).cast("decimal(5,0)")).cast("decimal(38,0)")
        return ((high + rest).cast("decimal(38,0)") % m).cast("decimal(20,0)")

    return F.aggregate(at, F.expr("cast('14695981039346656037' as decimal(20,0))"), step)
