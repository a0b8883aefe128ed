"""Context and time features: tags hashed into slots, time as sines and cosines, both beside a semantic vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vanespark.functions.vectors import let, normalized

SLOTS = 32
#: Angular rates by day.
RATES = (1.0, 1.0 / 7, 1.0 / 30, 1.0 / 365)


@dataclass(frozen=True)
class Scales:
    semantic: float = 0.95
    context: float = 0.55
    time: float = 0.6


def all_tags(tags: Column, source: Column, session: Column) -> Column:
    """Tags with the source and the session as two more, where they aren't null."""
    named = F.array(F.concat(F.lit("source:"), source), F.concat(F.lit("session:"), session))
    return F.array_compact(F.concat(F.coalesce(tags, F.array().cast("array<string>")), named))


def slot(tag: Column) -> Column:
    """FNV-1a of the tag's UTF-8 bytes, modulo 32. Only five bits of the state reach the result, so they are all that is kept."""
    raw = F.encode(tag, "UTF-8")
    n = F.octet_length(tag)
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(5), lambda h, i: (h.bitwiseXOR(byte(i).bitwiseAND(F.lit(31))) * 19).bitwiseAND(F.lit(31)))


def encode_context(tags: Column) -> Column:
    """Counts of tags by slot, of length one; zeros without tags."""
    every = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    counts = let(F.transform(tags, slot), lambda slots: F.transform(every, lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double")))
    return normalized(counts)


def encode_time(unix_seconds: Column) -> Column:
    """Sine and cosine of the day at four rates; each pair has length one, so half of it gives length one in all."""
    day = unix_seconds.cast("double") / 86400.0
    return F.array(*(0.5 * f(day * F.lit(r)) for r in RATES for f in (F.sin, F.cos)))


def combine(semantic: Column, context: Column, time: Column, scales: Scales = Scales()) -> Column:
    """The scaled blocks one after another, of length one."""
    scaled = lambda v, s: F.transform(v.cast("array<double>"), lambda x: x * F.lit(s))
    return normalized(F.concat(scaled(semantic, scales.semantic), scaled(context, scales.context), scaled(time, scales.time)))


def encode(semantic: Column, tags: Column, source: Column, session: Column, unix_seconds: Column, scales: Scales = Scales()) -> Column:
    """A memory or a query: both are encoded alike."""
    return combine(semantic, encode_context(all_tags(tags, source, session)), encode_time(unix_seconds), scales)
