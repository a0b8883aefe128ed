"""Document fingerprints: exact digests of a canonical form.

The canonical form of a text is NFKC, case folded, NFKC again, with runs of white space as one space and none at the ends. Its
fingerprint is the 128-bit XXH3 hash; texts whose hashes are equal are compared byte for byte, and should different ones ever
meet in a bucket, their fingerprints go on with a SHA-256.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vanespark.llm._util import broadcast_if_small, cols, record_batch, strs, written


def canonical(text: str) -> bytes:
    text = " ".join(text.split())
    if text.isascii():
        return text.lower().encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> bytes:
    return xxhash.xxh3_128_digest(canon)


_KEY = pa.schema([("digest", pa.binary()), ("canon", pa.binary())])


def collisions(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest) of the buckets whose canonical texts aren't all the same bytes. ``digests`` (digest): one row for each text.

    Only buckets of two or more are looked at; their texts meet as a least and a greatest one, pre-aggregated in each task, so
    a bucket of any size costs one row a task.
    """
    twice = broadcast_if_small(written(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("digest"), "twice"), 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canon = [canonical(t) for t in strs(b.column(0))]
            yield record_batch(_KEY, [[digest(c) for c in canon], canon])

    texts = docs.select("text").mapInArrow(run, "digest binary, canon binary").join(twice, "digest", "left_semi")
    return unequal(texts)


def unequal(texts: DataFrame) -> DataFrame:
    """(digest) under which (digest, canon) has different bytes."""
    return texts.groupBy("digest").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("digest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fingerprint): 32 hex digits; equal canonical texts have equal fingerprints, others
    different ones. Null text is empty; repeated rows and null ids are kept; an empty table gives an empty result."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("wide", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canon = [canonical(t) for t in strs(cols(b, "text")[0])]
            yield record_batch(schema, [cols(b, "doc_id")[0], [digest(c) for c in canon], [hashlib.sha256(c).digest() for c in canon]])

    keyed = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, wide binary"), "digest")
    hit = collisions(docs, keyed.select("digest")).withColumn("hit", F.lit(True))
    return keyed.join(hit, "digest", "left").select("doc_id", _hex("digest", "wide").alias("fingerprint"))


def _hex(d: str, wide: str) -> F.Column:
    return F.when(F.col("hit"), F.concat(F.lower(F.hex(d)), F.lower(F.hex(wide)))).otherwise(F.lower(F.hex(d)))


def _replaced(text: str, other: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + other[:k] if k else text


def _facts(text: str, other: str) -> tuple:
    edited = _replaced(text, other)
    own, new, nxt = canonical(text), canonical(edited), canonical(other)
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(own), hashlib.sha256(own).digest(), digest(new), hashlib.sha256(new).digest(), float(own == new), float(own == nxt)


_FACTS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.binary()), ("wide", pa.binary()), ("edited_digest", pa.binary()), ("edited_wide", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "n_chars long, edited_sha256 string, digest binary, wide binary, edited_digest binary, edited_wide binary, near_edited double, near_next double"


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text), its fingerprint beside that of an edited text and of the next document.

    The edited text is the text with its last quarter of code points replaced by the first as many of the next document's, in
    ascending order of doc_id (null first, ties by a hash of the text), the first following the last. near_edited and near_next
    are 1 where the canonical bytes are equal, else 0. Texts are dealt by ranges of doc_id, so the next document is the next
    row, but at the end of a partition: the two rows at each end are returned with their texts and joined afterwards.
    """
    order = ["doc_id", "_h"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema([("doc_id", pa.int64()), *_FACTS, ("part", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
    none = [None] * len(_FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple | None = None
        for b in batches:
            ids, text = cols(b, "doc_id", "text")
            out = []
            for i, t in zip(ids.to_pylist(), text.to_pylist()):
                if last is None:
                    out.append((i, *none, part, 0, t))
                else:
                    out.append((last[0], *_facts(last[1], t), part, None, None))
                last = i, t
            yield record_batch(schema, list(zip(*out)) if out else [[]] * len(schema))
        if last is not None:
            yield record_batch(schema, list(zip((last[0], *none, part, 1, last[1]))))

    facts = written(rows.select("doc_id", "text").mapInArrow(run, f"doc_id long, {_DDL}, part int, end int, text string"), "facts")
    ends = facts.where("end is not null").select("doc_id", "part", "end", "text")
    # one row a partition: partitions that have rows, in order, and the one after each
    parts = ends.where("end = 0").select("part")
    every = W.orderBy("part")
    after = parts.withColumn("next_part", F.coalesce(F.lead("part").over(every), F.min("part").over(W.partitionBy())))
    heads = ends.where("end = 0").select(F.col("part").alias("next_part"), F.col("text").alias("other"))
    tails = ends.where("end = 1").join(after, "part").join(heads, "next_part").select("doc_id", "text", "other")
    edge = pa.schema([("doc_id", pa.int64()), *_FACTS])

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text, other = (c.to_pylist() for c in cols(b, "doc_id", "text", "other"))
            yield record_batch(edge, list(zip(*((i, *_facts(t, o)) for i, t, o in zip(ids, text, other)))) or [[]] * len(edge))

    names = ["doc_id", *(n for n, _ in _FACTS)]
    out = facts.where("end is null").select(*names).unionByName(tails.mapInArrow(join_ends, f"doc_id long, {_DDL}"))
    own = written(out, "facts")
    hit = written(collisions(docs, own.select("digest")).withColumn("hit", F.lit(True)), "hit")
    own = own.join(hit, "digest", "left").withColumn("fingerprint", _hex("digest", "wide")).drop("hit")
    own = own.join(hit.withColumnRenamed("digest", "edited_digest"), "edited_digest", "left").withColumn("edited_fingerprint", _hex("edited_digest", "edited_wide"))
    return own.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
