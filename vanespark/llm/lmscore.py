"""LM scoring by stupid backoff (Brants et al. 2007), with n-gram counts over the whole corpus.

An n-gram of any order is a row of one relation, keyed by its 64-bit hash. Count tables are partitioned by that hash: each block
of documents sends its distinct n-grams to the partitions that own them, as one sorted run of hashes for each partition, and
gets back their corpus counts in the same order; they are joined to the block's n-grams by place, and log scores are summed for
each document. So what is shuffled is the distinct n-grams of a block, packed, and not a row for each word of the corpus.

Counts leave out the scored document's own share: an n-gram is seen only if other documents have it, else it backs off.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.llm._util import GAP, cols, record_batch, settled, tidy, utf8, word_pieces, written

ORDER = 3
BACKOFF = 0.4
#: A block ends with the document that brings it to so many bytes of text.
BLOCK_BYTES = 3 << 20
#: Bytes of input for each partition of the count tables.
PART_BYTES = 4 << 20
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[3]
    return h ^ (h >> np.uint64(29))


class Block:
    """N-grams of some documents. grams: sorted distinct hashes of all orders; place[k]: the words that end an n-gram of k + 1
    words; at[k]: the index in grams of each. The first ``skip`` words of each text are context: looked up, but not counted or
    scored here."""

    def __init__(self, texts: list[bytes], order: int, skip: int = 0):
        ids: dict[bytes, int] = {}
        words = [t.lower().split() for t in texts]
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        total = int(self.lengths.sum())
        flat = np.fromiter((ids.setdefault(x, len(ids)) for w in words for x in w), dtype=np.int32, count=total)
        unit = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), dtype=np.uint64, count=len(ids))[flat]
        del ids, words, flat
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        nth = np.arange(total) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.own = nth >= skip
        self.lengths = np.maximum(self.lengths - skip, 0)
        self.place = [np.flatnonzero(nth >= k).astype(np.int32) for k in range(order)]
        del nth
        h, every = unit, [unit]
        for k in range(1, order):
            longer = np.zeros(total, dtype=np.uint64)
            p = self.place[k]
            longer[p] = _stir(h[p - 1] * _C[0] + unit[p] * _C[1] + _C[2] * np.uint64(k))
            h = longer
            every.append(h[p])
        sizes = [len(e) for e in every]
        flat = np.concatenate(every)
        del every, h, unit
        self.grams, at = np.unique(flat, return_inverse=True)
        self.at = np.split(at.astype(np.int32), np.cumsum(sizes)[:-1])

    def counts(self) -> np.ndarray:
        return sum(np.bincount(a[self.own[p]], minlength=len(self.grams)) for p, a in zip(self.place, self.at))

    def scores(self, corpus: np.ndarray, n_words: int, backoff: float, whole: int | None = None) -> np.ndarray:
        """Sum of log scores of each document, from corpus counts of grams. ``whole``: the words of the document that the text is
        a piece of; the counts are then those of other documents already."""
        total = len(self.doc)
        room = max(1, len(self.grams))
        left = []  # for each order and word, the count in other documents of the n-gram that ends there
        for place, at in zip(self.place, self.at):
            _, inv, n = np.unique(self.doc[place].astype(np.int64) * room + at, return_inverse=True, return_counts=True)
            c = np.zeros(total, dtype=np.int64)
            c[place] = corpus[at] - (n[inv] if whole is None else 0)
            left.append(c)
        others = n_words - (self.lengths[self.doc] if whole is None else np.full(total, whole))
        # an unseen word counts as one more word of the corpus
        log = np.where(left[0] > 0, np.log(np.maximum(left[0], 1) / np.maximum(others, 1)), np.log(1.0 / (others + 1.0)))
        for k in range(1, len(self.place)):
            p = self.place[k]
            seen = left[k][p] > 0
            up = np.log(np.maximum(left[k][p], 1) / np.maximum(left[k - 1][p - 1], 1))
            log[p] = np.where(seen, up, np.log(backoff) + log[p])
        return np.bincount(self.doc[self.own], weights=log[self.own], minlength=len(self.lengths))


def _pack(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    width = x.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpack(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pieces_of(text: bytes, order: int, size: int) -> Iterator[tuple[bytes, int]]:
    """``text`` cut between words into pieces of about ``size`` bytes, each after the order - 1 words before it, and how many these are."""
    context: list[bytes] = []
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        piece = b" ".join([*context, text[at:end]])
        yield piece, len(context)
        last = piece.rsplit(None, order - 1)
        context, at = last[1:] if len(last) == order else last, end


class Cut(NamedTuple):
    """Some documents, or (owner >= 0) a piece of one: the number of its first block, its words as context and its words in all."""

    block: int
    ids: list
    texts: list[bytes]
    owner: int = -1
    skip: int = 0
    whole: int = 0


def _blocks_of(batches: Iterator[pa.RecordBatch], order: int, block_bytes: int) -> Iterator[Cut]:
    """A task's documents in blocks, the same whenever the task runs over the same rows. A text longer than a block is cut."""
    block = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            i, t = cols(b.slice(at, 256), "doc_id", "text")
            for one, text in zip(i.to_pylist(), utf8(t)):
                if len(text) > block_bytes:
                    owner, whole = block, sum(map(len, word_pieces(text)))
                    for piece, skip in pieces_of(text, order, block_bytes):
                        yield Cut(block, [one], [piece], owner, skip, whole)
                        block += 1
                    continue
                ids.append(one)
                texts.append(text)
                size += len(text)
                if size >= block_bytes:
                    yield Cut(block, ids, texts)
                    block, ids, texts, size = block + 1, [], [], 0
    if ids:
        yield Cut(block, ids, texts)


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for each row of ``docs`` (doc_id, text).

    Words are parted by ASCII white space, A-Z lower-cased. A word's score is the share of its n-gram among those of its
    context, in the other documents; where they lack the n-gram, ``backoff`` times that of one word less. A document's first
    words start at the order they have. Null and empty texts have no words, log_score 0 and a null mean. Repeated rows count
    as other documents of each other. An empty table gives an empty result. Texts longer than a block are counted and scored in
    pieces, with the same result.
    """
    docs = settled(docs.select("doc_id", "text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(16, size // part_bytes)
    sent = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("grams", pa.binary()), ("n", pa.binary()), ("words", pa.int64()), ("owner", pa.int64())])
    edge = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _blocks_of(batches, order, block_bytes):
            b = Block(cut.texts, order, cut.skip)
            n = b.counts().astype("<u4")
            at = np.concatenate([[0], np.searchsorted(b.grams, edge), [len(b.grams)]])
            rows = [(p, cut.block, _pack(np.diff(b.grams[s:e], prepend=np.uint64(0))), _pack(n[s:e]), 0, cut.owner) for p, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]
            if rows:
                rows[0] = (*rows[0][:4], int(b.lengths.sum()), cut.owner)
                yield record_batch(sent, list(zip(*rows)))
        tidy()

    back = pa.schema([("part", pa.int64()), ("from_block", pa.int64()), ("counts", pa.binary()), ("words", pa.int64())])

    def count(t: pa.Table) -> pa.Table:
        grams = [np.cumsum(_unpack(g, "<u8"), dtype=np.uint64) for g in t.column("grams").to_pylist()]
        n = [_unpack(x, "<u4") for x in t.column("n").to_pylist()]
        _, inv = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate(n)).astype("<u8")
        ends = np.cumsum([len(g) for g in grams])[:-1]
        own = np.split(total[inv], ends)
        owner = t.column("owner").to_numpy()
        place = np.split(inv, ends)
        for one in np.unique(owner[owner >= 0]):  # pieces of a document are told what the others have
            mine = np.flatnonzero(owner == one)
            u, at = np.unique(np.concatenate([place[i] for i in mine]), return_inverse=True)
            held = np.bincount(at, weights=np.concatenate([n[i] for i in mine])).astype("<u8")
            for i in mine:
                own[i] = own[i] - held[np.searchsorted(u, place[i])]
        out = pa.Table.from_arrays([t.column("part"), t.column("block"), pa.array([_pack(x) for x in own], type=pa.binary()), t.column("words")], schema=back)
        del grams, n, inv, total, own, place
        tidy()
        return out

    rows = docs.mapInArrow(send, "part long, block long, grams binary, n binary, words long, owner long")
    counts = written(rows.groupBy("part").applyInArrow(count, "part long, from_block long, counts binary, words long"), "ngrams")
    n_words = counts.agg(F.sum("words")).first()[0] or 0
    text = pa.schema([("block", pa.int64()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("packed", pa.binary()), ("owner", pa.int64()), ("skip", pa.int32()), ("whole", pa.int64())])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for cut in _blocks_of(batches, order, block_bytes):
            for s in range(0, len(cut.ids), 1024):
                some = cut.texts[s : s + 1024]
                m = len(some)
                yield record_batch(text, [[cut.block] * m, np.arange(s, s + m, dtype=np.int32), cut.ids[s : s + 1024], [pack(t) for t in some], [cut.owner] * m, [cut.skip] * m, [cut.whole] * m])

    out = pa.schema([("block", pa.int64()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        nth = np.argsort(left.column("nth").to_numpy())
        left = left.take(nth)
        unpack = zstandard.ZstdDecompressor().decompress
        block, owner, skip, whole = (left.column(c)[0].as_py() for c in ("block", "owner", "skip", "whole"))
        b = Block([unpack(x) for x in left.column("packed").to_pylist()], order, skip)
        got = [_unpack(x, "<u8") for _, x in sorted(zip(right.column("part").to_pylist(), right.column("counts").to_pylist()))]
        corpus = np.concatenate(got).astype(np.int64) if got else np.empty(0, dtype=np.int64)
        if len(corpus) != len(b.grams):
            raise ValueError("the input changed between two reads: write it to a table first")
        row = np.full(left.num_rows, block if owner < 0 else owner)
        scored = pa.Table.from_arrays([pa.array(row), left.column("nth"), left.column("doc_id"), pa.array(b.lengths), pa.array(b.scores(corpus, n_words, backoff, None if owner < 0 else whole))], schema=out)
        del b, corpus, got
        tidy()
        return scored

    texts = docs.mapInArrow(carry, "block long, nth int, doc_id long, packed binary, owner long, skip int, whole long")
    scored = texts.groupBy("block").cogroup(counts.groupBy("from_block")).applyInArrow(join, "block long, nth int, doc_id long, n_words long, log_score double")
    scored = scored.groupBy("block", "nth").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score")).drop("block", "nth")  # pieces of a document
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
