"""BPE encoding and decoding with a table of distinct words.

White space parts words for good: a word's ids don't depend on its neighbours. Texts are split into words, each distinct word
is encoded once, and its ids come back to every place by a join on position. Texts travel as blocks (a few thousand documents
whose words are numbered inside the block): a block asks the parts of the word table for its distinct words and is answered in
the same order, so what is shuffled is packed words, ids and word numbers, not a row for each word of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from vanespark.llm._util import cols, record_batch, settled, tidy, utf8, word_pieces

#: A block ends with the document that brings it to so many distinct words or bytes of text.
BLOCK_WORDS = 250_000
BLOCK_BYTES = 12 << 20
#: Bytes of input for each part of the word table.
PART_BYTES = 8 << 20
#: Documents to a packed row.
ROW_DOCS = 256
#: Words of a long text that are put together at once.
PIECE = 1 << 20
_tokenizers: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(model: bytes):
    key = hashlib.sha256(model).digest()
    if key not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(model)
        t.no_truncation()
        t.no_padding()
        _tokenizers[key] = t, [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]
    return _tokenizers[key]


_BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary())])


def _pack(x: np.ndarray) -> bytes:
    """32-bit integers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _blocks(docs: DataFrame, parts: int, block_words: int, block_bytes: int) -> DataFrame:
    """The rows that blocks of documents send.

    part >= 0: the block's distinct words that belong to this part of the word table, in order, each once. part -1: one row
    with the numbers of the block's words in order of (part, word). part -2: rows of documents: their doc_ids, their numbers of
    words, and the numbers of all these words in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        slots: dict[bytes, int] = {}
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list[bytes]] = {}
            for w in slots:
                by.setdefault(xxhash.xxh64_intdigest(w) % parts, []).append(w)
            order = []
            sent = []
            pack = zstandard.ZstdCompressor(level=3).compress
            for p in sorted(by):
                own = sorted(by[p])
                order += own
                sent.append(pack(b" ".join(own)))
            if by:
                none = [None] * len(by)
                yield record_batch(_BLOCKS, [[block] * len(by), sorted(by), none, none, sent])
            yield record_batch(_BLOCKS, [[block], [-1], [None], [None], [_pack(np.fromiter((slots[w] for w in order), dtype="<i4", count=len(order)))]])
            for at in range(0, len(held), ROW_DOCS):
                some = held[at : at + ROW_DOCS]
                yield record_batch(_BLOCKS, [[block], [-2], [[x[0] for x in some]], [[len(x[1]) for x in some]], [_pack(np.concatenate([x[1] for x in some]))]])

        for b in batches:
            ids, text = cols(b, "doc_id", "text")
            for at in range(0, b.num_rows, ROW_DOCS):
                for i, t in zip(ids.slice(at, ROW_DOCS).to_pylist(), utf8(text.slice(at, ROW_DOCS))):
                    parts_of = [np.fromiter((slots.setdefault(w, len(slots)) for w in words), dtype="<i4", count=len(words)) for words in word_pieces(t)]
                    held.append((i, np.concatenate(parts_of) if parts_of else np.empty(0, dtype="<i4")))
                    size += len(t)
                    if len(slots) >= block_words or size >= block_bytes:
                        yield from flush()
                        block, slots, held, size = block + 1, {}, [], 0
        if held:
            yield from flush()
        tidy()

    return docs.mapInArrow(run, "block long, part long, ids array<long>, sizes array<int>, words binary")


_CODED = pa.schema([("part", pa.int64()), ("coded_block", pa.int64()), ("sizes", pa.binary()), ("ids", pa.binary())])


def _coded(uses: DataFrame, shipped) -> DataFrame:
    """(part, coded_block, sizes, ids) from (block, part, words): a part of the word table holds each distinct word once, encodes
    it once, and answers every block with the ids of its words in the order they were asked."""

    def run(t: pa.Table) -> pa.Table:
        tok, _ = _tokenizer(shipped.value)
        unpack = zstandard.ZstdDecompressor().decompress
        table: dict[bytes, int] = {}
        asked = [np.fromiter((table.setdefault(w, len(table)) for w in unpack(x).split(b" ")), dtype=np.int64) for x in t.column("words").to_pylist()]
        words = [w.decode("utf-8", "replace") for w in table]
        ids = [np.array(e.ids, dtype="<u4") for at in range(0, len(words), 2000) for e in tok.encode_batch_fast(words[at : at + 2000], add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], dtype="<u4")
        flat = np.concatenate(ids) if ids else np.empty(0, dtype="<u4")
        start = np.cumsum(sizes, dtype=np.int64) - sizes
        rows = []
        for at in asked:
            n = sizes[at]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
            rows.append((_pack(n), _pack(flat[np.repeat(start[at], n) + within])))
        out = pa.Table.from_arrays([t.column("part"), t.column("block"), pa.array([r[0] for r in rows], type=pa.binary()), pa.array([r[1] for r in rows], type=pa.binary())], schema=_CODED)
        tidy()
        return out

    return uses.groupBy("part").applyInArrow(run, "part long, coded_block long, sizes binary, ids binary")


def encode(docs: DataFrame, vocabulary: str | None = None, finish=None, out: pa.Schema | None = None, block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of ``docs``: the ids of the whole text (array of int) and its decoding.

    A null text is empty: no ids, decoded ''. Repeated rows, null doc_ids and empty tables are kept as they are. Other columns
    are ignored. ``vocabulary`` is a file of the tokenizers library that the driver can read. ``finish`` (ids as bytes, decoded
    as bytes) -> tuple replaces the last two columns by those of ``out``, for callers that need digests only.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        model = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    if finish is None:
        finish = lambda ids, text: (np.frombuffer(ids, dtype="<u4").astype(np.int32), text.decode())
        out = pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    full = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *out])
    docs = settled(docs.select("doc_id", "text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    blocks = _blocks(docs, max(8, size // part_bytes), block_words, block_bytes)
    coded = _coded(blocks.where("part >= 0").select("block", "part", "words"), shipped)
    texts = blocks.where("part < 0").select("block", F.col("part").alias("kind"), F.col("ids").alias("doc_ids"), "sizes", "words")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, pieces = _tokenizer(shipped.value)
        answers = sorted(zip(*(right.column(c).to_pylist() for c in ("part", "sizes", "ids"))))
        size_of = np.concatenate([_unpack(x[1]) for x in answers]) if answers else np.empty(0, dtype=np.int64)
        flat = np.concatenate([_unpack(x[2]) for x in answers]).astype("<u4").tobytes() if answers else b""
        end = (np.cumsum(size_of, dtype=np.int64) * 4).tolist()
        own_rows = list(zip(*(left.column(c).to_pylist() for c in ("kind", "doc_ids", "sizes", "words"))))
        number = next(_unpack(x[3]) for x in own_rows if x[0] == -1).tolist()
        if len(number) != len(end):
            raise ValueError("the input changed between two reads: write it to a table first")
        ids: list = [b""] * len(number)
        last = 0
        for s, e in zip(number, end):
            ids[s], last = flat[last:e], e
        piece = [p.encode() for p in pieces]
        decoded = [b" ".join([piece[i] for i in np.frombuffer(x, dtype="<u4")]) for x in ids]  # the id-to-piece join: a fixed vocabulary
        doc_ids: list = []
        rows: list = []
        for kind, some, sizes, words in own_rows:
            if kind == -1:
                continue
            doc_ids += some
            every = _unpack(words)
            end = 0
            for n in sizes:
                at = every[end : end + n]
                end += n
                own = b"".join(b"".join([ids[i] for i in at[k : k + PIECE].tolist()]) for k in range(0, n, PIECE))
                text = b" ".join(x for k in range(0, n, PIECE) if (x := b" ".join([decoded[i] for i in at[k : k + PIECE].tolist() if ids[i]])))
                rows.append((len(own) // 4, *finish(own, text)))
        out = pa.Table.from_arrays([pa.array(doc_ids, type=pa.int64()), *(pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(list(full)[1:]))], schema=full)
        tidy()
        return out

    return texts.groupBy("block").cogroup(coded.groupBy("coded_block")).applyInArrow(run, from_arrow_schema(full))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), as :func:`encode` with the two long columns as SHA-256."""

    def finish(ids: bytes, text: bytes) -> tuple[str, str]:
        return hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return encode(docs, vocabulary, finish, pa.schema([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): training-ready ids with the digests that verify them."""

    def finish(ids: bytes, text: bytes) -> tuple:
        return np.frombuffer(ids, dtype="<u4").astype(np.int32), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return encode(docs, vocabulary, finish, pa.schema([("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))
