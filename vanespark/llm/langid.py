"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, permuted (rotated) by
their place; a text's vector bundles (sums) the vectors of its trigrams, and so does a language's prototype with the trigrams
of its training texts. A text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.llm._util import cols, packed, record_batch, strs, tidy

DIM = 512
SEED = 20
#: Code points below this have a vector of their own; those above share as many by a multiplicative hash.
OWN_SLOTS = 1024
SLOT_BITS = 11
PIECE = 1 << 20
#: Prototypes at most (8 MB at 512 places).
MAX_LANGS = 2048
_cache: dict = {}


def _letter_table() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _cache["letters"]


def letter_vectors(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors rotated by 2, 1 and 0 places."""
    if (dim, seed) not in _cache:
        rng = np.random.Generator(np.random.Philox(seed))
        v = (rng.integers(0, 2, (1 << SLOT_BITS, dim), dtype=np.int8) * 2 - 1).astype(np.int8)
        _cache[dim, seed] = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v
    return _cache[dim, seed]


def gram_vectors(grams: np.ndarray, dim: int, seed: int) -> np.ndarray:
    a, b, c = letter_vectors(dim, seed)
    mask = (1 << SLOT_BITS) - 1
    return a[grams >> (2 * SLOT_BITS)] * b[(grams >> SLOT_BITS) & mask] * c[grams & mask]


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of the whole text, lower-cased; runs of other characters than letters are one gap. Empty if there is no letter."""
    letters = _letter_table()
    out, tail = [], np.zeros(1, dtype=np.int64)
    for at in range(0, len(text), PIECE):
        cp = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        slot = np.where(cp < OWN_SLOTS, cp, OWN_SLOTS + ((cp * 2654435761) >> 13 & (OWN_SLOTS - 1)))
        slot = np.concatenate([tail, np.where(letters[cp], slot, 0)])
        if at + PIECE >= len(text):
            slot = np.append(slot, 0)
        keep = np.ones(len(slot), dtype=bool)
        keep[len(tail) :] = (slot[len(tail) :] != 0) | (slot[len(tail) - 1 : -1] != 0)
        slot = slot[keep]
        if len(slot) > 2:
            out.append(slot[:-2] << (2 * SLOT_BITS) | slot[1:-1] << SLOT_BITS | slot[2:])
        tail = slot[-2:]
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang); summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g = np.concatenate([p[0] for p in parts])
                grams, inv = np.unique(g, return_inverse=True)
                n = np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield record_batch(_COUNTS, [[lang] * len(grams), grams, n])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                text, lang = cols(b.slice(at, 256), "text", "lang")
                by: dict[str, list[np.ndarray]] = {}
                for t, g in zip(strs(text), lang.to_pylist()):
                    if len(x := trigrams(t)):
                        by.setdefault(g, []).append(x)
                for g, xs in by.items():
                    held.setdefault(g, []).append(np.unique(np.concatenate(xs), return_counts=True))
                    size += len(held[g][-1][0])
            if size > 2_000_000:
                out = list(merged())
                if sum(x.num_rows for x in out) > 1_000_000:
                    yield from out
                    held, size = {}, 0
                else:
                    held = {x.column(0)[0].as_py(): [(x.column(1).to_numpy(), x.column(2).to_numpy())] for x in out}
                    size = sum(x.num_rows for x in out)
        yield from merged()
        held.clear()
        tidy()

    return rows.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from rows (text, lang) with a non-null lang.

    What reaches the driver is dim numbers for each distinct lang value, whatever the number of rows; more than MAX_LANGS values
    are an error, as each prototype goes to every task.
    """
    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            lang, gram, n = cols(b, "lang", "gram", "n")
            lang, gram, n = np.array(lang.to_pylist(), dtype=object), gram.to_numpy(), n.to_numpy()
            for at in range(0, len(gram), 4096):
                v = gram_vectors(gram[at : at + 4096], dim, seed)
                for g in set(lang[at : at + 4096]):
                    own = lang[at : at + 4096] == g
                    part = n[at : at + 4096][own].astype(np.float64) @ v[own].astype(np.float64)
                    total[g] = total.get(g, 0) + part.astype(np.int64)
        for g, v in total.items():
            yield record_batch(schema, [[g] * dim, np.arange(dim, dtype=np.int32), v])

    sums = gram_counts(rows.where("lang is not null")).mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    by: dict[str, np.ndarray] = {}
    for lang, i, v in sums.limit(MAX_LANGS * dim + 1).collect():
        by.setdefault(lang, np.zeros(dim))[i] = v
    if len(by) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values: not a column of languages")
    langs = sorted(by)
    p = np.array([by[g] for g in langs]).reshape(len(langs), dim)
    norm = np.linalg.norm(p, axis=1, keepdims=True)
    return langs, p / np.where(norm == 0, 1, norm)


_PRED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _scores(texts: list[str], proto: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Cosine of each text with each prototype; NaN where a text has no letter."""
    out = np.full((len(texts), len(proto)), np.nan)
    for at in range(0, len(texts), 256):
        grams = [np.unique(trigrams(t), return_counts=True) for t in texts[at : at + 256]]
        every = np.unique(np.concatenate([g for g, _ in grams]))
        vectors = gram_vectors(every, dim, seed).astype(np.float32)
        for k, (g, n) in enumerate(grams):
            if len(g):
                v = np.zeros(dim)
                idx = np.searchsorted(every, g)
                for c in range(0, len(idx), 4096):
                    v += n[c : c + 4096].astype(np.float32) @ vectors[idx[c : c + 4096]]
                norm = np.linalg.norm(v)
                out[at + k] = proto @ v / norm if norm else 0.0
    return out


def predict(docs: DataFrame, langs: list[str], proto: np.ndarray, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 at least) as two more columns."""
    schema = docs.select(*(c for c in docs.columns if c not in ("lang_pred", "score")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(strs(cols(b, "text")[0]), proto, dim, seed) if langs else np.empty((b.num_rows, 0))
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if langs:
                known = np.flatnonzero(~np.isnan(s[:, 0]))
                best = s[known].argmax(axis=1)
                for k, x in zip(known, best):
                    lang[k] = langs[x]
                score[known] = np.clip(s[known, best], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])
        tidy()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    out = StructType([*schema.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return schema.mapInArrow(run, out)


def held_out() -> F.Column:
    """True where crc32 of doc_id as text leaves 1 by 3: such documents are never learned from. A null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``docs`` with held_out, lang_pred and score.

    Learns from text and non-null lang of the documents that aren't held out; lang, source and doc_id take no part in a
    prediction. lang_pred is ``und`` with score 0 for a null text, one without a letter, and where nothing could be learned.
    Ties go to the first language by name. Repeated rows are predicted alike; columns of ``docs`` named as an output give way.
    """
    docs = docs.select(*(c for c in docs.columns if c != "held_out")).withColumn("held_out", held_out())
    langs, proto = learn(docs.where("not held_out").select("text", "lang"), dim, seed)
    return predict(docs, langs, proto, dim, seed)


def keep_identified(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with the columns of ``docs``; those predicted ``und`` go."""
    out = identify(packed(docs, "doc_id", "text", "lang"), dim, seed).where("lang_pred <> 'und'")
    return out.select("_doc.*")
