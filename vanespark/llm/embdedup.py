"""Embedding near-dedup by iterative quantisation (Gong & Lazebnik 2011) and multi-index hashing (Norouzi et al. 2012).

A rotation learned on a bounded sample turns vectors into balanced binary codes. Substrings of the codes have one table
each; vectors of a label that agree on a substring are candidates, and candidates are compared by their original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.llm._util import adjacency_roots, cols, key_runs, record_batch, tiled, written
from vanespark.llm.components import connected_components

THRESHOLD = 0.98
#: Vectors the rotation is learned from, at most; every vector is indexed.
SAMPLE = 20_000
BITS = 64
ITERATIONS = 40
TILE_ROWS = 1024
SEED = 5


def learn_rotation(x: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit rows ``x``: the sign of (v - mean) @ projection is a code of min(bits, columns) bits."""
    mean = x.mean(axis=0)
    x = x - mean
    c = min(bits, x.shape[1])
    _, vectors = np.linalg.eigh(x.T @ x)
    pca = vectors[:, ::-1][:, :c]
    v = x @ pca
    r = np.linalg.qr(np.random.Generator(np.random.Philox(seed)).standard_normal((c, c)))[0]
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, pca @ r


def _model(sample: np.ndarray | None, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if sample is not None and sample.shape[1] == dim:
        return learn_rotation(sample)
    # a length the sample lacks: a random rotation
    q = np.linalg.qr(np.random.Generator(np.random.Philox(key=[SEED, dim])).standard_normal((dim, dim)))[0]
    return np.zeros(dim), q[:, : min(BITS, dim)]


def _vectors(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _usable() -> F.Column:
    """Not null or empty, no null or non-finite component, not zero, and with a label."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0)


def classes_of(vectors: DataFrame) -> DataFrame:
    """(label, embedding, rep, n) for each distinct usable vector of a label: its smallest vec_id and its rows."""
    return vectors.where(_usable()).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))


_CODE = pa.schema([("label", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("code", pa.int64()), ("unit", pa.binary())])


def codes_of(classes: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, rep, n, dim, code, unit) for each class; unit is the vector of length one in doubles."""
    some = classes.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()  # bounded by ``sample``
    sizes = [len(r[1]) for r in some]
    learned = None
    if some:
        dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
        learned = np.array([r[1] for r in some if len(r[1]) == dim], dtype=np.float64)
        learned /= np.linalg.norm(learned, axis=1, keepdims=True)
    models: dict[int, tuple] = {} if learned is None else {learned.shape[1]: _model(learned, learned.shape[1])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(models)
        for b in batches:
            size = pa.compute.list_value_length(cols(b, "embedding")[0]).to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                label, rep, n, emb = cols(part, "label", "rep", "n", "embedding")
                x = _vectors(emb)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is lost
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                d = int(d)
                if d not in known:
                    known[d] = _model(None, d)
                mean, proj = known[d]
                bits = np.zeros((len(x), 64), dtype=np.uint8)
                bits[:, : proj.shape[1]] = (x - mean) @ proj >= 0
                code = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
                yield record_batch(_CODE, [label.cast(pa.int64()), rep, n, np.full(len(x), d, dtype=np.int32), code, [r.tobytes() for r in x]])

    return classes.select("label", "embedding", "rep", "n").mapInArrow(run, "label long, rep long, n long, dim int, code long, unit binary")


def substring_bits(largest_label: int) -> int:
    """Bits of a substring: about one vector in 32 alike by chance, 8 at least and 16 at most."""
    return int(np.clip(round(np.log2(max(2, largest_label) / 32)), 8, 16))


def bit_masks(bits: int, threshold: float = THRESHOLD) -> list[int]:
    """The places of each table's substring. A pair at ``threshold`` meets in one of them with the probability that eight
    tables of 8 bits give, whatever ``bits`` is: longer substrings get more tables, cut from the bits in a new order each time
    round."""
    meet = 1 - np.arccos(min(threshold, 1.0)) / np.pi
    miss = 8 * np.log1p(-(meet**8)) if meet < 1 else -1.0
    tables = max(BITS // bits, int(np.ceil(round(miss / np.log1p(-(meet**bits)), 6))) if meet < 1 else 1)
    rng = np.random.Generator(np.random.Philox(SEED))
    out: list[int] = []
    places = np.arange(BITS)
    while len(out) < tables:
        out += [sum(1 << int(i) for i in places[s : s + bits]) for s in range(0, BITS - bits + 1, bits)]
        places = rng.permutation(BITS)
    return out[:tables]


_LINK = pa.schema([("rep", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])
_SEEN = pa.schema([("rep", pa.int64()), ("t", pa.int32()), ("k", pa.int64())])


def hamming_radius(threshold: float = THRESHOLD, bits: int = BITS) -> int:
    """Differing bits of a code beyond which vectors aren't compared: six standard deviations above the mean at ``threshold``."""
    differ = np.arccos(min(threshold, 1.0)) / np.pi
    return int(np.ceil(bits * differ + 6 * np.sqrt(bits * differ * (1 - differ))))


def _members(codes: DataFrame, places: list[int]) -> DataFrame:
    """(label, dim, rep, code, t, k): a row for each table, k being the substring."""
    signed = [m - (1 << 64) if m >> 63 else m for m in places]
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("code").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(signed)))
    return codes.withColumn("x", F.explode(tables)).select("label", "dim", "rep", "code", F.col("x.t").alias("t"), F.col("x.k").alias("k"))


def _near(code: np.ndarray, radius: int) -> np.ndarray:
    u = code.view(np.uint64)
    return np.bitwise_count(u[:, None] ^ u[None, :]) <= radius


def candidates(rows: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Those (rep, t, k) of :func:`_members` that have another code of their bucket within the radius: only codes are shuffled."""
    keys = ["label", "dim", "t", "k", "tile_a", "tile_b"]
    rows = tiled(rows, keys[:4], "rep", tile_rows).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in key_runs(batches, keys):
            rep, code, mine, ta, tb, t, k = (x.to_numpy(zero_copy_only=False) for x in cols(r, "rep", "code", "tile_own", "tile_a", "tile_b", "t", "k"))
            near = _near(code, radius)
            np.fill_diagonal(near, False)
            if ta[0] != tb[0]:
                near &= (mine == ta[0])[:, None] != (mine == ta[0])[None, :]
            at = near.any(axis=1)
            if at.any():
                yield record_batch(_SEEN, [rep[at], t[at], k[at]])

    return rows.select("rep", "code", "tile_own", *keys).mapInArrow(run, "rep long, t int, k long").distinct()


def links(codes: DataFrame, bits: int, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(rep, n_links, root): rows linked with a class, in parts to be summed, and edges (rep, root) that connect what links do.

    The tables are first asked with codes alone; vectors go only to buckets where their code has another within
    :func:`hamming_radius`. A pair of classes that meets in several tables is counted in the first of them.
    """
    places = bit_masks(bits, threshold)
    radius = hamming_radius(threshold)
    asked = written(candidates(_members(codes.select("label", "dim", "rep", "code"), places), radius, tile_rows), "asked")
    own = ["label", "dim", "t", "k"]
    keys = [*own, "tile_a", "tile_b"]
    rows = tiled(codes.join(asked, "rep"), own, "rep", tile_rows).repartition(*keys).sortWithinPartitions(*keys)
    masks = [np.uint64(m) for m in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in key_runs(batches, keys):
            rep, n, code, mine, ta, tb, t = (x.to_numpy(zero_copy_only=False) for x in cols(r, "rep", "n", "code", "tile_own", "tile_a", "tile_b", "t"))
            unit = np.frombuffer(b"".join(cols(r, "unit")[0].to_pylist()), dtype=np.float64).reshape(len(rep), -1)
            adj = _near(code, radius)
            adj &= unit @ unit.T >= threshold
            np.fill_diagonal(adj, False)
            if ta[0] != tb[0]:
                left = mine == ta[0]
                adj &= left[:, None] != left[None, :]
            i, j = np.nonzero(adj)
            if not len(i):
                continue
            x = code.view(np.uint64)[i] ^ code.view(np.uint64)[j]
            before = np.zeros(len(i), dtype=bool)
            for m in masks[: int(t[0])]:
                before |= (x & m) == 0
            adj[i[before], j[before]] = False
            total = adj @ n
            root = adjacency_roots(adj)
            at = np.flatnonzero(total)
            if len(at):
                yield record_batch(_LINK, [rep[at], total[at], rep[root[at]]])

    return rows.select("rep", "n", "code", "unit", "tile_own", *keys).mapInArrow(run, "rep long, n_links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine in doubles is ``threshold`` or more; equal vectors are
    compared once, as a class with its count. component_id is the smallest vec_id reachable, kept whether it is the row's own.
    Vectors that are null, empty, zero, without a label, or with null or non-finite components link with nothing; a null vec_id
    links with nothing, and its component_id is null and kept false. Vectors of different lengths don't link. Rows that repeat
    a vec_id are one vertex of the components. An empty table gives an empty result; other columns are ignored.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    classes = written(classes_of(vectors), "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    codes = written(codes_of(classes, sample), "codes")
    found = written(links(codes, substring_bits(largest), threshold, tile_rows), "links")
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("rep").agg(F.sum("n_links").alias("near"))
    of = classes.join(count, "rep", "left").join(comp, classes["rep"] == comp["node"], "left")
    of = of.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    ok = vectors.withColumn("_ok", _usable())
    good = ok.where("_ok").join(of, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")))
    rest = ok.where("not coalesce(_ok, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id")).unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
