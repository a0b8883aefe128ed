"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked exactly within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vanespark.llm._util import PIECE_BYTES, adjacency_roots, cols, key_runs, packed, record_batch, tidy, utf8, word_pieces, written
from vanespark.llm.components import connected_components

TILE_ROWS = 2048
CHUNK = 1 << 15


def shingle_pieces(text: bytes, width: int, size: int = PIECE_BYTES) -> Iterator[tuple[Iterator[bytes], int]]:
    """(shingles, their number), piece by piece: every ``width`` words with repeats; a shorter sequence is one shingle, none is none."""
    tail: list[bytes] = []
    short = True
    for words in word_pieces(text, size, bytes.lower):
        words = tail + words
        if len(words) >= width:
            short = False
            yield map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if short and tail:
        yield iter((b" ".join(tail),)), 1


def fingerprint_of(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of UTF-8 ``text``: XXH64 with ``seed`` of its shingles; a bit is set if more than half the hashes have it, none without a word."""
    ones = np.zeros(64, dtype=np.int64)
    total = 0
    for shingles, n in shingle_pieces(text, width):
        hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
        for start in range(0, n, CHUNK):
            h = np.fromiter(hashes, dtype="<u8", count=min(CHUNK, n - start))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row: fp is the fingerprint's bits as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = cols(b, "doc_id", "text")
            fps = np.fromiter((fingerprint_of(t, width) for t in utf8(text)), dtype=np.uint64, count=b.num_rows)
            yield record_batch(_FP, [ids, fps.view(np.int64)])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _apart(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of every two rows of (rows, words) arrays."""
    out = np.bitwise_count(u[:, None, 0] ^ v[None, :, 0]).astype(np.int16)
    for w in range(1, u.shape[1]):
        out += np.bitwise_count(u[:, None, w] ^ v[None, :, w])
    return out


def _linked(u: np.ndarray, radius: int, other: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix of links between fingerprints (rows, words), in strips of similar population count; strips that are
    further apart in population count than the radius are never compared."""
    v = u if other is None else other
    out = np.zeros((len(u), len(v)), dtype=bool)
    pu, pv = (np.bitwise_count(x).sum(axis=1, dtype=np.int16) for x in (u, v))
    ou, ov = np.argsort(pu, kind="stable"), np.argsort(pv, kind="stable")
    su, sv = pu[ou], pv[ov]
    for s in range(0, len(u), 256):
        rows = ou[s : s + 256]
        lo = np.searchsorted(sv, su[s] - radius, "left")
        hi = np.searchsorted(sv, su[min(s + 256, len(u)) - 1] + radius, "right")
        if lo < hi:
            at = ov[lo:hi]
            out[np.ix_(rows, at)] = _apart(u[rows], v[at]) <= radius
    return out


def tile_pairs(rows: DataFrame, keys: list[str], ones: F.Column, salt: F.Column, radius: int, tile_rows: int) -> DataFrame:
    """Rows of groups of two or more, dealt into pairs of tiles so that any two rows of a group whose population counts
    (``ones``) differ by at most ``radius`` meet in exactly one pair (tile_a, tile_b).

    A group of up to ``tile_rows`` rows is one tile. A larger one has tiles by population count, several where a count has more
    than ``tile_rows`` rows, and tiles whose counts differ beyond the radius are never paired. Adds tile_a, tile_b, tile_own.
    """
    rows = rows.withColumn("_ones", ones.cast("int"))
    each = rows.groupBy(*keys, "_ones").agg(F.count(F.lit(1)).alias("m"))
    tiles = F.struct(F.col("_ones").alias("p"), F.ceil(F.col("m") / F.lit(tile_rows)).cast("int").alias("s"))  # at most a few hundred counts
    sizes = each.groupBy(*keys).agg(F.sum("m").alias("_n"), F.collect_list(tiles).alias("_tiles")).where("_n >= 2")
    sizes = sizes.withColumn("_tiles", F.when(F.col("_n") > tile_rows, F.col("_tiles"))).drop("_n")
    out = rows.join(sizes, keys)
    number = F.element_at(F.filter("_tiles", lambda t: t["p"] == F.col("_ones")), 1)["s"]
    out = out.withColumn("tile_own", F.when(F.col("_tiles").isNull(), 0).otherwise(F.shiftleft("_ones", 16) + F.pmod(F.xxhash64(salt), number).cast("int")))
    near = F.filter("_tiles", lambda t: F.abs(t["p"] - F.col("_ones")) <= radius)
    near = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["s"] - 1), lambda i: F.shiftleft(t["p"], 16) + i)))
    out = out.withColumn("_o", F.explode(F.coalesce(near, F.array(F.lit(0)))))
    return out.withColumn("tile_a", F.least("_o", "tile_own")).withColumn("tile_b", F.greatest("_o", "tile_own")).drop("_o", "_ones", "_tiles")


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(fps: DataFrame, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect what all pairs of distinct ``fps`` (fp: long) within ``radius`` bits connect.

    Two fingerprints within the radius agree on all but ``radius`` of radius + 2 bit blocks, so on some two of them: one table
    for each pair of blocks brings every such pair together with nothing lost. The groups of a table are cut into tiles by
    population count, tile pairs within the radius are compared exactly (exclusive-or and bit count), and each tile pair returns
    a spanning forest of its links, never all pairs.
    """
    n_blocks = radius + 2
    edge = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    block = [F.shiftrightunsigned(F.shiftleft("fp", 64 - edge[i + 1]), 64 - (edge[i + 1] - edge[i])) for i in range(n_blocks)]
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.shiftleft(block[i], 32).bitwiseXOR(block[j]).alias("k")) for t, (i, j) in enumerate(combinations(range(n_blocks), 2))))
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("x.k").alias("k"))
    keys = ["t", "k", "tile_a", "tile_b"]
    rows = tile_pairs(rows, ["t", "k"], F.bit_count("fp"), F.col("fp"), radius, tile_rows).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out: list[np.ndarray] = []
        b_out: list[np.ndarray] = []
        held = 0
        for r in key_runs(batches, keys):
            fp, own, ta, tb = (x.to_numpy(zero_copy_only=False) for x in cols(r, "fp", "tile_own", "tile_a", "tile_b"))
            u = fp.view(np.uint64)[:, None]
            if ta[0] == tb[0]:
                if len(u) == 2:
                    if int(np.bitwise_count(u[0, 0] ^ u[1, 0])) <= radius:
                        a_out.append(fp[:1]), b_out.append(fp[1:])
                        held += 1
                    continue
                adj = _linked(u, radius)
                np.fill_diagonal(adj, False)
            else:
                left = own == ta[0]
                part = _linked(u[left], radius, u[~left])
                if not part.any():
                    continue
                order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
                fp, n, m = fp[order], *part.shape
                adj = np.zeros((n + m, n + m), dtype=bool)
                adj[:n, n:], adj[n:, :n] = part, part.T
            root = adjacency_roots(adj)
            at = np.flatnonzero(root != np.arange(len(root)))
            a_out.append(fp[at]), b_out.append(fp[root[at]])
            held += len(at)
            if held > 100_000:
                yield record_batch(_EDGE, [np.concatenate(a_out), np.concatenate(b_out)])
                a_out, b_out, held = [], [], 0
        if held:
            yield record_batch(_EDGE, [np.concatenate(a_out), np.concatenate(b_out)])

    return rows.select("fp", "tile_own", *keys).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are connected by steps of at most ``radius`` bits.

    component_id is the smallest doc_id of the component. Null text is empty text (fingerprint 0, linked like any other);
    repeated rows share a fingerprint and so a component; a component of null ids alone has a null component_id. An empty
    table gives an empty result. Other columns of ``docs`` are ignored.
    """
    fp = written(fingerprints(docs, width), "fp")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    comp = connected_components(links(nodes.select("fp"), radius, tile_rows)).withColumnRenamed("node", "fp")
    of = nodes.join(comp, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = written(of.join(least, "component").select("fp", "component_id"), "fpc")
    return fp.join(of, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Shingle sets link at this Jaccard similarity or more, as a fraction.
SIMILARITY = (4, 5)
#: Sets meet where all ROWS least values of one of BANDS bands are equal: two at 0.8 miss each other with probability
#: (1 - 0.8^5)^24 < 1e-4, whatever the size of the corpus.
BANDS, ROWS = 24, 5
#: Differing bits of 128 beyond which sets aren't compared: four standard deviations above the mean at 0.8.
WIDE_RADIUS = 36
#: Rounds of comparing each set with one other of its buckets, before all that are still apart are compared; none where all
#: pairs are at most so many for each row of a bucket.
ROUNDS, FEW_PAIRS = 8, 8
_MIX = np.random.Generator(np.random.Philox(11)).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.array([[1], [0]], dtype=np.uint32)


def wide_hashes(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct shingles of ``text`` as XXH3-128 hashes (rows, 2), in order of the first half, which names a shingle."""
    parts = []
    for shingles, n in shingle_pieces(text, width):
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles)), dtype="<u8").reshape(n, 2)
        parts.append(h[np.unique(h[:, 0], return_index=True)[1]])
    if len(parts) < 2:
        return parts[0] if parts else np.empty((0, 2), dtype="<u8")
    h = np.concatenate(parts)
    return h[np.unique(h[:, 0], return_index=True)[1]]


def shingles_of(text: bytes, width: int = 5) -> np.ndarray:
    """The set of shingles of ``text`` as sorted 64-bit hashes; empty without a word."""
    return np.ascontiguousarray(wide_hashes(text, width)[:, 0])


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of 128 bits of a set of :func:`wide_hashes`, as two words."""
    ones = np.zeros(128, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(np.ascontiguousarray(h[at : at + CHUNK]).view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def band_keys(h: np.ndarray) -> list[int]:
    """A signed key for each band: a hash of the least values of the set under its ROWS mixing functions. None for an empty set."""
    if not len(h):
        return []
    x = (h[:, 0] >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048, None] * _MIX[0] + _MIX[1]).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(raw[t].tobytes(), t) - (1 << 63) for t in range(BANDS)]


_SET = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("bands", pa.list_(pa.int64()))])


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, text_hash, node, n, x, y, bands) for every row: node names the set of n shingles, x and y are its wide SimHash;
    a task gives a set's bands once and null afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids, text, own = cols(b, "doc_id", "text", "text_hash")
            nodes = np.empty(b.num_rows, dtype=np.uint64)
            wide = np.zeros((b.num_rows, 2), dtype="<u8")
            size = np.zeros(b.num_rows, dtype=np.int64)
            bands: list[list[int] | None] = []
            for k, t in enumerate(utf8(text)):
                h = wide_hashes(t, width)
                size[k], nodes[k] = len(h), xxhash.xxh3_64_intdigest(np.ascontiguousarray(h[:, 0]).tobytes())
                node = int(nodes[k])
                wide[k] = wide_fingerprint(h)
                bands.append(None if node in seen else band_keys(h))
                seen.add(node)
            yield record_batch(_SET, [ids, own, nodes.view(np.int64), size, wide[:, 0].view(np.int64), wide[:, 1].view(np.int64), bands])
        tidy()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, n long, x long, y long, bands array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (node, shingles) are alike, in whole numbers."""
    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "s"), ("b", "t")))
    both = F.size(F.array_intersect("s", "t"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("s") + F.size("t")).alias("total"), both.alias("both"))
    return full.where(F.col("both") * similarity[1] >= (F.col("total") - F.col("both")) * similarity[0]).select("a", "b")


def _near(a: str, b: str, radius: int = WIDE_RADIUS) -> F.Column:
    """Whether the wide fingerprints of structs ``a`` and ``b`` are within the radius."""
    return F.bit_count(F.col(f"{a}.x").bitwiseXOR(F.col(f"{b}.x"))) + F.bit_count(F.col(f"{a}.y").bitwiseXOR(F.col(f"{b}.y"))) <= radius


def _may_be(n: str, m: str, similarity: tuple[int, int]) -> F.Column:
    """Whether sets of these sizes can be alike."""
    return F.least(n, m) * similarity[1] >= F.greatest(n, m) * similarity[0]


_SHINGLES = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def set_links(members: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY, radius: int = WIDE_RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(node, component) of the sets that are alike with another one of their buckets.

    ``members`` (k, node, n, x, y) says which sets meet in bucket k. A few rounds compare each set with one set of another
    component that it meets, which joins most of a large group by as many comparisons as it has sets; then all pairs that
    meet and are still in different components are compared: their wide fingerprints in tiles by exclusive-or and bit count,
    and the sets themselves of those within the radius.
    """
    num, den = similarity
    edges: DataFrame | None = None
    comp: DataFrame | None = None

    def placed() -> DataFrame:
        """Rows of those buckets that hold several components."""
        rows = members.withColumn("c", F.col("node")) if comp is None else members.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        apart = rows.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("k")
        return rows.join(apart, "k")

    def add(found: DataFrame) -> int:
        nonlocal edges, comp
        found = written(found, "found")
        n = found.count()
        if n:
            edges = found if edges is None else edges.unionByName(found)
            comp = written(connected_components(edges), "comp")
        return n

    for nth in range(ROUNDS):
        rows = written(placed(), "placed")
        size_of = rows.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("m"))
        total, all_pairs = size_of.agg(F.sum("m"), F.sum(F.expr("m * (m - 1) / 2"))).first()
        if (all_pairs or 0) <= FEW_PAIRS * (total or 0):
            break
        one = F.struct(F.xxhash64(F.lit(nth), "node").alias("o"), "node", "c", "n", "x", "y")
        rep = rows.groupBy("k").agg(F.min(one).alias("lo"), F.max(one).alias("hi"))
        met = rows.withColumn("own", F.struct("node", "n", "x", "y")).join(rep, "k")
        fits = [F.when((F.col(f"{r}.c") != F.col("c")) & _may_be("n", f"{r}.n", similarity) & _near("own", r, radius), F.col(f"{r}.node")) for r in ("lo", "hi")]
        met = met.select("node", F.coalesce(*fits).alias("r")).where("r is not null")
        often = met.groupBy("node", "r").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(F.max(F.struct("m", "r"))["r"].alias("r"))
        pairs = written(often.select(F.least("node", "r").alias("a"), F.greatest("node", "r").alias("b")).distinct(), "pairs")
        if add(verified(pairs, sets, similarity)) * 4 < pairs.count():
            break
    keys = ["k", "tile_a", "tile_b"]
    rest = tile_pairs(placed(), ["k"], F.bit_count("x") + F.bit_count("y"), F.col("node"), radius, tile_rows).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for r in key_runs(batches, keys):
            node, n, c, x, y, own, ta, tb = (v.to_numpy(zero_copy_only=False) for v in cols(r, "node", "n", "c", "x", "y", "tile_own", "tile_a", "tile_b"))
            u = np.stack([x, y], axis=1).view(np.uint64)
            for s in range(0, len(node), 256):
                some = slice(s, s + 256)
                ok = (c[some, None] != c[None, :]) & (np.minimum(n[some, None], n[None, :]) * den >= np.maximum(n[some, None], n[None, :]) * num)
                ok &= np.arange(s, min(s + 256, len(node)))[:, None] < np.arange(len(node))[None, :]
                if ta[0] != tb[0]:
                    ok &= own[some, None] != own[None, :]
                i, j = np.nonzero(ok)
                near = np.bitwise_count(u[i + s] ^ u[j]).sum(axis=1) <= radius
                i, j = i[near] + s, j[near]
                held.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
                rows += len(i)
                if rows > 100_000:
                    yield record_batch(_EDGE, [np.concatenate(v) for v in zip(*held)])
                    held, rows = [], 0
        if held:
            yield record_batch(_EDGE, [np.concatenate(v) for v in zip(*held)])
        tidy()

    met = rest.select("node", "n", "c", "x", "y", "tile_own", *keys).mapInArrow(run, "a long, b long")
    add(verified(met.distinct(), sets, similarity))
    return comp if comp is not None else members.select("node", F.col("node").alias("component")).limit(0)


def similar_documents(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = SIMILARITY, radius: int = WIDE_RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, text_hash, component, component_id) of documents connected by a Jaccard similarity of ``similarity`` or more of
    their sets of shingles of ``width`` words.

    SimHash alone doesn't tell 0.8 from 0.7, and its bit bands bring together a share of all pairs of the corpus. So sets meet
    by bands of least values, are compared by a SimHash of 128 bits with a radius that 0.8 is well within, and link if
    the sets themselves are alike: nothing below the threshold links. Recall doesn't depend on the size of the corpus.

    component_id is the smallest doc_id of those connected, which component tells apart also where all ids are null. Nulls,
    repeated rows and empty tables are treated as in :func:`near_duplicates`.
    """
    fp = written(shingle_sets(docs, width), "sets")
    nodes = fp.where("bands is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "x", "y", "bands")))  # equal in all rows of a node
    rows = nodes.select("node", "n", "x", "y", F.explode("bands").alias("k"))
    several = rows.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m >= 2").select("k")
    members = written(rows.join(several, "k"), "members")
    source = fp.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"))
    source = source.select("node", F.col("of.doc_id").alias("own_id"), F.col("of.text_hash").alias("own_hash"))  # one row whose text gives the set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                node, text = cols(b.slice(at, 64), "node", "text")
                yield record_batch(_SHINGLES, [node, [shingles_of(t, width).view(np.int64) for t in utf8(text)]])
        tidy()

    own = docs.select("doc_id", "text").join(source, (F.xxhash64("text") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    sets = written(own.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    comp = set_links(members, sets, similarity, radius, tile_rows)
    least_of = fp.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    of = least_of.join(comp, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = of.join(least, "component").select("node", "component", "component_id")
    return fp.join(of, "node").select("doc_id", "text_hash", "component", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest doc_id, a null id last, and of its texts the one with the
    least hash. ``groups`` is (doc_id, text_hash, component) for each row."""
    firsts = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    firsts = written(firsts.select(F.col("first.doc_id").alias("_first"), F.col("first.text_hash").alias("_hash")), "firsts")
    rows = packed(docs, "doc_id", F.xxhash64("text").alias("_text"))
    kept = rows.join(firsts, (F.col("_text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    nth = F.row_number().over(W.partitionBy("doc_id", "_text").orderBy("_text"))  # of rows that repeat id and text one stays
    return kept.withColumn("_nth", nth).where("_nth = 1").select("_doc.*")
