"""Line dedup over line-ID sequences, in DataFrame operations only.

Each document is its sequence of non-blank lines. A run of consecutive lines with at least ``min_words`` words that occurs at an
earlier place (smaller doc_id, then earlier line) is a later copy, and its lines are deleted; so the first copy of every maximal
repeated run stays and the others go.

The suffix array is built by distributed prefix doubling: the runs of 1, 2, 4, ... lines get sorted ranks, those of 2^(k+1) lines
by sorting the pairs of ranks of their halves over range partitions. The suffixes of one rank are an interval of the array whose
longest common prefix is 2^k lines or more. A suffix that shares its rank with no other leaves the array, as its common prefix
with all others is known to be shorter; doubling ends when none is left. In its deepest interval with an earlier suffix each
suffix is matched with the first one; matches at the same distance that overlap are one maximal repeated run.

2^k lines have 2^k words at least, so what these intervals give from min_words lines up counts. Repeated runs of fewer lines may
have the words too: from each position the shortest run forward and backward that reaches ``min_words`` is looked up as two
overlapping runs of a power of two. Any counting run has such a one around each of its lines (take away lines at the ends as long
as what is left counts), so nothing that counts is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vanespark.llm._util import drop_table, own, packed, table_of, written

MIN_WORDS = 8
#: White space that may surround a line or part its words.
SPACE = " \t\x0b\x0c\r"


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def repeated_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, h, i, w, seg, pos, n0, first) for the lines that occur more than once.

    h: hash of the text, which with doc_id names a document; i: the line's index; w: its words; pos: a number that follows
    the order of (doc_id, h, i) and is dense inside seg, a stretch of neighbouring lines; n0: sorted rank of the line by itself;
    first: the first position of that rank.
    """
    spark = docs.sparkSession
    line = F.transform(_lines(), lambda x, i: F.struct(i.alias("i"), F.trim(F.translate(x, SPACE, " " * len(SPACE))).alias("l")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.filter(line, lambda x: x["l"] != "")).alias("j", "x"))
    words = F.when(F.instr("x.l", "  ") == 0, F.length("x.l") - F.length(F.replace("x.l", F.lit(" "), F.lit(""))) + 1).otherwise(F.size(F.split("x.l", " +")))
    rows = rows.select("doc_id", "h", "j", F.col("x.i").alias("i"), words.alias("w"), F.xxhash64("x.l").alias("a"), F.xxhash64(F.lit(7), "x.l").alias("b"))
    # repeated lines are a table of their own, so that a join with a very common one can be split or broadcast
    twice, twice_path = table_of(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n"), "twice")
    rows = rows.join(twice, ["a", "b"])
    in_doc = W.partitionBy("doc_id", "h").orderBy("j")
    rows = rows.repartitionByRange("doc_id", "h").withColumn("again", F.lag("j").over(in_doc)).where("again is null or again <> j")
    rows, path = table_of(rows.drop("again").withColumn("pos", F.monotonically_increasing_id()), "lines")
    seg = F.min("pos").over(W.partitionBy("doc_id", "h", F.col("pos") - F.col("j")))
    first, first_path = _sorted(rows.groupBy("a", "b").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "n0", "a", "b")
    out, _ = table_of(rows.join(first, ["a", "b"], "left").withColumn("seg", seg).drop("a", "b", "j"), "lines")
    for p in (path, twice_path, first_path):
        drop_table(spark, p)
    return out


def _sorted(groups: DataFrame, name: str, *keys: str) -> tuple[DataFrame, str]:
    """Those of ``groups`` (keys, first, n) of two members or more as a table, with numbers in the order of their keys as ``name``.

    A table of its own, so that a join with a very common key can be split or broadcast.
    """
    groups = groups.where("n >= 2").drop("n").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return table_of(groups.withColumn(name, F.monotonically_increasing_id()), "ranks")


def ranks(rows: DataFrame, rounds: int) -> DataFrame:
    """``rows`` with n1 ... n<rounds>: the sorted rank of the 2^k lines from each position, null where they don't occur again;
    first is the first position of the last of these ranks."""
    path = None
    for k in range(rounds):
        step, own, new = 1 << k, f"n{k}", f"n{k + 1}"
        ahead = F.max(own).over(W.partitionBy("seg").orderBy("pos").rangeBetween(step, step))
        pairs, pairs_path = table_of(rows.drop("first").withColumn("ahead", ahead), "pairs")
        both = pairs.where(f"{own} is not null and ahead is not null")
        first, first_path = _sorted(both.groupBy(F.col(own).alias("p"), F.col("ahead").alias("q")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), new, "p", "q")
        named = both.join(first, (F.col(own) == F.col("p")) & (F.col("ahead") == F.col("q")), "left").drop("p", "q", "ahead")
        rest = pairs.where(f"{own} is null or ahead is null").drop("ahead").withColumns({"first": F.lit(None).cast("long"), new: F.lit(None).cast("long")})
        nxt, new_path = table_of(named.unionByName(rest), "ranks")
        for p in (path, pairs_path, first_path):
            if p:
                drop_table(rows.sparkSession, p)
        rows, path = nxt, new_path
    return rows


def interval_runs(r: DataFrame, rounds: int, min_words: int) -> DataFrame:
    """(seg, start, lines, source): the maximal repeated runs that the intervals of min_words lines or more reveal; source is the
    position of the earlier copy. Goes on from the ranks of 2^rounds lines until no run of twice as many lines occurs again."""
    active = r.where(f"n{rounds} is not null").select("seg", "pos", F.col(f"n{rounds}").alias("n"), "first")
    found: DataFrame | None = None
    k = rounds
    while True:
        if 1 << k >= min_words:
            late = active.where("first < pos").select("seg", "pos", F.lit(k).alias("k"), "first")
            found = late if found is None else found.unionByName(late)
        ahead = F.max("n").over(W.partitionBy("seg").orderBy("pos").rangeBetween(1 << k, 1 << k))
        pairs, pairs_path = table_of(active.select("seg", "pos", "n", ahead.alias("ahead")).where("ahead is not null"), "pairs")
        first, first_path = _sorted(pairs.groupBy(F.col("n").alias("p"), F.col("ahead").alias("q")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "rank", "p", "q")
        more = bool(first.take(1))
        if more:
            active = written(pairs.join(first, (F.col("n") == F.col("p")) & (F.col("ahead") == F.col("q"))).select("seg", "pos", F.col("rank").alias("n"), "first"), "ranks")
            k += 1
        for p in (pairs_path, first_path):
            drop_table(r.sparkSession, p)
        if not more and 1 << k >= min_words:
            break
        if not more:  # no run of min_words lines occurs again
            return r.select("seg", F.col("pos").alias("start"), F.lit(0).cast("long").alias("lines"), F.col("pos").alias("source")).limit(0)
    deepest = found.groupBy("seg", "pos").agg(F.max(F.struct("k", "first")).alias("x"))
    match = deepest.select("seg", "pos", (F.col("pos") - F.col("x.first")).alias("back"), (F.col("pos") + F.expr("shiftleft(1L, x.k)") - 1).alias("end"))
    along = W.partitionBy("seg", "back").orderBy("pos")
    match = match.withColumn("before", F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1)))
    match = match.withColumn("nth", F.sum(F.when(F.col("before") >= F.col("pos"), 0).otherwise(1)).over(along))
    runs = match.groupBy("seg", "back", "nth").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return runs.select("seg", "start", (F.col("end") - F.col("start") + 1).alias("lines"), (F.col("start") - F.col("back")).alias("source"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_line, last_line, lines, of_doc_id, of_line): the maximal repeated runs of at least ``min_words`` lines, each
    with the first document and line that its lines are found at. Line indexes count blank lines too, lines doesn't."""
    rounds = max(0, min_words.bit_length() - 1)
    r = ranks(repeated_positions(docs), rounds)
    runs = written(interval_runs(r, rounds, min_words), "runs")
    at = lambda name, *cols: r.select(F.col("pos").alias(name), *cols)
    out = runs.withColumn("end", F.col("start") + F.col("lines") - 1)
    out = out.join(at("start", "doc_id", F.col("i").alias("first_line")), "start").join(at("end", F.col("i").alias("last_line")), "end")
    out = out.join(at("source", F.col("doc_id").alias("of_doc_id"), F.col("i").alias("of_line")), "source")
    return out.select("doc_id", "first_line", "last_line", "lines", "of_doc_id", "of_line")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, gone): for each document that loses lines, the sorted indexes of these lines."""
    rounds = max(0, min_words.bit_length() - 1)
    r = ranks(repeated_positions(docs), rounds)
    names = [f"n{k}" for k in range(rounds + 1)]
    s = W.partitionBy("seg").orderBy("pos")
    near = F.struct("w", *names)
    r = r.withColumn("fwd", F.collect_list(near).over(s.rowsBetween(0, min_words - 1)))
    r = r.withColumn("bwd", F.reverse(F.collect_list(near).over(s.rowsBetween(1 - min_words, 0))))

    def reach(xs: str) -> Column:
        """Lines needed for min_words, 0 if the stretch ends before."""
        total = F.aggregate(xs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")), lambda t, x: F.when(t["w"] >= min_words, t).otherwise(F.struct((t["n"] + 1).alias("n"), (t["w"] + x["w"]).alias("w"))))
        return F.when(total["w"] >= min_words, total["n"]).otherwise(0)

    r = r.withColumn("m", reach("fwd")).withColumn("mb", reach("bwd"))
    power = lambda m: F.floor(F.log2(m)).cast("int")  # noqa: E731  exact for the few lengths there are

    def halves(xs: str, m: str, back: bool) -> tuple[Column, Column]:
        """Ranks of the first and the last 2^k lines of the run of m lines."""
        one = two = F.lit(None).cast("long")
        for k, name in enumerate(names):
            here = power(F.col(m)) == k
            near_end, far_end = F.lit(0), F.col(m) - (1 << k)
            if back:  # the list runs backwards: entry t is the line t before the last
                near_end, far_end = F.col(m) - 1, F.lit((1 << k) - 1)
            one = F.when(here, F.get(xs, near_end)[name]).otherwise(one)
            two = F.when(here, F.get(xs, far_end)[name]).otherwise(two)
        return one, two

    f1, f2 = halves("fwd", "m", back=False)
    b1, b2 = halves("bwd", "mb", back=True)
    runs = F.array(F.struct(F.col("m").alias("m"), F.col("pos").alias("start"), f1.alias("x"), f2.alias("y")), F.struct(F.col("mb").alias("m"), (F.col("pos") - F.col("mb") + 1).alias("start"), b1.alias("x"), b2.alias("y")))
    runs = r.select("seg", F.explode(runs).alias("r")).select("seg", "r.*").where("m > 0 and x is not null and y is not null").distinct()
    runs = written(runs, "runs")
    first = written(runs.groupBy("m", "x", "y").agg(F.min("start").alias("first")), "first")
    late = runs.join(first, ["m", "x", "y"]).where("start > first").select("seg", "start", "m")
    late = late.unionByName(interval_runs(r, rounds, min_words).select("seg", "start", F.col("lines").alias("m")))
    gone = late.select("seg", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("pos")).distinct()
    lines = r.select("doc_id", "h", "i", "seg", "pos").join(gone, ["seg", "pos"])
    return lines.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("i")).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of text, and n_deleted, the lines taken out, as one more column.

    Lines compare without surrounding white space; words of a line are parted by white space; blank lines neither break nor
    make a run and are kept. Null text stays null. Rows that repeat both doc_id and text are one document: they keep and lose
    the same lines. A null doc_id sorts first. Empty tables stay empty. A column n_deleted of ``docs`` gives way; others may have any name.
    """
    return _deduped(docs, min_words).select(*own([c for c in docs.columns if c != "n_deleted"], text="text"), "n_deleted")


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    """(_doc, text, n_deleted): each row of ``docs`` as it was, its text after the deletions, and the lines taken out."""
    gone = later_copies(docs, min_words).select(F.col("doc_id").alias("d"), "h", "gone")
    out = packed(docs, "doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left")
    out = out.withColumn("lines", F.when(F.col("gone").isNotNull(), _lines()))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(), "\n"))
    return out.select("_doc", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))


def _kept_lines() -> Column:
    """Lines that aren't gone. gone is sorted: between two of its entries whole slices of lines stay, so the work is linear."""
    n = F.size("lines")
    ends = F.concat("gone", F.array(n))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x + 1))
    spans = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: x["e"] > x["s"])
    return F.flatten(F.transform(spans, lambda x: F.slice(F.col("lines"), x["s"] + 1, x["e"] - x["s"])))


def drop_emptied(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` after :func:`dedup_lines`, without those of which nothing but white space is left because lines were deleted."""
    out = _deduped(docs, min_words).where(F.expr(r"not (n_deleted > 0 and text rlike '^\\s*$')"))
    return out.select(*own(docs.columns, text="text"))


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for (doc_id, n_deleted, n_chars_left, text_sha256): runs are compared as strings, without ranks."""
    space = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    ahead, back = f"ROWS BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING", f"ROWS BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW"
    reach = lambda xs: f"list_min(list_filter(range(1, len({xs}) + 1), lambda m: list_sum(list_transform({xs}[1:m], lambda x: x.w)) >= {min_words}))"
    return f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, i, trim(translate(ls[i], {space}, '     '), ' ') AS l FROM d, unnest(range(1, len(ls) + 1)) t(i)),
p AS (SELECT doc_id, i, l, len(string_split_regex(l, ' +')) AS w, row_number() OVER (ORDER BY doc_id, i) AS pos FROM u WHERE l <> ''),
a AS (SELECT doc_id, i, pos, list({{'l': l, 'w': w}}) OVER (PARTITION BY doc_id ORDER BY i {ahead}) AS f, list_reverse(list({{'l': l, 'w': w}}) OVER (PARTITION BY doc_id ORDER BY i {back})) AS b FROM p),
m AS (SELECT pos, f, b, {reach('f')} AS mf, {reach('b')} AS mb FROM a),
r AS (SELECT pos AS start, mf AS m, array_to_string(list_transform(f[1:mf], lambda x: x.l), chr(10)) AS run FROM m WHERE mf IS NOT NULL
UNION SELECT pos - mb + 1, mb, array_to_string(list_transform(list_reverse(b[1:mb]), lambda x: x.l), chr(10)) FROM m WHERE mb IS NOT NULL),
g AS (SELECT DISTINCT start + k AS pos FROM (SELECT *, min(start) OVER (PARTITION BY run) AS first FROM r), unnest(range(0, m)) t(k) WHERE start > first),
n AS (SELECT doc_id, list(i) AS gone FROM p JOIN g USING (pos) GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(len(gone), 0)::BIGINT AS n_deleted, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END AS text FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, n_deleted, length(text)::BIGINT AS n_chars_left, sha256(text) AS text_sha256 FROM o"""
