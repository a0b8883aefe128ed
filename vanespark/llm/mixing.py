"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of levels (domain, language, source) gets a token budget at its root. Every node deals its budget to its children by
weight; a child that holds too few tokens takes what it has, and what it lacks goes to its siblings by their weights, and on to
the parent's siblings only when all of them are full. Each leaf then takes whole epochs of its documents and, of one more
epoch in seeded random order, the longest prefix that its budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vanespark.llm._util import broadcast_if_small, own, packed, written

LEVELS = ("domain", "lang", "source")
#: Relative weights among siblings, the same under every parent; a value that isn't listed has weight 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "news": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
SEED = 7
#: Part of all tokens that the budget is, as a fraction of whole numbers.
BUDGET = (1, 2)
MAX_EPOCHS = 2
#: Bytes of a leaf's row, names included, as its broadcast is judged.
LEAF_BYTES = 512
SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def domain_of(source: Column) -> Column:
    """The domain a source belongs to, by the number in its name."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})", 1), F.lit(""))
    n = F.when(n == "", F.lit(None)).otherwise(n).cast("int") % 3
    return F.when(n == 0, "web").when(n == 1, "books").when(n == 2, "news").otherwise("other")


def tokens_of(text: Column) -> Column:
    """Words of a text parted by ASCII white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def _weight(level: str) -> Column:
    out = F.lit(1.0)
    for value, w in WEIGHTS.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaf totals (domain, lang, source, tokens).

    A node with capacity c and weight w gets least(c, w * level), where level is where the water stands among its siblings:
    the largest (budget - capacities of those filled before) / (weights left), going up by c / w. All sums are of whole
    numbers, so any order of summation gives the same result.
    """
    nodes = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    everything = F.floor(F.sum("tokens").over(W.partitionBy()) * budget[0] / budget[1]).cast("double")  # over the domains, a few rows
    given = None
    for k, level in enumerate(LEVELS):
        path = list(LEVELS[: k + 1])
        kids = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(level))
        kids = kids.withColumn("share", everything) if given is None else kids.join(given, path[:-1])
        among = W.partitionBy(*path[:-1]).orderBy(F.col("cap") / F.col("w"), level)
        before = F.coalesce(F.sum("cap").over(among.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("w").over(among.rowsBetween(0, W.unboundedFollowing))
        kids = kids.withColumn("level", (F.col("share") - before) / left)
        kids = kids.withColumn("share", F.least("cap", F.col("w") * F.max("level").over(W.partitionBy(*path[:-1]))))
        given = kids.select(*path, "share", *(["tokens"] if k == len(LEVELS) - 1 else []))
    return given.select(*LEVELS, "tokens", F.floor(F.greatest("share", F.lit(0.0))).cast("long").alias("budget"))


def _leaved(docs: DataFrame) -> DataFrame:
    clean = docs.withColumn("_domain", domain_of(F.col("source")))
    return clean.withColumn("_lang", F.coalesce("lang", F.lit(""))).withColumn("_source", F.coalesce("source", F.lit("")))


def _order_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _by_leaf(rows: DataFrame, leaves: DataFrame, leaf: list[str]) -> DataFrame:
    """``rows`` with their leaf's columns: leaves are broadcast up to a checked size, as a hot leaf's rows are best left where
    they are; beyond it they are joined by a shuffle, whose hot partitions adaptive execution splits."""
    return rows.join(broadcast_if_small(leaves, LEAF_BYTES), leaf)


def _cut_of(rows: DataFrame, leaf: list[str], rest: str, part: str) -> DataFrame:
    """(leaf..., part, left): the part of each leaf's rows in which ``rest`` tokens end, and how many of them are left there."""
    sums = rows.groupBy(*leaf, rest, part).agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(W.partitionBy(*leaf).orderBy(part))
    end = sums.withColumn("upto", upto).where((F.col("upto") > F.col(rest)) & (F.col("upto") - F.col("t") <= F.col(rest)))
    return end.select(*leaf, part, F.col(rest) - F.col("upto") + F.col("t"))


def mix(docs: DataFrame, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source and others) that the mix takes, with domain, tokens and copies, the
    number of epochs that hold the row. Columns of ``docs`` named domain, tokens or copies give way; see :func:`taken`."""
    kept = own([c for c in docs.columns if c.lower() not in ("domain", "tokens", "copies")])
    return taken(docs, budget, max_epochs, seed).select(*kept, "domain", "tokens", "copies")


def taken(docs: DataFrame, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(_doc, domain, tokens, copies): the rows of ``docs`` that the mix takes, each whole in a struct, so that its columns may
    have any name.

    Null lang or source is a leaf of its own; null text has no tokens and goes with whatever prefix it falls in. In an epoch
    documents go by md5 of seed, epoch and doc_id, ties by a hash of the text. A leaf without tokens and an empty table give
    nothing.

    A leaf's prefix is found by totals of 256 ranges of the order key and of 256 parts of the one in which it ends, so a leaf of
    any size is summed in parallel; only one part in 65,536 of its rows is ordered row by row.
    """
    leaf = ["_domain", "_lang", "_source"]
    slim = written(_leaved(docs.select("doc_id", "text", "lang", "source")).select("doc_id", *leaf, tokens_of(F.col("text")).alias("tokens")), "mix")
    totals = slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").toDF(*LEVELS, "tokens")
    share = budgets(totals, budget, max_epochs).toDF(*leaf, "_total", "_budget")
    full = F.least(F.floor(F.col("_budget") / F.col("_total")), F.lit(max_epochs)).cast("int")
    share = written(share.withColumn("_epoch", full).withColumn("_rest", F.col("_budget") - F.col("_epoch") * F.col("_total")), "share")
    ranged = _by_leaf(slim, share, leaf).withColumn("_range", F.substring(_order_key(seed), 1, 4))
    wide = _cut_of(ranged.withColumn("_wide", F.substring("_range", 1, 2)), leaf, "_rest", "_wide")
    near = _by_leaf(ranged, written(wide, "wide").toDF(*leaf, "_at", "_rest_there"), leaf).where(F.startswith("_range", "_at"))
    cut = _cut_of(near, leaf, "_rest_there", "_range").toDF(*leaf, "_cut", "_left")
    plan = written(share.join(cut, leaf, "left").select(*leaf, "_epoch", "_cut", "_left"), "plan")
    rows = _by_leaf(_leaved(packed(docs, "doc_id", "text", "lang", "source")), plan, leaf).withColumn("_key", _order_key(seed)).withColumn("_range", F.substring("_key", 1, 4))
    rows = rows.withColumn("tokens", tokens_of(F.col("text")))
    # rows before the cut are in, rows after it are out; null cut: the budget is a whole number of epochs
    sure = rows.where("_cut is null or _range <> _cut").withColumn("copies", F.col("_epoch") + F.when(F.col("_range") < F.col("_cut"), 1).otherwise(0))
    edge = W.partitionBy(*leaf).orderBy("_key", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, 0)
    close = rows.where("_range = _cut").withColumn("copies", F.col("_epoch") + F.when(F.sum("tokens").over(edge) <= F.col("_left"), 1).otherwise(0))
    out = sure.unionByName(close).where("copies > 0")
    return out.select("_doc", F.col("_domain").alias("domain"), "tokens", F.col("copies").cast("long").alias("copies"))


def mixed(docs: DataFrame, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row as many times as epochs hold it."""
    out = taken(docs, budget, max_epochs, seed)
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


def _sql_weight(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS.get(level, {}).items())
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def oracle_sql(budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL for (doc_id, domain, lang, source, tokens, copies) of :func:`mix`."""
    parts = []
    for k, level in enumerate(LEVELS):
        path, up = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k])
        over = f"PARTITION BY {up} " if up else ""
        join = f"JOIN s{k - 1} USING ({up})" if up else f"CROSS JOIN (SELECT floor(sum(tokens) * {budget[0]} / {budget[1]})::DOUBLE AS share FROM leaves)"
        parts.append(f"""n{k} AS (SELECT {path}, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {max_epochs})::DOUBLE AS cap FROM leaves GROUP BY {path}),
w{k} AS (SELECT *, ({_sql_weight(level)})::DOUBLE AS w FROM n{k}),
l{k} AS (SELECT w{k}.*, share AS b,
  (share - coalesce(sum(cap) OVER ({over}ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({over}ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w{k} {join}),
s{k} AS (SELECT {path}, {'tokens AS total,' if k == len(LEVELS) - 1 else ''} least(cap, w * max(lvl) OVER ({over.strip()})) AS share FROM l{k})""")
    last = f"s{len(LEVELS) - 1}"
    return f"""WITH d AS (SELECT doc_id, text, lang AS own_lang, source AS own_source, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})', 1) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' ELSE 'other' END AS domain,
  len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY domain, lang, source HAVING sum(tokens) > 0),
{', '.join(parts)},
plan AS (SELECT domain, lang, source, total, floor(greatest(share, 0))::BIGINT AS budget, least(floor(floor(greatest(share, 0)) / total), {max_epochs})::BIGINT AS epoch FROM {last}),
k AS (SELECT d.*, epoch, budget - epoch * total AS rest, md5(concat_ws('|', '{seed}', epoch::VARCHAR, doc_id::VARCHAR)) AS key FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, own_lang AS lang, own_source AS source, tokens, (epoch + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE epoch + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""
