"""URL filters: rules by host and path, and for the rest a learned tree of path templates.

For each host, the paths of its urls form a tree of segments. Segments that vary by nature (numbers, hex strings, long mixtures
of letters and digits) become wildcards, as do the children of a node that fans out; siblings whose labels don't differ
significantly from all of their parent's are merged into a wildcard branch too. A template is rejected if its labelled share of
bad pages, smoothed towards its host's and that towards the whole table's, is large enough.

The tree is grown level by level over (host, template) pairs with DataFrame operations; each level aggregates before it
shuffles, so a host with a third of all pages costs one row a segment and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanespark.llm._util import written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Depth of the tree. The segments of deeper paths from the last level on are one branch: each is generalised by its nature there,
#: but branches inside it aren't merged on their own.
DEPTH = 6
#: A node with more distinct children than this is a variable place.
FAN_OUT = 32
#: Standard deviations by which a branch must differ from its parent to stay apart.
APART = 2.0
SMOOTHING = 8.0
REJECT = 0.5


def host_of(url: str) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; '' for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked last and wins
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


_EXTENSION, _NUMBER, _HEX = r"(\.[A-Za-z]{1,5})\z", r"^[0-9]+\z", r"^[0-9a-fA-F]{8,}\z"


def _variable(seg: Column) -> Column:
    """The wildcard of a segment that varies by nature, else null: digits with or without an extension, hex strings, long mixtures."""
    stem = F.regexp_replace(seg, _EXTENSION, "")
    kind = F.when(stem.rlike(_NUMBER), "{n}").when(stem.rlike(_HEX), "{hex}").when(stem.rlike("[0-9]") & (F.length(stem) >= 8), "{id}")
    return F.concat(kind, F.regexp_extract(seg, _EXTENSION, 1))


def _named(seg: Column) -> Column:
    """A segment's branch: its wildcard, or itself, with a backslash before what might be taken for a wildcard."""
    return F.coalesce(_variable(seg), F.when(F.substring(seg, 1, 1).isin("{", "*", "\\"), F.concat(F.lit("\\"), seg)).otherwise(seg))


def _share(bad: str, n: str, to: Column) -> Column:
    return (F.col(bad) + F.lit(SMOOTHING) * to) / (F.col(n) + F.lit(SMOOTHING))


def templates(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, bad, template) from (page_id, host, path, bad); bad is 1, 0 or null where there is no label."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    parts = F.transform(parts, _named)
    cut = F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(F.array_join(F.slice(parts, DEPTH, 1 << 30), "/")))).otherwise(parts)
    # one row for each distinct path of a host: all that the tree needs
    paths = pages.groupBy("host", "path").agg(F.sum("bad").alias("b"), F.count("bad").alias("n"))
    rows = written(paths.withColumn("seg", cut).withColumn("template", F.lit("")).withColumn("b", F.coalesce("b", F.lit(0)).cast("long")), "paths")
    for d in range(DEPTH):
        rows = rows.withColumn("s", F.get("seg", F.lit(d)))
        kids = rows.where("s is not null").groupBy("host", "template", "s").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        node = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("fan"), F.sum("b").alias("pb"), F.sum("n").alias("pn"))
        kids = kids.join(node, ["host", "template"])
        # how far the branch's share is from its parent's, in standard deviations under the parent's smoothed share
        p = (F.col("pb") + 1.0) / (F.col("pn") + 2.0)
        far = F.abs(F.col("b") - F.col("n") * p) / F.sqrt(F.greatest(F.col("n"), F.lit(1)) * p * (1 - p))
        keep = (F.col("n") > 0) & (far >= APART)
        to = F.when((F.col("fan") > FAN_OUT) & ~keep, F.lit("*")).when(F.col("s").startswith("{"), F.col("s")).when(~keep & (F.col("fan") > 1), F.lit("*")).otherwise(F.col("s"))
        step = kids.select("host", "template", "s", to.alias("to"))
        rows = written(rows.join(step, ["host", "template", "s"], "left").withColumn("template", F.when(F.col("to").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "to"))).select("host", "path", "b", "n", "seg", "template"), "paths")
    return pages.join(rows.select("host", "path", "template"), ["host", "path"]).select("page_id", "host", "path", "bad", "template")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages`` (page_id, url).

    A page is bad if it is labelled (labels.doc_id is its page_id) toxic or of quality 0; labels that repeat a doc_id count
    once, bad if one of them is. A rule's verdict stands; elsewhere the page is blocked if its template's smoothed share of bad
    pages reaches REJECT, so where nothing is labelled it is allowed. Null urls have an empty host and path and are judged as
    such. Repeated rows each get their row; an empty table gives an empty result.
    """
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).cast("long").alias("bad"))
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).join(label, "page_id", "left")
    rows = written(templates(rows), "templates")
    total = rows.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.count("bad").alias("n"))
    total = total.select("host", "template", F.coalesce("b", F.lit(0)).alias("b"), "n")
    host = total.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("n").alias("hn"))
    b, n = host.agg(F.sum("hb"), F.sum("hn")).first()
    prior = F.lit(float(b or 0) / float(n) if n else 0.0)
    scored = total.join(host, "host").withColumn("purity", _share("b", "n", _share("hb", "hn", prior))).select("host", "template", "purity")
    rule, verdict = rule_of(rules)
    out = rows.join(scored, ["host", "template"]).withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def oracle_sql(rules=RULES) -> str:
    """DuckDB SQL for :func:`judge`."""
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + f" WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END"
    stem = f"regexp_replace(x, '{_EXTENSION}', '')"
    variable = f"coalesce((CASE WHEN regexp_matches({stem}, '{_NUMBER}') THEN '{{n}}' WHEN regexp_matches({stem}, '{_HEX}') THEN '{{hex}}' WHEN regexp_matches({stem}, '[0-9]') AND length({stem}) >= 8 THEN '{{id}}' END) || regexp_extract(x, '{_EXTENSION}', 1), CASE WHEN x[1] IN ('{{', '*', chr(92)) THEN chr(92) || x ELSE x END)"
    levels = []
    for d in range(DEPTH):
        levels.append(f"""a{d} AS (SELECT *, seg[{d + 1}] AS s FROM t{d}),
k{d} AS (SELECT host, template, s, sum(b) AS b, sum(n) AS n FROM a{d} WHERE s IS NOT NULL GROUP BY host, template, s),
m{d} AS (SELECT *, count(*) OVER g AS fan, (sum(b) OVER g + 1.0::DOUBLE) / (sum(n) OVER g + 2.0::DOUBLE) AS p FROM k{d} WINDOW g AS (PARTITION BY host, template)),
f{d} AS (SELECT *, n > 0 AND abs(b - n * p) / sqrt(greatest(n, 1) * p * (1 - p)) >= {APART} AS keep FROM m{d}),
g{d} AS (SELECT host, template, s, CASE WHEN fan > {FAN_OUT} AND NOT keep THEN '*' WHEN starts_with(s, '{{') THEN s WHEN NOT keep AND fan > 1 THEN '*' ELSE s END AS dest FROM f{d}),
t{d + 1} AS (SELECT host, path, b, n, seg, CASE WHEN dest IS NULL THEN template ELSE template || '/' || dest END AS template FROM a{d} LEFT JOIN g{d} USING (host, template, s))""")
    return f"""WITH l AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, bad FROM r LEFT JOIN l USING (page_id)),
c AS (SELECT host, path, coalesce(sum(bad), 0) AS b, count(bad) AS n, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: {variable}) AS seg FROM h GROUP BY host, path),
t0 AS (SELECT host, path, b, n, CASE WHEN len(seg) > {DEPTH} THEN list_append(seg[1:{DEPTH - 1}], array_to_string(seg[{DEPTH}:], '/')) ELSE seg END AS seg, '' AS template FROM c),
{", ".join(levels)},
e AS (SELECT page_id, host, path, bad, template FROM h JOIN t{DEPTH} USING (host, path)),
n AS (SELECT host, template, coalesce(sum(bad), 0)::DOUBLE AS b, count(bad)::DOUBLE AS n FROM e GROUP BY host, template),
q AS (SELECT host, sum(b) AS hb, sum(n) AS hn FROM n GROUP BY host),
o AS (SELECT CASE WHEN sum(hn) > 0 THEN sum(hb) / sum(hn) ELSE 0 END AS prior FROM q),
z AS (SELECT n.host, template, (b + {SMOOTHING}::DOUBLE * ((hb + {SMOOTHING}::DOUBLE * prior) / (hn + {SMOOTHING}::DOUBLE))) / (n + {SMOOTHING}::DOUBLE) AS purity FROM n JOIN q USING (host), o)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, template, round(purity, 9) AS purity FROM e JOIN z USING (host, template)"""
