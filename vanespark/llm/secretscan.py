"""Secret scans over an incremental ledger of blobs.

A text is a blob, addressed by the SHA-256 of its content. The ledger holds (blob, rule_version, spans) for what was scanned
before; a scan reads only blobs that the ledger lacks under the present rule version, each distinct one once, and findings are
joined back to every path that holds the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanespark.llm._util import broadcast_if_small, cols, record_batch, strs, written

RULE_VERSION = 2


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(f"(?:{'|'.join(_either_case(w) for w in _KEYWORDS[:4])}|{_either_case('api')}_?{_either_case('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_WEB = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
BASE = ("assign", "access", "hex")


def _assign(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if any(w in low for w in _KEYWORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                yield m.span()


def _access(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20)


#: Kinds in the order they are listed, each with the version that brought it in.
RULES: list[tuple[str, int, Callable[[str], Iterator[tuple[int, int]]]]] = [
    ("assign", 1, _assign),
    ("access", 1, _access),
    ("hex", 1, lambda t: (m.span() for m in _HEX.finditer(t))),
    ("pem", 2, lambda t: (m.span() for m in _PEM.finditer(t)) if "PRIVATE KEY-----" in t else iter(())),
    ("webtoken", 2, lambda t: (m.span() for m in _WEB.finditer(t)) if "eyJ" in t else iter(())),
]


def spans_of(text: str, version: int = RULE_VERSION) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by kind as listed."""
    found = [(start, k, kind, end) for k, (kind, since, rule) in enumerate(RULES) if since <= version for start, end in rule(text)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


_FOUND = pa.schema([("blob", pa.string()), ("rule_version", pa.int32()), ("spans", pa.string())])
LEDGER = "blob string, rule_version int, spans string"


def blob_of(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: int = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs of ``docs`` (doc_id, text) that ``ledger`` lacks under ``version``.

    spans is ``kind:start:end`` comma-joined, '' for a clean blob, so a clean one isn't read again either. Addresses alone meet
    the ledger; texts are read on for the blobs it lacks.
    """
    rows = docs.select("doc_id", "text").withColumn("blob", blob_of("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == version).select("blob").distinct()
        unseen = written(rows.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        if not unseen.take(1):
            return docs.sparkSession.createDataFrame([], LEDGER)
        rows = rows.join(broadcast_if_small(unseen, 96), "blob", "left_semi")
    # a blob of several rows is read where its least doc_id is; the many blobs of one row need no shuffle of texts
    several = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n")
    several = broadcast_if_small(written(several, "several"), 128)
    rows = rows.join(several.withColumn("many", F.lit(True)), "blob", "left").where("many is null or doc_id <=> first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [",".join(f"{k}:{s}:{e}" for k, s, e in spans_of(t, version)) for t in strs(cols(b, "text")[0])]
            yield record_batch(_FOUND, [cols(b, "blob")[0], [version] * b.num_rows, spans])

    return rows.select("blob", "text").mapInArrow(run, LEDGER).distinct()


def paths(docs: DataFrame, ledger: DataFrame, version: int = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``docs``: the ledger's findings at all paths; spans '' where there is none."""
    found = ledger.where((F.col("rule_version") == version) & (F.col("spans") != "")).select("blob", "spans")
    return docs.select("doc_id", blob_of("text").alias("blob")).join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.lit("")).alias("spans"))


def update(docs: DataFrame, ledger_path: str, version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it there, and return :func:`paths` over all of it."""
    spark = docs.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    old = spark.read.schema(LEDGER).parquet(ledger_path) if there else None
    scan(docs, old, version).write.mode("append").parquet(ledger_path)
    return paths(docs, spark.read.schema(LEDGER).parquet(ledger_path), version)


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, version: int = RULE_VERSION) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``docs``: what ``ledger`` knows and a scan of the rest.

    Null text is empty text; repeated rows each get their row; an empty table gives an empty result. A blob whose rows repeat
    the least doc_id is read at each of those and counted once.
    """
    new = written(scan(docs, ledger, version), "ledger")
    return paths(docs, new if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(new), version)


def digest_columns(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from :func:`find_secrets`."""
    each = F.filter(F.split("spans", ","), lambda x: x != "")
    base = F.filter("_each", lambda x: F.substring_index(x, ":", 1).isin(*BASE))
    out = found.withColumn("_each", each).withColumn("_base", base)

    def count(kind: str) -> F.Column:
        return F.size(F.filter("_base", lambda x: F.substring_index(x, ":", 1) == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in BASE]
    return out.select("doc_id", *n, F.sha2(F.array_join("_base", ","), 256).alias("base_sha256"), "spans")
