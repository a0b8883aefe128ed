"""The pipeline's stages by brute force on a small table, and by what each must leave alone."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_text_ops import _brute_lines
from vanespark.llm import linededup, mixing
from vanespark.llm._util import written


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "12 !", "en", "src1", 4), (9003, "", None, None, 0)], docs.schema)
    docs = written(docs.unionByName(odd))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mix", "encode"]
    stage = dict(corpus_pipeline.STAGES)
    one = written(stage["language_id"](spark, docs, sf))
    assert one.columns == docs.columns and one.count() == docs.count() - 3
    two = written(stage["line_dedup"](spark, one, sf))
    texts = sorted((r.doc_id, r.text) for r in one.collect())
    want = [x for x in map(eval, _brute_lines(texts, linededup.MIN_WORDS)) if not (x[2] and not x[1].strip())]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in two.collect()) == sorted((i, t, len(t)) for i, t, _ in want)
    three = written(stage["near_dedup"](spark, two, sf))
    kept = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns and len(kept) == three.count()

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    left = {r.doc_id: shingles(r.text) for r in two.collect()}
    gone = set(left) - kept
    like = lambda a, b: len(left[a] & left[b]) / len(left[a] | left[b])
    assert all(max(like(g, o) for o in left if o != g) > 0.5 for g in gone)  # only documents with a near copy go
    alone = [d for d in left if all(like(d, o) < 0.3 for o in left if o != d)]
    assert set(alone) <= kept
    four = written(stage["mix"](spark, three, sf))
    assert four.columns == docs.columns
    t = lambda df: df.select(mixing.tokens_of(df.text).alias("n")).groupBy().sum("n").first()[0]
    assert 0.5 * t(three) <= t(four) <= 0.8 * t(three)  # each of the many small leaves ends before the document that would exceed it
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in stage["encode"](spark, four, sf).collect()}
    assert len(got) == four.count()
    for r in four.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(got[r.doc_id].ids) == ids and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_an_empty_table_goes_through(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
