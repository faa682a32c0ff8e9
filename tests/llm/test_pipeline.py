"""The pipeline's rows against what its stages promise."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers

from pitchloom.llm import tokens
from tests_llm_helpers import expected_pipeline


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    kept = expected_pipeline(docs)
    tokenizer = tokens.library(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in kept.items():
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, k): (len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    rows = corpus_pipeline.run(spark, d).collect()
    assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in rows} == want


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "the house and the garden of the king", "en", "s", 36), (2, None, "en", "s", None), (3, "1234", None, None, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.where("doc_id = 1").count() == 1, name
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()} <= {1}


def test_documents_stay_where_no_language_is_learned(spark):
    form = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the house", None, "s", 9), (2, None, None, "s", None), (3, "1234", None, "s", 4)]
    unlearned = [rows, [(i, t, "en" if i == 3 else None, s, n) for i, t, _, s, n in rows], [(i, "the house", "en", "s", 9) for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]]
    for table, want in zip(unlearned, ({1}, {1}, {r[0] for r in unlearned[2]})):
        out = corpus_pipeline.language(spark, spark.createDataFrame(table, form), "")
        assert {r["doc_id"] for r in out.collect()} == want and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
