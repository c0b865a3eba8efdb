"""The pipeline against its operators' plain versions, stage by stage."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from brute import decontamination, line_dedup, simhash

import corpus_pipeline as pipeline
from matchloom.llm import byte_bpe, language_id
from matchloom.llm.shared import read


def plain(docs, items, languages):
    """{doc_id: (n_tokens, ids_sha256)} of (id, text) pairs; ``languages`` has what the first stage lets through."""
    kept = [(i, t) for i, t in docs if i in languages]
    kept = [(i, text) for i, (n, gone, text) in line_dedup(kept).items() if n == 0 or gone < n]
    groups = simhash(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    hits = decontamination(kept, items)
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = {i: np.array(enc.encode_ordinary(t or ""), "<u4") for i, t in kept if not hits[i][4]}
    return {i: (len(x), hashlib.sha256(x.tobytes()).hexdigest()) for i, x in ids.items()}


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """A third of the small table with some odd rows, beside its benchmark."""
    docs = read(spark, sf_dir, "documents").filter("doc_id < 70")
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "12 34 !!", "en", "s", 8), (1003, docs.filter("doc_id = 9").first()["text"], "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    read(spark, sf_dir, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run_equals_plain_version(spark, small):
    docs = read(spark, small, "documents")
    scored = language_id.predict(docs, language_id.fit(docs, language_id.learnable())).collect()
    sure = {r["doc_id"] for r in scored if r["lang_pred"] != "und" and r["score"] >= pipeline.LEAST_SCORE}
    assert not sure & {1000, 1001, 1002} and len(sure) >= 69
    items = [tuple(r) for r in read(spark, small, "benchmark").collect()]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in pipeline.run(spark, small).collect()}
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], items, sure)
    assert 1003 not in got


def test_stages_keep_the_columns(spark, small):
    docs = read(spark, small, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.filter("false"), small).count() == 0


def test_unlearnt_languages_go_and_clean_documents_stay(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    strange = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
               "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。", "xqzv kjwq zzxv bqkj vwxq pzkq jxvw qkzx"]
    more = spark.createDataFrame([(-1 - i, x, "en", "s", len(x)) for i, x in enumerate(strange)], docs.schema)
    model = language_id.fit(docs, language_id.learnable())
    left = {r["doc_id"] for r in language_id.predict(more.unionByName(docs), model, reject=True).filter("lang_pred <> 'und'").collect()}
    clean = {r["doc_id"] for r in language_id.predict(docs, model).filter("lang_pred <> 'und'").collect()}
    assert left == clean
