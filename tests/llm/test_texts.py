"""Operators that look at one text at a time."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import decontamination as plain_decontamination
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchloom.llm import byte_bpe, decontamination, language_id, records, token_counts
from matchloom.llm.crc32c import crc32c
from matchloom.llm.shared import read
from matchloom.sources.scratch import scratch_dir

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library_ids(path, texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(path).encode_batch([x or "" for x in texts], add_special_tokens=False)]


# --- byte-level BPE


def test_round_trip_equals_library(odd, odd_rows, real, spark):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    for frame, rows in ((odd, odd_rows), (spark.createDataFrame(real, "doc_id long, text string"), real)):
        got = {r["doc_id"]: r for r in byte_bpe.round_trip(frame, RANKS, PATTERN).collect()}
        assert len(got) == len(rows)
        for i, text in rows:
            ids = enc.encode_ordinary(text or "")
            assert got[i]["n_tokens"] == len(ids) and got[i]["restored"]
            assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_cut_at_safe_places_changes_nothing(odd_rows, real):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    for _, text in [*odd_rows, *real[:40]]:
        for size in (1, 7, 50):
            short = (text or "")[:3000]
            assert "".join(byte_bpe.safe_pieces(short, size)) == short
            assert byte_bpe.encode(short, RANKS, PATTERN, size).tolist() == enc.encode_ordinary(short)


def test_columns_of_ids_and_raw_bytes(odd):
    encode, decode = byte_bpe.encode_texts(RANKS, PATTERN), byte_bpe.decode_ids(RANKS, PATTERN)
    rows = odd.select("text", decode(encode(F.col("text"))).alias("raw")).collect()
    assert all(bytes(r["raw"]).decode() == (r["text"] or "") for r in rows)
    half = byte_bpe.encode("🙂", RANKS, PATTERN)[:1]
    assert byte_bpe.decode(half, RANKS, PATTERN) == "🙂".encode()[:len(byte_bpe.decode(half, RANKS, PATTERN))]


# --- token counts


def test_counts_equal_library(odd, odd_rows, real, spark):
    for frame, rows in ((odd, odd_rows), (spark.createDataFrame(real, "doc_id long, text string"), real)):
        got = {r["doc_id"]: r for r in token_counts.count_tokens(frame, BYTES, 512).collect()}
        for (i, text), ids in zip(rows, library_ids(BYTES, [t for _, t in rows]), strict=True):
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (len(ids), len((text or "").encode()), len(ids) > 512)


def test_counts_of_every_character():
    texts = [f"x{c}y {c}1 {c}{c} a\n{c}b" for c in map(chr, range(0x3000)) if c.isprintable() or c.isspace()]
    count = token_counts.counter(BYTES).count
    assert [count(x) for x in texts] == [len(x) for x in library_ids(BYTES, texts)]


def test_counter_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        token_counts.Counter(WORDS)


# --- records


def test_checksum():
    assert crc32c([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, 0xC1D04330]
    long = [bytes(range(256)) * 5 + b"x", bytes(300)]
    assert crc32c(long).tolist() == [int(crc32c([x])[0]) for x in long]


def test_records_equal_library(spark, odd, odd_rows, real):
    for frame, rows in ((odd, odd_rows), (spark.createDataFrame(real, "doc_id long, text string").repartition(5), real)):
        index = records.write_records(frame, scratch_dir(spark, "t-records"), WORDS, end_id=1)
        got = {r["doc_id"]: r for r in records.record_checksums(records.with_starts(index), WORDS).collect()}
        start = 0
        for (i, _), ids in zip(rows, library_ids(WORDS, [t for _, t in rows]), strict=True):
            ids = np.array([*ids, 1], "<u4")
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_records_of_every_character():
    texts = [f"x{c}y {c}1 {c}{c} a\n{c}b. a{c}. a.{c} {c}" for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    got = records.encoder(WORDS).encode(pa.array(texts))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == library_ids(WORDS, texts)


def test_records_words_kept_and_special():
    enc = records.Encoder(WORDS)
    texts = ["", None, "  a  b ", "x\x1cy Z", "<|endoftext|> A<|ENDOFTEXT|> <|startoftext|>\n", "Z" * 100 + ".", "a, b. c!"]
    for part in (texts, texts[:3], texts[5:], texts[:2], []):
        got = enc.encode(pa.array(part, pa.string()))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == library_ids(WORDS, [x or "" for x in part])
    assert max(map(len, enc.kept)) <= records.KEPT_CHARS


def test_records_of_one_id_are_in_order(spark):
    rows = [(1, f"text {i % 40}") for i in range(80)] + [(None, "b"), (None, "a"), (0, "z")]
    orders = []
    for parts in (1, 7):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        index = records.write_records(frame, scratch_dir(spark, "t-records"), WORDS)
        found = records.record_checksums(records.with_starts(index), WORDS).orderBy("start").collect()
        orders.append([(r["doc_id"], r["start"], r["ids_crc32"]) for r in found])
    assert orders[0] == orders[1] and [x[0] for x in orders[0][:3]] == [None, None, 0]


def test_shuffled_reads_repeats_and_damage(spark):
    rows = [(3, "three words here"), (1, "one"), (3, "three words here"), (None, "no id"), (2, None)]
    index = records.write_records(spark.createDataFrame(rows, "doc_id long, text string"), scratch_dir(spark, "t-records"), WORDS)
    assert index.count() == 5
    some = records.read_records(index.filter("doc_id = 3").orderBy(F.rand(1)), WORDS).collect()
    assert {np.frombuffer(bytes(r["ids"]), "<u2").tobytes() for r in some} == {np.array(library_ids(WORDS, ["three words here"])[0], "<u2").tobytes()}
    assert [r["n_tokens"] for r in records.with_starts(index).filter("doc_id = 2").collect()] == [0]
    framed = next(iter(records.frame([b"abcd"])))
    assert records.unframe([framed]) == [b"abcd"]
    with pytest.raises(ValueError):
        records.unframe([framed[:-6] + b"XX" + framed[-4:]])


def test_records_of_no_rows(spark, empty):
    index = records.write_records(empty, scratch_dir(spark, "t-records"), WORDS, end_id=1)
    assert records.record_checksums(records.with_starts(index), WORDS).count() == 0


# --- decontamination


def test_hits_equal_plain_version(spark, sf_dir, real, odd, odd_rows):
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").collect()]
    items += [(901, "beta alpha"), (902, None), (903, "..."), (904, "the same line another one here"), (904, "the same line another one here"), (905, "日本語")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for frame, rows in ((odd, odd_rows), (spark.createDataFrame(real, "doc_id long, text string"), real)):
        got = {r[0]: tuple(r)[1:] for r in decontamination.report(decontamination.find_hits(frame, bench)).collect()}
        assert got == plain_decontamination(rows, items)


def test_more_windows_than_a_set_holds(spark, sf_dir, real, monkeypatch):
    monkeypatch.setattr(decontamination, "SET_WINDOWS", 400)
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").collect()]
    docs = spark.createDataFrame(real, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontamination.report(decontamination.find_hits(docs, read(spark, sf_dir, "benchmark"))).collect()}
    assert len([*decontamination.window_sets(read(spark, sf_dir, "benchmark"), "item_id", "text", 10)]) > 1
    assert got == plain_decontamination(real, items)


def test_documents_and_spans_go(spark):
    docs = spark.createDataFrame([(1, "Before. One two THREE, four; after é."), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    found = decontamination.find_hits(docs, bench)
    assert {r["doc_id"] for r in decontamination.drop_documents(found).collect()} == {2, 3}
    assert {r["doc_id"]: r["text"] for r in decontamination.cut_spans(found).collect()} == {1: "Before. ; after é.", 2: "nothing", 3: None}
    none = decontamination.report(decontamination.find_hits(docs, bench.filter("false"))).collect()
    assert not any(r["contaminated"] for r in none) and len(none) == 3


# --- language ID


def test_held_out_accuracy(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, language_id.learnable(), rows=40, landmarks=8)
    out = language_id.predict(docs.withColumn("held", ~language_id.learnable()), model).filter("held").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_sample_is_bounded_in_rows(spark):
    rows = [(1, f"words of one id {i}", "en") for i in range(3000)] + [(1, "mots", "fr")] + [(i, f"more words {i}", "en") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once, again = (sorted(language_id.sample(docs.repartition(n), F.lit(True), "doc_id", "text", "lang", 20).collect()) for n in (1, 9))
    assert once == again and [sum(r["label"] == x for r in once) for x in ("en", "fr")] == [20, 1]
    assert len({(r["id"], r["label"]) for r in once}) == 21
    many = language_id.sample(docs, F.lit(True), "doc_id", "text", "lang", 100).collect()
    assert len(many) == 60 and {r["text"] for r in many if r["id"] > 1} == {f"more words {i}" for i in range(2, 60)}


def test_scores_equal_kernel_regression(spark, sf_dir):
    """The folded weights against kernel values taken n-gram by n-gram."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, language_id.learnable(), rows=20, landmarks=4)
    texts = [language_id.letters(r["text"] or "") for r in docs.limit(20).collect()]
    known = {int(h): int(model.number[s]) for s, h in enumerate(model.known) if model.number[s] >= 0}
    for text, scores in zip(texts, model.scores(texts), strict=True):
        have = {known[int(h)] for hashes in language_id.grams(text, model.longest) for h in hashes if int(h) in known}
        want = model.weights[sorted(have)].astype(float).sum(0) / max(1.0, len(have)) ** 0.5
        assert np.allclose(scores, want, atol=1e-4)


def test_no_letters_no_labels_no_rows(spark, odd, empty):
    model = language_id.fit(odd, F.lit(True))
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert len(got) == odd.count() and "mark" in language_id.predict(odd, model).columns
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and all(got[i]["score"] == 0 for i in range(4)) and got[8]["lang_pred"] == "en"
    signs = spark.createDataFrame([("²½ ³", 1), ("12 _ !", 2), ("x", 3)], "text string, n int")
    assert [r["lang_pred"] for r in language_id.predict(signs, model).orderBy("n").collect()] == ["und", "und", "en"]
    assert language_id.fit(empty, F.lit(True)) is None and language_id.predict(odd, None).filter("lang_pred = 'und'").count() == odd.count()
    assert language_id.predict(empty, model).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.fit(unlabelled, F.lit(True)) is None


@pytest.mark.parametrize("fn", [lambda d: byte_bpe.round_trip(d, RANKS, PATTERN), lambda d: token_counts.count_tokens(d, BYTES, 5)])
def test_empty_tables(empty, fn):
    assert fn(empty).count() == 0


@pytest.mark.parametrize("name", ["op4_language_id", "op5_byte_bpe", "op6_token_counts", "op10_records"])
def test_queries_return_a_row_per_document(spark, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in read(spark, sf_dir, "documents").select("doc_id").collect())
