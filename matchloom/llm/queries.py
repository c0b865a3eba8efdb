"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from . import byte_bpe, cross_polytope, decontamination, language_id, line_dedup, periodic_runs, perspectives, records, simhash, suffix_dedup, token_counts, url_templates, whitening
from .shared import read


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
    WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
  reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS low FROM reached GROUP BY a) USING (vec_id)
  LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives.rotate(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "speaker", "first_turn", "n_turns", "text", spans.alias("spans"))


_NEUTRAL = "replace(replace({}, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')"

OP2_SQL = f"""
WITH turns AS (SELECT conv_id, turn, role, {_NEUTRAL.format("coalesce(text, '')")} AS text, translate({_NEUTRAL.format("role")}, chr(13) || chr(10), '  ') AS name FROM conversations),
  speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
  heads AS (SELECT t.*, speaker, '<|im_start|>' || CASE WHEN role IS NULL THEN 'user' WHEN role = speaker THEN 'assistant'
      WHEN role = 'system' THEN role ELSE 'user name=' || name END || chr(10) AS head
    FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
  placed AS (SELECT *, CAST(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role NULLS FIRST, text
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM heads)
SELECT conv_id, speaker, min(turn) AS first_turn, count(*) AS n_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY stop) AS text,
  coalesce(string_agg((stop - 11 - length(text)) || '-' || (stop - 1), ',' ORDER BY stop) FILTER (WHERE role = speaker), '') AS spans
FROM placed GROUP BY conv_id, speaker
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.report(decontamination.find_hits(docs, read(spark, sf_dir, "benchmark")))


_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP3_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
    WHERE item_id IS NOT NULL AND len(w) > 0),
  grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
  docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
  runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM items))),
  hits AS (SELECT doc_id, n, i, item FROM runs JOIN grams USING (n, g)),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
  named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, language_id.learnable())
    held_out = F.coalesce(~language_id.learnable(), F.lit(False))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: The rules of the query.
RULES = [url_templates.Rule("org", "/", "allow"), url_templates.Rule("example.org", "/es/", "block"), url_templates.Rule("example.org", "/en/1", "block"),
         url_templates.Rule("com", "/fr/", "allow"), url_templates.Rule("com", "/de/", "block")]


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id its path names; it is known to be bad if that document is labelled toxic or poor."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long").alias("_doc"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_templates.judge(pages.join(labels, pages["_doc"] == labels["doc_id"], "left").select("page_id", "url", "bad"), RULES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    index = records.write_records(read(spark, sf_dir, "documents"), scratch_dir(spark, "records"), tokenizer, end_id=1)
    out = records.record_checksums(records.with_starts(index), tokenizer)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=8)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  starts AS (SELECT doc_id, i, sha256(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM docs)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM starts) WHERE c > 1),
  marked AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400 AS gap FROM again),
  runs AS (SELECT doc_id, min(i) AS low, max(i) + 400 AS high FROM (SELECT doc_id, i, count_if(coalesce(gap, false)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
  cuts AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, list(low ORDER BY low) || [2147483647] AS lows, [1] || list(high ORDER BY low) AS highs FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN hex(b) ELSE list_aggregate(list_transform(list_zip(highs, lows), lambda p: hex(b[p[1]:least(p[2], n + 1) - 1])), 'string_agg', '') END)) AS kept_sha256
FROM docs LEFT JOIN cuts USING (doc_id)
"""


def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose hash ends in 0 repeat a stretch of their words from some place to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).cast("long").alias("_g"))
    words = F.when(F.col("_h") % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    docs = docs.withColumn("_w", words).withColumn("_n", F.size("_w").cast("long"))
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.greatest("_n", F.lit(1))))
    docs = docs.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    a, p, rest = F.col("_a").cast("int"), F.col("_p").cast("int"), (F.col("_n") - F.col("_a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    return docs.select("doc_id", F.when(F.col("_a").isNull(), F.col("text")).otherwise(F.concat_ws(" ", F.slice("_w", F.lit(1), a), tail)).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(planted_runs(read(spark, sf_dir, "documents")))
    best = F.col("best_run")
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                      F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup, "op2_perspectives": op2_perspectives, "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id, "op5_byte_bpe": op5_byte_bpe, "op6_token_counts": op6_token_counts, "op7_line_dedup": op7_line_dedup,
    "op8_url_templates": op8_url_templates, "op9_simhash": op9_simhash, "op10_records": op10_records, "op11_whitening": op11_whitening, "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op2_perspectives": OP2_SQL, "op3_decontamination": OP3_SQL, "op12_suffix_dedup": OP12_SQL}
