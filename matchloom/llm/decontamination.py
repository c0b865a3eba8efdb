"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, matched against token windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TEXTS_PER_BATCH, chunks, map_arrow, stored, texts_of

#: Words of a window.
WINDOW = 10

#: What one broadcast set may hold. More windows than that are dealt over several sets, one pass over the texts each.
SET_WINDOWS, SET_BYTES = 500_000, 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII by byte: letters in lower case, digits as they are, anything else a blank; other bytes belong to words.
_CLEAN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_WORD_AT = re.compile(rb"[0-9a-z\x80-\xff]+")

ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([
    T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])))])


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8, A-Z in lower case."""
    return text.encode().translate(_CLEAN).split()


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(window, words, items)``: every distinct run of ``size`` words of an item, or its whole text if that is shorter,
    and the ids of its items as sorted strings. Items without words, or with a null id, have none."""
    w = F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), w.alias("w")).filter("item is not null and size(w) > 0")
    n = F.least(F.size("w"), F.lit(size))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i")
    runs = items.select("item", "w", n.alias("words"), starts)
    named = runs.select("item", "words", F.array_join(F.slice("w", F.col("i"), F.col("words")), " ").alias("window"))
    return named.groupBy("window", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WindowSet:
    """Hashes of windows by their number of words, the windows themselves to verify a hit, and their vocabulary."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        split = [(w.encode().split(b" "), items) for w, items in rows]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for words, _ in split for w in words}), 1)}
        self.items: dict[bytes, list[str]] = {}
        ids: dict[int, list[np.ndarray]] = {}
        for words, items in split:
            key = np.array([self.vocabulary[w] for w in words], np.uint32)
            self.items[key.tobytes()] = items
            ids.setdefault(len(words), []).append(key)
        self.hashes = {n: np.unique(self.hashed(np.stack(keys), np.zeros(len(keys), np.int64)[:, None] + np.arange(n), rows=True)) for n, keys in ids.items()}

    @staticmethod
    def hashed(ids: np.ndarray, at: np.ndarray, rows: bool = False) -> np.ndarray:
        """Polynomial hash of the ids at the places of each row of ``at``."""
        out = np.zeros(len(at), np.uint64)
        for k in range(at.shape[1]):
            out = (out + (ids[:, k] if rows else ids[at[:, k]]).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def find(self, texts: list[str]) -> tuple[list[int], list[list[tuple[int, int, list[str]]]]]:
        """Word counts, and per text the verified hits ``(first word, words, items)`` in order."""
        cut = [words_of(x) for x in texts]
        get, sizes = self.vocabulary.get, [len(x) for x in cut]
        # one array for all texts; 0 stands between texts and for words of no window, so no hit reaches over it
        starts = np.cumsum([0, *(n + 1 for n in sizes)])
        ids = np.zeros(int(starts[-1]), np.uint32)
        for at, words in zip(starts, cut, strict=False):
            ids[at:at + len(words)] = [*map(get, words, repeat(0))]
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        found: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            first = np.flatnonzero(gaps[n:] == gaps[:-n])
            code = self.hashed(ids, first[:, None] + np.arange(n))
            place = np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)
            first = first[hashes[place] == code]
            for i, t in zip(first.tolist(), (np.searchsorted(starts, first, side="right") - 1).tolist(), strict=True):
                items = self.items.get(ids[i:i + n].tobytes())
                if items is not None:
                    found[t].append((i - int(starts[t]), n, items))
        return sizes, [sorted(x, key=lambda h: h[:2]) for x in found]


def window_sets(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[WindowSet]:
    """All windows in sets of bounded size, by a hash of the window; one row of totals decides how many there are."""
    all_windows = stored(windows(benchmark, id_col, text_col, size), "windows")
    cost = F.length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x)) + 100
    n, total = all_windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(cost), F.lit(0))).first()
    parts = max(1, -(-n // SET_WINDOWS), -(-total // SET_BYTES))
    for part in range(parts):
        mine = all_windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        yield WindowSet([(r["window"], r["items"]) for r in mine.select("window", "items").toLocalIterator()])


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with ``_found``: its number of words and its hits ``(first word, words, items)``, each verified word by word.

    Whole texts are scanned in one pass without a shuffle. Null and empty texts have no words. An empty benchmark gives
    no hits. Repeated rows are scanned one by one; other columns stay, but a column named ``_found`` is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("_found")
    fields = T.StructType([*docs.schema.fields, T.StructField("_found", ADDED)])
    out = docs
    for turn, part in enumerate(window_sets(benchmark, item_col, item_text, size)):
        shared = spark.sparkContext.broadcast(part)
        if turn:  # beyond one set: what the earlier passes found is kept in a table
            out = stored(out, "hits")

        def scanned(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            added = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("items", pa.list_(pa.string()))])))])
            for whole in batches:
                for batch in chunks(whole, TEXTS_PER_BATCH):
                    at = batch.schema.get_field_index(text_col)
                    n, hits = shared.value.find(texts_of(batch.column(at)))
                    rows = [{"n_words": a, "hits": [{"first": f, "words": w, "items": i} for f, w, i in b]} for a, b in zip(n, hits, strict=True)]
                    if turn:
                        for row, old in zip(rows, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                            row["hits"] = old["hits"] + row["hits"]
                    kept = [c for i, c in enumerate(batch.columns) if not turn or i < batch.num_columns - 1]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, added)], names=fields.names)

        out = map_arrow(out, scanned, fields)
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of :func:`find_hits`: id, ``n_words``, ``n_hit`` (words inside any hit), ``n_items``, ``items_sha256``,
    ``contaminated``."""
    covered = F.flatten(F.transform("_found.hits", lambda h: F.sequence(h["first"], h["first"] + h["words"] - 1)))
    items = F.array_sort(F.array_distinct(F.flatten("_found.hits.items")))
    n_hit = F.size(F.array_distinct(covered)).cast("long")
    return found.select(id_col, F.col("_found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_documents(found: DataFrame, least_share: float = 0.0) -> DataFrame:
    """Rows whose share of hit words is at most ``least_share``; with 0, all without a hit."""
    covered = F.flatten(F.transform("_found.hits", lambda h: F.sequence(h["first"], h["first"] + h["words"] - 1)))
    share = F.coalesce(F.try_divide(F.size(F.array_distinct(covered)), F.col("_found.n_words")), F.lit(0.0))
    return found.filter(share <= least_share).drop("_found")


def cut_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows, without the stretches of text from the first to the last word of each hit."""
    kinds = T.StringType()

    @F.arrow_udf(kinds)
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, found_here in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            if text is None or not found_here:
                out.append(text)
                continue
            raw, covered = text.encode(), set()
            for h in found_here:
                covered.update(range(h["first"], h["first"] + h["words"]))
            kept, at, last = [], 0, -2
            for i, word in enumerate(_WORD_AT.finditer(raw.translate(_CLEAN))):
                if i in covered:
                    if i != last + 1:
                        kept.append(raw[at:word.start()])
                    at, last = word.end(), i
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    return found.withColumn(text_col, cut(F.col(text_col), F.col("_found.hits"))).drop("_found")
