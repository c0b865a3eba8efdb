"""Length-delimited binary records of token ids with masked checksums, and a separate offset index.

A record is its length (8 bytes), the masked CRC-32C of those 8 bytes, the data, and the masked CRC-32C of the data,
all little-endian: the framing that common record readers know. The data are the ids of one document, 2 bytes each if
the vocabulary has at most 65,536 ids, else 4.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import WHITE
from .crc32c import masked
from .shared import TEXTS_PER_BATCH, chunks, sized

HEAD, TAIL = 12, 4

#: Words and stretches whose ids are kept per worker process, and the longest that is kept; a full store starts anew
#: with what the texts at hand share with it.
KEPT, KEPT_CHARS = 800_000, 48

#: Visible text, cut where a sign follows Latin letters: letters and signs never share a token. U+00D7 and U+00F7 are
#: signs, and U+0130 in lower case ends in one.
STRETCH = re.compile(f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+(?=[.,;:!?])|[^{WHITE}]+")

#: Bytes of texts encoded at once.
BYTES_AT_ONCE = 8 << 20

VISIBLE = re.compile(f"[^{WHITE}]+")

INDEX_SCHEMA = "shard long, file string, start_in_shard long, offset long, n_bytes long, n_tokens long"


def id_type(n_ids: int) -> np.dtype:
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


class Encoder:
    """The tokenizers library over whole texts, with the ids of words and of their stretches kept.

    It is for vocabularies that drop white space, keep letters and signs apart and lower-case (this is verified). No
    token, normal form or pattern of theirs reaches from one stretch into the next, so the library encodes each
    stretch once; a word's ids are those of its stretches, put together once and looked up afterwards.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        pattern = split.get("pattern", {}).get("Regex", "")
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        added = spec.get("added_tokens", [])
        if split.get("behavior") != "Removed" or not split.get("invert") or "[^\\s\\p{L}\\p{N}]+" not in pattern or "Lowercase" not in steps \
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path} is not a vocabulary that drops white space, splits at signs and lower-cases")
        self.special = [t["content"].lower() for t in added]
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.dtype = id_type(self.library.get_vocab_size(with_added_tokens=True))
        self.kept: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> set[str]:
        """Keep the ids of words that are not kept yet; returns those, and stretches, that are too long to stay."""
        kept = self.kept
        fresh = {x: STRETCH.findall(x) for x in words if x not in kept}
        new = [*set().union(*fresh.values()).difference(kept)]
        found = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        ends = list(accumulate(map(len, found), initial=0))
        packed, width = np.fromiter(chain.from_iterable(found), self.dtype, ends[-1]).tobytes(), self.dtype.itemsize
        kept.update((x, packed[a * width:b * width]) for x, (a, b) in zip(new, pairwise(ends), strict=True))
        kept.update((x, b"".join(map(kept.__getitem__, parts))) for x, parts in fresh.items() if len(parts) != 1)
        return {x for x in chain(fresh, new) if len(x) > KEPT_CHARS}

    def _lowered(self, word: str) -> str:
        """Lower case is what the library would do first; not where it could make a special string."""
        low = word.lower() if word.isascii() else word
        return word if "<" in low and any(x in low for x in self.special) else low

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text, without special tokens of a template; null is the empty text.

        Arrow cuts the texts into words, numbers the different ones and puts the ids of words together; Python sees
        each different word of the texts once.
        """
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            # these four split Arrow's texts, but are not white space to the library
            cut = pa.array([VISIBLE.findall(x) for x in texts.to_pylist()], pa.list_(pa.string()))
        else:
            cut = pc.utf8_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        different = [*map(self._lowered, words.dictionary.to_numpy(zero_copy_only=False).tolist())]
        if len(self.kept) > KEPT:  # what these texts hold too stays
            self.kept = {x: self.kept[x] for x in different if x in self.kept}
        long = self._learn(different)
        ids = pa.array([self.kept[x] for x in different], pa.large_binary()).take(words.indices)
        for x in long:
            del self.kept[x]
        at = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False))])
        bounds = cut.offsets.to_numpy()
        ends = at[bounds - bounds[0]].astype(np.int64).tolist() if len(cut) else [0]
        data = (ids.buffers()[2] or b"") if len(ids) else b""  # the ids of all words, one after another
        return [bytes(memoryview(data)[a:b]) for a, b in pairwise(ends)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def frame(items: list[bytes]) -> Iterator[bytes]:
    """Framed records."""
    lengths = [struct.pack("<Q", len(x)) for x in items]
    for length, a, x, b in zip(lengths, masked(lengths).tolist(), items, masked(items).tolist(), strict=True):
        yield b"".join((length, struct.pack("<I", a), x, struct.pack("<I", b)))


def unframe(found: list[bytes]) -> list[bytes]:
    """Data of whole framed records; a wrong length or checksum raises."""
    heads, data = [x[:8] for x in found], [x[HEAD:-TAIL] for x in found]
    sums = [*map(masked, (heads, data))]
    for x, head, item, a, b in zip(found, heads, data, sums[0].tolist(), sums[1].tolist(), strict=True):
        if struct.unpack("<QI", x[:HEAD]) != (len(item), a) or struct.unpack("<I", x[-TAIL:])[0] != b:
            raise ValueError("a record does not match its checksums")
    return data


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` in ascending ``id_col`` order into ``folder`` and return the offset index read from there.

    A range exchange on (id, hash of the text) gives each task a run of ids; null ids come first, and rows of
    one id follow the hash of their text, then the text, so a task that is run again writes the same. A task streams its
    rows into one shard file of its own name and returns one index row per record, which Spark commits as Parquet in
    ``folder/index`` once per task. A task that is run again writes another file, and only the files of committed
    tasks are in the index. The index has ``id_col, shard, file, start_in_shard, offset, n_bytes, n_tokens``; shards
    ascend with the ids. ``end_id`` is appended to every record. Null and empty texts give a record of only that id;
    repeated rows each give one; an empty table gives an empty index. Other columns are not read.
    """
    spark = docs.sparkSession
    data = f"{folder}/data"
    kind = docs.schema[id_col].dataType.simpleString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, enc = task.partitionId(), encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        sink, file = None, f"{data}/shard-{shard:06d}-{task.taskAttemptId()}.rec"
        offset = before = 0
        for whole in batches:
            for batch in sized(whole, 1, BYTES_AT_ONCE):
                if sink is None:
                    target, path = _opened(file)
                    target.create_dir(os.path.dirname(path), recursive=True)
                    sink = target.open_output_stream(path)
                items = [x + end for x in enc.encode(batch.column(1))]
                sizes = np.array([len(x) for x in items], np.int64)
                for record in frame(items):
                    sink.write(record)
                ids = sizes // enc.dtype.itemsize
                offsets, starts = offset + np.cumsum(sizes + HEAD + TAIL) - sizes - HEAD - TAIL, before + np.cumsum(ids) - ids
                offset, before = offset + int(sizes.sum()) + len(sizes) * (HEAD + TAIL), before + int(ids.sum())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, shard), pa.int64()), pa.array([file] * n, pa.string()), pa.array(starts, pa.int64()),
                     pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())],
                    names=[id_col, "shard", "file", "start_in_shard", "offset", "n_bytes", "n_tokens"])
        if sink is not None:
            sink.close()

    order = [F.col(id_col).asc(), F.xxhash64(text_col).asc(), F.col(text_col).asc()]
    ordered = docs.select(id_col, text_col).repartitionByRange(*order[:2])
    index = ordered.sortWithinPartitions(*order).mapInArrow(written, f"`{id_col}` {kind}, {INDEX_SCHEMA}")
    index.write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``index``, all or any of them in any order, with ``ids``, the packed ids of the record each points at.

    Every task opens the files its rows name and reads just those records; lengths and checksums are verified.
    """
    return _per_record(index, tokenizer, "ids binary", lambda data, dtype: [pa.array(data, pa.binary())])


def record_checksums(index: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``index`` with ``ids_crc32``: CRC-32 of the record's ids as little-endian unsigned 32-bit integers."""

    def sums(data: list[bytes], dtype: np.dtype) -> list[pa.Array]:
        return [pa.array([zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in data], pa.int64())]

    return _per_record(index, tokenizer, "ids_crc32 long", sums)


def _per_record(index: DataFrame, tokenizer: str, more: str, made) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    at = {name: index.columns.index(name) for name in ("file", "offset", "n_bytes")}
    names = [*index.columns, more.split()[0]]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, now, source = encoder(tokenizer).dtype, None, None
        for whole in batches:
            for batch in chunks(whole, TEXTS_PER_BATCH):
                raw = []
                for file, offset, size in zip(*(batch.column(at[c]).to_pylist() for c in ("file", "offset", "n_bytes")), strict=True):
                    if file != now:
                        store, path = _opened(file)
                        now, source = file, store.open_input_file(path)
                    source.seek(offset)
                    raw.append(source.read(size + HEAD + TAIL))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made(unframe(raw), dtype)], names=names)

    return index.mapInArrow(found, f"{fields}, {more}")


def with_starts(index: DataFrame, start: str = "start") -> DataFrame:
    """Index rows with the number of ids in all records before: the place in its shard plus what earlier shards hold.

    Shards are summed first, so what is numbered in one place is one row per shard, never one per document.
    """
    from pyspark.sql import Window

    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_all"))
    earlier = F.coalesce(F.sum("_all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", earlier.alias("_base"))
    return index.join(bases, "shard").withColumn(start, F.col("_base") + F.col("start_in_shard")).drop("_base")
