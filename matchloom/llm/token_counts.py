"""Token counts by byte-pair merging with a heap over a linked list of symbols; no token ids are emitted."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import WHITE
from .shared import TEXTS_PER_BATCH, chunks, texts_of

#: Fixed value: the split pattern that the byte-level pre-tokenizer applies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A stretch of white space with the visible text behind it. No token reaches from one stretch into the next.
STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: Counts kept per worker process, and the longest stretch that is kept; a full store starts anew.
KEPT, KEPT_CHARS = 600_000, 48

_POS, _NONE = (1 << 32) - 1, (1 << 24) - 1


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Counter:
    """Counts of one vocabulary file of the tokenizers library, of the byte-level BPE kind."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        added = spec.get("added_tokens", [])
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges") or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.bytes = [vocab[s] for s in byte_symbols()]
        # pair of symbols -> its rank and the symbol they become; both are packed into integers
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[left] << 32 | vocab[right], rank << 24 | vocab[left + right])
        self.split = regex.compile(PATTERN).findall
        # special strings inside a text are one token each, the longest first where several fit
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.kept = _Kept(self)

    def merged(self, word: bytes) -> int:
        """Symbols left of ``word`` when the lowest-rank adjacent pair, the leftmost of equals, is merged until none is."""
        n = len(word)
        if n < 2:
            return n
        found, pop, push = self.pairs.get, heappop, heappush
        ids = [*map(self.bytes.__getitem__, word)]
        # an entry is the pair's rank and result, then the place of its left symbol
        heap = [m << 32 | i for i, (x, y) in enumerate(zip(ids, ids[1:])) if (m := found(x << 32 | y)) is not None]
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ids.append(_NONE)  # behind the last symbol: a symbol that pairs with nothing
        left = n
        while heap:
            top = pop(heap)
            i, m = top & _POS, top >> 32
            j = after[i]
            if found(ids[i] << 32 | ids[j]) != m:
                continue  # one of the two has been merged since
            left -= 1
            ids[i] = x = m & _NONE
            ids[j] = _NONE
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := found(x << 32 | ids[k])) is not None:
                    push(heap, m << 32 | i)
            h = before[i]
            if h >= 0 and (m := found(ids[h] << 32 | x)) is not None:
                push(heap, m << 32 | h)
        return left

    def stretch(self, text: str) -> int:
        if self.special and (hit := self.special.search(text)):
            return self.stretch(text[:hit.start()]) + 1 + self.stretch(text[hit.end():])
        return sum(self.merged(word.encode()) for word in self.split(text))

    def count(self, text: str) -> int:
        return sum(map(self.kept.__getitem__, STRETCH.findall(text)))


class _Kept(dict):
    """Counts of stretches seen before; bounded, so a worker's memory is."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, stretch: str) -> int:
        n = self.counter.stretch(stretch)
        if len(stretch) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[stretch] = n
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    The count is initial symbols minus merges, over whole texts. Null and empty texts have none. Repeated rows stay
    repeated, an empty table gives an empty one, other columns are not read. There is no shuffle.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for whole in batches:
            for batch in chunks(whole, TEXTS_PER_BATCH):
                texts = texts_of(batch.column(1))
                n = [count(x) for x in texts]
                size = [len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                                                  pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(counted, schema)
