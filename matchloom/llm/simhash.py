"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint is filed under every choice of blocks that must agree if at most ``MAX_BITS`` bits differ. Below one such
key the fingerprints are sorted by Gray rank, neighbours are grouped into nodes, and a node holds the bits its members
share. Two nodes whose shared bits already differ in too many places are dropped with all they hold; the difference
grows on the way down until, at single fingerprints, it is the distance itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import TEXTS_PER_BATCH, chunks, map_arrow, stored, texts_of

SHINGLE, SEED, MAX_BITS = 4, 42, 4

#: Blocks a fingerprint is cut into, two more than the bits that may differ: any two of them can be the key.
BLOCKS = MAX_BITS + 2

#: Children of a node, and fingerprints of a leaf table row. A key with more has several leaves, compared as pairs.
FAN, LEAF = 8, 2048

_PAIRS = 20_000


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(id, fp)``: a bit is 1 if it is set in over half the XXH64 hashes of the word shingles, repeats included.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words than a shingle make one shingle; null,
    empty and blank texts have fingerprint 0. ``fp`` is the 64 bits as a signed long.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in chunks(whole, TEXTS_PER_BATCH // 5):
                fps = np.zeros(batch.num_rows, np.uint64)
                codes, sizes, rows = [], [], []
                for row, text in enumerate(texts_of(batch.column(1))):
                    words = text.encode().lower().split()
                    if not words:
                        continue
                    joined = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    starts = [0, *ends[:-1].tolist()]
                    ends = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
                    codes += [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)]
                    sizes.append(len(ends))
                    rows.append(row)
                if rows:
                    bits = np.unpackbits(np.array(codes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    n = np.array(sizes)
                    ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
                    fps[rows] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=schema.names)

    return map_arrow(docs.select(id_col, text_col), hashed, schema)


def gray_rank(fp: Column) -> Column:
    """Place of ``fp`` in the Gray code sequence, moved so that signed order is the order of places."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """Masks, as signed longs, of every choice of ``blocks - max_bits`` blocks; two fingerprints with at most
    ``max_bits`` differing bits agree on at least one of them."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places by the links ``(a, b)``."""
    low = np.arange(n)
    while len(a):
        la, lb = low[a], low[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(low, la, least)
        np.minimum.at(low, lb, least)
        while (down := low[low]).tolist() != low.tolist() if n < 64 else not np.array_equal(down := low[low], low):
            low = down
    return low


class GrayIndex:
    """Index over fingerprints in Gray order inside each key; ``key`` ascends along the array."""

    def __init__(self, fps: np.ndarray, key: np.ndarray, linked: np.ndarray):
        self.ones, self.any, self.low, self.high, self.start = [fps], [fps], [linked], [linked], []
        while True:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
            if len(first) == len(key):
                break
            start = np.flatnonzero(place % FAN == 0)
            self.start.append(np.concatenate([start, [len(key)]]))
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], start))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], start))
            self.low.append(np.minimum.reduceat(self.low[-1], start))
            self.high.append(np.maximum.reduceat(self.high[-1], start))
            key = key[start]

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of fingerprints of one key with at most ``max_bits`` differing bits, except pairs known to be linked."""
        roots = np.arange(len(self.ones[-1]))
        todo = [(len(self.start), roots[i:i + _PAIRS], roots[i:i + _PAIRS]) for i in range(0, len(roots), _PAIRS)]
        child = np.arange(FAN)
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                yield a, b
                continue
            start, level = self.start[level - 1], level - 1
            ca, cb = (start[a][:, None] + child)[:, :, None], (start[b][:, None] + child)[:, None, :]
            there = (ca < start[a + 1][:, None, None]) & (cb < start[b + 1][:, None, None])
            there &= (ca <= cb) if level else (ca < cb)
            pair, i, j = np.nonzero(there)
            a, b = start[a][pair] + i, start[b][pair] + j
            ones, any_ = self.ones[level], self.any[level]
            apart = np.bitwise_count((ones[a] & ~any_[b]) | (ones[b] & ~any_[a])) <= max_bits
            low, high = self.low[level], self.high[level]
            apart &= ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[apart], b[apart]
            todo += [(level, a[k:k + _PAIRS], b[k:k + _PAIRS]) for k in range(0, len(a), _PAIRS)]


def tree_links(fps: np.ndarray, key: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, key by key, the same fingerprints as all links do: each to the smallest place it reaches."""
    n = len(fps)
    near = np.concatenate([[False], (key[1:] == key[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= max_bits)]) if n else np.zeros(0, bool)
    run = np.cumsum(~near) - 1  # neighbours in Gray order that link form a run
    several = np.isin(key, key[1:][key[1:] == key[:-1]]) if n else near
    fp, k, r = fps[several], key[several], run[several]
    found = [*GrayIndex(fp, k, r).links(max_bits)] if len(fp) else []
    a = np.concatenate([r[x] for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([r[y] for _, y in found]) if found else np.zeros(0, np.int64)
    head = np.flatnonzero(~near)
    top = head[forest(len(head), a, b)][run] if n else run
    at = np.flatnonzero(top != np.arange(n))
    return at, top[at]


_OUT = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("choice", T.IntegerType()), T.StructField("key", T.LongType()),
                     T.StructField("first", T.LongType()), T.StructField("ones", T.LongType()), T.StructField("any", T.LongType()), T.StructField("leaf", T.BinaryType())])
_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _edges(fps: np.ndarray, at: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
    signed = fps.view(np.int64)
    n = len(at)
    rest = [pa.nulls(n, t) for t in _ARROW[2:]]
    return pa.RecordBatch.from_arrays([pa.array(signed[at], pa.int64()), pa.array(signed[top], pa.int64()), *rest], names=_OUT.names)


def _leaves(leaves: list[tuple]) -> pa.RecordBatch:
    n = len(leaves)
    columns = [*zip(*leaves, strict=True)] if n else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _ARROW[2:], strict=True))], names=_OUT.names)


def _search(max_bits: int):
    """A task's part of the filed fingerprints, in order: links inside each leaf, and the leaves whose key has others."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice, key, fp = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first_key, begun, more = None, None, True
        source = iter(batches)
        while more:
            batch = next(source, None)
            more = batch is not None
            if more:
                choice = np.concatenate([choice, batch.column(0).to_numpy()])
                key = np.concatenate([key, batch.column(1).to_numpy()])
                fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            if not len(fp):
                continue
            new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
            heads = np.flatnonzero(new)
            if first_key is None:
                first_key = (choice[0], key[0])
            # the last key may go on in the next batch: of it, only whole leaves are taken now
            last = int(heads[-1])
            end = last + (len(fp) - last) // LEAF * LEAF if more else len(fp)
            if not end:
                continue
            group = np.cumsum(new[:end]) - 1
            place = np.arange(end) - heads[group]
            leaf_new = new[:end] | (place % LEAF == 0)
            leaf = np.cumsum(leaf_new) - 1
            yield _edges(fp[:end], *tree_links(fp[:end], leaf, max_bits))
            begin = np.flatnonzero(leaf_new)
            stop = np.concatenate([begin[1:], [end]])
            size = np.diff(np.concatenate([heads, [len(fp)]]))[group[begin]]
            # a key at either end of a task may have rows in another, and one begun before has a leaf already
            shared = (size > LEAF) | (begin >= last)
            for at in (first_key, begun or first_key):
                shared |= (choice[begin] == at[0]) & (key[begin] == at[1])
            out = []
            for s, t in zip(begin[shared].tolist(), stop[shared].tolist(), strict=True):
                part = fp[s:t]
                ones, any_ = np.bitwise_and.reduce(part), np.bitwise_or.reduce(part)
                out.append((int(choice[s]), int(key[s]), int(part[:1].view(np.int64)[0]), int(ones.astype(np.int64)), int(any_.astype(np.int64)), part.tobytes()))
            yield _leaves(out)
            begun = (choice[end - 1], key[end - 1])
            choice, key, fp = choice[end:], key[end:], fp[end:]

    return searched


def _across(max_bits: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                fps = np.concatenate([np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)])
                at, top = tree_links(fps, np.zeros(len(fps), np.int64), max_bits)
                signed = fps.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[at], pa.int64()), pa.array(signed[top], pa.int64())], names=["a", "b"])

    return searched


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``(a, b)``: pairs of distinct fingerprints with at most ``max_bits`` differing bits that connect just what all such
    pairs connect. ``fps(fp)`` holds each fingerprint once.

    Rows are dealt by ranges of (key, Gray rank), so a key with many fingerprints is spread over tasks; its leaves meet
    in a join of their headers, where the shared bits decide which pairs of leaves are opened.
    """
    filed = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                for i, m in enumerate(block_masks(blocks, max_bits))])).alias("at")
    rows = fps.select("fp", filed).select("at.choice", "at.key", "fp", gray_rank(F.col("fp")).alias("rank"))
    ordered = rows.repartitionByRange("choice", "key", "rank").sortWithinPartitions("choice", "key", "rank").select("choice", "key", "fp")
    found = stored(map_arrow(ordered, _search(max_bits), _OUT), "gray-index")
    near = found.filter("a is not null").select("a", "b")

    leaves = found.filter("leaf is not null").drop("a", "b")
    header = leaves.drop("leaf")
    other = header.select("choice", "key", *[F.col(c).alias(f"{c}2") for c in ("first", "ones", "any")])
    one_zero = F.col("ones").bitwiseAND(F.bitwise_not("any2"))
    zero_one = F.col("ones2").bitwiseAND(F.bitwise_not("any"))
    pairs = header.join(other, ["choice", "key"]).filter("first < first2").filter(F.bit_count(one_zero.bitwiseOR(zero_one)) <= max_bits)
    left = leaves.select("choice", "key", "first", F.col("leaf").alias("x"))
    right = leaves.select("choice", "key", F.col("first").alias("first2"), F.col("leaf").alias("y"))
    opened = pairs.select("choice", "key", "first", "first2").join(left, ["choice", "key", "first"]).join(right, ["choice", "key", "first2"])
    return near.unionByName(map_arrow(opened.select("x", "y"), _across(max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``fp``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    reachable over links.

    Equal fingerprints are one node, so copies are never paired. Null ids belong to components like others and are
    never their name, unless a component has no other. Repeated rows stay repeated; an empty table gives an empty one;
    other columns are not read.
    """
    marks = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(marks.groupBy("fp").agg(F.min(id_col).alias("_first")), "distinct-fingerprints")
    joined = components(links(nodes.select("fp"), max_bits), name="simhash")
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "_first", F.coalesce("component", "fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    by_fp = stored(named.select("fp", "_root").join(least, "_root").select("fp", "component_id"), "simhash-groups")
    return marks.join(by_fp, "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without documents that are not the first, by id, of their component.

    Repeated rows of a first document all stay, and so do rows with a null id, which no component is named by. All
    columns stay.
    """
    groups = near_duplicates(docs, id_col, text_col, max_bits)
    later = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_later"))
    first = groups.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_later"))
    # an id that is the first of one component and not of another, as its rows differ, stays
    return docs.join(later.distinct().join(first.distinct(), "_later", "left_anti"), docs[id_col] == F.col("_later"), "left_anti")
