"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import stored, whole_groups
from .simhash import forest

COSINE = 0.9

#: Tables, rotations whose vertices name a bucket of a table, buckets a vector looks into, and the seed of the signs.
TABLES, ROTATIONS, PROBES, SEED = 10, 2, 4, 7

#: Rows of a bucket that meet in one cell; a fuller bucket is cut into blocks, and each pair of blocks is a cell.
BLOCK = 512

_PAIRS = 200_000

#: What a cell is named by: table, bucket and, of a full bucket, its pair of blocks.
CELL = ["table", "bucket", "i", "j"]


class Hasher:
    """Buckets of unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES, seed: int = SEED):
        self.tables, self.rotations, self.probes = tables, rotations, probes
        self.width = max(4, 1 << (dim - 1).bit_length())
        self.signs = np.random.default_rng((seed, dim)).choice([-1.0, 1.0], (3, tables * rotations, self.width))
        self.near = min(probes, self.width)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        """Three rounds of random signs and a fast Hadamard transform: (vectors, rotations, width)."""
        y = np.zeros((len(x), self.signs.shape[1], self.width))
        y[:, :, :x.shape[1]] = x[:, None, :]
        for signs in self.signs:
            y *= signs
            half = 1
            while half < self.width:
                z = y.reshape(len(x), self.signs.shape[1], -1, 2, half)
                y = np.stack([z[..., 0, :] + z[..., 1, :], z[..., 0, :] - z[..., 1, :]], axis=-2).reshape(y.shape)
                half *= 2
            y /= np.sqrt(self.width)
        return y

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, probes): the own bucket first, then those with the least loss of projection."""
        y = self.rotated(x)
        size = np.abs(y)
        best = np.argsort(-size, axis=2, kind="stable")[:, :, :self.near]
        value = np.take_along_axis(size, best, 2)
        vertex = best + self.width * (np.take_along_axis(y, best, 2) < 0)
        loss = (value[:, :, :1] - value) ** 2
        shape = (len(x), self.tables, self.rotations, self.near)
        vertex, loss = vertex.reshape(shape), loss.reshape(shape)
        cost, code = 0.0, 0
        for r, ranks in enumerate(np.array([*product(range(self.near), repeat=self.rotations)]).T):
            cost = cost + loss[:, :, r, :][:, :, ranks]
            code = code * (2 * self.width) + vertex[:, :, r, :][:, :, ranks]
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :self.probes]
        return np.take_along_axis(code, order, 2)


@functools.lru_cache(maxsize=16)
def hasher(dim: int, tables: int, rotations: int, probes: int, seed: int) -> Hasher:
    return Hasher(dim, tables, rotations, probes, seed)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packing(vectors: DataFrame, vec_col: str) -> str:
    """How the components are packed: as they come, floats in half the bytes of doubles."""
    return "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"


def directions(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, mark, vector)``: packed components of each vector that can link, and a 128-bit mark of them. ``mark`` and
    ``vector`` are null for a null id, and for vectors that are null, empty, zero or hold null or non-finite components.
    Components stay floats if they are floats; doubles are divided by the largest, so that squares neither vanish nor
    overflow."""
    form = packing(vectors, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, raw = [], []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = None
                if key is not None and x.is_valid and len(x) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False) + 0  # no negative zeros
                    scale = np.abs(v).max()
                    usable = np.isfinite(scale) and scale > 0
                    v = None if not usable else v.astype(form) if form == "<f4" else (v / scale).astype(form)
                raw.append(None if v is None else v.tobytes())
                marks.append(None if v is None else hashlib.blake2b(raw[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(raw, pa.binary())], names=[id_col, "mark", "vector"])

    return vectors.select(id_col, vec_col).mapInArrow(packed, f"`{id_col}` {kind}, mark binary, vector binary")


def _filed(conf: tuple[int, int, int, int], kind: str):
    """A row for each bucket of a distinct vector; ``own`` tells its own bucket of a table from those it looks into."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                raw = batch.column(2).to_pylist()
                size = np.array([len(x) // int(kind[-1]) for x in raw])
                for dim in np.unique(size):
                    rows = np.flatnonzero(size == dim)
                    at = hasher(int(dim), *conf).buckets(_unit([raw[i] for i in rows], kind))
                    n, tables, probes = at.shape
                    of = np.repeat(rows, tables * probes)
                    # buckets of vectors of different dimensions stay apart
                    table = np.tile(np.repeat(np.arange(tables), probes), n) + tables * int(dim)
                    picked = batch.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(table, pa.int64()), pa.array(at.ravel(), pa.int64()), pa.array(np.tile(np.arange(probes) == 0, n * tables), pa.bool_()), *picked.columns],
                        names=["table", "bucket", "own", "node", "copies", "vector"])

    return filed


class Cell:
    """Pairs of one cell: rows of a bucket, or of two of its blocks (``side`` 0 and 1)."""

    def __init__(self, conf: tuple[int, int, int, int], cosine: float):
        self.conf, self.cosine = conf, cosine

    def close(self, x: np.ndarray, own: np.ndarray, side: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs with at least the wanted cosine of which one has this bucket as its own. ``one``: the cell is a
        block with itself."""
        s = np.flatnonzero(side == 0)
        t = s if one else np.flatnonzero(side == 1)
        near = x[s] @ x[t].T >= self.cosine
        near &= own[s][:, None] | own[t][None, :]
        a, b = np.nonzero(near)
        a, b = s[a], t[b]
        once = a < b if t is s else a != b
        return a[once], b[once]

    def first_here(self, table: int, node: np.ndarray, x: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether this cell is the first, by table, where a pair meets. Two vectors of different own buckets may meet in
        both of them; then the pair counts where the one with the smaller node looks in."""
        used = np.unique(np.concatenate([a, b]))
        place = np.zeros(len(x), np.int64)
        place[used] = np.arange(len(used))
        at = hasher(x.shape[1], *self.conf).buckets(x[used])
        here = np.zeros(len(a), bool)
        for k in range(0, len(a), _PAIRS):
            p, q = a[k:k + _PAIRS], b[k:k + _PAIRS]
            ap, aq = at[place[p]], at[place[q]]
            q_sees, p_sees = (ap[:, :, :1] == aq).any(2), (aq[:, :, :1] == ap).any(2)
            first = np.argmax(q_sees | p_sees, axis=1) == table
            both = q_sees[:, table] & p_sees[:, table] & ~(own[p] & own[q])
            looks = np.where(own[p], node[q], node[p])  # the one that only looks in
            here[k:k + _PAIRS] = first & (~both | (looks == np.minimum(node[p], node[q])))
        return here


def _meet(conf: tuple[int, int, int, int], cosine: float, kind: str):
    """Per cell and vector: links first met there, counted with copies, and the smallest node they lead to."""
    cell = Cell(conf, cosine)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edge in whole_groups(batches, CELL):
            table, i, j, node, copies, side = (part.column(c).to_numpy() for c in ("table", "i", "j", "node", "copies", "side"))
            own = part.column("own").to_numpy()
            nodes, counts, tops = [], [], []
            for s, t in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if t - s < 2 or not own[s:t].any():
                    continue
                x = _unit(part.column("vector").slice(s, t - s).to_pylist(), kind)
                a, b = cell.close(x, own[s:t], side[s:t], i[s] == j[s])
                if not len(a):
                    continue
                here = cell.first_here(int(table[s]) % conf[0], node[s:t], x, own[s:t], a, b)
                a, b = a[here], b[here]
                n = np.zeros(t - s, np.int64)
                np.add.at(n, a, copies[s:t][b])
                np.add.at(n, b, copies[s:t][a])
                found = np.flatnonzero(n)
                nodes.append(node[s:t][found])
                counts.append(n[found])
                tops.append(node[s:t][forest(t - s, a, b)][found])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (nodes, counts, tops)], names=["node", "n", "top"])

    return met


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, tables: int = TABLES,
                    rotations: int = ROTATIONS, probes: int = PROBES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other rows linked directly), ``component_id``, ``kept``.

    Equal vectors are collapsed first and count by their copies. A distinct vector is filed in its own bucket of each
    table and in those its next-best vertices name; pairs of a bucket are verified by cosine in double precision and
    counted in the first table where they meet, so no pair is emitted, and only links to the smallest reachable node
    leave a cell. A bucket with more than ``block`` rows is cut into blocks by a hash of the node and spread over the
    cells of all pairs of blocks, so no task holds a whole hot bucket.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with
    nothing: 0 links, their own component. Vectors of different length never link. Repeated rows are rows of their
    own. An empty table gives an empty one; other columns are not read.
    """
    conf, kind = (tables, rotations, probes, seed), packing(vectors, vec_col)
    known = stored(directions(vectors, id_col, vec_col), "directions")
    distinct = known.filter("mark is not null").groupBy("mark").agg(F.min(F.col(id_col).cast("long")).alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    distinct = stored(distinct, "distinct-vectors")
    filed = distinct.select("node", "copies", "vector").mapInArrow(_filed(conf, kind), "table long, bucket long, own boolean, node long, copies long, vector binary")
    full = filed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    full = full.select("table", "bucket", F.ceil(F.col("_n") / block).cast("long").alias("_blocks"))
    dealt = filed.join(full, ["table", "bucket"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    cells = dealt.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    i, j = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    cells = cells.select("table", "bucket", i.alias("i"), j.alias("j"), F.when(i == F.col("_mine"), 0).otherwise(1).alias("side"), "own", "node", "copies", "vector")
    met = stored(cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_meet(conf, cosine, kind), "node long, n long, top long"), "links")
    counts = met.groupBy("node").agg(F.sum("n").alias("_n"))
    joined = components(met.select(F.col("node").alias("a"), F.col("top").alias("b")), name="vectors")
    by_mark = distinct.select("mark", "node", "copies").join(counts, "node", "left").join(joined, "node", "left")
    by_mark = by_mark.select("mark", (F.col("copies") - 1 + F.coalesce("_n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    key = F.col(id_col).cast("long")
    out = known.drop("vector").join(by_mark, "mark", "left")
    component = F.coalesce("component_id", key)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == key, F.lit(True)).alias("kept"))
