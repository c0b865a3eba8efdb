"""Fuzzy line dedup by MinHash: character shingles, high-recall banding, Jaccard over 64-bit hashes, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import may_hold, members
from .components import components
from .shared import chunks, map_arrow, stored, texts_of, whole_groups

#: Characters of a shingle, and the Jaccard similarity of the sets of shingles from which two lines are the same.
SHINGLE, SIMILARITY = 7, 0.8

#: Bands and rows of a band: lines of similarity 0.8 share a band with probability 1 - (1 - 0.8^4)^12 = 0.998.
BANDS, ROWS = 12, 4

#: Hashes of each shingle. All fall into the same bins, so that lines fill more of them.
REPEATS = 2

#: Different shingles below which a line would leave bins empty and its bands depend on each other, so that pairs are
#: lost: it gets a hash function for each row of each band. Lines it may be similar to get those as well.
SHORT = 64

#: Further bands of lines in buckets that hold several components after their first check: with the others, a pair of
#: these at similarity 0.8 shares none with probability (1 - 0.8^4)^36 = 6e-9.
MORE_BANDS = 24

#: Lines of a bucket, or with a rare shingle in common, that meet in one cell. Of a fuller bucket, lines meet by their rare
#: shingles; lines with a rare shingle in common are cut into blocks, and each pair of blocks is a cell.
BLOCK = 512

#: 64-bit words of a sketch that tells, of so many slots, whether an odd number of a line's shingles fall into them.
WORDS = 16

#: Slots of the table that counts in how many lines a shingle is, and the bits of its hash that do not name the slot.
SLOTS, _SLOT = 1 << 20, np.uint64(44)

#: What does not count at either end of a line.
BLANKS = " \t\r\x0b\x0c"

#: Lines per step of the signatures: their characters and hashes fit in a core's cache.
_STEP = 1 << 15

_MIX = [(0x9E3779B1, 0x85EBCA77), (0xC2B2AE3D, 0x27D4EB2F), (0x165667B1, 0x9E3779B1), (0x85EBCA6B, 0xC2B2AE35)]


def shingles(line: str, size: int = SHINGLE) -> frozenset[str]:
    """Runs of ``size`` characters; a shorter line is one shingle."""
    return frozenset(line[i:i + size] for i in range(max(1, len(line) - size + 1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _hashed(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, line after line, and their number in each line."""
    sizes = np.array([len(x) for x in lines])
    code = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    h = np.zeros(len(code), np.uint32)
    padded = np.concatenate([code, np.zeros(size, np.uint32)])
    for k in range(size):
        h *= np.uint32(0x01000193)
        h += padded[k:k + len(code)]
    n = np.maximum(sizes - size + 1, 1)
    h = h[np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    short = np.flatnonzero(sizes < size)
    if len(short):  # a line shorter than a shingle: the hash of all of it, not of what follows
        at = np.cumsum(n) - n
        for i in short.tolist():
            x = len(lines[i])
            for c in lines[i]:
                x = (x * 0x01000193 + ord(c)) & 0xFFFFFFFF
            h[at[i]] = x
    return h, n


def _mixed(h: np.ndarray, a: int, b: int) -> np.ndarray:
    x = h * np.uint32(a)
    x ^= x >> np.uint32(16)
    x *= np.uint32(b)
    x ^= x >> np.uint32(13)
    return x


def _different(h: np.ndarray, n: np.ndarray, enough: float) -> np.ndarray:
    """Number of different hashes in each line; of lines with ``enough`` of them near their start, of those alone."""
    out, starts, width = n.copy(), np.cumsum(n) - n, int(enough) + 16
    long = np.flatnonzero(n >= width)
    first = np.sort(h[starts[long][:, None] + np.arange(width)], axis=1)
    out[long] = 1 + (first[:, 1:] != first[:, :-1]).sum(1)
    rest = (n >= SHORT) & ((n < width) | (out < enough))
    row = np.repeat(np.arange(rest.sum(), dtype=np.uint64), n[rest])
    key = np.sort(row << np.uint64(32) | h[np.repeat(rest, n)])
    new = key[np.diff(key, prepend=~key[:1]) != 0]
    out[rest] = np.bincount((new >> np.uint64(32)).astype(np.int64), minlength=rest.sum())
    return out


def _bins(h: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Least hash per bin and line; an empty bin takes the next filled one's, marked with its distance."""
    row = np.repeat(np.arange(len(n)), n)
    out = np.full(len(n) * bins, 0xFFFFFFFF, np.uint32)
    for a, b in _MIX[:REPEATS]:
        x = _mixed(h, a, b)
        place = (x.astype(np.uint64) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) + row * bins
        x *= np.uint32(0x2545F491)
        np.minimum.at(out, place, x ^ (x >> np.uint32(16)))
    out = out.reshape(-1, bins)
    twice = np.tile(out != 0xFFFFFFFF, 2)
    at = np.where(twice, np.arange(2 * bins), 4 * bins)
    ahead = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
    value = np.take_along_axis(out, ahead % bins, 1)
    return value + (ahead - np.arange(bins)).astype(np.uint32) * np.uint32(0x9E3779B1)


def _least(h: np.ndarray, n: np.ndarray, count: int, seed: int = 48) -> np.ndarray:
    """Least value per hash function and line, for ``count`` functions."""
    draw = np.random.RandomState(seed)
    salts, factors = (draw.randint(0, 1 << 32, count, np.uint64).astype(np.uint32) for _ in range(2))
    x, starts = _mixed(h, *_MIX[2]), np.cumsum(n) - n
    out = np.empty((len(n), count), np.uint32)
    for k in range(count):
        y = x ^ salts[k]
        y *= factors[k] | np.uint32(1)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def _banded(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(lines, bands) of 64-bit bucket hashes; rows of a band lie apart, as neighbouring bins may share a source."""
    least = least.astype(np.uint64)
    code = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        code = (code ^ least[:, r * bands:(r + 1) * bands]) * np.uint64(0xFF51AFD7ED558CCD)
        code ^= code >> np.uint64(32)
    return code


def _steps(lines: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(lines):
        end, room = at, _STEP
        while end < len(lines) and (end == at or room >= len(lines[end])):
            room -= len(lines[end])
            end += 1
        yield at, end
        at = end


def signatures(lines: list[str], size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) of 64-bit bucket hashes from bins, which suit lines of ``SHORT`` shingles or more."""
    out = np.zeros((len(lines), bands), np.uint64)
    for at, end in _steps(lines):
        out[at:end] = _banded(_bins(*_hashed(lines[at:end], size), bands * rows), bands, rows)
    return out.view(np.int64)


def buckets_of(lines: list[str], size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Number of buckets of each line, and the buckets, line after line.

    Similar lines have numbers of shingles within a factor of ``similarity``. So if one has fewer than ``SHORT``, both
    have fewer than ``SHORT / similarity`` and are filed by hash functions of their own; else both are filed by bins.
    """
    counts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, end in _steps(lines):
        h, n = _hashed(lines[at:end], size)
        different = _different(h, n, SHORT / similarity)
        out = np.zeros((end - at, 2, bands), np.uint64)
        ways = np.stack([different >= SHORT, different < SHORT / similarity], 1)
        for way, least in enumerate((_bins, _least)):
            mine = ways[:, way]
            if mine.any():
                out[mine, way] = _banded(least(h[np.repeat(mine, n)], n[mine], bands * rows), bands, rows)
        counts.append(ways.sum(1) * bands)
        found.append(out[ways].ravel())
    return np.concatenate(counts), np.concatenate(found).view(np.int64)


def lines_of(text: str) -> list[str]:
    """Lines without surrounding white space, in order; blank lines are empty."""
    return [x.strip(BLANKS) for x in text.split("\n")]


def _digests(lines: list[str]) -> list[bytes]:
    from xxhash import xxh3_128_digest

    return [xxh3_128_digest(x.encode()) if x else b"" for x in lines]


#: Name of a document: its id and the hash of its text, so repeated ids with different texts stay apart.
DOC = ["_id", "_text_hash"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text"))


def _signed(docs: DataFrame, size: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """A row for each non-blank line: document, place, digest, and the buckets of a line when a task first meets it."""
    kind = docs.schema["_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                doc, place, marks, seen = [], [], [], {}
                for i, text in enumerate(texts_of(batch.column(2))):
                    lines = lines_of(text)
                    for j, (line, mark) in enumerate(zip(lines, _digests(lines), strict=True)):
                        if mark:
                            doc.append(i)
                            place.append(j)
                            marks.append(mark)
                            seen.setdefault(mark, (len(marks) - 1, line))
                new = [at for at, _ in seen.values()]
                each, at = buckets_of([line for _, line in seen.values()], size, similarity, bands, rows)
                counts = np.zeros(len(marks) + 1, np.int32)
                counts[np.array(new, np.int64) + 1] = each
                buckets = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(at, pa.int64()))
                of = batch.select([0, 1]).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([of.column(0), of.column(1), pa.array(place, pa.int32()), pa.array(marks, pa.binary()), pa.array(_heads(marks), pa.int64()), buckets],
                                                 names=["_id", "_text_hash", "place", "mark", "head", "buckets"])

    return map_arrow(docs, signed, f"_id {kind}, _text_hash long, place int, mark binary, head long, buckets array<long>")


def _heads(marks: list[bytes]) -> np.ndarray:
    """First half of each digest. It only stands in for the digest where a clash costs work, not rightness."""
    return np.frombuffer(b"".join(marks), np.int64)[::2]


def _texts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``(mark, line)`` of lines whose digest's head may be wanted, from a second scan."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                seen = {}
                for text in texts_of(batch.column(0)):
                    lines = lines_of(text)
                    seen.update(zip(_digests(lines), lines, strict=True))
                seen.pop(b"", None)
                if seen:
                    marks = [*seen]
                    heads = _heads(marks)
                    keep = np.flatnonzero(may_hold(shared.value, heads)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([marks[i] for i in keep], pa.binary()), pa.array([seen[marks[i]] for i in keep], pa.string())], names=["mark", "line"])

    return map_arrow(docs.select("_text"), found, "mark binary, line string")


def _contested(signed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``(bucket, mark, head)`` of lines in buckets that may hold more than one line."""
    shared = signed.sparkSession.sparkContext.broadcast(wanted)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten()
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            keep = pa.array(np.flatnonzero(may_hold(shared.value, values.to_numpy())))
            yield pa.RecordBatch.from_arrays([values.take(keep), *(batch.column(k).take(pa.array(of).take(keep)) for k in (0, 1))], names=["bucket", "mark", "head"])

    return map_arrow(signed.filter("size(buckets) > 0").select("mark", "head", "buckets"), kept, "bucket long, mark binary, head long")


def _verified(size: int, similarity: float):
    """Candidate pairs with both lines, their numbers of shingles and sketches: those similar enough."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, odd = [batch.column(k).to_numpy() for k in (4, 5)], [_words(batch.column(k)) for k in (6, 7)]
            may = np.flatnonzero(_alike(*n, *odd, similarity))
            lines = [batch.column(k).take(pa.array(may)).to_pylist() for k in (2, 3)]
            sets = _sets([*{*lines[0], *lines[1]}], size)
            keep = [i for i, x, y in zip(may.tolist(), *lines, strict=True) if _similar(sets[x], sets[y], similarity)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return verified


def _ordered(lines: list[str], size: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of lines as 64-bit hashes, line after line: number of the line, hash, place within the line and
    number of shingles of the line. ``counts`` puts those first that are rare; the order is the same in all lines."""
    sizes = np.array([len(x) for x in lines], np.int64)
    code = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    padded, h = np.concatenate([code, np.zeros(size, np.uint64)]), np.zeros(len(code), np.uint64)
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - at
    for k in range(size):
        h = np.where(left > k, (h ^ padded[k:k + len(code)]) * np.uint64(0x9E3779B97F4A7C15), h)
        h ^= h >> np.uint64(29)
    begins = (left >= size) | (at == 0)
    row, h = np.repeat(np.arange(len(lines)), sizes)[begins], h[begins]
    keys = (h, row) if counts is None else (h, counts[h >> _SLOT], row)
    order = np.lexsort(keys)
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    n = np.bincount(row, minlength=len(lines))
    return row, h, np.arange(len(row)) - (np.cumsum(n) - n)[row], n[row]


def _sketches(row: np.ndarray, h: np.ndarray, lines: int) -> np.ndarray:
    """``(lines, WORDS)``: of each of 64 x ``WORDS`` slots whether an odd number of the line's shingles fall into it."""
    out = np.zeros(lines * WORDS, np.uint64)
    np.bitwise_xor.at(out, row * WORDS + (h >> np.uint64(6) & np.uint64(WORDS - 1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out.reshape(lines, WORDS)


def _packed(sketches: np.ndarray) -> pa.Array:
    data = sketches.tobytes()
    return pa.array([data[at:at + 8 * WORDS] for at in range(0, len(data), 8 * WORDS)], pa.binary())


def _words(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint64).reshape(-1, WORDS)


def _sets(lines: list[str], size: int) -> dict[str, np.ndarray]:
    """Different shingles of each line, as sorted 64-bit hashes: two of one pair of lines clash once in 10^13 pairs."""
    out = {}
    for s, t in _steps(lines):
        row, h, _, _ = _ordered(lines[s:t], size)
        out.update(zip(lines[s:t], np.split(h, np.cumsum(np.bincount(row, minlength=t - s))[:-1]), strict=True))
    return out


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """:func:`jaccard` of two sets of hashes, each sorted."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common) >= similarity


def _alike(n, m, odd, other, similarity: float) -> np.ndarray:
    """Whether lines of ``n`` and ``m`` shingles may be similar: these have enough shingles in common for their numbers, and
    two lines differ in no more slots of their sketches than in shingles."""
    share, total = similarity / (1 + similarity), n + m
    differ = np.bitwise_count(odd ^ other).sum(axis=-1, dtype=np.int64)
    return (np.minimum(n, m) >= share * total - 1e-9) & (differ <= total * (1 - 2 * share) + 1e-9)


def _sketched(size: int):
    """``(mark, line)`` with the number of different shingles of the line and its sketch."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(1).to_pylist()
            for s, t in _steps(lines):
                row, h, _, _ = _ordered(lines[s:t], size)
                n = np.bincount(row, minlength=t - s).astype(np.int32)
                part = batch.slice(s, t - s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), _packed(_sketches(row, h, t - s))], names=["mark", "line", "n", "odd"])

    return sketched


def _counted(size: int):
    """Lines: how many have a shingle in each slot of a table of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            lines = batch.column(0).to_pylist()
            for s, t in _steps(lines):
                np.add.at(total, (_ordered(lines[s:t], size)[1] >> _SLOT).astype(np.int64), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot], pa.int64())], names=["slot", "n"])

    return counted


def _rare(size: int, similarity: float, shared):
    """Lines: a row for each shingle by which a line must meet those similar to it, with the head of its digest and a hash of its root.

    Lines of n and m >= n shingles that are similar have at least ``similarity`` x m in common, so with all shingles in
    one order they share one of the first n (or m) less that many, and one.
    """

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0).to_pylist()
            heads, roots = (batch.column(k).to_numpy() for k in (1, 2))
            for s, t in _steps(lines):
                row, h, pos, n = _ordered(lines[s:t], size, shared.value)
                odd = _packed(_sketches(row, h, t - s))
                keep = pos <= n - np.ceil(similarity * n - 1e-9)
                of = row[keep]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (h[keep].view(np.int64), heads[of + s], roots[of + s], n[keep].astype(np.int32), pos[keep].astype(np.int32))), odd.take(pa.array(of))],
                    names=["key", "head", "root", "n", "pos", "odd"])

    return rare


def _feasible(similarity: float):
    """Cells without their lines: rows that may have a similar one of another root in their cell.

    If the key is the first shingle that two lines share, no more than what follows it in both can be common; a pair for
    which that is too little is judged where its first one is, or is not similar. All pairs at one distance go at once.
    """
    share = similarity / (1 + similarity)

    def feasible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edge in whole_groups(batches, CELL):
            block_i, block_j, side, root, n, pos = (part.column(c).to_numpy() for c in ("i", "j", "side", "root", "n", "pos"))
            odd = _words(part.column("odd"))
            end, after, two = np.repeat(edge[1:], np.diff(edge)), n - pos, block_i != block_j
            x, keep, step = np.arange(len(n)), np.zeros(len(n), bool), 1
            while len(x := x[x + step < end[x]]):
                y = x + step
                may = (np.minimum(after[x], after[y]) >= share * (n[x] + n[y]) - 1e-9) & (root[x] != root[y]) & ~(two[x] & (side[x] == side[y]))
                u, v = x[may], y[may]
                near = _alike(n[u], n[v], odd[u], odd[v], similarity)
                keep[u[near]] = keep[v[near]] = True
                step += 1
            yield from part.select([*CELL, "side", "head", "n", "pos", "odd"]).filter(pa.array(keep)).to_batches()

    return feasible


def _rest(size: int, similarity: float):
    """Cells of lines that share a bucket or a rare shingle: links between different components, as a forest."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = similarity / (1 + similarity)
        for part, edge in whole_groups(batches, CELL):
            block_i, block_j, mark, root, line = (part.column(c).to_pylist() for c in ("i", "j", "mark", "root", "line"))
            n, pos, side = (part.column(c).to_numpy() for c in ("n", "pos", "side"))
            after, odd = n - pos, _words(part.column("odd"))
            sets = _sets([*{*line}], size)
            a, b = [], []
            for s, t in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if len({*root[s:t]}) < 2:
                    continue
                up = {r: r for r in root[s:t]}

                def top(r, up=up):
                    while up[r] != r:
                        up[r] = up[up[r]]
                        r = up[r]
                    return r

                two = block_i[s] != block_j[s]
                for i in range(s, t - 1):
                    may = np.minimum(after[i + 1:t], after[i]) >= share * (n[i + 1:t] + n[i]) - 1e-9
                    if two:
                        may &= side[i + 1:t] != side[i]
                    if may.any():
                        may &= _alike(n[i + 1:t], n[i], odd[i + 1:t], odd[i], similarity)
                    for j in (np.flatnonzero(may) + i + 1).tolist():
                        p, q = top(root[i]), top(root[j])
                        if p != q and _similar(sets[line[i]], sets[line[j]], similarity):
                            up[max(p, q)] = min(p, q)
                            a.append(mark[i])
                            b.append(mark[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return searched


CELL = ["key", "i", "j"]


def _further(open_: DataFrame, size: int, similarity: float, block: int) -> DataFrame:
    """``(a, b)``: links between ``(mark, head, root, line)`` of different roots, found by the rare shingles of each line.

    What many lines have in common is frequent, so lines that share no more than that do not meet. The driver adds up one
    table of ``SLOTS`` counts; slots that several shingles share only make the order less selective.
    """
    counted = map_arrow(open_.select("line"), _counted(size), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = open_.sparkSession.sparkContext.broadcast(counts)
    keyed = stored(map_arrow(open_.select("line", "head", F.xxhash64("root")), _rare(size, similarity, shared), "key long, head long, root long, n int, pos int, odd binary"), "rare-shingles")
    # the shorter line of a pair has its first common shingle early, so two others need not meet
    early = F.col("n") - F.col("pos") >= 2 * similarity / (1 + similarity) * F.col("n") - 1e-9
    per = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if(early).alias("_e"), F.count(F.lit(1)).alias("_n"))
    first = F.ceil(F.col("_e") / block).cast("long").alias("_first")
    other = F.when(F.col("_n") <= block, 0).otherwise(F.ceil((F.col("_n") - F.col("_e")) / block)).cast("long").alias("_second")
    busy = stored(per.filter("lo < hi and _e > 0").select("key", first, other), "busy-shingles")
    filtered = open_.sparkSession.sparkContext.broadcast(members(busy, "key"))
    dealt = map_arrow(keyed, _held(filtered), keyed.schema).join(busy, "key")
    among = F.when(early | (F.col("_second") == 0), F.pmod(F.xxhash64("head"), "_first")).otherwise(
        F.col("_first") + F.pmod(F.xxhash64("head"), F.greatest("_second", F.lit(1))))
    dealt = dealt.withColumn("_mine", among)
    last = F.when(F.col("_mine") < F.col("_first"), F.col("_first") + F.col("_second")).otherwise(F.col("_first")) - 1
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    i, j = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    cells = dealt.select("key", i.alias("i"), j.alias("j"), F.when(i == F.col("_mine"), 0).otherwise(1).alias("side"), "head", "root", "n", "pos", "odd")
    return _linked(cells, open_, size, similarity)


def _more_buckets(size: int, rows: int):
    """``(mark, head, root, line)``: a row for each of the line's further buckets."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(3).to_pylist()
            for s, t in _steps(lines):
                buckets = _banded(_least(*_hashed(lines[s:t], size), MORE_BANDS * rows, seed=49), MORE_BANDS, rows)
                of = pa.array(np.repeat(np.arange(s, t), MORE_BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64).ravel()), *(batch.column(k).take(of) for k in range(3))], names=["bucket", "mark", "head", "root"])

    return filed


def _counted_buckets(rows: DataFrame) -> DataFrame:
    """``(bucket, _n)`` of buckets of ``(bucket, root)`` with several roots."""
    return rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("_n")).filter("lo < hi").select("bucket", "_n")


def _within(open_: DataFrame, lines: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(a, b)``: links between different roots in ``(bucket, mark, head, root)``, whose buckets are cells of bounded size."""
    told = open_.join(lines.select("mark", "n", "odd"), "mark")
    none = F.lit(-1).cast("long")
    cells = told.select(F.col("bucket").alias("key"), none.alias("i"), none.alias("j"), F.lit(0).alias("side"), "head", F.xxhash64("root").alias("root"),
                        "n", F.lit(0).alias("pos"), "odd")
    return _linked(cells, open_.select("mark", "head", "root").distinct().join(lines.select("mark", "line"), "mark"), size, similarity)


def _linked(cells: DataFrame, lines: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(a, b)``: links within cells, whose rows get their line from ``(mark, head, root, line)`` if it may be similar to another."""
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    near = stored(map_arrow(cells, _feasible(similarity), "key long, i long, j long, side int, head long, n int, pos int, odd binary"), "feasible-lines")
    told = near.join(lines, "head").drop("head")
    return map_arrow(told.repartition(*CELL).sortWithinPartitions(*CELL, "mark"), _rest(size, similarity), "a binary, b binary")


def _held(filtered):
    """Rows whose key may be among those of the filter."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(filtered.value, batch.column(0).to_numpy())))

    return held


def near_lines(docs: DataFrame, signed: DataFrame, size: int, similarity: float, block: int, band_rows: int = ROWS) -> DataFrame:
    """``(node, component)`` of lines, by digest, that have a different line of at least the wanted similarity.

    A bucket's lines are first verified against its smallest one, a pair once however many buckets it shares; this
    settles whole groups of near copies. Lines of buckets that then still hold several components meet again across
    components only, also in further buckets: one of up to ``block`` lines is a cell, lines of fuller ones meet by their
    rare shingles in cells of bounded size. So no link between different texts that share a bucket is lost, no cell emits more links than
    it has lines, and of unlike lines with a common part no more than their sketches are compared.
    """
    one = F.explode("buckets").alias("bucket")
    buckets = signed.filter("size(buckets) > 0").select(one, "head").groupBy("bucket").agg(F.min("head").alias("low"), F.max("head").alias("high"))
    shared = stored(buckets.filter("low < high").select("bucket", "low"), "shared-buckets")
    rows = stored(_contested(signed, members(shared, "bucket")).distinct().join(shared, "bucket"), "contested")
    texts = _texts(docs, members(rows, "head")).groupBy("mark").agg(F.first("line").alias("line"))
    lines = stored(map_arrow(texts, _sketched(size), "mark binary, line string, n int, odd binary"), "contested-lines")

    centre = rows.filter("head = low").groupBy("bucket").agg(F.min("mark").alias("b"))
    star = rows.join(centre, "bucket").filter("mark <> b").select(F.col("mark").alias("a"), "b").distinct()
    with_a = star.join(lines.select(F.col("mark").alias("a"), F.col("line").alias("x"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a")), "a")
    with_b = with_a.join(lines.select(F.col("mark").alias("b"), F.col("line").alias("y"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b")), "b").select(
        "a", "b", "x", "y", "n_a", "n_b", "odd_a", "odd_b")
    near = stored(map_arrow(with_b, _verified(size, similarity), "a binary, b binary"), "near-lines")
    first = stored(components(near, name="lines"), "line-groups")

    rooted = rows.join(first, rows["mark"] == first["node"], "left").select("bucket", "mark", "head", F.coalesce("component", "mark").alias("root"))
    rooted = stored(rooted, "rooted")
    # pairs with the smallest line have been verified, so of a bucket of two nothing is left
    open_ = stored(rooted.join(_counted_buckets(rooted).filter("_n > 2"), "bucket"), "open-rows")
    told = stored(open_.select("mark", "head", "root").distinct().join(lines.select("mark", "line"), "mark").select("mark", "head", "root", "line"), "open-lines")
    again = stored(map_arrow(told, _more_buckets(size, band_rows), "bucket long, mark binary, head long, root binary"), "more-buckets")
    open_ = stored(open_.unionByName(again.join(_counted_buckets(again), "bucket")), "open-buckets")
    more = stored(_within(open_.filter(F.col("_n") <= block), lines, size, similarity), "further-lines")
    full = open_.filter(F.col("_n") > block).select("mark").distinct()
    if not full.isEmpty():
        more = more.unionByName(stored(_further(stored(told.join(full, "mark"), "full-lines"), size, similarity, block), "rare-lines"))
    both = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    return components(both, name="all-lines")


def dropped_lines(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(_id, _text_hash, _drop)``: places of the lines that go, for documents that lose any."""
    signed = stored(_signed(docs, size, similarity, bands, rows), "signed-lines")
    groups = near_lines(docs, signed, size, similarity, block, rows)
    counts = signed.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # what is alone in its group needs no further look
    several = counts.join(groups, counts["mark"] == groups["node"], "full_outer").select(
        F.coalesce("mark", "node").alias("mark"), F.coalesce("component", "mark").alias("root"))
    found = stored(signed.select("mark", *DOC, "place").join(several, "mark").select("root", F.struct(*DOC, "place").alias("at")), "repeated-lines")
    keeper = found.groupBy("root").agg(F.min("at").alias("kept"))
    gone = found.join(keeper, "root").filter(~F.col("at").eqNullSafe(F.col("kept"))).select("at.*")
    return gone.groupBy(*DOC).agg(F.collect_set("place").alias("_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY,
                bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``docs`` with its text rid of repeated lines, and ``n_lines`` and ``n_dropped`` (non-blank lines).

    Lines are compared without surrounding white space; equal and similar ones form components, and of each the line
    first by (id, hash of the text, place) stays. Blank lines stay. Null and empty texts stay as they are and have no
    lines; null ids come first. Rows with the same id and text lose the same lines, rows with the same id and another
    text are documents of their own. An empty table gives an empty one. Other columns stay, but existing ``n_lines``
    and ``n_dropped`` are replaced.
    """
    keyed = _keyed(docs, id_col, text_col)
    gone = dropped_lines(keyed, size, similarity, bands, rows, block).select(F.col("_id").alias("_i"), F.col("_text_hash").alias("_h"), "_drop")
    mine = docs.drop("n_lines", "n_dropped")
    joined = mine.join(gone, mine[id_col].eqNullSafe(gone["_i"]) & (F.xxhash64(mine[text_col]) == gone["_h"]), "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_drop", i)), "\n"))
    filled = F.coalesce(F.size(F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)), F.lit(0)).cast("long")
    counted = {"n_lines": filled, "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long")}
    return joined.withColumns(counted).withColumn(text_col, left).select(*mine.columns, *counted)
