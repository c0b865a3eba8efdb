"""Exact removal of repeated byte strings of a least length, across a corpus, without a suffix array of all of it.

Every string of that many bytes has an anchor: of the shorter strings of fixed size inside it, the one with the least
hash (the first of equals). Equal strings have equal anchors at equal places, so only stretches of text around equal
anchors need to be compared, and those are compared by a Burrows-Wheeler transform of a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import may_hold, members
from .intervals import repeated
from .shared import map_arrow, sized, stored, whole_groups

#: Bytes of a string that is removed where it repeats.
LENGTH = 400

#: Bytes of texts that are anchored together and of stretches that are compared together, if one is not longer.
BYTES = 1 << 18

#: Different stretches with one anchor that are compared together; more are parted by longer strings around the anchor.
FULL = 512

#: Bits of a filter for each member and, as powers of two, the least and most bits of one. A filter that is too small
#: for its members lets more rows through and loses none.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28

#: Starts whose anchors are found at once; places in them take PLACE_BITS bits.
_STEP, _PLACE_BITS = 1 << 17, 20

_ODD = 0x9E3779B97F4A7C15

#: Name of a document: its id and the hash of its text, so repeated ids with different texts stay apart.
DOC = ["_id", "_hash"]


def gram_size(length: int) -> int:
    """The anchor's size: the greatest power of two that is at most a third of ``length``."""
    return 1 << (max(1, length // 3).bit_length() - 1)


def gram_hashes(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place on."""
    h, factor, width = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD), _ODD, 1
    while width < size:
        wider = h[:-width] * np.uint64(factor)
        wider += h[width:]
        wider ^= wider >> np.uint64(29)
        h, width, factor = wider, 2 * width, factor * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF | 1
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def anchors(hashes: np.ndarray, starts: int, wide: int) -> np.ndarray:
    """For each of the first ``starts`` places the place of the least of the ``wide`` hashes from there on."""
    out, mask = np.empty(starts, np.int64), np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, starts, _STEP):
        n = min(_STEP, starts - at)
        key = hashes[at:at + n + wide - 1] & ~mask
        key |= np.arange(len(key), dtype=np.uint64)
        width = 1
        while 2 * width <= wide:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < wide:
            key = np.minimum(key[:width - wide], key[wide - width:])
        out[at:at + n] = (key[:n] & mask).astype(np.int64) + at
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _signed(docs: DataFrame, length: int) -> DataFrame:
    """A row for each stretch of starts with one anchor: the anchor's hash and place, the stretch's digest and limits."""
    kind, size = docs.schema["_id"].dataType.simpleString(), gram_size(length)
    wide = length - size + 1

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for whole in batches:
            for batch in sized(whole, 2, BYTES):
                texts = _bytes(batch.column(2))
                data, ends = b"".join(texts), np.cumsum([len(x) for x in texts])
                if len(data) < length:
                    continue
                hashes = gram_hashes(np.frombuffer(data, np.uint8), size)
                place = anchors(hashes, len(data) - length + 1, wide)
                begins = ends - [len(x) for x in texts]
                # a stretch ends where the anchor changes or a text has no more room
                cuts = np.unique(np.concatenate([np.flatnonzero(place[1:] != place[:-1]) + 1, begins, ends - length + 1, [len(place)]]))
                low, high = cuts[:-1], cuts[1:]
                doc = np.searchsorted(ends, low, side="right")
                fits = (low >= 0) & (low < len(place))
                fits[fits] = low[fits] + length <= ends[doc[fits]]
                low, high, doc = low[fits], high[fits], doc[fits]
                if not len(low):
                    continue
                view = memoryview(data)
                marks = [digest(view[a:b]) for a, b in zip(low.tolist(), (high + length - 1).tolist(), strict=True)]
                of, begin, at = batch.select([0, 1]).take(pa.array(doc)), begins[doc], place[low]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(marks, pa.binary()), of.column(0), of.column(1), *(pa.array((x - y).astype(np.int32)) for x, y in ((low, begin), (high, begin), (at, low)))],
                    names=["anchor", "mark", "_id", "_hash", "low", "high", "place"])

    return map_arrow(docs, signed, f"anchor long, mark binary, _id {kind}, _hash long, low int, high int, place int")


def _filtered(df: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` (long) may be among ``wanted.name``; never loses one."""
    n = wanted.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
    shared, at = df.sparkSession.sparkContext.broadcast(members(wanted, name, bits)), df.columns.index(column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, batch.column(at).to_numpy())))

    return map_arrow(df, kept, df.schema)


_SPAN = [*DOC, "low", "high"]


def _settled(rows: DataFrame, first: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Stretches that occur twice are repeated as a whole: their documents and limits. And of anchors with several
    different stretches one row of each; ``alone`` if it occurs once."""
    kinds = rows.groupBy("anchor", "mark").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in first))
    kinds = stored(kinds, f"{name}-kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    spans = rows.select("mark", *_SPAN).join(kinds.filter("n > 1").select("mark"), "mark").select(*_SPAN)
    contested = kinds.join(several, "anchor").select("anchor", "mark", "kinds", (F.col("n") == 1).alias("alone"), *first)
    return spans, contested


def _with_bytes(docs: DataFrame, contested: DataFrame, length: int) -> DataFrame:
    """``contested`` with the bytes of each stretch, from the documents that hold one."""
    fields = ["anchor", "mark", "kinds", "alone", "low", "high", "place"]
    per = stored(contested.groupBy(*DOC).agg(F.collect_list(F.struct(*fields)).alias("_all")), "contested-documents")
    near = _filtered(docs, "_hash", per, "_hash")
    per = per.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_all")
    joined = near.join(per, (near["_hash"] == per["_h"]) & near["_id"].eqNullSafe(per["_i"])).select(*DOC, "_text", "_all")
    kind = docs.schema["_id"].dataType.simpleString()
    kinds = {f: contested.schema[f].dataType.simpleString() for f in fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sized(whole, 2, BYTES):
                lists, texts = batch.column(3), _bytes(batch.column(2))
                each = lists.flatten()
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                part = {f: each.field(k) for k, f in enumerate(fields)}
                found = [texts[d][a:b + length - 1] for d, a, b in zip(doc.tolist(), part["low"].to_pylist(), part["high"].to_pylist(), strict=True)]
                of = batch.select([0, 1]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([of.column(0), of.column(1), *part.values(), pa.array(found, pa.binary())], names=[*DOC, *fields, "bytes"])

    return map_arrow(joined, cut, f"_id {kind}, _hash long, " + ", ".join(f"{f} {k}" for f, k in kinds.items()) + ", bytes binary")


def _parted(rows: DataFrame, length: int, half: int) -> DataFrame:
    """Stretches cut into those whose strings have the anchor ``half`` bytes nearer to their end, and so on; the new
    anchor is the longer string that all strings of such a part share around the old one."""
    wide = length - gram_size(length) + 1

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            source, anchor, mark, low, high, place, cut = [], [], [], [], [], [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchor", "low", "high", "place", "bytes"))
            for i, (old, begin, end, at, data) in enumerate(zip(*columns, strict=True)):
                last = end - begin - 1
                for cell in range((at - last) // half, at // half + 1):
                    near, far = cell * half, min((cell + 1) * half, wide) - 1  # least and greatest distance of the anchor
                    a, b = max(0, at - far), min(last, at - near)
                    core = data[at - near:at - far + length]
                    source.append(i)
                    anchor.append(xxh3_64_intdigest(core, seed=(old ^ cell * _ODD) & 0xFFFFFFFFFFFFFFFF))
                    low.append(begin + a)
                    high.append(begin + b + 1)
                    place.append(at - a)
                    cut.append(data[a:b + length])
                    mark.append(xxh3_128_digest(cut[-1]))
            of = batch.drop_columns(["bytes"]).take(pa.array(source, pa.int64()))
            new = {"anchor": pa.array(np.array(anchor, np.uint64).view(np.int64)), "mark": pa.array(mark, pa.binary()), "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()),
                   "place": pa.array(place, pa.int32()), "bytes": pa.array(cut, pa.binary())}
            yield pa.RecordBatch.from_arrays([new[f] if f in new else of.column(f) for f in batch.schema.names], names=batch.schema.names)

    return map_arrow(rows, parted, rows.schema)


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """Limits of starts whose string occurs elsewhere among the stretches of their anchor."""
    kind = rows.schema["_id"].dataType.simpleString()

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for part, edge in whole_groups(batches, ["anchor"]):
            ends = np.cumsum(pc.binary_length(part.column("bytes")).to_numpy())
            at = 0
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                size += int(ends[b - 1]) - (int(ends[a - 1]) if a else 0)
                if size >= BYTES:
                    yield pa.concat_tables([*held, part.slice(at, b - at)])
                    held, size, at = [], 0, b
            if at < part.num_rows:
                held.append(part.slice(at))
        if held:
            yield pa.concat_tables(held)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bundles(batches):
            # the same stretch twice: rows with one id and text
            new = np.ones(part.num_rows, bool)
            new[1:] = pc.or_(pc.not_equal(part["mark"].slice(1), part["mark"].slice(0, part.num_rows - 1)),
                             pc.not_equal(part["anchor"].slice(1), part["anchor"].slice(0, part.num_rows - 1))).to_numpy()
            part = part.filter(pa.array(new))
            data = part["bytes"].to_pylist()
            sizes = np.array([len(x) + 1 for x in data])
            code = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
            table = np.zeros(256, np.uint16)
            ends = np.cumsum(sizes) - 1
            inner = np.ones(len(code), bool)
            inner[ends] = False
            seen = np.unique(code[inner])
            table[seen] = np.arange(1, len(seen) + 1)
            codes = table[code]
            codes[ends] = 0
            twice = repeated(codes, length)
            twice[np.repeat(~part["alone"].to_numpy(), sizes)] = False
            edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.view(np.int8), [0]])))
            begin, end = edge[::2], edge[1::2]
            of = np.searchsorted(ends, begin)
            base = part["low"].to_numpy()[of] - (ends - sizes + 1)[of]
            rows = part.take(pa.array(of)).combine_chunks()
            for b in pa.Table.from_arrays([rows["_id"], rows["_hash"], pa.array((begin + base).astype(np.int32)), pa.array((end + base).astype(np.int32))], names=_SPAN).to_batches():
                yield b

    dealt = rows.select("anchor", "mark", "alone", *DOC, "low", "bytes").repartition("anchor").sortWithinPartitions("anchor", "mark")
    return map_arrow(dealt, compared, f"_id {kind}, _hash long, low int, high int")


def repeated_starts(docs: DataFrame, length: int, full: int) -> list[DataFrame]:
    """``(_id, _hash, low, high)``: starts (from low, before high) whose string of ``length`` bytes also starts elsewhere."""
    signed = stored(_signed(docs, length), "signed-stretches")
    common = stored(signed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "common-anchors")
    rows = _filtered(signed, "anchor", common, "anchor")
    spans, contested = _settled(rows, [*DOC, "low", "high", "place"], "stretch")
    found, rows = [spans], stored(_with_bytes(docs, contested, length), "contested-stretches")
    half = 1 << (length - gram_size(length)).bit_length()
    while True:
        found.append(_compared(rows.filter(F.col("kinds") <= full), length))
        hot = rows.filter(F.col("kinds") > full)
        if half == 1 or hot.isEmpty():
            return found
        half //= 2
        parts = stored(_parted(hot, length, half), "parted-stretches")
        spans, rows = _settled(parts, [*DOC, "low", "high", "place", "bytes"], "part")
        found.append(spans)
        rows = stored(rows, "contested-parts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, full: int = FULL) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of removed bytes) and ``kept`` (the bytes left).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any document or at another
    place of the same one; strings do not cross documents and are judged on the texts as they were. Null is the empty
    text; texts shorter than ``length`` stay whole. Every row is a document, whatever its id, so rows with the same id
    and text repeat each other. An empty table gives an empty one. Other columns stay, but existing ones of the four
    names are replaced. What is left need not be valid UTF-8.
    """
    if not 1 <= length < (1 << _PLACE_BITS) - _STEP:
        raise ValueError(f"length must be between 1 and {(1 << _PLACE_BITS) - _STEP - 1}")
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    spans = None
    for part in repeated_starts(keyed, length, full):
        spans = part if spans is None else spans.unionByName(part)
    per = spans.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("_spans"))
    per = per.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_spans")
    mine = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    joined = mine.join(per, (F.xxhash64(mine[text_col]) == per["_h"]) & mine[id_col].eqNullSafe(per["_i"]), "left")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = joined.select(*mine.columns, raw.alias("kept"), "_spans")
    at, spans_at = out.columns.index("kept"), out.columns.index("_spans")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sized(whole, at, BYTES)):
            sizes, gone, number, kept = [], [], [], []
            for data, limits in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                left, end, runs = [], 0, 0
                for s in limits or ():
                    if s["low"] > end or not runs:
                        left.append(data[end:s["low"]])
                        runs += 1
                    end = max(end, s["high"] + length - 1)
                left.append(data[end:])
                kept.append(b"".join(left) if runs else data)
                sizes.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                number.append(runs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(x, pa.int64()) for x in (sizes, gone, number)), pa.array(kept, pa.binary())], names=[*batch.schema.names[:at], "n_bytes", "n_removed", "n_spans", "kept"])

    plain = mine.select(*mine.columns, *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.lit(b"").alias("kept"))
    return map_arrow(out, removed, plain.schema)
