"""Periodic run detection: maximal repetitions of words, on a harmonic grid of longest-common-extension queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extensions import Extensions
from .shared import sized

#: Times its period that a run spans at least, and words that it has at least.
EXPONENT, LEAST = 4, 6

#: Bytes of texts that are searched together, if each text is not longer by itself; grid places looked at together.
BYTES, GRID = 1 << 21, 1 << 21

#: Fixed value: what words are cut at.
_SPACE = "[\x20\x09-\x0d]+"

_RUNS = "array<struct<start: long, length: long, period: long>>"


def normalised(texts: pa.Array) -> pa.Array:
    """Words joined by one space; null is the empty text."""
    spaced = pc.replace_substring_regex(pc.fill_null(texts, ""), _SPACE, " ")
    return pc.utf8_trim(spaced, " ")


def _words(spaced: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, text after text, and the number of words of each text."""
    lists = pc.split_pattern(spaced, " ")
    filled = pc.not_equal(spaced, "").to_numpy(zero_copy_only=False)
    counts = np.where(filled, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
    words = lists.flatten()
    return words.filter(pc.not_equal(words, "")), counts


def grids(starts: np.ndarray, counts: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(place, period, origin)`` of every text and possible period: places (exponent - 1) periods apart. A run spans
    at least one of them together with the place a period later. All places of a text and period come together."""
    each = counts // exponent
    of = np.repeat(np.arange(len(counts)), each)
    period = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + 1
    step = (exponent - 1) * period
    number = -(-(counts[of] - period) // step)
    total, at = np.cumsum(number), 0
    while at < len(of):
        end = max(at + 1, int(np.searchsorted(total, total[at] - number[at] + GRID, side="right")))
        n = number[at:end]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        origin = np.repeat(starts[of[at:end]], n)
        yield origin + k * np.repeat(step[at:end], n), np.repeat(period[at:end], n), origin
        at = end


def runs_in(ids: np.ndarray, counts: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, length, period)`` of all runs, by text, start and period.

    ``ids`` has the words of all texts and after each text a value of its own; ``counts`` the words of each text.
    """
    starts = np.cumsum(counts + 1) - (counts + 1)
    ext, found = None, []
    for place, period, origin in grids(starts, counts, exponent):
        same = ids[place] == ids[place + period]
        place, period, origin = place[same], period[same], origin[same]
        if not len(place):
            continue
        ext = ext or Extensions(ids)
        reach = place + ext.common(place, place + period)
        # a run may span several places of its grid; the first one speaks for it
        step = (exponent - 1) * period
        inner = np.zeros(len(place), bool)
        inner[1:] = (period[1:] == period[:-1]) & (origin[1:] == origin[:-1]) & (place[1:] - place[:-1] == step[1:]) & (reach[:-1] > place[1:])
        place, period, origin, reach, step = (x[~inner] for x in (place, period, origin, reach, step))
        low, high = np.maximum(origin, place - step + 1), place.copy()
        while len(at := np.flatnonzero(low < high)):  # leftmost place that extends as far: halving
            mid = (low[at] + high[at]) // 2
            far = mid + ext.common(mid, mid + period[at]) >= reach[at]
            high[at] = np.where(far, mid, high[at])
            low[at] = np.where(far, low[at], mid + 1)
        length = reach + period - high
        keep = (length >= least) & (length >= exponent * period)
        found.append(np.stack([origin, high - origin, length, period])[:, keep])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    origin, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, origin))
    origin, start, length, period = (x[order] for x in (origin, start, length, period))
    new = np.ones(len(order), bool)  # a multiple of a run's period gives the same run again
    new[1:] = (origin[1:] != origin[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    origin, start, length, period = (x[new] for x in (origin, start, length, period))
    text = np.searchsorted(starts, origin)
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _best(start: list[int], length: list[int], period: list[int]) -> int:
    best = 0
    for k in range(1, len(start)):  # in order of start and period, so only a greater exponent wins
        if length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def _searched(texts: pa.Array, exponent: int, least: int) -> tuple[list, list, list, pa.Array]:
    """Of each text: number of words, runs, the place of the best run among them, and the text without repetitions."""
    spaced = normalised(texts)
    words, counts = _words(spaced)
    codes = words.dictionary_encode()
    n, kinds = len(counts), len(codes.dictionary)
    ids = np.empty(len(words) + n, np.int64)
    ends = np.cumsum(counts + 1) - 1
    inside = np.ones(len(ids), bool)
    inside[ends] = False
    ids[inside] = codes.indices.to_numpy()
    ids[ends] = kinds + np.arange(n)
    text, start, length, period = runs_in(ids, counts, exponent, least)
    runs, best, changed = [[] for _ in range(n)], [None] * n, {}
    edge = np.searchsorted(text, np.arange(n + 1))
    firsts = np.cumsum(counts) - counts
    for i in np.unique(text).tolist():
        s, ln, p = (x[edge[i]:edge[i + 1]].tolist() for x in (start, length, period))
        runs[i] = [{"start": a, "length": b, "period": c} for a, b, c in zip(s, ln, p, strict=True)]
        best[i] = runs[i][_best(s, ln, p)]
        cut = np.zeros(counts[i] + 1, np.int64)
        np.add.at(cut, np.array(s) + np.array(p), 1)
        np.add.at(cut, np.array(s) + np.array(ln), -1)
        kept = np.flatnonzero(np.cumsum(cut)[:-1] == 0) + firsts[i]
        changed[i] = " ".join(words.take(pa.array(kept)).to_pylist())
    if changed:
        mask = np.zeros(n, bool)
        mask[[*changed]] = True
        spaced = pc.replace_with_mask(spaced, pa.array(mask), pa.array([*changed.values()], spaced.type))
    return counts.tolist(), runs, best, spaced


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """``(id_col, n_words, runs, best_run, collapsed)`` of each row.

    Words are what white space (space, tab to carriage return) parts. A run is a stretch of words with smallest period
    q, of at least ``least`` words and ``exponent`` times q, that cannot be extended; ``runs`` has them by start and
    period. ``best_run`` has the greatest length / period (ties: smallest start, then period; null without runs).
    ``collapsed`` is the words, joined by one space, without those that some run holds after its first period.

    Each row is judged by itself: null and blank texts have no words and collapse to the empty text, repeated ids and
    texts give rows of their own, an empty table an empty one. Other columns are not carried along. A text is searched
    as a whole by one task, in memory in proportion to its length; short texts are searched many at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for whole in batches:
            for batch in sized(whole, 1, BYTES):
                counts, runs, best, collapsed = _searched(batch.column(1), exponent, least)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(struct)), pa.array(best, struct), collapsed],
                                                 names=["id", "n_words", "runs", "best_run", "collapsed"])

    schema = f"id {kind}, n_words long, runs {_RUNS}, best_run struct<start: long, length: long, period: long>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(found, schema).withColumnRenamed("id", id_col)
