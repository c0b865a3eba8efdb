"""String similarity and exact candidate keys for similarity joins over vocabularies."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_python(a: str, b: str) -> float:
    """Jaro-Winkler with a prefix of up to four characters at 0.1 each, half transpositions counted."""
    if not a or not b:
        jaro = 1.0 if a == b else 0.0
    else:
        reach = max(0, max(len(a), len(b)) // 2 - 1)
        taken = [False] * len(b)
        left = []
        for i, ch in enumerate(a):
            for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
                if not taken[j] and b[j] == ch:
                    taken[j] = True
                    left.append(ch)
                    break
        m = float(len(left))
        if not left:
            return 0.0
        right = [ch for ch, used in zip(b, taken) if used]
        half = 0.5 * sum(x != y for x, y in zip(left, right))
        jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3.0
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_python(x, y) for x, y in zip(a, b)], dtype="float64")


# A fixed order of characters from rare to frequent; any fixed order is exact, this one is selective.
_FREQUENT = "zwkxjqñyvfhbgpmudctlnirsoae"


def _rarity(ch: str) -> tuple[int, str]:
    return (_FREQUENT.find(ch), ch)


def _numbered(word: str) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for ch in sorted(word, key=_rarity):
        seen[ch] = seen.get(ch, 0) + 1
        out.append(f"{ch}{seen[ch]}")
    return out


def _share(threshold: float, prefix: int) -> float:
    """Of ``a b / (a + b)`` for lengths a and b, the part that characters in common must reach."""
    jaro = (threshold - 0.1 * prefix) / (1 - 0.1 * prefix)
    if 3 * jaro - 1 <= 1:
        raise ValueError("threshold too low for exact keys")
    return 3 * jaro - 1


def _group(longer: int) -> int:
    """Characters per key: long words are rare, so for them fewer and less selective keys do."""
    return 3 if longer <= 16 else 2 if longer <= 40 else 1


def in_reach(length: Column, other: Column, threshold: float) -> Column:
    """Whether words of these lengths can be that similar at all."""
    return _share(threshold, 4) * length * other / (length + other) - 1e-9 <= F.least(length, other)


def jaro_winkler_keys(word: str, threshold: float, lengths: Iterable[int]) -> list[str]:
    """Keys such that ``word`` and any word of one of ``lengths`` with Jaro-Winkler >= ``threshold`` share one.

    A pair at the threshold needs Jaro >= J with J = (t - 0.1 p) / (1 - 0.1 p) for a common prefix p, and
    Jaro <= (m/a + m/b + 1) / 3 for m common characters, so m >= (3J - 1) a b / (a + b). Two character
    multisets sharing m characters share g of the len - m + g rarest of each, in the same order. Pairs without common
    prefix must meet the higher bound of p = 0; the others also share their first character.
    """
    n = len(word)
    ordered = _numbered(word)
    keys = set()
    for tag, prefix in (("n", 0), (f"p{word[:1]}", 4)):
        share = _share(threshold, prefix)
        # Lengths b that can reach the bound: m <= min(a, b).
        for other in lengths:
            need = share * n * other / (n + other) - 1e-9
            if need > min(n, other):
                continue
            needed = max(1, int(-(-need // 1)))
            group = min(needed, _group(max(n, other)))
            head = ordered[: n - needed + group]
            pair = f"{tag}|{min(n, other)}-{max(n, other)}"
            keys.update(f"{pair}|{''.join(k)}" for k in combinations(head, group))
    return sorted(keys)


def signature_python(word: str) -> int:
    """Bits of the numbered characters of a word; a bit that another word lacks stands for a character that it lacks."""
    seen: dict[str, int] = {}
    bits = 0
    for ch in word:
        seen[ch] = k = seen.get(ch, 0) + 1
        at = ord(ch) - 97
        bits |= 1 << (at + 26 * (k - 1) if 0 <= at < 26 and k <= 2 else 52 + (ord(ch) + k) % 11)
    return bits


@F.pandas_udf(T.LongType())
def signature(words: pd.Series) -> pd.Series:
    return words.map(signature_python)


def jaro_winkler_bound(a: str, b: str, a_bits: str, b_bits: str) -> Column:
    """No less than the Jaro-Winkler of words that are not empty, from the characters each lacks of the other."""
    x, y, p, q = F.length(a), F.length(b), F.col(a_bits), F.col(b_bits)
    common = F.least(x - F.bit_count(p.bitwiseAND(F.bitwise_not(q))), y - F.bit_count(q.bitwiseAND(F.bitwise_not(p))))
    jaro = (common / x + common / y + 1) / 3
    prefix = F.lit(4)
    for k in range(4, 0, -1):
        prefix = F.when(F.substring(a, 1, k) != F.substring(b, 1, k), k - 1).otherwise(prefix)
    return jaro + prefix * 0.1 * (1 - jaro)


#: Words (and characters) of a pack, and cells of a tile of two packs, which stays in a processor's cache.
_PACK, _PACK_CHARS, _TILE = 8192, 1 << 20, 1 << 17
PACKS = "words array<string>, bits array<bigint>"


def packed(batches):
    """Words in rows of many, with their signatures."""
    held, chars = [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string())), pa.array([[signature_python(w) for w in held]], pa.list_(pa.int64()))], ["words", "bits"])

    for batch in batches:
        for word in batch.column(0).to_pylist():
            held.append(word)
            chars += len(word)
            if len(held) >= _PACK or chars >= _PACK_CHARS:
                yield row()
                held, chars = [], 0
    if held:
        yield row()


def _by_length(words: list[str], bits: np.ndarray) -> dict[int, tuple]:
    """Of the words of each length: the words, signatures, characters that have no bit of their own, first four characters."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    out = {}
    for part in np.split(order, cuts):
        n = int(lengths[part[0]])
        some = [words[i] for i in part]
        marks = bits[part].view(np.uint64)
        heads = np.array([[ord(x) for x in w[:4]] + [-1] * (4 - len(w)) for w in some], np.int64)
        out[n] = some, marks, n - np.bitwise_count(marks).astype(np.int64), heads
    return out


def met(left: dict[int, tuple], right: dict[int, tuple], threshold: float):
    """Pairs ``(a, b)`` of two packs whose Jaro-Winkler may reach ``threshold``: none that does is left out.

    By their lengths two words need some characters in common, if all of the first four are; signatures, held against each
    other tile by tile, bound those they have. The few pairs left are bounded again by the characters they do start with.
    """
    share = _share(threshold, 4)
    for x, (a, p, own, a_heads) in left.items():
        for y, (b, q, others, b_heads) in right.items():
            need = share * x * y / (x + y) - 1e-9
            if need > min(x, y):
                continue
            least_a, least_b = (np.clip(np.ceil(need - free), 0, 255).astype(np.uint8) for free in (own, others))
            step = max(1, _TILE // len(b))
            for at in range(0, len(a), step):
                common = np.bitwise_count(p[at:at + step, None] & q)
                i, j = np.nonzero((common >= least_a[at:at + step, None]) & (common >= least_b))
                if not len(i):
                    continue
                most = common[i, j] + np.minimum(own[at + i], others[j])
                same = np.cumprod(a_heads[at + i] == b_heads[j], axis=1)
                prefix = np.minimum(same.sum(axis=1), min(x, y))
                jaro = (most / x + most / y + 1) / 3
                for k in np.flatnonzero(jaro + prefix * 0.1 * (1 - jaro) >= threshold - 1e-9):
                    yield a[at + i[k]], b[j[k]]


def pairs_of_packs(threshold: float):
    """Arrow function giving the candidate pairs of rows that hold a pack of either side."""

    def pairs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for words, bits in ((0, 1), (2, 3)):
                    sides.append(_by_length(batch.column(words)[k].as_py(), batch.column(bits)[k].values.to_numpy(zero_copy_only=False)))
                found = met(*sides, threshold)
                while some := list(islice(found, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(side, pa.string()) for side in zip(*some)], ["a", "b"])

    return pairs


def segments(n: int, distance: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the ``distance + 1`` parts of a word of length ``n``."""
    parts = distance + 1
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def segment_keys(word: str, distance: int) -> list[str]:
    n = len(word)
    if n <= distance:
        return [f"{n}"]
    return [f"{n}|{i}|{word[s:e]}" for i, (s, e) in enumerate(segments(n, distance))]


def segment_probes(word: str, distance: int) -> list[str]:
    keys = set()
    for n in range(max(0, len(word) - distance), len(word) + distance + 1):
        if n <= distance:
            keys.add(f"{n}")
            continue
        for i, (s, e) in enumerate(segments(n, distance)):
            for at in range(max(0, s - distance), min(s + distance, len(word) - (e - s)) + 1):
                keys.add(f"{n}|{i}|{word[at:at + e - s]}")
    return sorted(keys)


def segment_udfs(distance: int):
    """Arrow functions giving the segments of the indexed words and the probes of the other side."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(words: pd.Series) -> pd.Series:
        return words.map(lambda w: segment_keys(w, distance))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def probe(words: pd.Series) -> pd.Series:
        return words.map(lambda w: segment_probes(w, distance))

    return cut, probe
