"""Removal of repeated byte strings against a plain version, and interval expansion against all windows."""

import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from matchloom.llm import suffix_dedup
from matchloom.llm.intervals import repeated


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, bytes left) of each text."""
    data, seen = [(x or "").encode() for x in texts], {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i:i + length], []).append((d, i))
    gone = [np.zeros(len(b) + 1, bool) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i:i + length] = True
    return [(len(b), int(g.sum()), int((g[:-1] & ~g[1:]).sum()), bytes(np.frombuffer(b, np.uint8)[~g[:-1]])) for b, g in zip(data, gone, strict=True)]


def both(spark, texts, length, **more):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df, length=length, **more).collect()}
    wanted = dict(enumerate(plain(texts, length)))
    assert got == wanted
    return wanted


def test_query_equals_plain_version(spark, sf_dir, real):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in entry.queries()["op12_suffix_dedup"](spark, sf_dir).collect()}
    wanted = {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(real, plain([x for _, x in real], 400), strict=True)}
    assert got == wanted and sum(w[1] for w in wanted.values()) > 10_000


def test_intervals_equal_all_windows():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n, kinds, length = int(rng.integers(1, 80)), int(rng.integers(1, 4)), int(rng.integers(1, 9))
        codes = np.append(rng.integers(0, kinds + 1, n), 0).astype(np.uint16)
        if trial % 3 == 0:
            codes[n // 2:n] = codes[:n - n // 2]
        seen = {}
        for i in range(len(codes) - length + 1):
            if 0 not in (w := tuple(codes[i:i + length].tolist())):
                seen.setdefault(w, []).append(i)
        wanted = np.zeros(len(codes), bool)
        wanted[[i for at in seen.values() if len(at) > 1 for i in at]] = True
        assert (repeated(codes, length) == wanted).all()


def test_wide_intervals_equal_all_windows():
    rng = np.random.default_rng(4)
    code = np.append(rng.integers(1, 4, 5000), 0).astype(np.uint16)
    seen = {}
    for i in range(4992):
        seen.setdefault(code[i:i + 9].tobytes(), []).append(i)
    wanted = np.zeros(len(code), bool)
    wanted[[i for at in seen.values() if len(at) > 1 for i in at if i + 9 <= 5000]] = True
    assert (repeated(code, 9) == wanted).all()


@pytest.mark.parametrize(("length", "full"), [(12, 512), (12, 2), (30, 3), (1, 512), (3, 1)])
def test_edited_copies(spark, length, full):
    """Copies with edits, shared passages in many contexts, periodic texts; ``full`` parts groups down to single strings."""
    rng = random.Random(length + full)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    passage, texts = " ".join(word() for _ in range(12)), []
    for _ in range(25):
        base = " ".join(word() for _ in range(rng.randrange(1, 30)))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(base) + 1)
            texts.append(base[:at] + rng.choice(["", "x", passage]) + base[at + rng.randrange(3):])
    texts += [word() + passage + word() for _ in range(20)] + ["ab" * 40, "z" * 90, "", None, "xyz", "xyz"]
    removed = both(spark, texts, length, full=full)
    assert sum(w[1] for w in removed.values()) > 500


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(7)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    for length in (7, 40):
        size = suffix_dedup.gram_size(length)
        where = lambda x: suffix_dedup.anchors(suffix_dedup.gram_hashes(x, size), len(x) - length + 1, length - size + 1) - np.arange(len(x) - length + 1)  # noqa: E731, B023
        assert (where(text)[100:] == where(text[100:])).all() and (where(text)[:200] == where(text[:199 + length])).all()


def test_odd_texts(spark, odd, odd_rows, empty):
    done = suffix_dedup.remove_repeats(odd, length=8)
    assert done.columns == [*odd.columns, "n_bytes", "n_removed", "n_spans", "kept"] and done.schema["score"].dataType == odd.schema["score"].dataType
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in done.collect()}
    assert got == {i: w for (i, _), w in zip(odd_rows, plain([x for _, x in odd_rows], 8), strict=True)}
    assert suffix_dedup.remove_repeats(empty).count() == 0
    again = spark.createDataFrame([("a", "0123456789", 7, "x"), ("a", "0123456789", 7, "y"), (None, "0123456789?", 7, "z"), ("a", None, 7, "x"), ("a", None, 7, "x")], "doc_id string, text string, low int, kept string")
    rows = suffix_dedup.remove_repeats(again, length=10).collect()
    assert sorted((r["doc_id"] or "", r["low"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == [
        ("", 7, 11, 10, 1, b"?"), ("a", 7, 0, 0, 0, b""), ("a", 7, 0, 0, 0, b""), ("a", 7, 10, 10, 1, b""), ("a", 7, 10, 10, 1, b"")]
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.remove_repeats(again, length=0)
