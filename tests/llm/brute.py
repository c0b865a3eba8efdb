"""Plain versions of the operators, one row after another in memory."""

import hashlib
import re

import numpy as np
import xxhash

from matchloom.llm.line_dedup import BLANKS


class Groups:
    def __init__(self):
        self.up = {}

    def top(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def decontamination(docs, items, size=10):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)} of (id, text) pairs."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


def fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs):
    """{doc_id: (fingerprint, component_id)}"""
    fps = {d: fingerprint(t) for d, t in docs}
    groups = Groups()
    ids = sorted(fps)
    for i, a in enumerate(ids):
        groups.top(a)
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                groups.join(a, b)
    return {d: (f"{fps[d]:016x}", groups.top(d)) for d in ids}


def _shingles(line, size=7):
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def line_dedup(docs, similarity=0.8):
    """{doc_id: (n_lines, n_dropped, text)}; the ids are distinct."""
    lines, groups = {}, Groups()
    for _, text in docs:
        for line in (text or "").split("\n"):
            if key := line.strip(BLANKS):
                lines.setdefault(key, _shingles(key))
    names = sorted(lines)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = lines[a], lines[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                both = len(x & y)
                if both / (len(x) + len(y) - both) >= similarity:
                    groups.join(a, b)
    seen, out = set(), {}
    for doc, text in sorted(docs):
        kept, n, gone = [], 0, 0
        for line in (text or "").split("\n"):
            if key := line.strip(BLANKS):
                n += 1
                if (root := groups.top(key)) in seen:
                    gone += 1
                    continue
                seen.add(root)
            kept.append(line)
        out[doc] = (n, gone, None if text is None else "\n".join(kept))
    return out


def cosine_links(rows, least=0.9):
    """{vec_id: (n_links, component_id)}"""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    n, groups = dict.fromkeys((i for i, _ in rows), 0), Groups()
    ids = sorted(good)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[a] += 1
                n[b] += 1
                groups.join(a, b)
    return {i: (n[i], groups.top(i)) for i in n}
