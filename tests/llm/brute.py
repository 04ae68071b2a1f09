"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def spaces_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rule_counts(text):
    text = text or ""
    words = spaces_words(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if spaces_words(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(repeated))


def removed_bytes(rows, threshold=100):
    """{(id, text): flags per byte} for distinct (id, text), a null id first."""
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for d, t in order:
        raw = t.encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - threshold + 1):
            window = raw[q:q + threshold]
            if window in seen:
                gone[q:q + threshold] = b"\1" * threshold
            seen.add(window)
        out[d, t] = gone
    return out


def cut_result(text, gone):
    raw = (text or "").encode()
    spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
    kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
    return len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def shingle_counts(text):
    words = spaces_words(text)
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def near_classes(texts, similarity=0.8, weights="set"):
    """{text: smallest text of its class} over distinct texts, by (weighted) Jaccard similarity."""
    texts = sorted(set(texts))
    counts = {t: shingle_counts(t) for t in texts}
    if weights == "set":
        counts = {t: Counter(set(c)) for t, c in counts.items()}
    holders, shared = defaultdict(list), Counter()
    for t, c in counts.items():
        for g in c:
            for other in holders[g]:
                shared[other, t] += min(counts[other][g], c[g])
            holders[g].append(t)
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for (a, b), both in shared.items():
        if both / (counts[a].total() + counts[b].total() - both) >= similarity:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {t: find(t) for t in texts}


def item_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits(text, items, window=13):
    """(words, words hit, item ids) of a document."""
    windows = defaultdict(set)
    for name, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k:k + window])].add("" if name is None else str(name))
    words, hit, found = item_words(text), set(), set()
    for size in {len(w) for w in windows}:
        for k in range(len(words) - size + 1):
            names = windows.get(tuple(words[k:k + size]))
            if names:
                found |= names
                hit.update(range(k, k + size))
    return len(words), len(hit), sorted(found)
