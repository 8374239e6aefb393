"""Plain versions of the text operators' results."""

import hashlib
import re
from collections import Counter

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return SPLIT.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(docs):
    sets = {k: shingles(t) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in docs}


def rule_counts(text):
    w = words(text)
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if SPLIT.search(line):
            repeated += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(cover)


def without_strings(docs, size=200):
    bodies = {k: (t or "").encode() for k, t in docs.items()}
    count = Counter(b[i : i + size] for b in bodies.values() for i in range(len(b) - size + 1))
    out = {}
    for k, b in bodies.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def without_windows(docs, size=20):
    seen, out = set(), {}
    for k in sorted(docs):
        w = words(docs[k])
        gone = set()
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            if x in seen:
                gone.update(range(i, i + size))
            seen.add(x)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def clean_words(text):
    return [x for x in (y.strip(PUNCTUATION) for y in words((text or "").translate(LOWER))) if x]


def contamination(docs, items):
    """doc -> greatest similarity of a window of an item's length."""
    out = {}
    for k, t in docs.items():
        w, best = clean_words(t), 0.0
        for item in items:
            v = clean_words(item)
            if not v:
                continue
            gram, n = min(5, len(v)), len(v)
            count = Counter(tuple(v[i : i + gram]) for i in range(n - gram + 1))
            for s in range(max(1, len(w) - n + 1)):
                part = w[s : s + n]
                here = Counter(tuple(part[i : i + gram]) for i in range(len(part) - gram + 1))
                if here:
                    least = sum((here & count).values())
                    best = max(best, least / (sum(here.values()) + sum(count.values()) - least))
        out[k] = best
    return out
