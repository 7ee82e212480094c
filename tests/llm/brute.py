"""Plain versions of the operators' results, straight from their contracts."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

DARK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(_LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    w = DARK.findall(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_groups(docs):
    """{doc_id: (hex, component)}; docs: {id: text}."""
    fps = {i: fingerprint(t) for i, t in docs.items()}
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], dtype=np.uint64)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 2):
                low = min(group[i], group[ids[j]])
                if group[i] != low or group[ids[j]] != low:
                    group[i] = group[ids[j]] = low
                    changed = True
    return {i: (f"{fps[i]:016x}", group[i]) for i in ids}


def contaminated(docs, items):
    """{doc_id: (n_words, n_hit, n_items, sha, flag)}; items: [(id, text)]."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(k) for k in windows}
    out = {}
    for doc, text in docs.items():
        w, hit, seen = ALNUM.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    seen |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), len(seen), sha(",".join(sorted(map(str, seen)))), bool(hit))
    return out


def without_repeats(docs):
    """{doc_id: (n_words, n_removed, sha)}."""
    seen, out = set(), {}
    for doc in sorted(docs):
        w, gone = DARK.findall(docs[doc] or ""), set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        out[doc] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def exact(docs):
    """{doc_id: (keep_id, size, kept, sha)}."""
    groups = defaultdict(list)
    for doc, text in docs.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    return {doc: (min(g)[1], len(g), doc == min(g)[1], sha(k)) for k, g in groups.items() for _, doc in g}
