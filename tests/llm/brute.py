"""Plain single-machine versions of the operators, for small inputs."""

from __future__ import annotations

import xxhash


def simhash(text, k=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + k]) for i in range(len(parts) - k + 1)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, prints, radius):
    """Smallest id reachable over links of near prints, by repeated sweeps."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if (p ^ q).bit_count() <= radius:
                root[find(q)] = find(p)
    least = {}
    for d, p in zip(ids, prints):
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [least.get(find(p)) for p in prints]


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def leaks(docs, items, k=5, threshold=0.8):
    """(doc, item) -> best similarity over every window of the item's length."""
    from collections import Counter

    found = {}
    for doc, text in docs:
        own = words(text)
        seen = {" ".join(own[i : i + j]) for j in range(1, k + 1) for i in range(len(own) - j + 1)}
        for item, item_text in items:
            wanted = words(item_text)
            size = min(k, len(wanted))
            if not wanted or len(own) < size:
                continue
            cut = lambda w: [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]  # noqa: B023, E731
            goal = Counter(cut(wanted))
            if not seen & set(goal):
                continue
            n = min(len(wanted), len(own))
            for a in range(len(own) - n + 1):
                window = Counter(cut(own[a : a + n]))
                sim = sum((goal & window).values()) / sum((goal | window).values())
                if sim >= threshold and sim > found.get((doc, item), (0,))[0]:
                    found[doc, item] = (sim, a)
    return found


def without_repeats(docs, window):
    """(words, removed, kept text) of each text, by a table of all windows."""
    from collections import Counter

    split = [(t or "").encode().split() for t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out
