"""Plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    """{doc_id: (n, component)} by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: (len(s), top(d)) for d, s in sets}


def repeats(docs):
    """[(doc_id, n_words, n_removed, sha)] by counting all 35-word windows."""
    split = [(d, words(t)) for d, t in docs]
    count = Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    out = []
    for d, w in split:
        gone = {p for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def rules(text):
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)
