"""Plain-Python versions that the operators are held against."""

import hashlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return [w for w in (text or "").translate({ord(c): " " for c in SPACE}).split(" ") if w]


def marks(sequences, length):
    """{id: mask}: items of each sequence covered by a window that also starts in a smaller id."""
    first = {}
    for i, s in sorted(sequences.items()):
        for p in range(len(s) - length + 1):
            first.setdefault(tuple(s[p : p + length]) if isinstance(s, list) else s[p : p + length], i)
    out = {}
    for i, s in sequences.items():
        mask = [False] * len(s)
        for p in range(len(s) - length + 1):
            if first[tuple(s[p : p + length]) if isinstance(s, list) else s[p : p + length]] < i:
                mask[p : p + length] = [True] * length
        out[i] = mask
    return out


def suffix(rows, length=50):
    data = {r[0]: (r[1] or "").encode() for r in rows}
    out = {}
    for i, mask in marks(data, length).items():
        kept = bytes(b for b, gone in zip(data[i], mask) if not gone)
        spans = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        out[i] = (len(mask), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring(rows, length=50):
    data = {r[0]: words(r[1]) for r in rows}
    out = {}
    for i, mask in marks(data, length).items():
        kept = " ".join(w for w, gone in zip(data[i], mask) if not gone)
        out[i] = (len(mask), sum(mask), hashlib.sha256(kept.encode()).hexdigest())
    return out


def jaccard(rows, n=4, percent=85):
    """{id: (shingles, component)}."""
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets[r[0]] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            hit.update(range(k, k + 8))
    lines = (text or "").split("\n")
    twice = sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(hit)


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by sharing again and again what is above the caps."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not above:
            out |= {s: level * weight[s] for s in free}
            break
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= above
    return out
