"""Plain versions of the corpus operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(docs):
    sets = {d: shingles(t) for d, t in docs}
    held = {}
    for d, s in sets.items():
        for v in s:
            held.setdefault(v, []).append(d)
    pairs = {}
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    links = [p for p, n in pairs.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return {d: (len(sets[d]), c) for d, c in components(sets, links).items()}


def lm(docs, mass):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    import math
    import zlib
    from collections import Counter

    rows = [(d, zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False, WORD.findall(lower(t)) + [None]) for d, t in docs]
    one, two = Counter(), Counter()
    for _, held, w in rows:
        if not held:
            one.update(w)
            two.update(zip(["<s>"] + w, w))
    starts, n, v = sum(not h for _, h, _ in rows), sum(one.values()), len(one)
    out = {}
    for d, held, w in rows:
        base = score = 0.0
        for h, x in zip(["<s>"] + w, w):
            p = (one[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            c = starts if h == "<s>" else one[h]
            score += math.log10((two[h, x] + mass * p) / (c + mass))
        out[d] = (held, len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out


def repeated(docs, least=50):
    """(doc_id, start, words, documents) of maximal spans of shared windows; ``docs``: (doc_id, text) rows."""
    words = [WORD.findall(lower(t)) for _, t in docs]
    held = {}
    for n, w in enumerate(words):
        for i in range(len(w) - least + 1):
            held.setdefault(tuple(w[i : i + least]), set()).add(n)
    out = []
    for n, w in enumerate(words):
        spans = []
        for i in range(len(w) - least + 1):
            k = len(held[tuple(w[i : i + least])])
            if k < 2:
                continue
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + least, max(spans[-1][2], k))
            else:
                spans.append((i, i + least, k))
        out += [(docs[n][0], a, b - a, k) for a, b, k in spans]
    return out
