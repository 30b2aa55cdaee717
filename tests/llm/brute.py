"""Plain versions of the operators, written from their contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_components(docs, percent=80):
    """docs: {id: text} -> {id: (n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    shared = Counter()
    for ids in having.values():
        ids = sorted(ids)
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[t or ""].append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g}


def substrings(docs, window=13):
    """{id: (n_words, n_removed, sha)}."""
    owner = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - window + 1):
            owner.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in docs.items():
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), failed


def fit_beta(groups):
    groups = [(k, n) for k, n in groups if n]
    n, k = sum(n for _, n in groups), sum(k for k, _ in groups)
    if not n:
        return 0.5, 2.0
    p, j = k / n, len(groups)
    spare = n - sum(m * m for _, m in groups) / n - (j - 1)
    if p in (0.0, 1.0):
        return (k + 1) / (n + 2), 2.0
    if spare <= 0:
        return (k + 1) / (n + 2), 1.0
    rho = ((sum(a * a / m for a, m in groups) - p * k) / (p * (1 - p)) - (j - 1)) / spare
    return p, 1 / min(max(rho, 1e-3), 0.5) - 1


def posterior(k, n, mean, weight, z):
    rate = (k + mean * weight) / (n + weight)
    return rate + z * math.sqrt(rate * (1 - rate) / (n + weight + 1))


def kept_by_quality(docs):
    """docs: [(id, text, host)] -> {id: (base_failed, borderline, verdict of the host, kept)}."""
    judged = {}
    for i, text, _ in docs:
        n, chars, symbols, _, _, failed = quality(text)
        judged[i] = failed, not failed and (symbols * 100 > n * 10 or not 3 * n <= chars <= 10 * n)
    counts = defaultdict(lambda: [0, 0])
    for i, _, host in docs:
        counts[host][0] += any(judged[i])
        counts[host][1] += 1
    mean, weight = fit_beta([tuple(c) for c in counts.values()])
    verdict = {h: "reject" if posterior(k, n, mean, weight, -3.0) > 0.5 else "strict" if posterior(k, n, mean, weight, 0) > mean * 1.01 else "lenient" for h, (k, n) in counts.items()}
    return {i: (*judged[i], verdict[h], not judged[i][0] and verdict[h] != "reject" and not (judged[i][1] and verdict[h] == "strict")) for i, _, h in docs}


def source_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes: {source: words} -> {source: target}, by refilling until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def mixture(docs, seed=0):
    """docs: [(id, text, source)] -> {id: (size, source_size, target, copies)}; ids are unique."""
    by_source = defaultdict(list)
    for i, text, source in docs:
        by_source[source].append((len(words(text)), i))
    sizes = {s: sum(n for n, _ in v) for s, v in by_source.items()}
    targets = source_targets(sizes)
    out = {}
    for s, rows in by_source.items():
        rows.sort()
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5((f"{seed}/" + ("null" if s is None else f"={s}")).encode()).hexdigest()[:8], 16) / float(1 << 32)
        for k, (n, i) in enumerate(rows):
            out[i] = (n, sizes[s], targets[s], min(math.floor((k + 1) * rate + u) - math.floor(k * rate + u), math.ceil(rate)))
    return out
