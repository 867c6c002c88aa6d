"""Plain restatements of operators: loops over dictionaries and lists."""

import bisect
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}
FOLD = LOWER | {i: i + 32 for i in range(0xC0, 0xDF) if i != 0xD7}
WORD, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, (text or "").translate(FOLD))


def ftrl(rows, labels, alpha=2.0, beta=1.0, l1=4.0, epochs=5):
    """(bias, weights) of logistic regression by FTRL-proximal, a coordinate at a time; a row is a set of features."""
    mean = (sum(labels) + 0.5) / (len(labels) + 1)
    bias, bias_n, z, n = math.log(mean / (1 - mean)), 0.0, defaultdict(float), defaultdict(float)
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha)
    for _ in range(epochs):
        for row, y in zip(rows, labels):
            w = {f: weight(f) for f in row}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for f in row:
                rate = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha
                z[f] += g - rate * w[f]
                n[f] += g * g
            bias_n += g * g
            bias -= alpha / (beta + math.sqrt(bias_n)) * g
    return bias, {f: weight(f) for f in list(z) if abs(z[f]) > l1}


def features(text):
    w = words(text)
    return {("one", a) for a in w} | {("two", *p) for p in zip(w, w[1:])} | {("skip", *p) for p in zip(w, w[2:])}


def statistics(text):
    """The quality classifier's statistics of a text, in its order."""
    raw = (text or "").encode()
    low = raw.decode().translate(LOWER)
    w = [x.encode() for x in re.findall(SPACED, low)]
    n, size = len(w), len(raw)
    per = lambda a, b: a / max(b, 1)
    kind = lambda chars: sum(c in chars for c in raw)
    lines = [tuple(re.findall(SPACED, x)) for x in low.split("\n")]
    full = [x for x in lines if x]
    windows = [tuple(w[i : i + 5]) for i in range(n - 4)]
    ends = b"#*$%&<>@^~=+_\\{}[]|!?"
    classes = [bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\v\f", b"\n", b"#*$%&<>@^~=+_\\{}[]", b"|", b"!?", b".,;:"]
    known = b"".join(classes) + bytes(range(128, 256))
    out = [math.log1p(size), math.log1p(n), per(sum(map(len, w)), n)]
    out += [per(kind(classes[k]), size) for k in range(5)]
    out += [per(kind(classes[k]), n) for k in (5, 6, 7, 8)] + [per(sum(c not in known for c in raw), n), per(sum(c >= 192 for c in raw), size)]
    out += [per(len(set(w)), n), per(max(Counter(w).values(), default=0), n), per(sum(a == b for a, b in zip(w, w[1:])), n), per(len(windows) - len(set(windows)), len(windows))]
    out += [per(len(full) - len(set(full)), len(full)), per(n, len(full)), per(sum(len(x) > 20 for x in w), n), per(sum(x[-1] in ends for x in w), n)]
    return out


def added(values):
    """A sum from left to right, so that ties fall as they do in arrays."""
    total = 0.0
    for v in values:
        total += v
    return total


def grow(x, y, rounds=80, depth=4, bins=64, rate=0.15, ridge=1.0, least=2.0):
    """A function from a row to the chance of label 1: boosted trees by Newton steps, with splits at quantiles."""
    mean = (sum(y) + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    sigmoid = lambda t: float(1 / (1 + np.exp(-np.array([t]))[0]))
    if len(y) < 20 or min(y) == max(y):
        return lambda row: sigmoid(base)
    columns = [sorted(c) for c in zip(*x)]
    edges = [sorted({c[(len(c) - 1) * k // bins] for k in range(1, bins)}) for c in columns]
    trees, total = [], [base] * len(y)

    def tree(rows, g, h, level):
        if level == depth:
            return -rate * added(g[i] for i in rows) / (added(h[i] for i in rows) + ridge)
        best, whole = (1e-6, None, None), None
        for f, cuts in enumerate(edges):
            held = [[0.0, 0.0] for _ in range(len(cuts) + 1)]
            for i in rows:
                b = bisect.bisect_left(cuts, x[i][f])
                held[b][0] += g[i]
                held[b][1] += h[i]
            held = list(itertools.accumulate(held, lambda a, b: [a[0] + b[0], a[1] + b[1]]))
            gs, hs = whole = whole or held[-1]
            for cut, (gl, hl) in zip(cuts, held):
                gain = gl * gl / (hl + ridge) + (gs - gl) * (gs - gl) / (hs - hl + ridge) - gs * gs / (hs + ridge)
                if hl >= least and hs - hl >= least and gain > best[0]:
                    best = (gain, f, cut)
        _, f, cut = best
        left = [i for i in rows if f is None or x[i][f] <= cut]
        right = [i for i in rows if f is not None and x[i][f] > cut]
        return (0 if f is None else f, math.inf if f is None else cut, tree(left, g, h, level + 1), tree(right, g, h, level + 1))

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(rounds):
        p = [sigmoid(t) for t in total]
        made = tree(range(len(y)), [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-6) for a in p], 0)
        total = [t + walk(made, row) for t, row in zip(total, x)]
        trees.append(made)
    return lambda row: sigmoid(base + sum(walk(t, row) for t in trees))


def fingerprint(text):
    w = re.findall(SPACED, (text or "").translate(LOWER))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits=2):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def without_repeats(texts, least=50):
    """Texts by id without the stretches of `least` words or more that an earlier one holds word by word; those that lose all words go."""
    held, out = set(), {}
    for i in sorted(texts):
        t = texts[i] or ""
        at = [m.span() for m in re.finditer(WORD, t.translate(FOLD))]
        w = words(t)
        windows = [tuple(w[k : k + least]) for k in range(len(w) - least + 1)]
        covered = [False] * len(w)
        for k, v in enumerate(windows):
            if v in held:
                covered[k : k + least] = [True] * least
        held |= set(windows)
        rest = t
        for covers, run in reversed([(c, list(r)) for c, r in itertools.groupby(range(len(w)), key=covered.__getitem__)]):
            if covers:
                rest = rest[: at[run[0]][0]] + rest[at[run[-1]][1] :]
        if words(rest) or not any(covered):
            out[i] = texts[i] if not any(covered) else rest
    return out


def alignment(text, item):
    """Smith-Waterman by its recurrence, as a share of the item's full score."""
    before, best = [0] * (len(text) + 1), 0
    for q in item:
        row = [0]
        for j, p in enumerate(text, 1):
            row.append(max(0, before[j - 1] + (2 if p == q else -1), before[j] - 1, row[j - 1] - 1))
        before, best = row, max(best, *row)
    return best / (2 * len(item))
