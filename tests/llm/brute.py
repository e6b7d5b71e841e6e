"""Plain Python versions of what the operators compute, for small inputs."""
from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def near_duplicates(rows):
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    where, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(docs, bench):
    windows = {}
    for i, t in bench:
        w = ALNUM.findall((t or "").translate(FOLD))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    lengths, out = {len(k) for k in windows}, {}
    for d, t in docs:
        w, hit, items = ALNUM.findall((t or "").translate(FOLD)), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    items |= windows[k]
        out[d] = (len(w), len(hit), sorted(items))
    return out


def repeats(rows, k=13):
    first, words = {}, {}
    for d, t in sorted(rows):
        words[d] = w = SPACED.findall(t or "")
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < d:
                gone.update(range(j, j + k))
        out[d] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(t):
    t = t or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def measures(t):
    t = t or ""
    w = SPACED.findall(t)
    seen, gone = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)), set()
    for j in range(len(w) - 4):
        if seen[tuple(w[j : j + 5])] > 1:
            gone.update(range(j, j + 5))
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(gone)


def targets(sizes):
    """{source: size} -> {source: target}: shares by weight, capped at three sizes, by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)
    return out
