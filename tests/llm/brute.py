"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(rows, window):
    """[(text)] -> [(n_words, n_removed, kept_sha256)]."""
    seen = Counter()
    split = [words(x) for x in rows]
    for w in split:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def simhash(text, shingle=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, max_bits):
    """Smallest id reachable over links of at most ``max_bits`` bits."""
    fps = np.array(fps, np.uint64)
    label = np.array(ids)
    uniq, inv = np.unique(fps, return_inverse=True)
    piece = list(range(len(uniq)))

    def find(a):
        while piece[a] != a:
            a = piece[a]
        return a
    for i in range(len(uniq)):
        for j in np.flatnonzero(np.bitwise_count(uniq[i] ^ uniq[i + 1:]) <= max_bits) + i + 1:
            a, b = find(i), find(int(j))
            piece[max(a, b)] = min(a, b)
    root = np.array([find(int(i)) for i in inv])
    least = {r: label[root == r].min() for r in set(root.tolist())}
    return [least[r] for r in root.tolist()]


def normal_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def decontaminate(rows, items, window):
    """[(text)] -> [(n_words, hit word numbers, item ids)]."""
    wins = {}
    for i, t in items:
        w = normal_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for t in rows:
        w, hits, who = normal_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k:k + n]))) is not None:
                    hits.update(range(k, k + n))
                    who |= got
        out.append((len(w), sorted(hits), sorted(str(i) for i in who if i is not None)))
    return out


def planted_words(doc_id, text):
    """The words of a document after its planted tail."""
    w = words(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def runs(w, least=12):
    """[(start, length, period)] by trying every lag at every place."""
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                seen.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in seen.items())


def periodic(doc_id, text, least=12, planted=True):
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    w = planted_words(doc_id, text) if planted else words(text)
    found = runs(w, least)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def merkle(rows):
    """[(doc_id, source, lang, n_chars, text)] -> {row number: the seven columns}, by the definition."""
    def sha(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    def steps(lev, i):
        for nodes in lev[:-1]:
            at = i - i % 3
            yield nodes[at:i], nodes[i + 1:at + 3]
            i //= 3
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(row[1], []).append(k)
    first = lambda v: (v is not None, v if v is not None else 0)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda k: (first(rows[k][0]), leaf(rows[k])))
    trees = {name: levels([leaf(rows[k]) for k in groups[name]]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = {}
    for t, name in enumerate(names):
        for i, k in enumerate(groups[name]):
            row = rows[k]
            path = [*steps(trees[name], i), *steps(top, t)]
            fold = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                fold = leaf((*row[:4], row[4].replace("\n", "")))
            for a, b in path:
                fold = sha(*a, fold, *b)
            root = top[-1][0]
            out[k] = (row[0], leaf(row), trees[name][-1][0], root, sha(*(d for a, b in path for d in (*a, *b))), fold, fold == root)
    return out


def shingle_set(text, shingle=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def jaccard_components(rows, percent=85, shingle=3):
    """[(doc_id, text)] -> [(n_shingles, component id)] by comparing all pairs."""
    sets = [shingle_set(t, shingle) for _, t in rows]
    piece = list(range(len(rows)))

    def find(a):
        while piece[a] != a:
            a = piece[a]
        return a
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                piece[max(x, y)] = min(x, y)
    least = {}
    for i, (name, _) in enumerate(rows):
        r = find(i)
        least[r] = name if r not in least or least[r] is None else least[r] if name is None else min(name, least[r])
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]
