"""Plain Python versions of the contracts, for comparison on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import regex


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def luhn(d):
    return sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def personal_base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15))
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    n = Counter(x[3] for x in found)
    joined = ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(found))
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()


def quality_base(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def shingles(text):
    words = words_of(low(text))
    if len(words) < 2:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:]))


def near_groups(rows):
    """rows: (id, text) -> {id: (set size, component)}."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, width=400):
    """rows: texts -> (bytes, removed, spans, sha256 of the rest) for each."""
    data = [(t or "").encode() for t in rows]
    n = Counter(d[i:i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if n[d[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def contained(docs, items, n=5, share=0.8):
    unspaced = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", unspaced.sub(r" \1 ", t or "").lower())
    runs = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    wanted = [(i, w, runs(w, min(n, len(w)))) for i, t in items for w in [words(t)] if w]
    out = set()
    for d, t in docs:
        have = words(t)
        for i, w, want in wanted:
            both = len(want & runs(have, min(n, len(w))))
            if both >= share * len(want):
                out.add((d, i, len(want), both))
    return out


def planted_tail(doc_id, text):
    """Words of a text, with the periodic tail that the contract gives to some ids."""
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def runs(w, least=12):
    """All maximal stretches with smallest period q and at least max(least, 2 q) words: (start, length, q)."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s, n = i, j + q - i
            if j > i and n >= max(least, 2 * q) and not any(w[s:s + n - d] == w[s + d:s + n] for d in range(1, q)):
                out.append((s, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_runs(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes, fanout=2):
    """(root, for every node its siblings as (left, right) from the bottom up)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            first = a - a % fanout
            paths[k].append(("".join(nodes[first:a]), "".join(nodes[a + 1:first + fanout])))
        nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], paths


def merkle(rows, fanout=2):
    """rows: (tree, id, leaf, leaf as found) -> (id, leaf, subroot, root, siblings, folded root), in any order."""
    order = lambda v: (v is not None, str(v).encode() if not isinstance(v, int) else v)
    groups = {}
    for r in sorted(rows, key=lambda r: (order(r[0] if r[0] is None else str(r[0])), order(r[1]), r[2])):
        groups.setdefault(r[0], []).append(r)
    subs = {k: tree([r[2] for r in v], fanout) for k, v in groups.items()}
    root, tops = tree([s for s, _ in subs.values()], fanout) if subs else (None, [])
    out = []
    for (key, members), top in zip(groups.items(), tops, strict=True):
        for (_, i, h, seen), path in zip(members, subs[key][1], strict=True):
            path, fold = path + top, seen
            for left, right in path:
                fold = sha(left, fold, right)
            out.append((i, h, subs[key][0], root, path, fold))
    return out


def cross_parse(text, learnt, segment):
    """Phrases of a text: each the longest string from where the last one ended that `learnt` holds, a byte that it does not hold alone."""
    n = 0
    for first in range(0, len(text), segment):
        part = text[first:first + segment]
        i = 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in learnt:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
    return n


def raked(cells, shares, share, rounds=300):
    """Plain raking by bisection: {cell: probability} from {(a, b, c): tokens} and one wanted share per value and kind.

    A value that has too little is taken whole; the rest of its margin shares what is missing.
    """
    total, probability = sum(cells.values()), {}
    have = [{v: sum(n for c, n in cells.items() if c[i] == v) / total / share for v in {c[i] for c in cells}} for i in range(3)]
    want = []
    for i in range(3):
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(have[i][v], mid * shares[i][v]) for v in have[i]) < 1 else (low, mid)
        want.append({v: min(have[i][v], high * shares[i][v]) for v in have[i]})
    factor = [dict.fromkeys(h, 1.0) for h in have]
    for _ in range(rounds):
        for i in range(3):
            for v in have[i]:
                mine = [(n / total / share, math.prod(factor[j][c[j]] for j in range(3) if j != i)) for c, n in cells.items() if c[i] == v]
                low, high = 0.0, 1e6
                for _ in range(100):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(n * min(1.0, mid * f) for n, f in mine) < want[i][v] else (low, mid)
                factor[i][v] = high
    for c in cells:
        probability[c] = min(1.0, math.prod(factor[i][c[i]] for i in range(3)))
    return probability
