"""Plain Python versions of what the operators compute, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(rows, window=50):
    """(doc_id, n_words, n_removed, kept text) of (doc_id, text) rows; null ids come last."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    words = [(i, WORD.findall(text or "")) for i, text in rows]
    for i, own in words:
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, own in words:
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < rank(i):
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((i, len(own), len(gone), kept))
    return out


def shingles(text, size=5):
    own = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))) if own else frozenset()


def linked(rows):
    """(doc_id, set size, least linked id) of rows with distinct ids."""
    sets = {i: shingles(text) for i, text in rows}
    having = defaultdict(list)
    for i in sorted(sets):
        for gram in sets[i]:
            having[gram].append(i)
    shared = Counter()
    for ids in having.values():
        for k, b in enumerate(ids):
            for a in ids[:k]:
                shared[a, b] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def secrets(text):
    """Base spans (start, kind order, end) as the contract has them."""
    text = text or ""
    assign = re.compile(
        r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
    )
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    own = WORD.findall(text)
    grams = list(zip(own, own[1:], own[2:], strict=False))
    count = Counter(grams)
    covered = {i + j for i, gram in enumerate(grams) if count[gram] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def lexical(docs, items, k=20):
    """(item_id, rank, doc_id, score) by the scores of the contract, all documents scored."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(i, Counter(term.findall((text or "").translate(UPPER)))) for i, text in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(term.findall((text or "").translate(UPPER)))
        scored = []
        for i, c in own:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, r in asked.items() if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return out


def runs(own, min_length=24, min_exponent=3):
    """(start, length, period) of each run of a list of words, by start and period."""
    found = {}
    for q in range(1, len(own) // min_exponent + 1):
        i = 0
        while i + q < len(own):
            j = i
            while j + q < len(own) and own[j] == own[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_periodic(i, text):
    """The words of a document as the contract of the query on runs changes them."""
    own = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not own:
        return own
    g, n = h // 10, len(own)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]


def collapsed(own, found):
    gone = {k for start, length, period in found for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(own) if k not in gone)
