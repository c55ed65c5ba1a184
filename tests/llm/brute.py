"""Plain versions of what the operators return."""

import base64
import collections
import hashlib
import re

import numpy as np

BIG = 2**63 - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def key(r):
    return tuple((x is None, x) for x in r)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def quality(t):
    w = words(t)
    t = t or ""
    n = len(w)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.defaultdict(list)
    for i in range(n - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def warc(rows):
    largest = {}
    for p, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), p)
    out = []
    for p, h in rows:
        raw = (h or "").encode()
        top = largest[h or ""]
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top == p else "revisit", None if top == p else top))
    return out


def suffix(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def substring_marks(rows, window):
    first, texts = {}, [(BIG if d is None else d, words(t)) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, BIG), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def substring(rows, window):
    marks = substring_marks(rows, window)
    return [(d, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode())) for (d, _), (w, g) in zip(rows, marks, strict=True)]


def jaccard(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), BIG), BIG if d is None else d)
    return [(d, len(sets[i]), None if least[top(i)] == BIG else least[top(i)]) for i, (d, _) in enumerate(rows)]


def order_minhash(text, k, xors, odds):
    """As the module says, number by number: k-mers with their occurrences, the two least of each function, in text order."""
    full, golden, other = 2**64 - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

    def mix(x):
        x = ((x ^ x >> 31) * golden) & full
        x = ((x ^ x >> 29) * other) & full
        return x >> 32

    if not text:
        return "ffff" * len(xors)
    text = text + bytes(max(0, k - len(text)))
    seen, grams, numbered = collections.Counter(), [], []
    for i in range(len(text) - k + 1):
        gram = mix(int.from_bytes(text[i : i + k], "little"))
        seen[gram] += 1
        grams.append(gram)
        numbered.append(mix((gram + seen[gram] * other) & full))
    out = ""
    for x, odd in zip(xors, odds, strict=True):
        least = sorted(range(len(grams)), key=lambda i: (((numbered[i] ^ x) * odd) & 0xFFFFFFFF, i))[:2]
        a, b = min(least), max(least)
        out += f"{mix((grams[a] * golden + grams[b]) & full) & 0xFFFF:04x}"
    return out


def contexts(texts, bucket_of, buckets, places, signs, reach):
    """Sums of the index vectors of each word's neighbours, and its count in the last column."""
    table = np.zeros((buckets, int(places.max()) + 2 if len(places) else 1), np.int64)
    for t in texts:
        ws = [bucket_of(m[0]) for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n+|([^\x09-\x0d\x200-9A-Za-z\x80-\xff])\1*", t)]
        for i, w in enumerate(ws):
            table[w, -1] += 1
            for j in range(max(0, i - reach), min(len(ws), i + reach + 1)):
                if j != i:
                    for p, s in zip(places[ws[j]], signs[ws[j]], strict=True):
                        table[w, p] += s
    return table
