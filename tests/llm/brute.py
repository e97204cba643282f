"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from math import exp, log10, tanh

import xxhash

KINDS = ("assign", "access", "hex")
PLAIN = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def secrets(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            if {"assign": kind == "assign" and len(m[2]) >= 8, "access": len(m[0]) >= 16, "hex": len(m[0]) >= 32}[kind]:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def fingerprint(text):
    ws = words(lower(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(len(ws) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{position: least position reachable} by steps of at most four bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def repeated(docs):
    """{id: (bytes, removed, runs, kept sha256)} of [(id, text)] with distinct ids."""
    least = {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i, t in raw.items():
        for p in range(len(t) - 49):
            s = t[p : p + 50]
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def unigrams(docs):
    """[(id, held out, tokens, known, N, base score)] in order."""
    texts = [[*words(lower(t)), "\n"] for _, t in docs]
    counts = Counter(w for (i, _), ws in zip(docs, texts) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        for (i, _), ws in zip(docs, texts)
    ]


def runs(ws, least=6, times=4):
    """[(start, length, period)] of the words' runs by trying every period."""
    found = {}
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i + q < len(ws):
            start = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i - start + q >= max(least, times * q) and i > start:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def looped(doc_id, ws):
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def periodic(doc_id, text):
    """(number of runs, start, length, period, exponent, two hashes)."""
    ws = looped(doc_id, words(text))
    found = runs(ws)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    exponent = 1000 * best[1] // best[2] if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def ranked(docs, items, k=10):
    """[(item id, rank, doc id, score)] over every pair."""
    from math import floor, log

    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, t in items:
        scores = []
        for i, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            s = sum(n * floor(1000 * log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 8 * m)) for x, n in Counter(terms(t)).items() if c[x])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def convolved(network, text):
    """Chance of each language for one text, by loops over windows, filters and places."""
    import math

    w = {k: v.astype(float).tolist() for k, v in network.weights.items()}
    total, weights = [0.0] * len(network.languages), 0.0
    for k in range(0, max(len(text), 1), 128):
        own = text[k : k + 128]
        x = list(own) + [0] * (132 - len(own))
        hidden = []
        for f in range(len(w["shift"])):
            top = max(sum(w["embed"][x[i + t]][e] * w["kernel"][t * 8 + e][f] for t in range(5) for e in range(8)) for i in range(128))
            hidden.append(max(top + w["shift"][f], 0))
        z = [sum(h * w["judge"][f][c] for f, h in enumerate(hidden)) + b for c, b in enumerate(w["bias"])]
        e = [math.exp(v - max(z)) for v in z]
        size = max(len(own), 1e-9)
        total, weights = [t + size * v / sum(e) for t, v in zip(total, e)], weights + size
    return [t / weights for t in total]


class Backoff:
    """Interpolated absolute discounting over n-grams that occur twice, add-0.1 unigrams below; dictionaries and recursion only."""

    def __init__(self, texts, order, least=2, discount=0.75):
        self.order, self.discount, self.counts = order, discount, Counter()
        for t in texts:
            ws = [*words(lower(t)), "\n"]
            for n in range(1, order + 1):
                self.counts.update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
        self.words = sorted(g[0] for g in self.counts if len(g) == 1)
        self.total = sum(self.counts[w,] for w in self.words)
        self.kept = {g: c for g, c in self.counts.items() if len(g) > 1 and c >= least}
        self.taken = Counter()
        for g, c in self.kept.items():
            self.taken[g[:-1]] += c - discount

    def chance(self, context, word):
        if not context:
            return (self.counts[word,] + 0.1) / (self.total + 0.1 * (len(self.words) + 1))
        own = self.kept.get((*context, word), 0)
        whole = max(self.kept.get(context, 0) if len(context) > 1 else self.counts[context], 1)
        return (own and (own - self.discount) / whole) + (1 - self.taken[context] / whole) * self.chance(context[1:], word)

    def score(self, text):
        ws = [*words(lower(text)), "\n"]
        return sum(log10(self.chance(tuple(ws[max(0, i - self.order + 1) : i]), w)) for i, w in enumerate(ws))


def passage_vectors(text, classes, size=512, piece=4096 * 512):
    """Passage vectors of the quality classifier, by loops."""
    out = []
    for first in range(0, max(len(text), 1), piece):
        part = text[first : first + piece]
        n = max(-(-len(part) // size), 1)
        of = [i * n // len(part) for i in range(len(part))]
        pairs, words = [Counter() for _ in range(n)], [[] for _ in range(n)]
        for i in range(1, len(part)):
            if of[i] == of[i - 1]:
                pairs[of[i]][classes[part[i - 1]], classes[part[i]]] += 1
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", part):
            words[of[m.start()]].append(m[0])
        for k in range(n):
            length, ws = of.count(k), words[k]
            x = [0.0] * 260
            for (a, b), c in pairs[k].items():
                x[a * 16 + b] = (c / length) ** 0.5
            if ws:
                x[256:259] = min(sum(map(len, ws)) / len(ws) / 16, 4), (len(ws) - len(set(ws))) / len(ws), sum(a == b for a, b in zip(ws, ws[1:])) / len(ws)
            x[259] = length / size
            out.append(x)
    return out


def quality_score(w, text, classes):
    """Gated attention over the passages of a text, by loops."""
    times = lambda x, m: [sum(a * row[j] for a, row in zip(x, m)) for j in range(len(m[0]))]
    sigmoid = lambda x: 1 / (1 + exp(-x))
    hidden = [[tanh(a + b) for a, b in zip(times(x, w["encode"]), w["shift"])] for x in passage_vectors(text, classes)]
    logits = [sum(tanh(t) * sigmoid(g) * r for t, g, r in zip(times(h, w["attend"]), times(h, w["gate"]), w["rank"])) for h in hidden]
    shares = [exp(e - max(logits)) for e in logits]
    mean = [sum(s * h[j] for s, h in zip(shares, hidden)) / sum(shares) for j in range(len(hidden[0]))]
    return sigmoid(sum(a * b for a, b in zip(mean, w["judge"])) + w["bias"][0])
