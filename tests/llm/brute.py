"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0d]+")
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRETS = {"assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def is_pii(kind, text):
    d = re.sub("[^0-9]", "", text)
    return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in text.split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)


def pii(text):
    found = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if is_pii(k, m[0])]
    return (*(sum(f[0] == k for f in found) for k in PII), sha(",".join(f"{k}:{a}:{b}" for k, a, b in found)))


def secrets(text):
    found = []
    for rank, (kind, p) in enumerate(SECRETS.items()):
        for m in re.finditer(p, text or ""):
            if {"assign": lambda m=m: len(m[2]) >= 6, "access": lambda m=m: len(m[0]) >= 20, "hex": lambda m=m: len(m[0]) >= 24}[kind]():
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    return (*(sum(f[2] == k for f in found) for k in SECRETS), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found)))


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def repeated(seqs, width, first):
    """Masks of the symbols that repeated windows cover; with ``first``, by all but a window's first occurrence."""
    seen = {}
    for d in seqs:
        for i in range(len(seqs[d]) - width + 1):
            seen.setdefault(tuple(seqs[d][i : i + width]), []).append((d, i))
    out = {d: [0] * len(s) for d, s in seqs.items()}
    for places in seen.values():
        if len(places) > 1:
            for d, i in sorted(places)[1 if first else 0 :]:
                out[d][i : i + width] = [1] * width
    return out


def repeated_fast(seqs, width):
    """``repeated`` on bytes, by slices."""
    seen = Counter(t[i : i + width] for t in seqs.values() for i in range(len(t) - width + 1))
    out = {}
    for d, t in seqs.items():
        last, mask = 0, []
        for i in range(len(t)):
            if i + width <= len(t) and seen[t[i : i + width]] > 1:
                last = i + width
            mask.append(i < last)
        out[d] = mask
    return out


def components(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def em(rows, start, strength, rounds):
    """Posteriors of rows (kind, vote, vote, vote) under two classes, from numpy arrays with one row a candidate."""
    kinds = sorted({r[0] for r in rows})
    kind = np.array([kinds.index(r[0]) for r in rows])
    votes = np.array([[int(v) + 1 for v in r[1:]] for r in rows])
    prior = np.full(len(kinds), 0.5)
    first = np.array([[start[str(v), y] for v in (-1, 0, 1)] for y in (0, 1)])
    told = np.stack([first] * 3)  # labeler, truth, vote
    for _ in range(rounds):
        no, yes = (np.prod([told[j, y, votes[:, j]] for j in range(3)], axis=0) * (prior if y else 1 - prior)[kind] for y in (0, 1))
        p = yes / (yes + no)
        prior = np.array([(1 + p[kind == k].sum()) / (2 + (kind == k).sum()) for k in range(len(kinds))])
        for j in range(3):
            for y in (0, 1):
                w = np.array([(p if y else 1 - p)[votes[:, j] == v].sum() for v in range(3)]) + strength * first[y]
                told[j, y] = w / w.sum()
    return p


def bm25(passages, items, k1=1.2, b=0.75):
    """For each passage (a list of words), the score of each item over what the item scores for all of its own terms."""
    freq = Counter(t for w in items.values() for t in set(w))
    mean = sum(map(len, items.values())) / len(items)
    idf = {t: np.log(1 + (len(items) - f + 0.5) / (f + 0.5)) for t, f in freq.items()}
    weight = {i: {t: idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(w) / mean)) for t, n in Counter(w).items()} for i, w in items.items()}
    return [{i: sum(w.get(t, 0.0) for t in set(p)) / sum(w.values()) for i, w in weight.items() if w} for p in passages]


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ftrl(rows, epochs, alpha, beta, l1, l2):
    """Follow the regularised leader, one coordinate at a time; rows of ({slot: value}, label). Weights by slot."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return ((l1 if z[i] > 0 else -l1) - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for x, label in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def repeats(text, low):
    """Words in windows of ``low`` words that start twice, and the length of the longest window that does (0 if shorter)."""
    words = re.findall(r"[^ \t-\r]+", text or "")

    def again(size):
        starts = {}
        for i in range(len(words) - size + 1):
            starts.setdefault(hash(tuple(words[i : i + size])), []).append(i)
        return [i for at in starts.values() if len(at) > 1 for i in at]

    covered, least, most = {i + j for i in again(low) for j in range(low)}, low - 1, len(words)
    while most - least > 1:  # what repeats at some size repeats at all smaller ones
        size = (least + most) // 2
        least, most = (size, most) if again(size) else (least, size)
    return len(covered), least if least >= low else 0
