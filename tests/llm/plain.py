"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    w = lowered(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(docs, k, percent):
    """{id: (set size, component)} of {id: text}, comparing all pairs."""
    sets, parts = {i: shingles(t, k) for i, t in docs.items()}, Union(docs)
    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parts.join(a, b)
    return {i: (len(sets[i]), parts.root(i)) for i in docs}


def without_repeats(texts, window):
    """(n_words, n_removed, kept words joined) of each text of a list."""
    seen = Counter()
    split = [words(t) for t in texts]
    for w in split:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target}: excess over the cap reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def sha256(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def conversations(rows):
    """{conv: (turns, turns digest, loss chars, loss digest)}."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha256("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha256(loss))
    return out
