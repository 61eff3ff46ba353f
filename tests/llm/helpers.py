"""Plain Python versions of what the operators compute."""

import re


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n=5):
    w = words(low(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def kept_words(rows, window=13):
    """n_words, n_removed and kept text of each row of (id, text), a null id being larger than all."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out
