"""Plain Python versions of the operators, row by row, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACES = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def near(docs):
    """doc_id -> (n_shingles, component_id)."""
    sets = {}
    for d, text in docs:
        words = WORD.findall((text or "").translate(SPACES))
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    where, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for shingle in s:
            for other in where[shingle]:
                common[other, d] += 1
            where[shingle].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, rep, n < 20 or 100 * rep > 30 * n


def base_licenses(text):
    words = LICENSE_WORD.findall((text or "").translate(SPACES))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def substrings(docs):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def targets(sizes):
    """source -> target, from source -> total size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        target = {s: left * weight[s] / total for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target | {s: 2.0 * sizes[s] for s in full}
        full |= over


def perplexities(texts, order=5):
    """Mean negative log probability of each text's byte 5-grams under interpolated modified Kneser-Ney of them all."""
    streams = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode() for t in texts]
    of = [[s[i : i + order] for i in range(len(s) - order + 1)] for s in streams]
    levels = [Counter(g for found in of for g in found)]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    p = {b"": 1 / 256}
    for level in reversed(levels):
        n = [max(1, sum(c == i for c in level.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cut = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.1) for i in (1, 2, 3)]
        total, freed = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            freed[g[:-1]] += min(cut[min(c, 3) - 1], c)
        p = {g: (c - min(cut[min(c, 3) - 1], c) + freed[g[:-1]] * p[g[1:] if len(g) > 1 else b""]) / total[g[:-1]] for g, c in level.items()}
    return [-sum(math.log(p[g]) for g in found) / len(found) if found else None for found in of]
