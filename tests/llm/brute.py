"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def kept_digests(rows, span=35):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    docs = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    count = Counter(tuple(w[j : j + span]) for _, w in docs for j in range(len(w) - span + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - span + 1):
            if count[tuple(w[j : j + span])] > 1:
                gone[j : j + span] = [True] * span
        kept = [a for a, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def near_duplicates(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows with ids."""
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.append((i, own))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (i, own) in enumerate(sets):
        shared = Counter(m for g in own for m in holders[g])
        for m, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[m][1]) - n):
                a, b = find(i), find(sets[m][0])
                parent[max(a, b)] = min(a, b)
        for g in own:
            holders[g].append(k)
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def base_counts(rows):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = len(w)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        count = Counter(zip(w, w[1:], w[2:]))
        repeated = np.zeros(n, bool)
        for j in range(n - 2):
            if count[w[j], w[j + 1], w[j + 2]] > 1:
                repeated[j : j + 3] = True
        r = int(repeated.sum())
        symbols = sum(t.count(x) for x in "#*$%&|<>")
        failed = n < 50 or 100 * r > 50 * n
        out.append((i, n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), r, failed))
    return out


def vectors(counts, texts):
    """The statistics of each document that passes the base rules, by its place."""
    sound = [k for k, c in enumerate(counts) if not c[6]]
    upper = {k: sum(ch.isupper() for ch in texts[k]) for k in sound}
    lines = {k: sum(1 for x in texts[k].split("\n") if x.strip(" \t\n\x0b\x0c\r")) for k in sound}
    return {
        k: np.array([
            np.log(counts[k][1]),
            np.log(counts[k][2] / counts[k][1]),
            counts[k][3] / counts[k][2],
            counts[k][4] / lines[k],
            counts[k][5] / counts[k][1],
            upper[k] / counts[k][2],
        ])
        for k in sound
    }


def least_determinant(rows, core, factor, floor, starts=60, seed=1):
    """(log determinant, mean, covariance) of the best of many random small starts."""
    draw = np.random.default_rng(seed)
    h = max(1, int(np.ceil(core * len(rows))))
    best = None
    for _ in range(starts):
        near, last = rows[draw.choice(len(rows), rows.shape[1] + 2, replace=False)], None
        while True:
            mean, cov = near.mean(axis=0), factor * np.cov(near.T, bias=True) + np.diag(floor**2)
            if len(near) >= h:  # not the few of the start
                det = np.linalg.slogdet(cov)[1]
                if last is not None and det >= last[0] - 1e-9:
                    break
                last = (det, mean, cov)
            away = rows - mean
            d2 = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
            near = rows[d2 <= np.sort(d2)[h - 1]]
        if best is None or last[0] < best[0]:
            best = last
    return best


TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def license_pairs(rows, notices, share=0.75):
    """The (doc_id, license) whose notice has this share of its 5-token shingles in the text."""

    def shingles(text):
        w = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x) for x in TOKEN.findall(text or "")]
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    own = {k: shingles(v) for k, v in notices.items()}
    return {(i, k) for i, t in rows for s in [shingles(t)] for k, v in own.items() if len(v & s) >= share * len(v)}
