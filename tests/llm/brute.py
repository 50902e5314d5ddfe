"""The operators' results by plain loops over small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    """Connected groups, each named by its smallest member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def substring(rows, k=20):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(docs):
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s:s + k]), (i, s))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s:s + k])] < (i, s):
                gone.update(range(s, s + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def vectors(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    ids = sorted(good)
    groups, links = Groups(ids), collections.Counter()
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    return sorted(((i, links[i], groups.root(i) if i in good else i) for i, _ in rows), key=str)


def scores(rows):
    three, two, docs = collections.Counter(), collections.Counter(), []
    for i, t in rows:
        w = ["<s>", "<s>", *WORD.findall(t or "")]
        g = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        docs.append((i, g))
        three.update(g)
        two.update(x[:2] for x in g)
    return [(i, len(g), sum(math.log(three[x] / two[x[:2]]) for x in g) if g else None) for i, g in docs]


def similar(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
    groups, ids = Groups(sets), [i for i in sorted(sets) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                groups.join(a, b)
    return sorted((i, len(sets[i]), groups.root(i)) for i in sets)


def archive(rows):
    latest = {}
    for i, _, html in rows:
        if i is not None:
            latest[html or ""] = max(latest.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = i is not None and i < latest[html or ""]
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response",
                    latest[html or ""] if again else None))
    return sorted(out, key=str)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    """The root, and for each node what stands left and right of it on each level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, parts = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at:at + 16]
            for k in range(len(run)):
                for i in members[at + k]:
                    paths[i].append((run[:k], run[k + 1:]))
            above.append(_sha("".join(run)))
            parts.append([i for m in members[at:at + 16] for i in m])
        nodes, members = above, parts
    return nodes[0], paths


def merkle(rows):
    """Rows of (doc_id, source, lang, n_chars, text); texts of every fifth crc32 are lower-cased afterwards."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    trees = []
    for source in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *_tree([leaf(r) for r in own])))
    root, tops = _tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for row, path in zip(own, paths, strict=True):
            later = row[4]
            if row[0] is not None and later is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                later = "".join(c.lower() if "A" <= c <= "Z" else c for c in later)
            folded = leaf((*row[:4], later))
            for left, right in path + top:
                folded = _sha("".join(left) + folded + "".join(right))
            proof = _sha("".join(x for left, right in path + top for x in left + right))
            out.append((row[0], leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def hard_negatives(rows):
    good = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scores = [(max(min(sum(x * y for x, y in zip(v, w, strict=True)), 2**63 - 1), 1 - 2**63), j, other)
                  for k, (j, other, w) in enumerate(good) if k != n and len(w) == len(v)]
        for p in sorted([s for s in scores if s[2] == label], key=order)[:5]:
            near = [s for s in scores if s[2] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]]
            out += [(i, p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(sorted(near, key=order)[:5])]
    return sorted(out, key=str)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses(rows, phrases, notices):
    out = []
    for i, t in rows:
        w = LICENSE_WORD.findall((t or "").translate(LOWER))
        places = [(p, label) for phrase, label in phrases for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()]
        base, more, score = {label for _, label in places}, set(), float(bool(places))
        for n in notices:
            for p in range(len(w)):
                for q in range(p + 1, min(len(w), p + len(n.text.split()) + n.edits) + 1):
                    span = " ".join(w[p:q])
                    if abs(len(span) - len(n.text)) <= n.edits and (d := edits(span, n.text)) <= n.edits:
                        more.add(n.label)
                        score = max(score, (len(n.text) - d) / len(n.text))
        first = [p for p, _ in places]
        out.append((i, len(w), len(places), min(first, default=None), max(first, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | more)), score))
    return sorted(out, key=str)
