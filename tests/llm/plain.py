"""Plain versions of the rules, over lists, for comparison."""

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        group = groups[text or ""]
        keep = max((d for d in group if d is not None), default=None)
        out.append((doc_id, keep, len(group), doc_id == keep, sha(text or "")))
    return out


def lines(rows, least=20, often=3):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = lower_ascii(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= least:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = []
        for line in all_lines:
            held = holders.get(lower_ascii(line.strip(" \t\n\x0b\x0c\r")), ())
            last = max((d for d in held if d is not None), default=None)
            if len(held) < often or doc_id == last:
                kept.append(line)
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def substrings(rows, window=50):
    first = {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingle_set(text):
    w = words(lower_ascii(text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def similar(rows):
    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            common = len(a & b)
            if common and 100 * common >= 80 * (len(a) + len(b) - common):
                up[find(i)] = find(j)
    low = defaultdict(list)
    for k, (doc_id, _) in enumerate(sets):
        low[find(k)].append(doc_id)
    return [(doc_id, len(s), min(low[find(k)])) for k, (doc_id, s) in enumerate(sets)]
