"""Plain Python versions of the operators' defined results, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def tokens(text):
    return TOKEN.findall(lower(text))


def held_out(key, folds):
    return key is None or zlib.crc32(str(key).encode()) % folds == 0


def base_scores(docs):
    """{doc_id: (n_tokens, n_known, base_score)}, training tokens."""
    train = Counter()
    for i, text in docs:
        if not held_out(i, 10):
            train.update([*tokens(text), ""])
    total, distinct = sum(train.values()), len(train)
    out = {}
    for i, text in docs:
        each = [train[t] for t in [*tokens(text), ""]]
        score = sum(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in each)
        out[i] = (len(each), sum(c > 0 for c in each), score)
    return out, total


def contamination(docs, items):
    patterns = {}
    for i, text in items:
        w = words(text)
        for at in range(max(1, len(w) - 12) if w else 0):
            patterns.setdefault(tuple(w[at:at + 13]), set()).add(i)
    sizes = sorted({len(p) for p in patterns})
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                for item in patterns.get(tuple(w[at:at + n]), ()):
                    found.add(item)
                    hit.update(range(at, at + n))
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    w = tokens(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_duplicates(docs, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in docs]
    real = [(i, s) for i, s in sets if s and i is not None]
    links = [(a, b) for (a, s), (b, t) in combinations(real, 2)
             if percent * max(len(s), len(t)) <= 100 * min(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t)]
    comp = components({i for i, _ in sets if i is not None}, links)
    return [(i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets]


def vector_links(rows, least=0.93):
    """[(id, n_links, component)] for rows of unique ids."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (label, np.array(v, float))
    links = []
    for (a, (la, x)), (b, (lb, y)) in combinations(good.items(), 2):
        if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
            links.append((a, b))
    n = Counter(x for pair in links for x in pair)
    comp = components({i for i, _, _ in rows if i is not None}, links)
    return [(i, n[i], comp.get(i), i is None or comp[i] == i) for i, _, _ in rows]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_base(text):
    w = words(text)
    places = [(at, label) for p, label in PHRASES.items() for q in [p.split()]
              for at in range(len(w)) if w[at:at + len(q)] == q]
    at = [a for a, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def targets(sizes):
    """{source: target} by repeated resharing; ``sizes`` is {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    fixed, total = {s: 0.0 for s in order if not sizes[s]}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(s):
    d = [int(c) for c in re.findall("[0-9]", s)]
    return sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])


def personal(text):
    t = text or ""
    digits = lambda s: len(re.findall("[0-9]", s))
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= digits(m[0]) <= 19 and _luhn(m[0]) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= digits(m[0]) <= 15]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = lower(host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")
