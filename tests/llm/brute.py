"""Plain-Python versions of what the corpus operators compute."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPAN = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def shingles(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    return collections.Counter(runs)


def near_classes(texts, similarity=0.8):
    """Class number of each text: equal texts, and links of multiset similarity, over all pairs that share a shingle."""
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    first = {}
    for i, t in enumerate(texts):
        join(i, first.setdefault(t or "", i))
    sets = {i: shingles(texts[i]) for i in first.values()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter()
    for x, who in holders.items():
        for a in range(len(who)):
            for b in range(a):
                shared[who[b], who[a]] += min(sets[who[a]][x], sets[who[b]][x])
    links = 0
    for (a, b), n in shared.items():
        if n >= similarity * (sum(sets[a].values()) + sum(sets[b].values()) - n) - 1e-9:
            links += 1
            join(a, b)
    return [find(i) for i in range(len(texts))], links


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(SPAN):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    out.sort()
    return [(k, a, b) for a, _, k, b in out]


def base_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows(items):
    out = collections.defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            out[tuple(w[k : k + 10])].add(i)
    return out


def hits(text, known):
    """(words, hit words, items) of a text against ``windows``."""
    w, hit, found = bench_words(text), set(), set()
    for size in {len(k) for k in known}:
        for i in range(len(w) - size + 1):
            at = known.get(tuple(w[i : i + size]))
            if at:
                hit.update(range(i, i + size))
                found |= at
    return len(w), len(hit), found
