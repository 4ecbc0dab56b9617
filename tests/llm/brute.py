"""Plain readings of the queries' contracts, for small inputs. Rows are (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def op3(rows, n=50):
    docs = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - n + 1):
            first.setdefault(tuple(docs[i][k : k + n]), i)
    out = {}
    for i, w in docs.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op4(url):
    """host, path, rule, fixed verdict."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        host, path = re.sub("[A-Z]+", lambda x: x[0].lower(), m[0]), re.match(r"[^?#]*", rest[m.end() :])[0]
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, verdict


def op5(rows, tok, end=1):
    out, at = {}, 0
    for i, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


KINDS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(d):
    return sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def op7(text):
    """counts, base digest."""
    got = []
    for o, (k, r) in enumerate(KINDS.items()):
        for m in r.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[k]():
                got.append((m.start(), o, m.end(), k))
    got.sort()
    return tuple(sum(g[3] == k for g in got) for k in KINDS), [f"{k}:{a}:{b}" for a, _, b, k in got]


def op9(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            rep.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def op10(rows, items, n=13):
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for i, t in rows:
        w = ITEM_WORD.findall(lower(t))
        hit, ids = set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if (g := tuple(w[k : k + s])) in windows:
                    hit.update(range(k, k + s))
                    ids |= windows[g]
        out[i] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def near_pairs(texts, least, rare=1024, size=5):
    """{(i, j): similarity >= least} of texts by position: weighted Jaccard over runs of words, tf * (1 + log(N / df) / log(rare)), from counts of the runs themselves."""
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append(Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else Counter())
    n = sum(1 for s in sets if s)
    df = Counter(g for s in sets for g in s)
    weighted = [{g: k * (1 + np.log(n / max(df[g], n / rare, 1)) / np.log(rare)) for g, k in s.items()} for s in sets]
    total = [sum(s.values()) for s in weighted]
    where = defaultdict(list)
    for i, s in enumerate(weighted):
        for g in s:
            where[g].append(i)
    both = Counter()
    for g, at in where.items():
        for k, i in enumerate(at):
            for j in at[:k]:
                both[j, i] += min(weighted[i][g], weighted[j][g])
    return {p: b / (total[p[0]] + total[p[1]] - b) for p, b in both.items() if b / (total[p[0]] + total[p[1]] - b) >= least}


def joined(n, pairs):
    """The class of each of n positions."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]
