"""Plain-Python forms of the operators, for tests."""

import re

import xxhash

from ritardo.llm import secrets

def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return fp - (1 << 64) if fp >> 63 else fp


def brute_groups(ids, fps):
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(ids))]


def brute_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))}


def brute_similar(a, b):
    return len(a & b) / len(a | b)


def brute_similar_groups(texts, least=0.8):
    """Root index of every text: first of those linked at ``least`` or more."""
    sets, up = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if brute_similar(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def brute_spans(text, scope):
    pats = [(re.compile(p), n, g, r) for p, n, g, r in secrets.PATTERNS.values()]
    parts = [(m.start(), k, m.end()) for k, (p, n, g, _) in enumerate(pats)
             for m in p.finditer(text) if len(m[1] if g else m[0]) >= n]
    role = [p[3] for p in pats]
    strong = [x for x in parts if x[1] < secrets.BASE]
    kept = []
    for x in sorted(parts):
        s, k, e = x
        if k >= secrets.BASE:
            if any(a < e and s < b for a, _, b in strong):
                continue
            if role[k] == "secret" and any(
                    role[j] == "secret" and j >= secrets.BASE and y < x and y[2] > s
                    for y in parts for j in [y[1]]):
                continue
        kept.append(x)
    return [x for x in kept if x[1] < secrets.BASE or any(
        (role[y[1]] == "secret") != (role[x[1]] == "secret") and abs(y[0] - x[0]) <= scope
        for y in kept)]


def brute_contaminated(text, items):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    w, hit, which = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(13, len(b))
        grams = {tuple(b[j:j + n]) for j in range(len(b) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if n and tuple(w[j:j + n]) in grams:
                hit |= set(range(j, j + n))
                which.add(i)
    return len(w), len(hit), which
