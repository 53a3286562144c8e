"""Plain versions of the contracts, one text or one small table at a time."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(spans):
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def pii(text):
    t, out = text or "", []
    n = lambda s: len(re.sub("[^0-9]", "", s))
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= n(s) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= n(s) <= 15)]
    for kind, pattern, ok in rules:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(m[0])]
    return out


def secrets(text):
    t, out = text or "", []
    rules = [
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    for rank, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, t) if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def fingerprint(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())


def similarity(a, b):
    return len(a & b) / max(1, len(a | b))


def components(fps, linked=lambda a, b: (a ^ b).bit_count() <= 2):
    """fps: list of (doc_id, fingerprint); the smallest id of each one's component."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if linked(fps[i][1], fps[j][1]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(fps))]


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 400 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    places = {j for i, g in enumerate(grams) if g in many for j in (i, i + 1, i + 2)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup,
            "n_repeat_words": len(places), "base_failed": len(w) < 50 or 100 * len(places) > 50 * len(w)}


def targets(sizes):
    """sizes: source -> size; contract of the mix."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left, rest = goal - sum(fixed.values()), [s for s in order if s not in fixed]
        total = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / total for s in rest} if rest else {}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def warc(pages):
    """pages: list of (page_id, html); rows of the contract."""
    data = [(p, (h or "").encode()) for p, h in pages]
    top = {}
    for p, b in data:
        if len(b) >= 1000 and p is not None:
            top[b] = max(top.get(b, p), p)
    return [(p, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", top[b]) if b in top and p is not None and p < top[b] else ("response", None)))
            for p, b in data]


def edit_distance_inside(item, text):
    """Fewest edits of item against any stretch of text."""
    line = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(line[j] + (a != b), line[j + 1] + 1, new[j] + 1))
        line = new
    return min(line)
