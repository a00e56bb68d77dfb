"""The contracts' results for rows in memory, written as plainly as can be."""

import hashlib
import re

import numpy as np

KIND_1 = ["email", "ip", "card", "phone"]
KIND_7 = ["assign", "access", "hex"]


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def listed(spans, kinds):
    spans = sorted(spans, key=lambda x: (x[1], kinds.index(x[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return {f"n_{k}": sum(x[0] == k for x in out) for k in KIND_1} | {"base_sha256": sha(listed(out, KIND_1))}


def secrets(text):
    t, out = text or "", []
    keys = "".join  # letters of the key words in either case
    either = keys(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append(("assign", *m.span()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 18:
            out.append(("access", *m.span()))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 16:
            out.append(("hex", *m.span()))
    return {f"n_{k}": sum(x[0] == k for x in out) for k in KIND_7} | {"base_sha256": sha(listed(out, KIND_7))}


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w, t = space_words(text), text or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(w) - 7):
        count[tuple(w[i:i + 8])] = count.get(tuple(w[i:i + 8]), 0) + 1
    inside = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i:i + 8])] >= 2:
            inside.update(range(i, i + 8))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": dup, "n_repeat_words": len(inside),
            "base_failed": len(w) < 20 or 100 * len(inside) > 30 * len(w)}


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def contamination(docs, bench):
    """docs: [(id, text)], bench: [(item, text)] -> [(id, n_words, n_hit, items, contaminated)]"""
    windows = {}
    for item, text in bench:
        w = bench_words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, items = bench_words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s:s + n]))
                if found:
                    items |= found
                    hit.update(range(s, s + n))
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text, k=5):
    w = space_words(ascii_lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_duplicates(docs, percent=85):
    """docs: [(id, text)] -> {id: (n_shingles, component_id)}; every pair that
    shares a shingle is compared."""
    sets = [shingles(t) for _, t in docs]
    ids = [i for i, _ in docs]
    first = {}
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, s in enumerate(sets):
        if s:
            j = first.setdefault(s, i)
            parent[root(i)] = root(j)
    reps = sorted(first.values())
    where = {}
    for i in reps:
        common = {}
        for x in sets[i]:
            for j in where.get(x, ()):
                common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    smallest = {}
    for i in range(len(docs)):
        r = root(i)
        smallest[r] = min(smallest.get(r, ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), smallest[root(i)]) for i in range(len(docs))}


def area_under_curve(scores, labels):
    s, y = np.asarray(scores), np.asarray(labels)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = (y == 1).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(s) - n1))


def classified(cands, rounds):
    """The span classifier of op1 in plain Python: expectation-maximisation
    over each kind's candidates one by one, then naive Bayes."""
    import math
    out = set()
    for kind in {c[1] for c in cands}:
        mine = [c for c in cands if c[1] == kind]
        k = len(mine[0][4])
        prior, acc = 0.5, [0.8] * k

        def clamp(x):
            return min(0.95, max(0.05, x))

        def probability(votes):
            odds = prior / (1 - prior)
            for v, a in zip(votes, acc):
                odds *= a / (1 - a) if v == 1 else (1 - a) / a if v == -1 else 1
            return odds / (1 + odds)
        for _ in range(rounds):
            p = [probability(c[4]) for c in mine]
            prior = clamp((1 + sum(p)) / (2 + len(mine)))
            acc = [clamp((1 + sum(x if c[4][j] == 1 else 1 - x for x, c in zip(p, mine) if c[4][j]))
                         / (1.5 + sum(c[4][j] != 0 for c in mine))) for j in range(k)]
        p = [probability(c[4]) for c in mine]
        yes, no, seen = sum(p), sum(1 - x for x in p), {}
        for x, c in zip(p, mine):
            for f in c[5]:
                y, n = seen.get(f, (0, 0))
                seen[f] = y + x, n + 1 - x
        share = yes / (yes + no)
        weight = {f: math.log((y + share) / yes) - math.log((n + 1 - share) / no) for f, (y, n) in seen.items()}
        bias = math.log((yes + 0.5) / (no + 0.5))
        out |= {(c[0], kind, c[2], c[3]) for c in mine if bias + sum(weight[f] for f in c[5]) > 0}
    return out
