"""Periodic runs, pieces and prefix tries for rows in memory, written as
plainly as can be."""

import hashlib
import re
import zlib
from fractions import Fraction


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(w):
    """[(start, length, period)] of all runs, period by period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = w[i:i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs(doc_id, text):
    w = space_words(text)
    n = len(w)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = repeats(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def pieces(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


def conversations(rows, rebuild=True):
    """rows: [(conv_id, turn, role, text)] -> {conv_id: [(role, text)]}; equal
    turns by the digest of role and text."""
    def digest(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie(convs):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256) of each node."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        kids = children.get(path, [])
        own = (len(members[path]) - 1) * len(space_words(path[-1][1])) if path else 0
        total[path] = (sum(total[k][0] for k in kids) or 1, own + sum(total[k][1] for k in kids))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), *total[p],
                   sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)))) for p, m in members.items())
