"""Plain versions of the operators over lists of rows, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text: str | None) -> dict:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    n = len(w)
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup,
        "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def shingles(text: str | None, width: int) -> frozenset:
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(docs: list[tuple[int, str | None]], width: int) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id)."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    holders: dict = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for k, (i, s) in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j > k)
        for j, both in common.items():
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def shard_rows(docs: list[tuple[int | None, str | None]], encode) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) in order of id; ids are unique."""
    out, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = array("I", [*encode(t or ""), 2])
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def archive(pages: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    largest: dict[bytes, int] = {}
    for i, h in pages:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            largest[p] = max(largest.get(p, i), i)
    out = []
    for i, h in pages:
        p = (h or "").encode()
        first = largest.get(p)
        revisit = first is not None and (i is None or i < first)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Share 150 % by weight; what is above twice a source's size is reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] > 2 * sizes[s] * total}
        if not over:
            return {s: float(2 * sizes[s]) if s in capped else rest * weight[s] / total for s in names}
        capped |= over


def sainte_lague(votes: dict, seats: int) -> dict:
    """By the definition: the highest quotient takes the next seat."""
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda s: (votes[s] / (2 * won[s] + 1), [-ord(c) for c in s or "\U0010ffff"]))
        won[best] += 1
    return won


def settled(quotas: list[int], room: list[int]) -> list[int]:
    """Quotas moved on, then back, where there is no room for them."""
    out, over = [], 0
    for q, r in zip(quotas, room, strict=True):
        out.append(min(q + over, r))
        over += q - out[-1]
    for h in reversed(range(len(out))):
        more = min(over, room[h] - out[h])
        out[h] += more
        over -= more
    assert not over
    return out


def contamination(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    """(n_words, n_hit, n_items, items_sha256, contaminated)."""
    w = ITEM_WORD.findall(lower(text or ""))
    hit, who = set(), set()
    for item, t in items:
        iw = ITEM_WORD.findall(lower(t or ""))
        if not iw:
            continue
        for window_words in {tuple(iw[k : k + window]) for k in range(max(1, len(iw) - window + 1))}:
            n = len(window_words)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == window_words:
                    hit.update(range(k, k + n))
                    who.add(str(item))
    return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    """Base spans (start, kind number, kind, end) in order."""
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
DIGITS, UPPER, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alphabet(token: str) -> str:
    body = token.rstrip("=")
    for letters, padded in ((DIGITS + "abcdef", False), (DIGITS + "ABCDEF", False), (UPPER + "234567", True), (DIGITS + UPPER + LETTERS, False), (UPPER + LETTERS + DIGITS + "+/", True), (UPPER + LETTERS + DIGITS + "-_", True)):
        if set(body) <= set(letters) and (padded or body == token):
            return letters
    return UPPER + LETTERS + DIGITS + "-_+/"


def randomness(token: str) -> float:
    """The smallest of three p-values, times three."""
    letters = alphabet(token)
    v = [letters.index(c) for c in token.rstrip("=")]
    n, size = len(v), len(letters)
    tail = lambda z, sides: sides / (1 + math.exp(min(1.5976 * z + 0.07056 * z**3, 600)))  # noqa: E731  the normal tail
    chi = sum((c - n / size) ** 2 / (n / size) for c in (v.count(k) for k in range(size)))
    f = size - 1
    z_chi = max(0, ((max(chi, 0) / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f)))
    side = [2 * x >= size for x in v]
    a, b = sum(side), n - sum(side)
    z_runs = math.sqrt(n)
    if a and b:
        mean = 2 * a * b / n + 1
        runs = 1 + sum(x != y for x, y in zip(side, side[1:], strict=False))
        z_runs = abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 0.25))
    m = sum(v) / n
    square = sum((x - m) ** 2 for x in v)
    z_serial = abs(sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / square + 1 / n) * math.sqrt(n) if square else math.sqrt(n)
    return min(1.0, 3 * min(tail(z_chi, 1), tail(z_runs, 2), tail(z_serial, 2)))


def random_spans(texts: list[str], rate: float = 0.05) -> list[list[tuple[int, int]]]:
    """Per text the candidates that stay: those that Benjamini-Hochberg, per class of length, does not reject as not random."""
    found, classes = [], {}
    for i, t in enumerate(texts):
        for m in CANDIDATE.finditer(t):
            w = m[0].rstrip("=")
            plain = re.fullmatch(r"[a-z+/_-]+|[0-9+/_-]+", w)
            if not plain and not any(a < m.end() and m.start() < z for a, _, _, z in secrets(t)):
                bin_ = min(96, math.floor(-math.log10(max(randomness(m[0]), 1e-300)) * 8))
                kind = sum(len(m[0]) >= n for n in (24, 32, 48, 80))
                found.append((i, m.start(), m.end(), kind, bin_))
                classes.setdefault(kind, []).append(bin_)
    limit = {k: min([b for b in range(97) if (n := sum(x >= b for x in bins)) and 10 ** (-b / 8) <= rate * n / len(bins)], default=97) for k, bins in classes.items()}
    return [[(a, z) for j, a, z, k, b in found if j == i and b < limit[k]] for i in range(len(texts))]


def ftrl(rows: list[tuple[list[int], int]], alpha: float, beta: float, l1: float, l2: float) -> dict[int, float]:
    """The weights after one pass; feature 0 is not regularised by l1."""
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(k: int) -> float:
        least = l1 if k else 0.0
        if abs(z.get(k, 0.0)) <= least:
            return 0.0
        return -(z[k] - math.copysign(least, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for features, y in rows:
        w = {k: weight(k) for k in features}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for k in features:
            s = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
            z[k] = z.get(k, 0.0) + g - s * w[k]
            n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def url(u: str | None) -> tuple[str, str, str | None, str | None]:
    """(host, path, rule, the rule's verdict)."""
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = lower(rest[:k]), rest[k:]
    path = re.match(r"[^?#]*", rest)[0]
    fits = []
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]

