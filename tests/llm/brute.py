"""Plain-Python versions of the contract's results."""

import collections
import hashlib
import html
import re


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            bad = (
                kind == "ip" and any(int(x) > 255 for x in m.group().split("."))
                or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                or kind == "phone" and not 9 <= len(digits) <= 15
            )
            if not bad:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def contaminated(docs, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def repeats(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            x = b[p : p + length]
            if x in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[doc] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(rows, threshold=0.8):
    """``doc -> (least id of its group, links)``."""
    sets = {i: shingles(t) for i, t in rows}
    parent, links = {i: i for i in sets}, collections.Counter()

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (top(i), links[i]) for i in ids}


def article(page):
    """Text of the synthetic pages' article."""
    m = re.search(r"<article>(.*)</article>", page, re.S)
    blocks = re.split(r"<p>|</p>|<br>|</?h1>", m[1] if m else "")
    return " ".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks) if x)
