"""The operators' contracts in plain Python, one row or one table at a time."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str) -> str:
    return text.translate(_LOWER)


def base_metrics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(windows)
    inside = {k + i for k, w in enumerate(windows) if many[w] > 1 for i in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def base_licenses(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    words = ALNUM.findall(lower(text or ""))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def url_rule(url: str | None) -> tuple[str, str, str | None, str | None]:
    """host, path, rule, the rule's verdict."""
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    best = None
    for rule, verdict in {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}.items():
        h, _, p = rule.partition("/")
        if ("." + host).endswith("." + h) and host and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def decontaminate(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], n: int = 8) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text or ""))
        size = min(n, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k : k + size])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for size in range(1, n + 1):
            for k in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= owners
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = SPACED.findall(lower(text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def near(docs: list[tuple[int | None, str | None]], percent: int = 85) -> list[tuple]:
    """All pairs; rows of one id are one vertex."""
    sets = [shingles(t) for _, t in docs]
    parent: dict[int, int] = {d: d for d, _ in docs if d is not None}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    both: Counter = Counter()
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        da, db = docs[a][0], docs[b][0]
        if da is not None and db is not None and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(da), root(db)))
            parent[y] = x
    out = []
    for (d, _), s in zip(docs, sets, strict=True):
        c = None if d is None else root(d)
        out.append((d, len(s), c, True if d is None else d == c))
    return out


def reference_tokens(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def warc(pages: list[tuple[int, str | None]]) -> list[tuple]:
    payloads = [((h or "").encode(), p) for p, h in pages]
    top: dict[bytes, int] = {}
    for data, p in payloads:
        if len(data) >= 1000 and p is not None:
            top[data] = max(p, top.get(data, p))
    out = []
    for data, p in payloads:
        revisit = p is not None and data in top and top[data] != p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top[data] if revisit else None))
    return out


def line_dedup(docs: list[tuple[int, str | None]], least: int = 50) -> dict[int, str | None]:
    """Texts after line dedup, ids being unique: windows of whole lines, the shortest with ``least`` words from each line on and up to it."""
    seen: set[tuple[str, ...]] = set()
    out: dict[int, str | None] = {}
    for d, text in sorted(docs):
        if text is None:
            out[d] = None
            continue
        raw = text.split("\n")
        real = [k for k, x in enumerate(raw) if SPACED.search(x)]
        count = [len(SPACED.findall(raw[k])) for k in real]
        windows = set()
        for i in range(len(real)):
            for order, make in ((range(i, len(real)), lambda j: (i, j)), (range(i, -1, -1), lambda j: (j, i))):
                total = 0
                for j in order:
                    total += count[j]
                    if total >= least:
                        windows.add(make(j))
                        break
        gone = set()
        for s, e in sorted(windows):
            said = tuple(raw[real[k]] for k in range(s, e + 1))
            if said in seen:
                gone.update(range(s, e + 1))
            seen.add(said)
        drop = {real[k] for k in gone}
        out[d] = "\n".join(x for k, x in enumerate(raw) if k not in drop) if drop else text
    return out
