"""Plain re-statements of the operators, quadratic where that is simplest."""

from __future__ import annotations


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None) -> set:
    words = lower(text).encode().split()
    if not words:
        return set()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def near_duplicates(docs: list[tuple[int, str | None]], percent: int = 85) -> dict:
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {}
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), shared in pairs.items():
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def plain_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, width=10):
    import hashlib

    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for d, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))):
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def secrets(text):
    """Base spans as (start, kind, end)."""
    import re

    out = []
    for kind, pattern, least, group in (
        (0, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
        (1, r"AKIA[A-Z0-9]+", 16, 0), (2, r"[0-9a-f]+", 32, 0),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(out)


def entropy_ranges(s, alphabet, threshold, w=20):
    import math
    from collections import Counter

    out = []
    for i in range(len(s) - w + 1):
        n = Counter(s[i : i + w])
        if -sum(c / w * math.log2(c / w) for c in n.values()) >= threshold - 1e-9:
            if out and out[-1][1] >= i:
                out[-1][1] = i + w
            else:
                out.append([i, i + w])
    return out


def shards(rows, n=24, fraction=0.05):
    """rows: (doc_id, text); returns doc_id -> (size, crc32, shard, slot)."""
    import hashlib
    import zlib
    from collections import Counter

    data = []
    for d, t in rows:
        raw = (t or "").encode()
        data.append((int(hashlib.md5(raw).hexdigest()[:15], 16), d, len(raw) + 8, zlib.crc32(raw)))
    total, groups = sum(r[2] for r in data), Counter()
    for r in data:
        groups[r[0]] += r[2]
    copies = Counter(r[0] for r in data)
    keyed = sorted((k, d if groups[k] > fraction * total / n and copies[k] > 1 else 0, d, size, crc) for k, d, size, crc in data)
    out, before, slots, seen, last = {}, 0, Counter(), 0, None
    for k, inner, d, size, crc in keyed:
        if (k, inner) != last:
            before, last = seen, (k, inner)
        seen += size
        shard = before * n // total
        out[d] = (size, crc, shard, slots[shard])
        slots[shard] += 1
    return out


def repeats(docs, width=50):
    import hashlib

    split = {d: (t or "").encode().split() for d, t in docs}
    least = {}
    for d, w in sorted(split.items()):
        for i in range(len(w) - width + 1):
            least.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def license_base(text):
    words, places, labels = plain_words(text), [], set()
    for phrase, label in ((["cc", "by"], "cc-by"), (["general", "public", "license"], "gpl"), (["all", "rights", "reserved"], "reserved")):
        own = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
