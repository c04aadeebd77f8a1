"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import xxhash


def lower_ascii(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(ids: list, links: list[tuple]) -> dict:
    parent = {i: i for i in ids}
    for a, b in links:
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    return {i: find(parent, i) for i in ids}


def simhash(t: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_copies(rows: list[tuple]) -> dict:
    fp = {i: simhash(t) for i, t in rows}
    ids = list(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 3]
    head = components(ids, links)
    return {i: (f"{fp[i]:016x}", head[i]) for i in ids}


def near_texts(rows: list[tuple], least: float = 0.8, width: int = 5) -> dict:
    """Smallest id of each row's group, where pairs link by the Jaccard of their shingle sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    return components(ids, links)


def near_vectors(rows: list[tuple], threshold: float = 0.9) -> dict:
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    v = {i: np.array(x, dtype=float) if usable(x) else None for i, x in rows}
    ids, links = list(v), []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if v[a] is not None and v[b] is not None and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= threshold:
                links.append((a, b))
    head = components(ids, links)
    return {i: (sum(i in e for e in links), head[i], head[i] == i) for i in ids}


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t: str | None) -> list[tuple]:
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def licences(t: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
    at, labels = [], set()
    for phrase, label in PHRASES:
        k = phrase.split()
        for i in range(len(w) - len(k) + 1):
            if w[i : i + len(k)] == k:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def notices(rows: list[tuple], posted: int = 8, slip: int = 2, least: float = 0.6) -> dict:
    """(labels, score) of each row, by trying every passage at every offset."""
    import math

    from tidemark.llm.notices import PASSAGES, SPELLINGS

    def spell(ws):
        return [SPELLINGS.get(w, w) for w in ws]

    texts = {i: spell(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))) for i, t in rows}
    sets, n = [set(w) for w in texts.values()], len(texts)
    idf = functools.cache(lambda w: math.log((1 + n) / (1 + sum(w in s for s in sets))) + 1e-3)
    out = {}
    for i, t in rows:
        v, labels, best = texts[i], set(), 0.0
        for label, text, keys in PASSAGES:
            notice = spell(text.split())
            rare = sorted(sorted({notice.index(w) for w in notice}, key=lambda k: (-idf(notice[k]), k))[:posted])
            if sum(notice[k] in v for k in rare) < 2:
                continue
            for o in range(-len(notice), len(v)):
                at = lambda k: v[k] if 0 <= k < len(v) else None  # noqa: B023, E731
                if sum(at(o + k) == notice[k] for k in rare) < 2:
                    continue
                share = sum(idf(w) for k, w in enumerate(notice) if w in v[max(0, o + k - slip) : max(0, o + k + slip + 1)]) / sum(map(idf, notice))
                phrases = [spell(k.split()) for k in keys]
                starts = [next(k for k in range(len(notice)) if notice[k : k + len(p)] == p) for p in phrases]
                keyed = any(o + s + d >= 0 and v[o + s + d : o + s + d + len(p)] == p for p, s in zip(phrases, starts, strict=True) for d in range(-slip, slip + 1))
                if keyed and share >= least - 1e-12:
                    labels.add(label)
                    best = max(best, share)
        labels |= set(filter(None, licences(t)[4].split(",")))
        out[i] = (",".join(sorted(labels)), round(min(1.0, best), 6))
    return out


def tokens(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def crc(b: bytes) -> int:
    return zlib.crc32(b)
