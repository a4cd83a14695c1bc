"""Straight-line versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter

import xxhash

SPACES = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    found, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            if word:
                found.append(word)
            word = ""
        else:
            word += c
    return found


def fingerprint(text: str | None) -> int:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (fingerprint, component_id)."""
    prints = {i: fingerprint(t) for i, t in docs}
    left, out = sorted(prints), {}
    while left:
        seen, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            near = [y for y in left if y not in seen and (prints[x] ^ prints[y]).bit_count() <= 3]
            seen.update(near)
            todo += near
        out |= {i: (prints[i], min(seen)) for i in seen}
        left = [i for i in left if i not in seen]
    return out


def repeats_removed(docs: list[tuple[int, str | None]], window: int = 35) -> dict[int, tuple[int, int, str]]:
    """doc_id: (n_words, n_removed, sha256 of the kept words)."""
    split = {i: words(t) for i, t in docs}
    seen = Counter(tuple(w[k : k + window]) for w in split.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i] = len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    import re

    def luhn(d: str) -> bool:
        total = 0
        for k, c in enumerate(reversed(d)):
            x = int(c) * (1 + k % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    t = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(only(m[0])) <= 15]
    return out
